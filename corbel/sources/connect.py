"""Design-file connections of components: `figma.connect(Component, url, {...})` calls in code files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CALL = re.compile(r"""\bfigma\.connect\(\s*(?:["']([^"']+)["']|([A-Za-z_$][\w$.]*))\s*,\s*["']([^"']+)["']\s*([,)])""")
_PROP = re.compile(r"""([A-Za-z_$][\w$]*|["'][^"']+["'])\s*:\s*figma\.(\w+)\(\s*["']([^"']+)["']""")
_VALUES = re.compile(r"\s*,\s*\{([^{}]*)\}")
_VALUE = re.compile(r"""([A-Za-z_$][\w$]*|\d+|"[^"]*"|'[^']*')\s*:\s*("[^"]*"|'[^']*'|[A-Za-z_$][\w$]*|-?\d[\d.]*)\s*(?:,|$)""")
_EXAMPLE = re.compile(r"\bexample\s*:\s*(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>\s*(?:\{[^<]*?\breturn\b)?\s*\(*\s*(?=<)")
_NODE = re.compile(r"[?&]node-id=([^&]+)")
# Kinds of property that a connection can name; any other is `other`.
KINDS = ("string", "boolean", "enum", "instance", "children", "nestedProps", "className", "textContent")


def node_id(url: str) -> str:
    """The node a link points to, with colons; empty if it names none."""
    m = _NODE.search(url)
    return unquote(m[1]).replace("-", ":") if m else ""


def connections(code: str) -> list[tuple[str, str, str, list[dict[str, str]]]]:
    """component, url, node id and props of each call; broken calls are skipped."""
    calls = list(_CALL.finditer(code))
    out = []
    for m, end in zip(calls, [*(c.start() for c in calls[1:]), len(code)]):
        name = m[1] or m[2].rpartition(".")[2]
        props = [{"prop": p[1].strip("\"'"), "kind": p[2] if p[2] in KINDS else "other", "figma": p[3]} for p in _PROP.finditer(code, m.end(), end)]
        out.append((name, m[3], node_id(m[3]), props))
    return out


def connected(files: DataFrame) -> DataFrame:
    """path, pos, component, url, node_id, props of the connections in files(path, text)."""
    schema = pa.schema([
        ("path", pa.string()), ("pos", pa.int32()), ("component", pa.string()), ("url", pa.string()), ("node_id", pa.string()),
        ("props", pa.list_(pa.struct([("prop", pa.string()), ("kind", pa.string()), ("figma", pa.string())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, i, *c) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, c in enumerate(connections(text or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    kinds = "path string, pos int, component string, url string, node_id string, props array<struct<prop:string,kind:string,figma:string>>"
    return files.select("path", "text").mapInArrow(run, kinds)


def enum_values(code: str) -> list[tuple[str, str, str, str]]:
    """component, prop, design value and code value of every entry of every enum of the calls."""
    calls = list(_CALL.finditer(code))
    out = []
    for m, end in zip(calls, [*(c.start() for c in calls[1:]), len(code)]):
        for p in _PROP.finditer(code, m.end(), end):
            values = _VALUES.match(code, p.end(), end) if p[2] == "enum" else None
            for v in _VALUE.finditer(values[1].strip()) if values else ():
                out.append((m[1] or m[2].rpartition(".")[2], p[1].strip("\"'"), v[1].strip("\"'"), v[2].strip("\"'")))
    return out


def example(code: str) -> str | None:
    """The markup of a call's example, with `{name}` where it has `props.name`."""
    m = _EXAMPLE.search(code)
    if not m:
        return None
    depth, at = 0, m.end()
    for tag in re.finditer(r"<(/?)[A-Za-z>][^<>]*?(/?)>|</?>", code[m.end() :]):
        depth += -1 if tag[0].startswith("</") else 0 if tag[2] else 1
        at = m.end() + tag.end()
        if depth <= 0:
            break
    return re.sub(r"\bprops\.([A-Za-z_$][\w$]*)", r"{\1}", code[m.end() : at]).strip() or None


def matched(files: DataFrame, exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, pos, system_id, component, status, node_id, example of the connections in files(path, system_id, text).

    exports and symbols(system_id, name). Status is `unmatched` if the system has
    no such symbol, `mapped` if an export documents it, else `created`.
    """
    schema = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("example", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                calls = [c.start() for c in _CALL.finditer(text or "")]
                rows += [(path, i, example(text[a:b])) for i, (a, b) in enumerate(zip(calls, [*calls[1:], len(text or "")]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)

    shown = files.select("path", "text").mapInArrow(run, "path string, pos int, example string")
    rows = connected(files).join(files.select("path", "system_id"), "path").join(shown, ["path", "pos"], "left")
    known = lambda df, flag: df.where("name is not null").select("system_id", F.col("name").alias("component"), F.lit(True).alias(flag)).distinct()
    rows = rows.join(known(symbols, "_symbol"), ["system_id", "component"], "left").join(known(exports, "_export"), ["system_id", "component"], "left")
    status = F.when(F.col("_symbol").isNull(), "unmatched").when(F.col("_export").isNull(), "created").otherwise("mapped")
    return rows.select("path", "pos", "system_id", "component", status.alias("status"), "node_id", "example")


def connection_aliases(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """system_id, alias, target, concept of the enum entries of real components that are called otherwise in code: each once."""
    schema = pa.schema([(c, pa.string()) for c in ("path", "component", "prop", "alias", "target")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *v) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for v in enum_values(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    rows = files.select("path", "text").mapInArrow(run, "path string, component string, prop string, alias string, target string").where("alias != target")
    rows = rows.join(files.select("path", "system_id"), "path")
    rows = rows.join(symbols.select("system_id", F.col("name").alias("component")).distinct(), ["system_id", "component"], "left_semi")
    return rows.select("system_id", "alias", "target", F.concat_ws(".", "component", "prop").alias("concept")).distinct()
