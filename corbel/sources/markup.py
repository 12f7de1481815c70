"""Elements and imports of code snippets, HTML and simple JSX alike."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that have no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][\w.-]*)")
_NAME = re.compile(r"\s*([A-Za-z_:@][-\w:.]*)")
_VALUE = re.compile(r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`{]+))""")
_IMPORT = re.compile(r"""\bimport\s+(?:type\s+)?([^'";]*?)\s*(?:from\s*)?["']([^"']+)["']""")
_STYLE = re.compile(r"""([A-Za-z_$][\w$]*|"[^"]+"|'[^']+')\s*:\s*(?:"([^"]*)"|'([^']*)'|`([^`$]*)`|(-?\d*\.?\d+)(?=\s*[,}]))""")
_QUOTED = re.compile(r"""^\s*(["'`])([^"'`$]*)\1\s*$""")


def _braces(code: str, at: int) -> int:
    """Place after the brace that closes the one at `at`."""
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] == "{") - (code[i] == "}")
        if depth == 0:
            return i + 1
    return len(code)


def _declarations(literal: str) -> str | None:
    """A style object as declarations: its quoted values, and its numbers as px."""
    if not literal.lstrip().startswith("{"):
        return None
    entries = [(m[1].strip("\"'"), next(v for v in (m[2], m[3], m[4], f"{m[5]}px") if v is not None)) for m in _STYLE.finditer(literal)]
    return "; ".join(f"{name}: {value}" for name, value in entries)


def _attributes(code: str, at: int) -> tuple[list[tuple[str, str | None]], bool, bool, int]:
    """Attributes from a place in a tag: pairs, whether one is spread, whether it closes itself, and the tag's end."""
    attrs, spread = [], False
    while at < len(code):
        if code[at] in "><":
            return attrs, spread, False, at + (code[at] == ">")
        if code.startswith("/>", at):
            return attrs, spread, True, at + 2
        if code[at] == "{":
            spread = spread or code[at + 1 : at + 40].lstrip().startswith("...")
            at = _braces(code, at)
        elif m := _NAME.match(code, at):
            name, at = m[1], m.end()
            if v := _VALUE.match(code, at):
                attrs.append((name, next(x for x in v.groups() if x is not None)))
                at = v.end()
            elif re.match(r"\s*=\s*\{", code[at : at + 20]):
                start = code.index("{", at)
                at = _braces(code, start)
                inner = code[start + 1 : at - 1]
                q = _QUOTED.match(inner)
                attrs.append((name, q[2] if q else _declarations(inner) if name == "style" else None))
            else:
                attrs.append((name, None))
        else:
            at += 1
    return attrs, spread, False, at


def scan(code: str) -> list[tuple[int, str, list[tuple[str, str | None]], bool, bool]]:
    """line, tag, attributes, spread and has_children of each element, in one pass.

    An element has children if text that is not blank stands between its tag and
    the one that closes it; comments, scripts and styles are blanked first.
    """
    code = _RAW.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    out, opened, at, line, counted = [], [], 0, 1, 0
    while m := _TAG.search(code, at):
        if code[at : m.start()].strip():
            for o in opened:
                o[1] = True
        line += code.count("\n", counted, m.start())
        counted = m.start()
        if m[1]:
            at = code.find(">", m.end()) + 1 or len(code)
            for i in range(len(opened) - 1, -1, -1):
                if opened[i][0].lower() == m[2].lower():
                    out[opened[i][2]][4] = opened[i][1]
                    del opened[i]
                    break
            continue
        attrs, spread, closed, at = _attributes(code, m.end())
        out.append([line, m[2], attrs, spread, False])
        if not closed and m[2].lower() not in VOID:
            opened.append([m[2], False, len(out) - 1])
    return [tuple(x) for x in out]


def imports(code: str) -> list[tuple[int, str, str | None, str | None]]:
    """line, module, local name and real name of each import; names are null for bare and namespace imports."""
    out = []
    for m in _IMPORT.finditer(code):
        line, clause = code.count("\n", 0, m.start()) + 1, m[1]
        named = re.search(r"\{([^}]*)\}", clause)
        head = re.match(r"\s*([A-Za-z_$][\w$]*)", clause.split("{")[0])
        found = [(head[1], None)] if head else []
        for part in named[1].split(",") if named else []:
            names = re.split(r"\s+as\s+", part.strip())
            if names[0]:
                found.append((names[-1], names[0]))
        out += [(line, m[2], local, real) for local, real in found] or [(line, m[2], None, None)]
    return out


ELEMENTS = "snippet_id string, line int, tag string, attrs array<struct<name:string,value:string>>, spread boolean, has_children boolean, el int"
_ARROW = pa.schema([
    ("snippet_id", pa.string()), ("line", pa.int32()), ("tag", pa.string()), ("attrs", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
    ("spread", pa.bool_()), ("has_children", pa.bool_()), ("el", pa.int32()),
])


def elements(snippets: DataFrame) -> DataFrame:
    """One row per element of snippets(snippet_id, code); null and broken code gives what can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sid, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(sid, line, tag, [{"name": n, "value": v} for n, v in attrs], spread, kids, i) for i, (line, tag, attrs, spread, kids) in enumerate(scan(code or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _ARROW)], schema=_ARROW)

    return snippets.select(F.col("snippet_id").cast("string"), "code").mapInArrow(run, ELEMENTS)


def imported(snippets: DataFrame) -> DataFrame:
    """snippet_id, line, module, local_name, real_name of the imports of snippets(snippet_id, code)."""
    schema = pa.schema([("snippet_id", pa.string()), ("line", pa.int32()), ("module", pa.string()), ("local_name", pa.string()), ("real_name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(sid, *i) for sid, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in imports(code or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return snippets.where(F.col("code").contains("import")).select(F.col("snippet_id").cast("string"), "code").mapInArrow(run, "snippet_id string, line int, module string, local_name string, real_name string")


def language(code):
    """html if the code has a tag and nothing that looks like a script, else tsx."""
    script = code.rlike(r"\b(import|export|function)\b|=>|\{")
    return F.when(~script & code.rlike("<[a-zA-Z]"), "html").otherwise("tsx")
