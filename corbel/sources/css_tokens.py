"""Design tokens from CSS custom properties, by theme."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import category_by_name

_COMMENT = re.compile(r"/\*.*?\*/", re.S)
# Fixed value: what is a token in a rule.
_DECLARED = re.compile(r"--([A-Za-z0-9_-]+)\s*:\s*([^;]+);")
# How a selector tells its theme, in the order they are tried.
_THEME = [re.compile(p, re.I) for p in (r"""\[data-theme\s*=\s*["']?([\w-]+)["']?\]""", r"\.([\w-]+)-theme\b")]
_PLAIN = [(re.compile(r"^\.dark\b"), "dark"), (re.compile(r"^\.light\b"), "light")]
_ROOT = re.compile(r"^(:root|html|body)\b", re.I)


def theme_of(header: str, media: str | None) -> str | None:
    """Theme of the first selector that tells one; a root selector means the media query's, else light."""
    for selector in map(str.strip, header.split(",")):
        found = next((m[1] for p in _THEME if (m := p.search(selector))), None) or next((name for p, name in _PLAIN if p.match(selector)), None)
        if found or _ROOT.match(selector):
            return found or media or "light"
    return None


def _blocks(css: str) -> Iterator[tuple[str, str]]:
    """Header and body of each outermost block; a header starts after the last statement before it."""
    depth = begin = opened = 0
    for m in re.finditer(r"[{}]", css):
        if m[0] == "{":
            opened = m.start() if depth == 0 else opened
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                yield css[begin:opened].rpartition(";")[2].strip(), css[opened + 1 : m.start()]
                begin = m.end()


def declarations(css: str, media: str | None = None) -> Iterator[tuple[str, str, str]]:
    """theme, name and value of each custom property; media queries and layers are opened, a last one without ; is none."""
    for header, body in _blocks(_COMMENT.sub("", css)):
        kind = header.lower()
        if kind.startswith("@media"):
            dark = re.search(r"prefers-color-scheme\s*:\s*dark", kind)
            yield from declarations(body, "dark" if dark else media)
        elif kind.startswith("@layer"):
            yield from declarations(body, media)
        else:
            theme = (media or "light") if kind.startswith("@theme") else theme_of(header, media)
            if theme:
                yield from ((theme, m[1], m[2].strip()) for m in _DECLARED.finditer(body))


def css_tokens(files: DataFrame) -> DataFrame:
    """system_id, name, value, themes, category, refs of each property in files(system_id, pos, css).

    The first declaration of a name in a theme wins; the value is that of light,
    else the first seen; themes (a map by name, only if there is more than one)
    and refs (from the value) follow. Null css declares nothing.
    """
    schema = pa.schema([("system_id", pa.string()), ("pos", pa.int64()), ("n", pa.int32()), ("theme", pa.string()), ("name", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, p, n, *d) for s, p, css in zip(*(batch.column(i).to_pylist() for i in range(3))) for n, d in enumerate(declarations(css or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    found = files.select("system_id", F.col("pos").cast("long").alias("pos"), "css").mapInArrow(run, "system_id string, pos long, n int, theme string, name string, value string")
    place = F.struct("pos", "n")
    each = found.groupBy("system_id", "name", "theme").agg(F.min_by("value", place).alias("value"), F.min(place).alias("place"))
    whole = each.groupBy("system_id", "name").agg(
        F.coalesce(F.max(F.when(F.col("theme") == "light", F.col("value"))), F.min_by("value", "place")).alias("value"),
        F.array_sort(F.collect_list(F.struct("place", "theme", "value"))).alias("t"),
    )
    themes = F.when(F.size("t") > 1, F.transform("t", lambda x: F.struct(x["theme"].alias("theme"), x["value"].alias("value"))))
    refs = F.array_distinct(F.regexp_extract_all("value", F.lit(r"var\(\s*(--[a-zA-Z0-9_-]+)"), 1))
    return whole.select("system_id", F.concat(F.lit("--"), "name").alias("name"), "value", themes.alias("themes"), category_by_name(F.col("name"), F.col("value")).alias("category"), refs.alias("refs"))
