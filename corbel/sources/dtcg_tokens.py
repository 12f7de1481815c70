"""Design tokens from nested JSON groups with $value and $type."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import category_by_type


def shown(value) -> str:
    """A value as text: strings as they are, value with unit joined, all else compact JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict) and "value" in value and "unit" in value:
        return f"{shown(value['value'])}{value['unit']}"
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def leaves(node, path: tuple[str, ...] = (), kind: str | None = None) -> Iterator[tuple]:
    """path, type, value, description and deprecation of each token; a type holds for all below it."""
    stack = [(node, path, kind)]
    while stack:
        node, path, kind = stack.pop()
        if not isinstance(node, dict):
            continue
        own = node.get("$type")
        kind = own if isinstance(own, str) else kind
        if "$value" in node or "value" in node:
            about, old = node.get("$description"), node.get("$deprecated")
            note = old if isinstance(old, str) and old else "deprecated" if old is True else None
            yield ".".join(path), kind, shown(node.get("$value", node.get("value"))), about if isinstance(about, str) else None, note
        else:
            stack += [(v, (*path, k), kind) for k, v in reversed(node.items()) if not k.startswith("$")]


def dtcg_tokens(files: DataFrame) -> DataFrame:
    """system_id, name, value, themes, category, refs, description of files(system_id, pos, theme, json).

    theme null means the default; per name and theme the first wins; the value is
    that of light, else of the first file. Deprecations are told in the
    description. Invalid JSON and null declare nothing.
    """
    schema = pa.schema([("system_id", pa.string()), ("pos", pa.int64()), ("theme", pa.string()), ("n", pa.int32()), *((k, pa.string()) for k in ("name", "kind", "value", "description", "note"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for system, pos, theme, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                try:
                    rows += [(system, pos, theme or "default", n, *leaf) for n, leaf in enumerate(leaves(json.loads(text or "null")))]
                except (ValueError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 9, schema)], schema=schema)

    kinds = "system_id string, pos long, theme string, n int, name string, kind string, value string, description string, note string"
    found = files.select("system_id", F.col("pos").cast("long").alias("pos"), "theme", "json").mapInArrow(run, kinds)
    place = F.struct("pos", "n")
    refs = F.regexp_extract_all("value", F.lit(r"\{([a-zA-Z0-9_.-]+)\}"), 1)
    told = F.concat_ws(" ", "description", F.when(F.col("note").isNotNull(), F.concat(F.lit("Deprecated: "), "note")))
    each = found.groupBy("system_id", "name", "theme").agg(F.min_by(F.struct("value", "kind", F.when(told != "", told).alias("told")), place).alias("x"), F.min(place).alias("place"), F.flatten(F.collect_list(refs)).alias("refs"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    whole = each.groupBy("system_id", "name").agg(
        F.coalesce(F.max(F.when(F.col("theme") == "light", F.col("x.value"))), F.min_by("x.value", "place")).alias("value"),
        first("x.kind").alias("kind"),
        first("x.told").alias("description"),
        F.array_sort(F.collect_list(F.struct("place", "theme", F.col("x.value").alias("value")))).alias("t"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"),
    )
    themes = F.when(F.size("t") > 1, F.transform("t", lambda x: F.struct(x["theme"].alias("theme"), x["value"].alias("value"))))
    return whole.select("system_id", "name", "value", themes.alias("themes"), category_by_type(F.col("kind"), F.col("name")).alias("category"), "refs", "description")


def theme_of_file(path, files: int, told=None):
    """Theme that a file's name tells, only among several files; else the theme it names itself."""
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    out = F.when(F.lit(files <= 1), None)
    for theme in ("high-contrast", "hc", "dark", "light"):
        out = out.when(name.contains(theme), theme)
    return out.otherwise(told if told is not None else F.lit(None))
