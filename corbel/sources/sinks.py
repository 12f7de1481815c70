"""Writing extracted tables and generated texts without needless changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.freshness import fingerprints


def _stamp(df: DataFrame, but: tuple[str, ...]) -> list:
    parts = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns if c not in but]
    return [tuple(r) for r in fingerprints(df, [], *parts).collect()]


def write_if_changed(df: DataFrame, path: str, but: tuple[str, ...] = ("generated_at",)) -> bool:
    """Write a table over the one at path unless that has the same rows, `but` columns aside; tells whether it wrote."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
        same = set(old.columns) == set(df.columns) and _stamp(old.select(*df.columns), but) == _stamp(df, but)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        same = False
    if not same:
        df.write.mode("overwrite").parquet(path)
    return not same


def upsert_section(text: str, name: str, section: str) -> str:
    """The text with a marked section replaced, or added after a blank line."""
    begin, end = f"<!-- begin {name} -->", f"<!-- end {name} -->"
    marked = f"{begin}\n{section.strip()}\n{end}"
    a, b = text.find(begin), text.find(end)
    if 0 <= a < b:
        return text[:a] + marked + text[b + len(end) :]
    return f"{text.rstrip()}\n\n{marked}\n" if text.strip() else f"{marked}\n"
