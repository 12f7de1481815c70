"""Content fingerprints that merge, and whether what was stamped is still what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_hash(*parts: Column) -> Column:
    """A number of the content: the first 60 bits of the md5 of its parts, joined by line ends."""
    text = F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprints(rows: DataFrame, by: list[str], *parts: Column) -> DataFrame:
    """by, n, fingerprint of a set of rows, in whatever order they come.

    The rows' hashes are summed, so partial sums of any tasks merge and no group
    is ever held together; repeated rows count, the order does not.
    """
    return rows.select(*by, part_hash(*parts).alias("_h")).groupBy(*by).agg(F.count("*").alias("n"), F.sum("_h").cast("string").alias("fingerprint"))


def freshness(stamped: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """by, status: fresh, stale, unknown (nothing to compare with now) or none (never stamped)."""
    old = stamped.select(*by, F.col("fingerprint").alias("_old"))
    new = current.select(*by, F.col("fingerprint").alias("_new"))
    status = F.when(F.col("_old").isNull(), "none").when(F.col("_new").isNull(), "unknown").when(F.col("_old") == F.col("_new"), "fresh").otherwise("stale")
    return old.join(new, by, "full").select(*by, status.alias("status"))
