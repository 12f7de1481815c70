"""What an element of a token's refs names: a token, `{name}` or `var(css_var)`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import once, trimmed


def ref_kind(ref: Column) -> Column:
    """css for var(...), else name."""
    return F.when(trimmed(ref).rlike(r"(?s)^var\(.*\)$"), "css").otherwise("name")


def ref_key(ref: Column) -> Column:
    """The name or css variable inside a reference, trimmed."""
    text = trimmed(ref)
    inner = trimmed(F.regexp_extract(text, r"(?s)^(?:var\((.*)\)|\{(.*)\})$", 1))
    braced = trimmed(F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1))
    return F.when(ref_kind(ref) == "css", inner).when(text.rlike(r"(?s)^\{.*\}$"), braced).otherwise(text)


def token_nodes(tokens: DataFrame) -> DataFrame:
    """token_id, system_id, name, css_var, refs, added_at, removed_at; one row per token."""
    clean = tokens.select("token_id", "system_id", trimmed(F.col("name")).alias("name"), trimmed(F.col("css_var")).alias("css_var"), "refs", "added_at", "removed_at")
    return once(clean, "token_id")


def token_links(nodes: DataFrame) -> DataFrame:
    """id, parent, grp: each token to the token its first non-null ref names.

    nodes(id, system_id, name, css_var, refs). A name or css variable that
    several tokens share means the one with the smallest id. Tokens without
    refs, or whose first ref names nothing, give no link.
    """
    first = F.get(F.filter("refs", lambda r: r.isNotNull()), F.lit(0))
    asked = nodes.where("refs is not null").select("id", "system_id", ref_kind(first).alias("kind"), ref_key(first).alias("key")).where("key is not null")
    both = F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("key")), F.struct(F.lit("css").alias("kind"), F.col("css_var").alias("key")))
    named = nodes.select(F.col("id").alias("parent"), F.col("system_id").alias("_system"), F.explode(both).alias("x"))
    target = named.where("x.key is not null").select("parent", "_system", F.col("x.kind").alias("_kind"), F.col("x.key").alias("_key"))
    same = F.col("system_id").eqNullSafe(F.col("_system")) & (F.col("kind") == F.col("_kind")) & (F.col("key") == F.col("_key"))
    # Joined before anything is grouped, so that the links to a popular token can be split.
    return asked.join(target, same).groupBy("id").agg(F.min("parent").alias("parent"), F.first("system_id").alias("grp"))
