"""Paths by glob: ** / * / ? / {a,b}, matched on the whole relative path."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"\*\*/|\*\*|\*|\?|[^*?]+")
# What the parts of a glob stand for.
_MEANS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(glob: str) -> str:
    """One anchored Java regex for a glob; several {a,b} groups mean all their combinations."""
    pieces = re.split(r"\{([^}]*)\}", glob)
    ways = [p.split(",") if i % 2 else [p] for i, p in enumerate(pieces)]
    plain = lambda text: re.sub(r"([.+^$()|\[\]\\{}])", r"\\\1", text)
    each = ("".join(_MEANS.get(m[0]) or plain(m[0]) for m in _PART.finditer("".join(w))) for w in product(*ways))
    return "^(?:" + "|".join(each) + ")$"


def matches(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Included and not excluded. Literal includes hold anywhere; globs skip dot folders and node_modules."""
    glob = [g for g in include if re.search(r"[*?{]", g)]
    literal = [g for g in include if g not in glob]
    hidden = path.rlike(r"(^|/)(node_modules|\.[^/]+)/")
    hit = path.isin(literal) if literal else F.lit(False)
    for g in glob:
        hit = hit | (path.rlike(glob_regex(g)) & ~hidden)
    for g in exclude:
        hit = hit & ~path.rlike(glob_regex(g))
    return hit


def read_files(spark, root: str, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """path (relative, sorted by it when collected) and text of the matching files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = F.length(F.lit(root.rstrip("/"))) + 2
    full = F.regexp_replace("path", "^file:/*", "/")
    df = files.select(F.substr(full, prefix).alias("path"), F.col("content").cast("string").alias("text"))
    return df.where(matches(F.col("path"), include, exclude))
