"""Merges by precedence: alias layers, and hand-written facts laid over a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The layers of aliases, weakest first.
LAYERS = ["lexicon", "code-connect", "team"]


def merge_aliases(aliases: DataFrame) -> DataFrame:
    """One row per system, kind and alias: the entry of its strongest layer, whole.

    aliases(alias_id, system_id, kind, pos, alias, target, concept, source). Keys
    are compared with their case. Within a layer the last entry wins. `layer` and
    `first_pos` tell the place in the merged list: where the alias came first.
    Null aliases and unknown sources are left out.
    """
    rank = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("source"))
    rows = aliases.where("alias is not null").withColumn("layer", (rank - 1).cast("int")).where("layer >= 0")
    return rows.groupBy("system_id", "kind", "alias").agg(
        F.max_by(F.struct("alias_id", "target", "concept", "source"), F.struct("layer", "pos", "alias_id")).alias("e"),
        F.min(F.struct("layer", "pos")).alias("p"),
    ).select("system_id", "kind", "alias", "e.*", "p.layer", F.col("p.pos").alias("first_pos"))


def merge_overlay(exports: DataFrame, symbols: DataFrame, overlay: DataFrame) -> DataFrame:
    """system_id, name, status, description, props of every overlay entry.

    exports(system_id, name, description, props array<struct<name, type>>),
    symbols(system_id, name), overlay as exports. Status is `unknown` if the
    system has no such symbol, `created` if it has but no export says more, else
    `merged`: set fields win, a prop of the same name is replaced where it
    stands, new ones follow. Each name occurs once per system on either side;
    null names and null props are left out.
    """
    none = F.array().cast("array<struct<name:string,type:string>>")
    clean = lambda c: F.coalesce(F.filter(c, lambda p: p.isNotNull() & p["name"].isNotNull()), none)
    own = exports.select(F.col("system_id").alias("_s"), F.col("name").alias("_n"), F.col("description").alias("_d"), clean("props").alias("_p"))
    known = symbols.select(F.col("system_id").alias("_ks"), F.col("name").alias("_kn")).distinct()
    df = overlay.where("name is not null").withColumn("props", clean("props"))
    df = df.join(known, (F.col("system_id") == F.col("_ks")) & (F.col("name") == F.col("_kn")), "left").join(own, (F.col("system_id") == F.col("_s")) & (F.col("name") == F.col("_n")), "left")
    same = lambda p: F.element_at(F.concat(F.array(p), F.filter("props", lambda o: o["name"] == p["name"])), -1)
    names = F.transform(F.coalesce("_p", none), lambda p: p["name"])
    merged = F.concat(F.transform(F.coalesce("_p", none), same), F.filter("props", lambda o: ~F.array_contains(names, o["name"])))
    status = F.when(F.col("_kn").isNull(), "unknown").when(F.col("_n").isNull(), "created").otherwise("merged")
    touched = status != "unknown"
    return df.select("system_id", "name", status.alias("status"), F.when(touched, F.coalesce("description", "_d", F.lit(""))).alias("description"), F.when(touched, merged).alias("props"))


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
