"""The normalised tables of a catalog workspace, one row per record."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import segments, words
from ..session import once, stage, table, trimmed


class Workspace:
    """exports, tokens, aliases, chunks and symbols of all systems; redelivered rows count once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str, key: str) -> DataFrame:
        return once(table(self.spark, self.sf_dir, name), key)

    @cached_property
    def exports(self) -> DataFrame:
        """One row per export with a name: module_id, epos, system_id, pos, dir and its own fields."""
        modules = once(table(self.spark, self.sf_dir, "catalog_modules").select("module_id", "system_id", "pos", "dir", "exports"), "module_id")
        rows = modules.select("module_id", "system_id", "pos", "dir", F.posexplode("exports").alias("epos", "e"))
        return rows.where("e.display_name is not null").select("module_id", "epos", "system_id", "pos", "dir", "e.*")

    @cached_property
    def tokens(self) -> DataFrame:
        df = once(table(self.spark, self.sf_dir, "tokens").drop("loaded_at"), "token_id")
        return df.withColumn("name", trimmed(F.col("name"))).withColumn("css_var", trimmed(F.col("css_var")))

    @cached_property
    def aliases(self) -> DataFrame:
        df = once(table(self.spark, self.sf_dir, "aliases").drop("loaded_at"), "alias_id")
        return df.withColumn("alias", trimmed(F.col("alias"))).withColumn("target", trimmed(F.col("target")))

    @cached_property
    def chunks(self) -> DataFrame:
        return once(table(self.spark, self.sf_dir, "doc_chunks").drop("loaded_at"), "chunk_id")

    @cached_property
    def symbols(self) -> DataFrame:
        df = once(table(self.spark, self.sf_dir, "symbols").drop("loaded_at"), "symbol_id")
        return df.withColumn("name", trimmed(F.col("name")))

    @cached_property
    def export_names(self) -> DataFrame:
        """system_id, name, export: the first export that is spelled so, by position."""
        order = F.struct("pos", "module_id", "epos", "dir", "display_name")
        spelled = self.exports.select("system_id", order.alias("export"), F.explode(F.array("display_name", "tag_name")).alias("name")).where("name is not null")
        return stage(spelled.groupBy("system_id", "name").agg(F.min("export").alias("export")), "names")

    def found_loosely(self, asked: DataFrame, name: str) -> DataFrame:
        """asked with `export` and `how` (exact, case) of the export that column `name` means.

        The exact spelling of a display or tag name goes first, then any case; of
        several exports the first by position. Rows without a match are left out.
        """
        names = self.export_names
        lower = names.groupBy(F.col("system_id").alias("_system"), F.lower("name").alias("_name")).agg(F.min("export").alias("_loose"))
        exact = names.select(F.col("system_id").alias("_exact_system"), F.col("name").alias("_exact_name"), F.col("export").alias("_exact"))
        df = asked.withColumn("_asked", trimmed(F.col(name))).withColumn("_lower", F.lower("_asked"))
        df = df.join(exact, (F.col("_asked") == F.col("_exact_name")) & (F.col("system_id") == F.col("_exact_system")), "left")
        df = df.join(lower, (F.col("_lower") == F.col("_name")) & (F.col("system_id") == F.col("_system")), "left")
        df = df.withColumn("export", F.coalesce("_exact", "_loose")).withColumn("how", F.when(F.col("_exact").isNotNull(), "exact").otherwise("case"))
        return df.where("export is not null").drop("_asked", "_lower", "_exact_system", "_exact_name", "_exact", "_system", "_name", "_loose")

    @cached_property
    def export_words(self) -> DataFrame:
        """system_id, export, word, described: each word of an export's description and names once."""
        order = F.struct("pos", "module_id", "epos", "dir", "display_name").alias("export")
        described = words(F.col("description"))
        named = F.concat(segments(F.col("display_name")), segments(F.col("tag_name")))
        rows = self.exports.select("system_id", order, described.alias("_d"), F.array_distinct(F.concat(described, named)).alias("_w"))
        rows = rows.select("system_id", "export", "_d", F.explode("_w").alias("word"))
        return stage(rows.select("system_id", "export", "word", F.array_contains("_d", F.col("word")).alias("described")), "words")
