"""References to names that do not exist, or not at the time of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

KEY = ["scope", "_system", "ref_name"]


def orphan_references(refs: DataFrame, names: DataFrame) -> DataFrame:
    """ref_table, record_id, ref_name, at, reason of every reference without a live name.

    refs(ref_table, record_id, scope, system_id, ref_name, at) against
    names(scope, system_id, name, added_at, removed_at). The distinct foreign
    keys that an anti-join finds without a name are missing; of the others each
    has the spans of its name in one row. That table is written, so that the
    references meet it in one join in which a popular name can be split, and are
    judged where they meet it. A name's distinct spans are its history of being
    added and removed, which is held in one row.

    Nulls: a null ref_name is no reference. A null system is a system of its own.
    A null added_at means since ever, a null `at` is only judged as missing or
    not. Repeated references of one record come out once. Empty tables: without
    references there are no rows, without names all are missing.
    """
    system = F.coalesce(F.concat(F.lit("="), "system_id"), F.lit("")).alias("_system")
    refs = refs.where("ref_name is not null").select("ref_table", "record_id", "scope", system, "ref_name", "at")
    spans = names.where("name is not null").select("scope", system, F.col("name").alias("ref_name"), F.struct("added_at", "removed_at").alias("span"))
    known = spans.groupBy(*KEY).agg(F.collect_set("span").alias("spans"))
    keys = refs.select(*KEY).distinct()
    missing = keys.join(known, KEY, "left_anti").select(*KEY, F.lit(None).cast(known.schema["spans"].dataType).alias("spans"))
    told = stage(known.join(keys, KEY, "left_semi").unionByName(missing), "foreign-keys")

    at = F.col("at")
    begun = lambda s: s["added_at"].isNull() | (s["added_at"] <= at)
    live = lambda s: begun(s) & (s["removed_at"].isNull() | (s["removed_at"] > at))
    reason = F.when(F.col("spans").isNull(), "missing").when(at.isNull() | F.exists("spans", live), None).when(F.exists("spans", begun), "deleted").otherwise("late")
    judged = refs.join(told, KEY).select("ref_table", "record_id", "ref_name", "at", "scope", "_system", reason.alias("reason"))
    return judged.where("reason is not null").distinct().select("ref_table", "record_id", "ref_name", "at", "reason")


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, month of their time, and reason."""
    month = F.date_format("at", "yyyy-MM").alias("period")
    return orphans.groupBy("ref_table", month, "reason").agg(F.count("*").alias("n_refs"), F.count_distinct("ref_name").alias("n_names"))
