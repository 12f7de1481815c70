"""Catalogs and overlays in JSON: normalised rows with defaults, and what is wrong with a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.nested import FlatTables, Level, flatten_records
from .manifests import text_field

CATALOG = (Level("components", "component", (Level("exports", "export", (Level("props", "prop"), Level("events", "event"), Level("slots", "slot"))),)),)


def catalog_tables(files: DataFrame) -> FlatTables:
    """The flat tables of files(record_id, text); a null text gives no rows, bad JSON one of the tag `_invalid`."""
    return flatten_records(files, "record_id", F.col("text"), CATALOG)


def _named(field: str):
    """A field that is shown as text whatever it is; empty if it is absent."""
    return F.coalesce(F.get_json_object("payload", f"$.{field}"), F.lit(""))


def json_exports(tables: FlatTables) -> DataFrame:
    """record_id, key, dir, display_name, tag_name, description of every export; what is absent or no text gets its default."""
    dirs = tables.rows("component").select(F.col("key").alias("parent_key"), F.coalesce(text_field("dir"), F.lit("")).alias("dir"))
    rows = tables.rows("export").select("record_id", "key", "parent_key", _named("displayName").alias("display_name"), text_field("tagName").alias("tag_name"), F.coalesce(text_field("description"), F.lit("")).alias("description"))
    return rows.join(dirs, "parent_key").drop("parent_key")


def json_props(tables: FlatTables) -> DataFrame:
    """record_id, export_key, pos, name, type, required, default_value, description, deprecated of every prop.

    A type that is absent or no text is `unknown`; required is what is neither absent, false, 0 nor empty.
    """
    needed = F.coalesce(~F.get_json_object("payload", "$.required").isin("false", "0", ""), F.lit(False))
    return tables.rows("prop").select(
        "record_id", F.col("parent_key").alias("export_key"), F.get("places", F.lit(2)).alias("pos"), _named("name").alias("name"), F.coalesce(text_field("type"), F.lit("unknown")).alias("type"),
        needed.alias("required"), text_field("defaultValue").alias("default_value"), text_field("description").alias("description"), text_field("deprecated").alias("deprecated"),
    )


def all_exports(files: DataFrame, tables: FlatTables) -> DataFrame:
    """record_id, name: the `allExports` that a file tells, else the distinct names of its exports."""
    told = files.select("record_id", F.from_json(F.get_json_object("text", "$.allExports"), "array<string>").alias("names")).where("names is not null")
    own = json_exports(tables).select("record_id", F.col("display_name").alias("name")).distinct()
    return told.select("record_id", F.explode("names").alias("name")).unionByName(own.join(told.select("record_id"), "record_id", "left_anti"))


def overlay_problems(files: DataFrame) -> DataFrame:
    """path, problem of files(path, text) that are no overlay: an object with `exports`, objects with a text `displayName`; each entry that is none has a row."""
    v = files.where("text is not null").select("path", F.try_parse_json("text").alias("v"))
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit(""))
    exports = F.try_variant_get("v", "$.exports", "variant")
    shape = F.when(F.col("v").isNull(), "not valid JSON").when(~kind(F.col("v")).startswith("OBJECT"), "not an object").when(~kind(exports).startswith("ARRAY"), "no exports array")
    entries = v.where(shape.isNull()).select("path", F.posexplode(F.try_variant_get("v", "$.exports", "array<variant>")).alias("i", "e"))
    bad = entries.where(kind(F.try_variant_get("e", "$.displayName", "variant")) != "STRING").select("path", F.concat(F.lit("exports["), "i", F.lit("] has no displayName")).alias("problem"))
    return v.withColumn("problem", shape).where("problem is not null").select("path", "problem").unionByName(bad)


def overlay_stubs(names: DataFrame, existing: DataFrame) -> DataFrame:
    """system_id, name, note: an entry to be filled in for every name(system_id, name) that existing(system_id, name) lacks; existing ones stay as they are."""
    new = names.where("name is not null").select("system_id", "name").distinct().join(existing.where("name is not null").select("system_id", "name").distinct(), ["system_id", "name"], "left_anti")
    return new.select("system_id", "name", F.concat(F.lit("Read the declaration of "), "name", F.lit(" and fill in its props.")).alias("note"))
