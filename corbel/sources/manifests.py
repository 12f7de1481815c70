"""Element manifests as exports and props, from the flat tables of one tagged pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import prop_key
from ..operators.nested import FlatTables, Level, flatten_records
from ..session import once, table

MANIFEST = (Level("modules", "module", (Level("declarations", "declaration", (Level("attributes", "attribute"), Level("members", "member"), Level("events", "event"), Level("slots", "slot"))),)),)


def manifest_tables(spark: SparkSession, sf_dir: str) -> FlatTables:
    df = once(table(spark, sf_dir, "custom_elements").select("record_id", "manifest"), "record_id")
    return flatten_records(df, "record_id", F.col("manifest"), MANIFEST)


def text_field(name: str):
    """A payload field if it is a JSON string: quotes show in the raw form of a one-field object."""
    value = F.get_json_object("payload", f"$.{name}")
    is_text = F.schema_of_variant(F.variant_get(F.parse_json("payload"), f"$.{name}", "variant")) == "STRING"
    return F.when(is_text, value)


def _deprecated():
    """`deprecated` for true, the note for a text that is not empty, else null."""
    told = text_field("deprecated")
    return F.when(F.get_json_object("payload", "$.deprecated") == "true", "deprecated").when(told != "", told)


def elements(tables: FlatTables) -> DataFrame:
    """One row per declared element: record_id, key, places, display_name, tag_name, class_name, description, deprecated.

    A declaration is an element if it says so or has a tag; it is called by its
    tag, else its class, else UnknownElement. An empty description falls back to
    the summary.
    """
    df = tables.rows("declaration").select(
        "record_id", "key", "places", text_field("tagName").alias("tag_name"), text_field("name").alias("class_name"),
        F.coalesce(F.when(text_field("description") != "", text_field("description")), text_field("summary"), F.lit("")).alias("description"),
        _deprecated().alias("deprecated"), (F.get_json_object("payload", "$.customElement") == "true").alias("custom"),
    )
    df = df.where("custom or tag_name is not null")
    return df.select("record_id", "key", "places", F.coalesce("tag_name", "class_name", F.lit("UnknownElement")).alias("display_name"), "tag_name", "class_name", "description", "deprecated")


def element_props(tables: FlatTables) -> DataFrame:
    """record_id, parent_key, pos, name, type, deprecated, from_kind of every prop of a declaration.

    All attributes with a name, then the public, non-static fields that no
    attribute stands for already (same letters without case and dashes); of such
    fields the first.
    """
    kind = F.when(F.col("tag") == "attribute", 0).otherwise(1)
    type_ = F.get_json_object("payload", "$.type.text")
    rows = tables.rows("attribute", "member").where("name is not null").select(
        "record_id", "parent_key", "name", kind.alias("rank"), F.get("places", F.lit(2)).alias("place"), prop_key(F.col("name")).alias("prop_key"),
        F.coalesce(type_, F.when(F.col("tag") == "attribute", "string").otherwise("unknown")).alias("type"), _deprecated().alias("deprecated"),
        F.get_json_object("payload", "$.kind").alias("kind"), F.get_json_object("payload", "$.privacy").alias("privacy"), F.get_json_object("payload", "$.static").alias("static"),
    )
    rows = rows.where("rank = 0 or (kind = 'field' and coalesce(static, '') != 'true' and coalesce(privacy, '') not in ('private', 'protected'))")
    first = F.row_number().over(W.partitionBy("parent_key", "prop_key").orderBy("rank", "place"))
    kept = rows.withColumn("_n", first).where("rank = 0 or _n = 1")
    pos = F.row_number().over(W.partitionBy("parent_key").orderBy("rank", "place")) - 1
    return kept.select("record_id", "parent_key", pos.alias("pos"), "name", "type", "deprecated", F.when(F.col("rank") == 0, "attribute").otherwise("member").alias("from_kind"))
