from __future__ import annotations

import json

from conftest import rows
from pyspark.sql import functions as F

from corbel.operators.nested import Level, flatten_records

LEVELS = (Level("modules", "module", (Level("declarations", "declaration", (Level("attributes", "attribute"), Level("members", "member"))),)),)


def flat(spark, *texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, record_id string")
    return flatten_records(df, "id", F.col("text"), LEVELS)


def names(tables):
    return sorted(rows(tables.rows("attribute", "member").select("record_id", "places", "tag", "name")), key=repr)


def test_bare_objects_null_elements_and_odd_names_keep_their_places(spark):
    doc = {"modules": {"declarations": [None, 7, {"name": "A", "attributes": [None, {"name": 3}, {"name": "b"}, "x"], "members": {"name": "m"}}]}}
    assert names(flat(spark, json.dumps(doc))) == [(0, (0, 2, 0), "member", "m"), (0, (0, 2, 1), "attribute", None), (0, (0, 2, 2), "attribute", "b")]


def test_invalid_and_missing_records(spark):
    tables = flat(spark, '{"modules": [{"decl', None, "[]", "null", "", '{"modules": "none"}', '{"modules": [{"x": NaN}]}')
    assert names(tables) == []
    assert sorted(r[0] for r in rows(tables.rows("_invalid"))) == [0, 4, 6]


def test_parent_links_and_typed_table(spark):
    doc = {"modules": [{"declarations": [{"name": "A", "n": 4, "wide": [1], "attributes": [{"name": "a"}]}, {"name": "B", "n": "no"}]}]}
    tables = flat(spark, json.dumps(doc))
    assert rows(tables.table("declaration", "name string, n int").orderBy("key")) == [
        (0, "0/module.0/declaration.0", "0/module.0", (0, 0), "A", 4),
        (0, "0/module.0/declaration.1", "0/module.0", (0, 1), "B", None),
    ]
    assert rows(tables.rows("attribute").select("parent_key")) == [("0/module.0/declaration.0",)]


def test_lone_surrogates_deep_nesting_and_long_numbers(spark):
    deep = '{"modules": ' + "[" * 100_000 + "]" * 100_000 + "}"
    odd = '{"modules": [{"declarations": [{"attributes": [{"name": "a\\ud800"}, {"name": "b", "n": ' + "9" * 5000 + "}]}]}]}"
    kept = '{"modules": [{"declarations": [{"attributes": [{"name": "c", "default": ' + '{"a": ["]\\\\", ' * 20_000 + "1" + "]}" * 20_000 + "}]}]}]}"
    broken = deep[:-9] + "]" * 5 + "}"
    tables = flat(spark, deep, odd, kept, broken, kept.replace("1]", "1,]"))
    assert [r[3] for r in names(tables)] == ["a�", "b", "c"]
    assert sorted(rows(tables.rows("_invalid").select("record_id"))) == [(3,), (4,)]
    payload = {r[0]: json.loads(r[1]) for r in rows(tables.rows("attribute").where("name != 'a�'").select("name", "payload"))}
    assert payload["b"]["n"] == "9" * 5000 and len(json.dumps(payload["c"])) > 300_000


def test_records_as_structs(spark):
    df = spark.createDataFrame([(1, ([("x", None), None, ("y", 1)],)), (2, (None,)), (3, None)], "id long, r struct<attributes:array<struct<name:string,n:int>>>")
    tables = flatten_records(df, "id", F.col("r"), (Level("attributes", "attribute"),))
    assert names(tables) == [(1, (0,), "attribute", "x"), (1, (2,), "attribute", "y")]
    assert rows(tables.table("attribute", "name string, n int").select("n").orderBy("key")) == [(None,), (1,)]


def test_empty_input_and_null_ids(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert flatten_records(empty, "id", F.col("text"), LEVELS).rows("attribute").count() == 0
    df = spark.createDataFrame([(None, '{"modules": [{"declarations": [{"attributes": [{"name": "a"}]}]}]}')], "id long, text string")
    assert names(flatten_records(df, "id", F.col("text"), LEVELS)) == [(None, (0, 0, 0), "attribute", "a")]
