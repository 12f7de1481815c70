from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corbel.functions import classify, color, text
from corbel.session import clear_staged, once, shared_dir, stage, trimmed


def of(spark, function, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows(df.orderBy("i").select(function(F.col("v"))))]


def test_words_and_segments(spark):
    assert of(spark, text.words, "Für the Demo-Button 2!", None, "") == [("f", "r", "the", "demo", "button", "2"), (), ()]
    assert of(spark, text.segments, "letterSpacing-focus_x.URL", None) == [("letter", "spacing", "focus", "x", "u", "r", "l"), ()]
    assert of(spark, text.path_words, "zIndex.URLBar") == [("z", "index", "urlbar")]


def test_spellings(spark):
    assert of(spark, text.camel, "icon-only", "a", "on-", "x-2y") == ["iconOnly", "a", "on-", "x2y"]
    assert of(spark, text.kebab, "iconOnly", "URL") == ["icon-only", "url"]
    assert of(spark, text.spellings, ["iconOnly", "max-width"], [], kind="array<string>") == [("icon-only", "iconOnly", "max-width", "maxWidth"), ()]


def test_literal_unions(spark):
    got = of(spark, text.literal_union, "'sm' | \"md\" | undefined", "boolean", "'a' | Size", "0 | 1", "undefined", "'it''s'", None)
    assert got == [("sm", "md"), None, None, None, None, ("it''s",), None]


def test_raw_values(spark):
    assert of(spark, text.raw_values, "bg-[#ffffff] p-[16px] m-16px #abcd rgb(1, 2,3) #abcde #ffffff", "") == [("#ffffff", "#abcd", "rgb(1, 2,3)", "16px"), ()]


def test_natural_order(spark):
    names = ["space-10", "Space-2", "space-1", "a", "space-2x"]
    keys = of(spark, text.natural_key, *names)
    assert [n for _, n in sorted(zip(keys, names))] == ["a", "space-1", "Space-2", "space-2x", "space-10"]


def test_lines(spark):
    df = spark.createDataFrame([("a\nb\nc", 0), ("a\nb\nc", 2), ("a\nb\nc", 4)], "t string, n int")
    assert [r[0] for r in rows(df.select(text.line_at(F.col("t"), F.col("n"))))] == [1, 2, 3]


def test_colors(spark):
    got = of(spark, color.parse_color, "#fff", "#2563eb", "#2563EB80", "rgb(1, 2, 3)", "rgba(1,2,3,.5)", "hsl(0, 100%, 50%)", "hsl(300, 100%, 50%)", "hsl(210, 50%, 40%)", "#abcd", "red", "rgb(1 2 3)", None)
    assert got == [(255, 255, 255), (37, 99, 235), (37, 99, 235), (1, 2, 3), (1, 2, 3), (255, 0, 0), (255, 0, 255), (51, 102, 153), None, None, None, None]


def test_lengths(spark):
    assert of(spark, color.parse_px, "12px", "1.5rem", "-.5PX", " 8 ", "8 px", "", "auto", None) == [12.0, 24.0, -0.5, 8.0, None, None, None, None]


@pytest.mark.parametrize(
    "name, value, category",
    [("--shadow-focus-inset", "", "shadow"), ("letterSpacing", "", "typography"), ("font.color", "", "color"), ("text", "", "color"), ("line-height-1", "", "typography"), ("border-width", "", "border"), ("radius.md", "", "radius"),
     ("z-index-1", "", "z-index"), ("gap.1", "", "space"), ("width", "", "size"), ("brand", "#ABC", "color"), ("brand", "Transparent", "color"), ("brand", "4px", "other")],
)
def test_category_by_name(spark, name, value, category):
    df = spark.createDataFrame([(name, value)], "n string, v string")
    assert rows(df.select(classify.category_by_name(F.col("n"), F.col("v")))) == [(category,)]


def test_category_by_type(spark):
    cases = [("dimension", "space.x"), ("dimension", "borderRadius.x"), ("dimension", "w"), ("number", "zIndex.modal"), ("number", "alpha"), ("number", "n"), ("cubicBezier", "e"), (None, "e")]
    df = spark.createDataFrame(cases, "k string, p string")
    assert [r[0] for r in rows(df.select(classify.category_by_type(F.col("k"), F.col("p"))))] == ["space", "radius", "size", "z-index", "opacity", "other", "motion", "other"]


def test_trim_and_once(spark):
    assert of(spark, trimmed, " \t a b \n", "", None) == ["a b", "", None]
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "x", 1), (None, "x", 1), (None, "y", 1)], "id int, v string, n int")
    assert sorted(r[1] for r in rows(once(df.select("id", "v"), "id"))) == ["a", "x", "y"]


def test_staged_tables_can_be_cleared(spark):
    kept = stage(spark.createDataFrame([(1,)], "a int"), "kept")
    assert rows(kept) == [(1,)]
    clear_staged(spark)
    assert not spark._jvm.java.io.File(f"{shared_dir(spark)[7:]}/corbel-{spark.sparkContext.applicationId}").exists()
