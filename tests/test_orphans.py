from __future__ import annotations

from datetime import datetime

from conftest import rows

from corbel.operators.orphans import orphan_references, orphans_by_period

DAY = {n: datetime(2025, 1, n) for n in range(1, 29)}
REFS = "ref_table string, record_id long, scope string, system_id string, ref_name string, at timestamp, extra int"
NAMES = "scope string, system_id string, name string, added_at timestamp, removed_at timestamp, at int"


def found(spark, refs, names):
    r = spark.createDataFrame([("t", i, "s", sys_, name, at, 0) for i, (sys_, name, at) in enumerate(refs)], REFS)
    n = spark.createDataFrame([("s", *x, 0) for x in names], NAMES)
    return {(i, reason) for _, i, _, _, reason in rows(orphan_references(r, n))}, r, n


def test_reasons(spark):
    names = [("a", "x", DAY[5], DAY[10]), ("a", "x", DAY[15], None), ("b", "x", DAY[1], None), (None, "n", DAY[1], None), ("a", "old", None, DAY[3])]
    refs = [("a", "x", DAY[7]), ("a", "x", DAY[10]), ("a", "x", DAY[5]), ("a", "x", DAY[2]), ("a", "y", DAY[7]), ("b", "x", DAY[1]), ("c", "x", DAY[7]), (None, "n", DAY[2]), ("a", None, DAY[2]), ("a", "x", None), ("a", "z", None), ("a", "old", DAY[2])]
    got, *_ = found(spark, refs, names)
    assert got == {(1, "deleted"), (3, "late"), (4, "missing"), (6, "missing"), (10, "missing")}


def test_scopes_are_apart_and_repeats_count_once(spark):
    _, refs, names = found(spark, [("a", "x", DAY[7])] * 2, [("a", "x", DAY[9], None)] * 3)
    again = refs.unionByName(refs)
    assert len(rows(orphan_references(again, names.unionByName(names)))) == 2
    other = names.withColumn("scope", names["scope"].substr(1, 0))
    assert {r[4] for r in rows(orphan_references(refs, other))} == {"missing"}


def test_empty_tables_and_periods(spark):
    _, refs, names = found(spark, [("a", "x", DAY[7]), ("a", "y", DAY[8])], [("a", "x", DAY[1], None)])
    assert rows(orphan_references(refs.limit(0), names)) == []
    assert rows(orphans_by_period(orphan_references(refs, names.limit(0)))) == [("t", "2025-01", "missing", 2, 2)]
