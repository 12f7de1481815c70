from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from corbel.llm.terms import array_frequency, marked, term_frequency


def test_totals_records_and_marks(spark):
    data = [(1, "a", 2), (1, "a", 1), (2, "a", 1), (3, "b", None), (4, None, 5), (None, "c", 1), (None, "c", 1), (5, "A", 1)]
    df = spark.createDataFrame(data, "record_id long, term string, n int")
    freq = term_frequency(df)
    assert sorted(rows(freq)) == [("A", 1, 1), ("a", 4, 2), ("b", 0, 1), ("c", 2, 1)]
    got = {r[0]: r[3] for r in rows(marked(freq, "n_total", 1, F.lit(12), 4))}
    assert got == {"A": "rare", "a": "common", "b": "rare", "c": "useful"}
    assert rows(term_frequency(df.limit(0))) == []


def test_counts_within_rows(spark):
    df = spark.createDataFrame([(["b", "a", None, "b"],), (["a"],), ([],), (None,), (["A", "A", "A"],)], "terms array<string>")
    assert sorted(rows(array_frequency(df))) == [("A", 3, 1), ("a", 2, 2), ("b", 2, 1)]
    assert rows(array_frequency(df.limit(0))) == []
