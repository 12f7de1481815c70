"""How often every term occurs, in how many records, and which are too rare or too common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_frequency(records: DataFrame) -> DataFrame:
    """term, n_total, n_records from records(terms array<string>), one row per record.

    A record's own counts are made within its row: its terms are sorted, and the
    first of equal ones stands for the record. Tasks combine theirs by hash, so
    that only one row per task and term is shuffled, however common the term. Null
    terms are no terms; null and empty arrays, as an empty input, give no rows.
    """
    in_order = records.select(F.array_sort(F.filter("terms", lambda t: t.isNotNull())).alias("terms"))
    is_first = lambda t, i: F.when((i == 0) | (F.get("terms", i - 1) != t), 1).otherwise(0)
    each = in_order.select(F.explode(F.transform("terms", lambda t, i: F.struct(t.alias("term"), is_first(t, i).alias("first")))).alias("e")).select("e.*")
    return each.groupBy("term").agg(F.count("*").alias("n_total"), F.sum("first").alias("n_records"))


def term_frequency(counts: DataFrame) -> DataFrame:
    """term, n_total, n_records from counts(record_id, term, n), of which a record may have several rows.

    A record's rows of a term are combined first, which shuffles one row per
    record and term; then the terms' partial sums of each task. Null terms are no
    terms, a null n counts 0, an empty input gives no rows. Rows with a null
    record_id count as one record.
    """
    per_record = counts.where("term is not null").groupBy("record_id", "term").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n"))
    return per_record.groupBy("term").agg(F.sum("n").alias("n_total"), F.count("*").alias("n_records"))


def marked(freq: DataFrame, measure: str, rare_up_to: int, whole: Column, common_one_in: int) -> DataFrame:
    """freq with `mark`: rare up to a bound of the measure, else common above 1/common_one_in of the whole, else useful."""
    common = F.col(measure) * common_one_in > F.coalesce(whole, F.lit(0))
    return freq.withColumn("mark", F.when(F.col(measure) <= rare_up_to, "rare").when(common, "common").otherwise("useful"))
