"""Session lifecycle: idle time-outs as windows, and a bounded table with least-recently-used eviction."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage, stage_path


def idle_sessions(events: DataFrame, ttl: str = "30 minutes") -> DataFrame:
    """user_id, began, ended, n of each session; one that is idle for longer than ttl is over.

    Works on tables and on streams with a watermark. Null times and users are
    left out. ended is the time of the last event.
    """
    known = events.where("ts is not null and user_id is not null")
    return known.groupBy("user_id", F.session_window("ts", ttl).alias("w")).agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("w")


def stream_of(spark, path: str) -> DataFrame:
    """A Parquet table as a stream, be it a folder or a single file in one."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("basePath", folder).parquet(f"{folder}/{name[:-8]}[.]parquet")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and read its output back."""
    spark = stream.sparkSession
    out = stage_path(spark, name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", stage_path(spark, f"{name}-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def streamed_sessions(spark, path: str, ttl: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that are over for certain: as idle_sessions, of a stream that waits `late` for late events."""
    events = stream_of(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return run_to_table(idle_sessions(events, ttl), "sessions")


EVICTED = "user_id long, last_seen long, ended long, reason string"


def _timed(events: DataFrame) -> DataFrame:
    return events.where("ts is not null and user_id is not null").select(F.col("user_id").cast("long").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def evictions(events: DataFrame, capacity: int = 200, ttl_seconds: int = 1800, live: DataFrame | None = None) -> DataFrame:
    """user_id, last_seen, ended, reason of the sessions that one table of `capacity` lets go.

    Events are taken in order of time, then user: each ends the sessions that are
    idle for longer than ttl ('idle'), and a new user pushes the least recently
    seen one out of a full table ('capacity'). live(user_id, ts) is in the table
    before. The table holds the most recently seen users of the last ttl, so time
    is cut into slices of one ttl: each slice first takes in, silently, what came
    within a ttl before the last event of the slices before it, and is then one
    pass with a table of at most `capacity` users.
    """
    ttl = ttl_seconds * 1_000_000
    known = _timed(events).withColumn("silent", F.lit(False))
    if live is not None:
        known = known.unionByName(_timed(live).withColumn("silent", F.lit(True)))
    known = stage(known.withColumn("slice", F.floor(F.col("us") / ttl)), "events")
    # One row per slice that has events: a bounded table.
    order = W.orderBy("slice")
    slices = known.groupBy("slice").agg(F.max("us").alias("last"))
    slices = slices.select(F.col("slice").alias("to"), (F.lag("last").over(order) - ttl).alias("since"), F.array(F.lag("slice").over(order), F.lag("slice", 2).over(order)).alias("at"))
    slices = slices.select("to", "since", F.explode("at").alias("slice"))
    before = known.join(F.broadcast(slices.where("slice is not null")), "slice").where("us >= since")
    work = known.unionByName(before.select("user_id", "us", F.lit(True).alias("silent"), F.col("to").alias("slice")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: OrderedDict[int, int] = OrderedDict()
        at = None
        for pdf in batches:
            ended = []
            for slice_, us, user, silent in zip(pdf["slice"], pdf["us"], pdf["user_id"], pdf["silent"]):
                if slice_ != at:
                    at = slice_
                    table.clear()
                while table and us - next(iter(table.values())) > ttl:
                    other, seen = table.popitem(last=False)
                    if not silent:
                        ended.append((other, seen, us, "idle"))
                if user not in table and len(table) >= capacity:
                    other, seen = table.popitem(last=False)
                    if not silent:
                        ended.append((other, seen, us, "capacity"))
                table[user] = us
                table.move_to_end(user)
            yield pd.DataFrame(ended, columns=["user_id", "last_seen", "ended", "reason"])

    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ended = work.repartition(parts, "slice").sortWithinPartitions("slice", "us", "user_id").select("slice", "us", "user_id", "silent").mapInPandas(run, EVICTED)
    return ended.select("user_id", F.timestamp_micros("last_seen").alias("last_seen"), F.timestamp_micros("ended").alias("ended"), "reason")


def still_live(events: DataFrame, capacity: int = 200, ttl_seconds: int = 1800, live: DataFrame | None = None) -> DataFrame:
    """user_id, ts of the sessions in the table after the last event."""
    known = _timed(events) if live is None else _timed(events).unionByName(_timed(live))
    seen = known.groupBy("user_id").agg(F.max("us").alias("us"))
    recent = seen.crossJoin(known.agg(F.max("us").alias("_last"))).where(F.col("us") >= F.col("_last") - ttl_seconds * 1_000_000)
    return recent.orderBy(F.desc("us"), F.desc("user_id")).limit(capacity).select("user_id", F.timestamp_micros("us").alias("ts"))


def streamed_evictions(stream: DataFrame, capacity: int = 200, ttl_seconds: int = 1800) -> DataFrame:
    """evictions of all that a stream holds now; what is in the table goes on from micro-batch to micro-batch."""
    spark = stream.sparkSession
    out = stage_path(spark, "evictions")
    live: list[DataFrame | None] = [None]

    def step(batch: DataFrame, _: int) -> None:
        evictions(batch, capacity, ttl_seconds, live[0]).write.mode("append").parquet(out)
        live[0] = stage(still_live(batch, capacity, ttl_seconds, live[0]), "live")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", stage_path(spark, "evictions-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("user_id long, last_seen timestamp, ended timestamp, reason string").parquet(out)
