from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows

from corbel.streaming.sessions import evictions, streamed_evictions

BEGAN = datetime(2024, 1, 1)


def one_table(events, capacity, ttl):
    live, out = {}, []
    for at, user in sorted(events):
        for other in [u for u, seen in live.items() if at - seen > ttl]:
            out.append((other, live.pop(other), at, "idle"))
        if user not in live and len(live) >= capacity:
            other = min(live, key=lambda u: (live[u], u))
            out.append((other, live.pop(other), at, "capacity"))
        live[user] = at
    return sorted(out)


def shown(found):
    return sorted((u, int((a - BEGAN).total_seconds()), int((b - BEGAN).total_seconds()), why) for u, a, b, why in found)


@pytest.mark.parametrize("capacity", [3, 6, 200])
def test_evictions_against_one_table(spark, tmp_path, capacity):
    rng = random.Random(capacity)
    at, events = 0, []
    for _ in range(600):
        at += rng.choice([0, 1, 3, 10, 10, 60]) if rng.random() < 0.97 else rng.choice([101, 250, 900])
        events.append((at, rng.randrange(12)))
    want = one_table(events, capacity, 100)
    assert {w[3] for w in want} == ({"idle", "capacity"} if capacity < 10 else {"idle"})
    df = spark.createDataFrame([(BEGAN + timedelta(seconds=s), u) for s, u in events] + [(None, 1), (BEGAN, None)], "ts timestamp, user_id long")
    assert shown(rows(evictions(df, capacity, 100))) == want
    half = events[300][0]
    cut = (BEGAN + timedelta(seconds=half)).isoformat(sep=" ")
    df.where(f"ts < timestamp'{cut}'").coalesce(1).write.parquet(str(tmp_path / "e"))
    df.where(f"ts >= timestamp'{cut}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    assert shown(rows(streamed_evictions(stream, capacity, 100))) == want
