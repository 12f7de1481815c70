from __future__ import annotations

from collections import Counter

import pytest
from conftest import SF, rows

from corbel.llm.packing import TokenCounter, assigned, default_vocabulary, fill, pack, token_counts

TEXTS = ["", "a", "Hello world, it's  two  spaces\n\n\tand tabs 😀 d'été", " lead", "trail ", "x" * 500, "a b c d", "1 2 3", "\n \n a"]


def test_counts_equal_the_whole_encoding(spark):
    counter = TokenCounter(open(default_vocabulary(), "rb").read())
    texts = TEXTS + [r[0] for r in rows(spark.read.parquet(f"{SF}/documents.parquet").select("text")) if r[0]]
    assert [counter(t) for t in texts] == [len(counter._encode(t)) for t in texts]


def fullness(sizes, where, capacity):
    used = Counter()
    for n, c in zip(sizes, where):
        used[c] += n
    assert max(used.values()) <= capacity and len(used) == max(where) + 1
    return sum(sizes) / (capacity * len(used))


def test_nothing_overflows_and_little_is_wasted():
    even = sorted([(i * 7919) % 400 + 1 for i in range(3000)], reverse=True)
    small = sorted([(i * i * 31) % 90 + 1 for i in range(3000)], reverse=True)
    for sizes in (even, small):
        assert fullness(sizes, fill(sizes, 512), 512) > 0.9 and fullness(sizes, assigned(sizes, 512), 512) > 0.985
    assert assigned([], 10) == [] and len(set(assigned([10, 10, 5, 5, 0], 10))) == 3


def test_only_oversized_texts_are_split(spark):
    df = spark.createDataFrame([(1, 25), (2, 10), (3, 7), (4, 3), (5, 0), (6, None), (7, 20)], "doc_id long, n_tokens long")
    got = rows(pack(df, 10, per_shard=3))
    pieces = {(d, p): (first, n) for _, _, _, d, p, first, n in got}
    assert pieces == {(1, 0): (0, 10), (1, 1): (10, 10), (1, 2): (20, 5), (2, 0): (0, 10), (3, 0): (0, 7), (4, 0): (0, 3), (5, 0): (0, 0), (7, 0): (0, 10), (7, 1): (10, 10)}
    used = Counter()
    for shard, container, _, _, _, _, n in got:
        used[shard, container] += n
    assert max(used.values()) <= 10
    assert rows(pack(df.limit(0), 10)) == []
    with pytest.raises(ValueError):
        pack(df, 0)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (None, "x")], "doc_id long, text string")
    assert sorted(rows(token_counts(df))) == [(1, 2), (2, 0)]
