"""Whole texts into containers of a fixed number of tokens.

Sizes come from a public tokenizer. The texts are spread over shards by a hash of
their key; within a shard they are taken in descending size, each to the sequence
of the lowest estimated cost (linear plus quadratic in the size of each text) that
still has room, so sequences fill evenly in work as well as in tokens. What ends
up in sequences that are not full is assigned once more by the same rule.
"""

from __future__ import annotations

import base64
import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A single space between two other characters always starts a new piece.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_MEMO = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class TokenCounter:
    """Exact token counts; the counts of recurring words are remembered, up to a bound."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self._encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        n, first = 0, True
        known = self._known
        if len(known) > _MEMO:
            known.clear()
        for word in _BETWEEN.split(text):
            size = known.get(word) if not first else None
            if size is None:
                size = len(self._encode(word if first else " " + word))
                if not first and len(word) < 100:
                    known[word] = size
            first = False
            n += size
        return n


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens of docs(doc_id, text); null texts are left out, empty ones have 0."""
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), "rb") as f:
        told = spark.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(told.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(count, batch.column(1).to_pylist()), pa.int64())], schema=schema)

    whole = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return whole.mapInArrow(run, "doc_id long, n_tokens long")


def cost(n: int, capacity: int) -> float:
    """Estimated work of a text in its sequence: linear layers, and attention within the text."""
    return n + n * n / capacity


def fill(sizes: list[int], capacity: int) -> list[int]:
    """A container for each of the sizes, which descend and are at most the capacity.

    The cheapest container with enough room takes the next item. Containers that
    have too little room for it wait aside until items are small enough again.
    """
    active = [(0.0, i, capacity) for i in range(math.ceil(sum(sizes) / capacity))]
    waiting: dict[int, list] = defaultdict(list)
    opened, room_now, out = len(active), capacity, []
    for n in sizes:
        while room_now > n:
            room_now -= 1
            for entry in waiting.pop(room_now, ()):
                heapq.heappush(active, entry)
        if active:
            spent, i, room = heapq.heappop(active)
        else:
            spent, i, room = 0.0, opened, capacity
            opened += 1
        out.append(i)
        left = (spent + cost(n, capacity), i, room - n)
        if room - n >= n:
            heapq.heappush(active, left)
        else:
            waiting[room - n].append(left)
    return out


def assigned(sizes: list[int], capacity: int, slack: float = 0.005) -> list[int]:
    """fill, and once more for what is in containers with more room left than `slack` of the capacity, while that takes fewer."""
    where = fill(sizes, capacity)
    while True:
        room = [capacity] * (max(where, default=-1) + 1)
        for n, i in zip(sizes, where):
            room[i] -= n
        loose = [i for i, r in enumerate(room) if r > slack * capacity]
        again = [k for k, i in enumerate(where) if room[i] > slack * capacity]
        closer = fill([sizes[k] for k in again], capacity)
        if max(closer, default=-1) + 1 >= len(loose):
            return where
        for k, i in zip(again, closer):
            where[k] = loose[i]
        used = {i: k for k, i in enumerate(sorted(set(where)))}
        where = [used[i] for i in where]


PACKED = "shard int, container int, slot int, doc_id long, piece int, first_token long, n_tokens int"


def pack(counts: DataFrame, capacity: int, per_shard: int = 2_000) -> DataFrame:
    """shard, container, slot, doc_id, piece, first_token, n_tokens of counts(doc_id, n_tokens).

    A text of more tokens than the capacity is cut into full pieces and one rest;
    all others stay whole. A container is known by its shard and number; slot is
    the place within it. Empty texts take no room and share a container. Shards
    hold about per_shard pieces, so no task holds more, and each leaves at most a
    few containers partly empty. doc_id must be unique; an empty table gives no
    rows; null counts are left out.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1)
    pieces = counts.where("n_tokens is not null").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("long") * capacity
    pieces = pieces.select("doc_id", "piece", first.alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - first).cast("int").alias("n_tokens"))
    shards = max(1, math.ceil((counts.agg(F.sum(last + 1)).first()[0] or 0) / per_shard))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))

    def run(key, pdf):
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
        pdf["container"] = assigned(pdf["n_tokens"].tolist(), capacity)
        pdf["slot"] = pdf.groupby("container").cumcount()
        return pdf[["shard", "container", "slot", "doc_id", "piece", "first_token", "n_tokens"]]

    return sharded.groupBy("shard").applyInPandas(run, PACKED)
