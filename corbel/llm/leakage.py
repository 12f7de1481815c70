"""Held-out passages inside a training corpus.

The n-grams of the test items, of normalised words, are a bounded set that every
task gets. Documents are scanned once, without a shuffle: the words of a whole
Arrow batch become word numbers of the items' vocabulary, rolling hashes of the
windows are looked up among the items' hashes, and each hit is verified word by
word. Items beyond the bound are taken in blocks, one scan for each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

WORD = re.compile(r"[^\W_]+")
# The marks that Latin, Greek and Cyrillic letters are taken apart into; one range is searched fast.
_ACCENTS = re.compile("[\u0300-\u036f]+")


def plain(text: str) -> str:
    """Compatibility normalised, without accents, in one case."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    text = _ACCENTS.sub("", text)
    others = [c for c in set(text) if c > "\u036f" and unicodedata.category(c)[0] == "M"]
    return text.translate(dict.fromkeys(map(ord, others))) if others else text


def words(text: str) -> list[str]:
    return WORD.findall(plain(text))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word of words(text) stands in the text itself."""
    out, origin = [], []
    for i, ch in enumerate(text):
        p = plain(ch)
        out.append(p)
        origin.extend([i] * len(p))
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer("".join(out))]


class Ngrams:
    """The n-grams of a block of items: their words as numbers one after another, and where each window stands, by its hash."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.vocab = n, {}
        flat: list[int] = []
        ends = []
        for _, text in items:
            flat += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            flat.append(0)
            ends.append(len(flat))
        self.items = np.array([item for item, _ in items], np.int64)
        self.ends = np.array(ends, np.int64)
        self.flat = np.array(flat, np.uint32)
        places = self._full(self.flat)
        h = self.rolled(self.flat)[places]
        order = np.argsort(h, kind="stable")
        self.hashes, self.places = h[order], places[order]

    def _full(self, ids: np.ndarray) -> np.ndarray:
        """The places of windows without a 0."""
        if len(ids) < self.n:
            return np.array([], np.int64)
        other = np.concatenate([[0], np.cumsum(ids == 0)])
        return np.flatnonzero(other[self.n :] == other[: -self.n])

    def rolled(self, ids: np.ndarray) -> np.ndarray:
        """Hash of the window that starts at each place."""
        m = len(ids) - self.n + 1
        h = np.zeros(max(m, 0), np.uint64)
        for k in range(self.n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += ids[k : k + len(h)].astype(np.uint64) + np.uint64(1)
        return h

    def hits(self, ids: np.ndarray) -> list[tuple[int, set[int]]]:
        """Places whose next n words are n consecutive words of items. 0 stands for any other word."""
        places = self._full(ids)
        if not len(places) or not len(self.hashes):
            return []
        h = self.rolled(ids)[places]
        low = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = []
        for k in np.flatnonzero(self.hashes[low] == h):
            p, last = int(places[k]), np.searchsorted(self.hashes, h[k], "right")
            mine = ids[p : p + self.n]
            same = [q for q in self.places[low[k] : last] if np.array_equal(mine, self.flat[q : q + self.n])]
            if same:
                found.append((p, set(self.items[np.searchsorted(self.ends, same, "right")].tolist())))
        return found


_HITS = "doc_id long, item_id long, first_word int, last_word int"
_HITS_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32())])


def _scan(grams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grams.value
        get, n = g.vocab.get, g.n
        for batch in batches:
            ids, flat, starts = batch.column(0).to_pylist(), [], [0]
            for text in batch.column(1).to_pylist():
                if text:
                    flat += [get(w, 0) for w in words(text)]
                flat.append(0)
                starts.append(len(flat))
            found: dict[tuple[int, int], list[list[int]]] = {}
            hits = g.hits(np.array(flat, np.uint32))
            docs = np.searchsorted(starts, [p for p, _ in hits], "right") - 1
            for (p, items), d in zip(hits, docs):
                for item in items:
                    runs = found.setdefault((int(d), item), [])
                    at = p - starts[d]
                    if runs and at <= runs[-1][1] + 1:
                        runs[-1][1] = max(runs[-1][1], at + n - 1)
                    else:
                        runs.append([at, at + n - 1])
            rows = [(ids[d], item, a, b) for (d, item), runs in found.items() for a, b in runs]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _HITS_ARROW)], schema=_HITS_ARROW)

    return run


def leaked_spans(docs: DataFrame, items: DataFrame, n: int = 20, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, first_word, last_word: runs of a document's words taken from an item.

    docs(doc_id, text), items(item_id, text). Every run of n or more consecutive
    words that an item also has comes out once per item that has it. Items are
    spread over blocks of about block_words words by a hash; the driver makes one
    block after the other, some 20 bytes a word, and broadcasts it. Null, empty and shorter texts give no rows, as do empty
    tables; texts are scanned whole.
    """
    spark = docs.sparkSession
    items = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * block_words)))
    scanned = None
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        grams = spark.sparkContext.broadcast(Ngrams([(r.item_id, r.text) for r in mine.toLocalIterator()], n))
        hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(grams), _HITS)
        scanned = hits if scanned is None else scanned.unionByName(hits)
    return scanned


def leaks(docs: DataFrame, items: DataFrame, n: int = 20) -> DataFrame:
    """doc_id, item_id of every document that holds n consecutive words of an item."""
    return leaked_spans(docs, items, n).select("doc_id", "item_id").distinct()


# Spans of the documents to be cut; more than that meet the texts in a shuffled join.
BROADCAST_IDS = 100_000


def without_leaks(docs: DataFrame, items: DataFrame, n: int = 20) -> DataFrame:
    """The affected documents with the leaked passages cut out: doc_id, text, n_words_cut.

    A passage is cut from its first to its last word; what stood before and after
    it is joined by a line break. doc_id must be unique and not null. The affected
    ids are broadcast up to BROADCAST_IDS of them, so that no text is shuffled.
    """
    spans = stage(leaked_spans(docs, items, n), "leaks")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def cut(batches):
        for pdf in batches:
            texts, counts = [], []
            for text, runs in zip(pdf["text"], pdf["runs"]):
                at, gone = word_spans(text), set()
                for r in runs:
                    gone.update(range(r["first_word"], r["last_word"] + 1))
                kept, pos, i = [], 0, 0
                order = sorted(gone)
                while i < len(order):
                    j = i
                    while j + 1 < len(order) and order[j + 1] == order[j] + 1:
                        j += 1
                    kept.append(text[pos : at[order[i]][0]].rstrip())
                    pos = at[order[j]][1]
                    i = j + 1
                kept.append(text[pos:].lstrip())
                texts.append("\n".join(k for k in kept if k))
                counts.append(len(gone))
            pdf = pdf.assign(text=texts, n_words_cut=counts)
            yield pdf[["doc_id", "text", "n_words_cut"]]

    hit = spans.select("doc_id", "first_word", "last_word").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "last_word")).alias("runs"))
    hit = F.broadcast(hit) if spans.count() <= BROADCAST_IDS else hit
    return whole.join(hit, "doc_id").mapInPandas(cut, "doc_id long, text string, n_words_cut int")
