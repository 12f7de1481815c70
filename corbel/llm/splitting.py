"""Oversized texts cut into pieces at natural boundaries, with an overlap.

Lexical cohesion finds the topics: at each boundary between two sentences the
words before it are compared with the words after it, and a valley of that
similarity marks a change of topic. Each piece ends at the deepest valley its
size window holds; the next begins the overlap before that end.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import once

_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")
_LINE = re.compile(r"\r\n|\r|\n")
# A sentence's signs are taken with or without white space after them, so that a long run of them is looked at once.
_SENTENCE = re.compile(r"[.!?…]++[\"'”’»)\]*_`]*+(\s+)?")
_CLAUSE = re.compile(r"[,;:–—]\s+")
_SPACE = re.compile(r"\s+")
_FENCE = re.compile(r"^ {0,3}(?:```|~~~)", re.M)
_WORD = re.compile(r"[^\W_]+")
# How natural a cut at a boundary is, by kind; the deepest valley decides within a kind.
PARAGRAPH, SENTENCE, CLAUSE, WORD = 3, 2, 1, 0


def boundaries(text: str) -> dict[int, int]:
    """Places where a piece may end, with the kind of boundary. Inside code only lines end."""
    fences = [m.start() for m in _FENCE.finditer(text)]
    code = [(a, b) for a, b in zip(fences[::2], [*fences[1::2], len(text)])]
    kinds: dict[int, int] = {}
    for pattern, kind in ((_SPACE, WORD), (_CLAUSE, CLAUSE), (_SENTENCE, SENTENCE), (_LINE, SENTENCE), (_PARAGRAPH, PARAGRAPH)):
        for m in pattern.finditer(text):
            if pattern is not _SENTENCE or m[1]:
                kinds[m.end()] = kind
    i = 0
    for place in sorted(kinds):
        while i < len(code) and code[i][1] < place:
            i += 1
        if i < len(code) and code[i][0] < place <= code[i][1] and kinds[place] > WORD:
            kinds[place] = CLAUSE if text[place - 1] in "\r\n" else WORD
    kinds.pop(len(text), None)
    return kinds


def valleys(text: str, places: list[int], block: int = 3) -> list[float]:
    """Depth of the similarity valley at each place between two units of text.

    The similarity of a gap is the cosine of the words in the `block` units on
    either side; its depth, how far it lies below the peaks left and right of it.
    """
    ends = [0, *places, len(text)]
    blank: Counter = Counter()
    units = [Counter(found) if (found := _WORD.findall(text[a:b].lower())) else blank for a, b in zip(ends, ends[1:])]
    n = len(units)
    alike = lambda a, b: sum([a[w] * b[w] for w in a.keys() & b.keys()]) if a and b else 0
    nothing = [0] * (2 * block)
    near = [[alike(units[i], units[j]) for j in range(i, min(n, i + 2 * block))] if units[i] else nothing for i in range(n)]
    worded = [0, *accumulate(map(bool, units))]

    def norm(a: int, b: int) -> int:
        return sum([near[i][0] + 2 * sum(near[i][1 : b - i]) for i in range(a, b)])

    sim = []
    for g in range(1, n):
        a, b = max(0, g - block), min(n, g + block)
        if not worded[a] < worded[g] < worded[b]:
            sim.append(0.0)
            continue
        both = norm(a, g) * norm(g, b)
        sim.append(sum([sum(near[i][g - i : b - i]) for i in range(a, g)]) / math.sqrt(both) if both else 0.0)
    left, right = list(sim), list(sim)  # the peak on either side: where the similarity stops rising
    for g in range(1, len(sim)):
        if sim[g - 1] >= sim[g]:
            left[g] = left[g - 1]
    for g in range(len(sim) - 2, -1, -1):
        if sim[g + 1] >= sim[g]:
            right[g] = right[g + 1]
    return [a + b - 2 * s for a, b, s in zip(left, right, sim)]


def _whole(text: str, at: int, least: int) -> int:
    """The nearest place at or before `at` that does not part a character from its marks."""
    low = max(least, at - 64)
    for p in range(at, low, -1):
        ch = text[p] if p < len(text) else "x"
        if not (unicodedata.combining(ch) or ch in "‍︎️" or 0x1F3FB <= ord(ch) <= 0x1F3FF or text[p - 1] == "‍" or text[p - 1 : p + 1] == "\r\n"):
            return p
    return at


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """start, end of each piece of at most `limit` code points; one piece if the text fits.

    Every piece but the first starts `overlap` before the end of the one before.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    kinds = boundaries(text)
    natural = sorted(p for p, k in kinds.items() if k >= SENTENCE)
    depth = dict(zip(natural, valleys(text, natural)))
    places, out, start, i = sorted(kinds), [], 0, 0
    while len(text) - start > limit:
        low, high = start + limit // 2, start + limit
        least = start + overlap + 1
        while i < len(places) and places[i] < least:
            i += 1
        best, j = None, i
        while j < len(places) and places[j] <= high:
            p = places[j]
            rank = (p >= low, min(kinds[p], SENTENCE), depth.get(p, 0.0) + (0.1 if kinds[p] == PARAGRAPH else 0.0), p)
            if best is None or rank > best:
                best = rank
            j += 1
        end = best[-1] if best else _whole(text, high, least)
        out.append((start, end))
        start = end - overlap
    out.append((start, len(text)))
    return out


PIECES = "chunk_id long, piece_no int, n_pieces int, start int, end int, text string, trail array<string>"


def split_oversized(chunks: DataFrame, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """chunk_id, piece_no, n_pieces, start, end, text, trail of every oversized chunk.

    chunks(chunk_id, text, trail); sizes and places are code points of the text
    without white space at either end. Chunks of at most `limit`, null and blank
    ones give no rows, as does an empty table; a null trail stays null; a chunk
    delivered twice is split once. Any length of text is cut whole.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("overlap must be less than half the limit")
    long_ones = once(chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text", "trail").where(F.length("text") > limit), "chunk_id")
    schema = pa.schema([("chunk_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("trail", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunk, text, trail in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = text.strip()
                if len(text) > limit:
                    cuts = split_text(text, limit, overlap)
                    rows += [(chunk, i, len(cuts), a, b, text[a:b], trail) for i, (a, b) in enumerate(cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, schema)], schema=schema)

    return long_ones.mapInArrow(run, PIECES)
