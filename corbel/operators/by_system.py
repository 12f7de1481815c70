"""Requests answered system by system: a system's tokens pass by once, in order, however many requests ask for them."""

from __future__ import annotations

from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Scores of a word of the name, of the category and of the description.
NAMED, FILED, TOLD = 30, 15, 10
# A word that at most so many requests of a system have leads from a token straight to them.
FEW = 2
BATCH = 20_000


class ByWords:
    """The best tokens of each request of one system by score, then by the order in which they come.

    Tokens with a word that few requests have are scored for those at once. What
    only shares frequent words is kept by its kind, which is its category and the
    frequent words of its name, and by the frequent words of its description: for
    any request only the first tokens of a kind, and of a kind and a word told,
    can be among the best.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.requests: dict[tuple, set[str]] = defaultdict(set)
        self.tokens = 0

    def ask(self, query_id, category: str | None, words: list[str]) -> None:
        self.requests[query_id, category].update(words)

    def _begin(self) -> None:
        by_word: dict[str, list[int]] = defaultdict(list)
        self.asked = [(category, words) for (_, category), words in self.requests.items()]
        for q, (_, words) in enumerate(self.asked):
            for w in words:
                by_word[w].append(q)
        self.few = {w: qs for w, qs in by_word.items() if len(qs) <= FEW}
        self.common = by_word.keys() - self.few.keys()
        self.best: list[list] = [[] for _ in self.asked]
        self.kinds: dict[tuple, int] = {}
        self.first: list[list] = []
        self.told: list[dict[str, list]] = []

    def add(self, token_id, category: str | None, name: list[str], said: list[str]) -> None:
        if not self.tokens:
            self._begin()
        self.tokens += 1
        few, common, limit = self.few, self.common, self.limit
        token = (self.tokens, token_id)
        near = {q for w in (*name, category, *said) if w in few for q in few[w]}
        for q in near:
            wanted, words = self.asked[q]
            if wanted is None or wanted == category:
                score = sum(NAMED for w in name if w in words) + (FILED if category in words else 0) + (TOLD if any(w in words for w in said) else 0)
                best = self.best[q]
                if len(best) < limit or -score < best[-1][0]:
                    insort(best, (-score, *token))
                    del best[limit:]
        words = sorted(w for w in name if w in common)
        heard = [w for w in said if w in common]
        if not words and not heard and category not in common:
            return
        kind = self.kinds.setdefault((category, *words), len(self.first))
        if kind == len(self.first):
            self.first.append([])
            self.told.append({})
        if len(first := self.first[kind]) < limit:
            first.append(token)
        told = self.told[kind]
        for w in heard:
            if len(first := told.setdefault(w, [])) < limit:
                first.append(token)

    def _frequent(self) -> Callable[[str | None, frozenset[str]], list]:
        """The best tokens for frequent words, each with what these words score."""
        score_of: dict[str, Counter] = defaultdict(Counter)
        telling: dict[str, list[int]] = defaultdict(list)
        for (category, *words), kind in self.kinds.items():
            for w in words:
                score_of[w][kind] += NAMED
            if category in self.common:
                score_of[category][kind] += FILED
            for w in self.told[kind]:
                telling[w].append(kind)
        scores = {w: (np.array(list(c), np.int64), np.array(list(c.values()), np.int64)) for w, c in score_of.items()}
        size = np.array([len(f) for f in self.first], np.int64)
        categories: dict[str | None, list[int]] = defaultdict(list)
        for (category, *_), kind in self.kinds.items():
            categories[category].append(kind)
        of_category = {c: np.isin(np.arange(len(size)), kinds) for c, kinds in categories.items()}

        def best(wanted: str | None, words: frozenset[str]) -> list:
            score = np.zeros(len(size), np.int64)
            for w in words:
                if w in scores:
                    kinds, n = scores[w]
                    score[kinds] += n
            allowed = None if wanted is None else of_category.get(wanted, np.zeros(len(size), bool))
            if allowed is not None:
                score[~allowed] = 0
            hit = np.flatnonzero(score)
            order = hit[np.argsort(-score[hit], kind="stable")]
            # So many tokens score at least this by name and category; only a description can bring others as far.
            full = int(np.searchsorted(np.cumsum(size[order]), self.limit))
            bound = int(score[order[full]]) if full < len(order) else 0
            near = set(hit[score[hit] + TOLD >= bound].tolist())
            if bound <= TOLD:
                near.update(k for w in words for k in telling.get(w, ()) if allowed is None or allowed[k])
            found: dict[tuple, int] = {}
            for kind in near:
                base, told = int(score[kind]), self.told[kind]
                for w in words:
                    for token in told.get(w, ()):
                        found[token] = base + TOLD
                if base:
                    for token in self.first[kind]:
                        found.setdefault(token, base)
            return sorted((-s, *token) for token, s in found.items())[: self.limit]

        return best

    def answers(self) -> Iterator[tuple]:
        """query_id, rank, token_id, score."""
        if not self.tokens:
            return
        frequent, known = self._frequent(), {}
        for (query_id, category), words, best in zip(self.requests, self.requests.values(), self.best):
            key = category, frozenset(words & self.common)
            if key not in known:
                known[key] = frequent(*key)
            # A token in both lists has its whole score in the one that comes first.
            score: dict[tuple, int] = {}
            for s, *token in sorted(best + known[key]):
                score.setdefault(tuple(token), -s)
            for rank, ((_, token_id), s) in enumerate(list(score.items())[: self.limit], 1):
                yield query_id, rank, token_id, s


class Listed:
    """The first tokens that have any word of a request, in the order in which they come."""

    def __init__(self, limit: int):
        self.limit = limit
        self.requests: dict[tuple, set[str]] = defaultdict(set)
        self.tokens = 0

    def ask(self, query_id, category: str | None, words: list[str]) -> None:
        self.requests[query_id, category].update(words)

    def add(self, token_id, category: str | None, words: list[str], name: str | None) -> None:
        if not self.tokens:
            # The first tokens of each word that is asked for, within any category or one.
            self.first: dict[tuple, list] = {(c, w): [] for (_, c), ws in self.requests.items() for w in ws}
        self.tokens += 1
        for w in words:
            for key in ((None, w), (category, w)) if category is not None else ((None, w),):
                first = self.first.get(key)
                if first is not None and len(first) < self.limit:
                    first.append((self.tokens, token_id, name))

    def answers(self) -> Iterator[tuple]:
        """query_id, rank, token_id, name."""
        if not self.tokens:
            return
        known: dict[tuple, list] = {}
        for (query_id, category), words in self.requests.items():
            key = category, frozenset(words)
            if key not in known:
                known[key] = sorted({t for w in words for t in self.first[category, w]}, key=lambda t: t[0])[: self.limit]
            for rank, (_, token_id, name) in enumerate(known[key], 1):
                yield query_id, rank, token_id, name


def _lists(column: pa.ListArray) -> list[list]:
    flat, ends = column.flatten().to_pylist(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def answered(requests: DataFrame, tokens: DataFrame, order: list[str], make: Callable[[], ByWords | Listed], schema: StructType) -> DataFrame:
    """The answers of make() to each system's requests.

    requests(system_id, query_id, category, words), tokens(system_id, token_id,
    category, words, more, and what order names). A system's requests come first,
    then its tokens in their order; none is held but what the object keeps.
    """
    asked = requests.where("system_id is not null").select("system_id", F.lit(0).alias("_kind"), "query_id", "category", "words")
    known = tokens.where("system_id is not null and token_id is not null").withColumn("_kind", F.lit(1))
    rows = asked.unionByName(known, allowMissingColumns=True).repartition("system_id").sortWithinPartitions("system_id", "_kind", *order)
    rows = rows.select("system_id", "_kind", "query_id", "token_id", "category", "words", "more")
    fields = to_arrow_schema(schema)

    def batched(answers: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)

        for row in answers:
            held.append(row)
            if len(held) >= BATCH:
                yield batch()
                held.clear()
        if held:
            yield batch()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        system, now = None, make()
        for batch in batches:
            columns = (_lists(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns)
            for own, kind, query_id, token_id, category, words, more in zip(*columns):
                if own != system:
                    yield from now.answers()
                    system, now = own, make()
                if not kind:
                    now.ask(query_id, category, words)
                elif now.requests:
                    now.add(token_id, category, words, more)
        yield from now.answers()

    return rows.mapInArrow(lambda batches: batched(each(batches)), schema)
