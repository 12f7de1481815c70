"""Tokens by words and in lists, against each request alone, and how much is held of a large system."""

from __future__ import annotations

import random

import pytest
from conftest import rows

from corbel.operators import tokens as ops
from corbel.operators.by_system import ByWords, Listed

ASKED = "query_id long, system_id string, query string, category string"
TOKENS = "token_id long, system_id string, pos int, name string, category string, description string"


def scored(words, t):
    parts, said = t[3].split("."), (t[5] or "").split()
    return sum(30 for p in parts if p in words) + 15 * (t[4] in words) + 10 * any(w in words for w in said)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_words_and_lists_against_each_request(spark, seed):
    rng = random.Random(seed)
    pick = lambda known, most: [rng.choice(known) for _ in range(rng.randint(0, most))]
    hues, says, kinds = [f"h{i}" for i in range(6)], [f"d{i}" for i in range(5)] + ["h0", "space"], ["space", "color", "z-index", None]
    data = [(i, rng.choice(["s", "s", "s", "t", None]), rng.choice([None, *range(9)]), ".".join(["all", *pick(hues, 3), str(rng.randint(0, 150))]), rng.choice(kinds), " ".join(pick(says, 3)) or None) for i in range(300)]
    asked = [(q, rng.choice(["s", "s", "t", "u", None]), " ".join([*pick(hues, 2), *pick(says, 2), *pick(["all", "space", "color", str(q)], 2)]), rng.choice([None, *kinds])) for q in range(80)]
    tokens, requests = spark.createDataFrame(data, TOKENS), spark.createDataFrame(asked, ASKED)
    best, first = [], []
    for q, system, query, category in asked:
        words = set(query.split())
        own = [t for t in data if system and t[1] == system and category in (None, t[4])]
        found = sorted((-s, t[2] is not None, t[2] or 0, t[0]) for t in own if (s := scored(words, t)))
        best += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(found[:6], 1)]
        some = {t[0] for t in own if words & {*t[3].split("."), *(t[5] or "").split()}}
        first.append((q, some))
    assert sorted(rows(ops.tokens_by_words(tokens, requests))) == sorted(best)
    listed = {}
    for q, r, i, name in rows(ops.listed_tokens(tokens, requests, 5)):
        listed.setdefault(q, []).append((r, i, name))
    for q, some in first:
        got = sorted(listed.get(q, []))
        assert len(got) == min(5, len(some)) and {i for _, i, _ in got} <= some and [r for r, *_ in got] == list(range(1, len(got) + 1))


def test_a_word_of_every_token_is_not_met_by_every_request():
    """Kept for 400 requests that share a word with 20,000 tokens: the first of each kind, not a pair of each."""
    by, listed = ByWords(6), Listed(40)
    for q in range(400):
        by.ask(q, None, ["all", f"h{q % 4}"])
        listed.ask(q, None, ["all"])
    for t in range(20_000):
        by.add(t, "space", ["all", f"h{t % 4}", str(t)], ["told"])
        listed.add(t, "space", ["all"], f"n{t}")
    assert len(by.kinds) == 4 and sum(map(len, by.first)) == 24 and not any(by.best) and len(listed.first[None, "all"]) == 40
    assert list(by.answers())[:7] == [(0, r, 4 * (r - 1), 60) for r in range(1, 7)] + [(1, 1, 1, 60)]
    assert [t for q, _, t, _ in listed.answers() if q == 399] == list(range(40))


def test_colors_of_a_dense_system(spark, monkeypatch):
    """Narrow cells give what a look at all colours gives."""
    rng = random.Random(4)
    shade = lambda: tuple(rng.choice([rng.randrange(256), rng.randrange(40)]) for _ in range(3))
    colors, wanted = [shade() for _ in range(400)], [shade() for _ in range(30)] + [(0, 0, 0), (255, 255, 255)]
    css = lambda c: "#%02x%02x%02x" % c
    schema = "token_id long, system_id string, pos int, css_var string, value string, values_by_theme array<struct<theme:string,value:string>>, category string"
    tokens = spark.createDataFrame([(i, "s" if i < 390 else "few", i % 7, None, css(c), None, "color") for i, c in enumerate(colors)], schema)
    asked = spark.createDataFrame([(q, s, css(c), None) for q, (s, c) in enumerate((s, c) for s in ("s", "few") for c in wanted)], ASKED)
    monkeypatch.setattr(ops, "DENSE", 100)
    monkeypatch.setattr(ops, "_color_width", lambda places: places * 0 + 16.0)
    monkeypatch.setattr(ops, "_color_width", lambda places: places * 0 + 16.0)
    seen, stage = [], ops.stage
    monkeypatch.setattr(ops, "stage", lambda df, name: seen.append((name, out := stage(df, name))) or out)
    got = {(q, r): i for q, r, i, *_ in rows(ops.nearest_colors(tokens, asked))}
    for q, (s, c) in enumerate((s, c) for s in ("s", "few") for c in wanted):
        own = range(390) if s == "s" else range(390, 400)
        want = sorted(own, key=lambda i: (sum((a - b) ** 2 for a, b in zip(colors[i], c)), i % 7, i))[:6]
        assert [got[q, r] for r in range(1, 7)] == want
    assert [rows(df) for name, df in seen if name == "dense"] == [[("s", 16.0)]]
