from __future__ import annotations

import random

from conftest import rows

from corbel.llm.leakage import leaked_spans, leaks, without_leaks, word_spans, words

PASSAGE = "Één café zählt heute die alten Boote und morgen noch zwei neue Räder am Ufer bei Nacht und Nebel im Herbst"


def frames(spark, docs, items):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_words():
    assert words("**Ｆull** Ｗidth é_É ①½ don’t") == ["full", "width", "e", "e", "11", "2", "don", "t"]
    text = "A “b–c” déjà"
    assert [text[a:b] for a, b in word_spans(text)] == ["A", "b", "c", "déjà"]


def test_twenty_words_whatever_their_marks(spark):
    w = PASSAGE.split()
    docs = [
        f"x {PASSAGE.upper()} y", " ".join(f"**{x}**," for x in w[1:21]), " ".join(w[:19]), " ".join(w[:10] + ["neu"] + w[10:]), " ".join(w[:20]), None, "", PASSAGE + "\n\n" + PASSAGE,
    ]
    d, i = frames(spark, docs, [PASSAGE, "short item", None, "", f"Intro. {PASSAGE}"])
    assert sorted(rows(leaks(d, i))) == [(doc, item) for doc in (0, 1, 4, 7) for item in (0, 4)]
    assert rows(leaks(d.limit(0), i)) == [] and rows(leaks(d, i.limit(0))) == []


def test_against_brute_force_in_one_and_many_blocks(spark):
    rng = random.Random(9)
    pool = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [text(12) for _ in range(8)]
    docs = [text(40) + " " + " ".join(rng.choice(items).split()[2:8]) for _ in range(40)]
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    want = sorted((a, b) for a, d in enumerate(docs) for b, i in enumerate(items) if grams(d) & grams(i))
    d, i = frames(spark, docs, items)
    assert sorted(rows(leaks(d, i, 5))) == want
    assert sorted(set(rows(leaked_spans(d, i, 5, block_words=20).select("doc_id", "item_id")))) == want


def test_passages_are_cut_out(spark):
    d, i = frames(spark, [f"Before it. {PASSAGE}! After it.", "clean"], [PASSAGE])
    (doc, text, n), *rest = rows(without_leaks(d, i))
    assert (doc, n, rest) == (0, len(PASSAGE.split()), []) and text.split("\n") == ["Before it.", "! After it."]
