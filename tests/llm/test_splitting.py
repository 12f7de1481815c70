from __future__ import annotations

import random
import time

import pytest
from conftest import rows

from corbel.llm.splitting import boundaries, split_oversized, split_text


def check(text, limit, overlap):
    cuts = split_text(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(0 < b - a <= limit for a, b in cuts)
    assert all(start == before[1] - overlap for before, (start, _) in zip(cuts, cuts[1:]))
    return cuts


def test_any_text_is_covered():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "word ", ". ", "\n", "\n\n", "```\n", "é", "😀", "x" * 30, "\r\n"]) for _ in range(rng.randrange(1, 120)))
        check(text, 60, 10)
    assert split_text("", 60, 10) == [(0, 0)]
    check("y" * 5000, 60, 10)


def test_cuts_at_the_change_of_topic():
    boats = " ".join(f"The boat {w} the river." for w in ("crossed", "left", "followed", "reached"))
    bread = " ".join(f"Bread {w} in the hot oven." for w in ("bakes", "rises", "browns", "cracks"))
    text = f"{boats} {bread}"
    assert text[split_text(text, len(boats) + 60, 10)[0][1] :].startswith("Bread bakes")


def test_time_grows_with_the_text():
    lines, words = "the same line again\n" * 50_000, " ".join(f"word{i}.\n" for i in range(90_000))
    for text in (lines, words, "." * 1_000_000, "a." * 500_000, "\n" * 1_000_000):
        began = time.process_time()
        check(text, 1200, 120)
        assert time.process_time() - began < 8


def test_long_words_and_marks_stay_whole():
    cuts = check("é" * 400, 101, 10)
    assert all(end % 2 == 0 for _, end in cuts[:-1])


def test_no_boundary_inside_code():
    text = "Text. \n```\na. b. c\n```\nMore. End."
    kinds = boundaries(text)
    assert max(kinds[p] for p in kinds if text.index("a.") < p <= text.index("c")) == 0


def test_chunks(spark):
    long = "One sentence here. " * 100
    df = spark.createDataFrame([(1, f"  {long}\n", ["A", "B"], "x"), (1, f"  {long}\n", ["A", "B"], "x"), (2, "short", None, "x"), (3, None, None, "x"), (4, " " * 3000, None, "x"), (5, "z" * 1201, None, "x")], "chunk_id long, text string, trail array<string>, start string")
    got = rows(split_oversized(df))
    assert {r[0]: (r[2], r[6]) for r in got} == {1: (2, ("A", "B")), 5: (2, None)}
    assert rows(split_oversized(df.limit(0))) == []
    with pytest.raises(ValueError):
        split_oversized(df, 100, 60)
