"""Every training-data query on the smallest tables, against its SQL where there is one."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import SF, rows, same_rows, tables

from corbel.llm import encodings, leakage, plans


def ids(name, column, spark):
    return sorted(r[0] for r in rows(plans.QUERIES[name](spark, SF).select(column).distinct()))


def one(sql):
    return tables(SF).execute(sql).fetchall()


def p3_pieces(spark, got):
    assert sorted({r[0] for r in got}) == ids("p3_found", "chunk_id", spark) and all(0 < len(r[5]) <= 1200 for r in got)


def p5_found(spark, got):
    want = one("SELECT DISTINCT alias_id, 'alias' FROM aliases WHERE alias IS NOT NULL UNION SELECT DISTINCT alias_id, 'target' FROM aliases WHERE target IS NOT NULL AND kind = 'components'")
    assert sorted(r[:2] for r in got) == sorted(want)
    meant = {r[:2]: r[2] for r in got}
    exact = one("SELECT DISTINCT alias_id, 'alias', trim(alias) FROM aliases a JOIN convention_lexicon l ON l.kind = a.kind AND trim(l.expected) = trim(a.alias)")
    assert exact and all(meant[a, f] == name for a, f, name in exact)


def p5_unmatched(spark, got):
    assert sum(r[3] for r in got) == plans.QUERIES["p5_found"](spark, SF).where("canonical = '(none)'").count()


def p7_packed(spark, got):
    used = Counter()
    for shard, container, _, _, _, _, n in got:
        used[shard, container] += n
    assert max(used.values()) <= 2048 and sum(used.values()) / (2048 * len(used)) > 0.95


def p7_fill(spark, got):
    (containers, n, most, _, spread), = got
    assert most <= 2048 and n > 0.95 * 2048 * containers and 1 <= spread < 2


def p8_cleaned(spark, got):
    assert sorted(r[0] for r in got) == ids("p8_found", "doc_id", spark) and all(r[2] >= 20 for r in got)
    again = leakage.leaks(spark.createDataFrame([r[:2] for r in got], "doc_id long, text string"), spark.read.parquet(f"{SF}/eval_items.parquet"))
    assert rows(again) == []


def p9_found(spark, got):
    texts = dict(one("SELECT doc_id, text FROM documents WHERE text IS NOT NULL"))
    surely = {d for d, t in texts.items() if any(s in t for s in ("Ã©", "Ã¼", "â€™", "Ð¾")) and "`" not in t}
    assert surely <= {r[0] for r in got} and not any(texts[r[0]].isascii() and "&#" not in texts[r[0]] for r in got)


def p9_restored(spark, got):
    assert sorted(r[0] for r in got) == ids("p9_found", "doc_id", spark)
    assert all(encodings.garbled_spans(r[1]) == [] or not r[3] for r in got)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLES:
        same_rows(df, plans.ORACLES[name], SF)
    else:
        globals()[name](spark, rows(df))
