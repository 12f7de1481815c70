"""Every core query on the smallest tables, against its SQL where there is one."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import SF, rows, same_rows, tables
from test_sessions import one_table

import __spark_entry__ as entry

CORE = sorted(n for n, f in entry.queries().items() if ".llm." not in f.__module__)


def sessions_lru(df):
    """One table of 200 users, event by event."""
    events = tables(SF).execute("SELECT epoch_us(ts) / 1e6, user_id FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL").fetchall()
    assert dict(rows(df)) == dict(Counter(why for *_, why in one_table(events, 200, 1800)))


NO_SQL = {"sessions_lru": sessions_lru}


@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql:
        same_rows(df, sql, SF)
    else:
        NO_SQL[name](df)


def test_entry(spark):
    assert entry.entry(spark).columns == ["system_id", "name", "root_name", "depth"]
