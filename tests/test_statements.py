"""The SQL of queries on tables with ties and neighbours, against what their rules say."""

import re

import duckdb
import pytest

from tidemark.plans import catalog
from tidemark.plans.registry import build

CHECKS = catalog.checks()


def with_block(sql, name, body):
    """The statement with one of its blocks replaced."""
    out, n = re.subn(rf"\b{name} AS MATERIALIZED \(.*?\),\n(?=\w+ AS MATERIALIZED)", lambda _: f"{name} AS MATERIALIZED ({body}),\n", sql, flags=re.S)
    assert n == 1
    return out


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.1/{t}.parquet'")
    return c


def test_equal_intervals_do_not_split_a_union(con):
    """Unions of one timeframe are disjoint; at sf0.1 some lowest intervals are equal (F1)."""
    got = con.execute(f"SELECT T, side, combination, lower, upper FROM ({CHECKS['interval_intersection']}) WHERE NOT contains(combination, '+') ORDER BY ALL").fetchall()
    assert len(got) > 1000
    assert [(a, b) for a, b in zip(got, got[1:]) if a[:3] == b[:3] and b[3] <= a[4]] == []


def test_equal_lowest_intervals_are_one_union(con):
    """Two equal levels a decision are one interval a side, whatever the order of equals (F2)."""
    con.execute("CREATE OR REPLACE TABLE twins AS SELECT t AS T, 'SUPPORT' AS kind, 1000.0::DOUBLE AS price, 1.0::DOUBLE AS weight FROM range(500) a(t), range(2) b(i) ORDER BY hash(t * 1000 + i)")
    got = con.execute(f"SELECT count(*), count(DISTINCT (T, side)) FROM ({with_block(CHECKS['interval_union'], 'act_e', 'SELECT * FROM twins')})").fetchone()
    assert got == (1000, 1000)


def test_adjacent_quarantined_minutes_are_one_interval(con):
    """Pairs of visits and quarantine intervals, counted in plain Python (F3)."""
    spans = []
    for a, b in con.execute(build("SELECT s, e FROM quar ORDER BY s")).fetchall():
        if spans and spans[-1][1] == a:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    visits = con.execute(build("SELECT start, observed_at, count(*) FROM vis_sep GROUP BY ALL")).fetchall()
    want = sum(n for start, seen, n in visits for a, b in spans if start < b and seen > a)
    assert con.execute(CHECKS["join_interval_overlap"]).fetchone()[0] == want


def test_flow_counts_equal_zones_once(con):
    """Thirty equal zones at every fast decision are one interval (F4)."""
    con.execute(f"CREATE OR REPLACE TABLE twins15 AS SELECT T, 'support' AS side, 1000.0::DOUBLE AS lo, 1001.0::DOUBLE AS hi FROM ({build('SELECT T FROM dec_c15m')}), range(30) b(i) ORDER BY hash(T // 900000 + i)")
    got = con.execute(f"SELECT DISTINCT support_interval_count, joint_interval_count FROM ({with_block(CHECKS['zone_flow_native'], 'ivl_c15m', 'SELECT * FROM twins15')}) WHERE tf = '15m'").fetchall()
    assert got == [(1, 1)]
