import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import detectors as D


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("highs,price,source", [((110, 108), 108, 1000), ((108, 110), 108, 0), ((110, 110), 110, 0)])
def test_pair_resistance(bars_of, highs, price, source):
    b = bars_of([(100, highs[0], 99, 105), (105, highs[1], 98, 101)])
    assert got(D.detect_a(b), "kind", "price", "source_timestamp", "known_at") == [("RESISTANCE", price, source, 2000)]


@pytest.mark.parametrize("lows,price,source", [((90, 92), 92, 1000), ((92, 90), 92, 0), ((90, 90), 90, 0)])
def test_pair_support(bars_of, lows, price, source):
    b = bars_of([(105, 110, lows[0], 100), (100, 111, lows[1], 106)])
    assert got(D.detect_a(b), "kind", "price", "source_timestamp") == [("SUPPORT", price, source)]


def test_doji_gives_no_pair(bars_of):
    assert D.detect_a(bars_of([(100, 110, 90, 100), (100, 105, 95, 98)])).count() == 0


def test_pair_never_spans_a_missing_bar(bars_of):
    b = bars_of([(100, 110, 99, 105), (1, 1, 1, 1), (105, 108, 98, 101)]).filter("idx <> 1")
    assert D.detect_a(b).count() == 0


def test_extreme_known_after_right_hand_bars(bars_of):
    b = bars_of([(100, 105, 95, 100), (100, 110, 96, 100), (100, 106, 95.5, 100)])
    assert got(D.detect_b(b, 1).filter("kind = 'RESISTANCE'"), "price", "known_at") == [(110.0, 3000)]
    assert D.detect_b(b.filter("idx < 2"), 1).count() == 0


def test_ties_give_no_extreme(bars_of):
    assert D.detect_b(bars_of([(100, 110, 90, 100)] * 5), 1).count() == 0


def test_reversal_confirmed_by_later_close(bars_of):
    b = bars_of([(100, 110, 99, 108), (108, 109, 100, 105)])
    assert got(D.detect_c(b, 0.04), "kind", "price", "known_at") == [("RESISTANCE", 110.0, 2000), ("SUPPORT", 99.0, 2000)]


def test_new_extreme_cannot_confirm_itself(bars_of):
    b = bars_of([(100, 101, 99.9, 100), (100, 120, 99.95, 100)])
    assert D.detect_c(b, 0.04).filter("kind = 'RESISTANCE'").count() == 0


def walk(n, seed):
    rnd = random.Random(seed)
    rows, p = [], 100.0
    for _ in range(n):
        o = p
        p = max(50.0, p * (1 + rnd.uniform(-0.02, 0.02)))
        rows.append((o, max(o, p) * (1 + rnd.uniform(0, 0.01)), min(o, p) * (1 - rnd.uniform(0, 0.01)), p))
    return rows


def test_rolling_reversals_equal_a_restart_in_every_window(bars_of):
    n, window, f = 60, 20, 0.02
    b = bars_of(walk(n, 7))
    rolled = got(D.detect_c_rolling(b, f, window), "decision_timestamp", "kind", "source_timestamp", "known_at")
    want = []
    for start in range(n - window + 1):
        part = b.filter(F.col("idx").between(start, start + window - 1))
        want += [((start + window) * 1000, *x) for x in got(D.detect_c(part, f), "kind", "source_timestamp", "known_at")]
    assert rolled == sorted(want)


@pytest.mark.parametrize("chunk", [3, 5, 4096])
def test_chunks_do_not_change_levels(bars_of, monkeypatch, chunk):
    from tidemark.functions import scans

    b = bars_of(walk(40, 3))
    want = got(D.detect_b(b, 2), "kind", "price", "known_at")
    monkeypatch.setattr(scans.halo, "__defaults__", (0, 0, chunk))
    assert got(D.detect_b(b, 2), "kind", "price", "known_at") == want


def test_every_prefix_gives_the_same_past(bars_of):
    b = bars_of(walk(40, 11))
    for cut in (10, 25, 33):
        for name, p in (("A", None), ("B", 2), ("C", 0.02)):
            full = got(D.detect(b, name, p).filter(F.col("known_at") <= cut * 1000), "kind", "price", "known_at")
            part = got(D.detect(b.filter(F.col("end") <= cut * 1000), name, p), "kind", "price", "known_at")
            assert full == part
