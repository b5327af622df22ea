import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.operators.periods import IntervalMap, periods_and_gaps


def brute(rows):
    """Cover every position, then read off runs."""
    out = set()
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None:
            by.setdefault(k, set()).update(range(min(s, e), max(s, e) + 1))
    for k, cover in by.items():
        p = sorted(cover)
        start = p[0]
        for a, b in zip(p, [*p[1:], None]):
            if b is None or b > a + 1:
                out.add((k, "period", start, a))
                if b is not None:
                    out.add((k, "gap", a + 1, b - 1))
                    start = b
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = [tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e", **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_map_is_the_cover(pairs):
    m = IntervalMap()
    for s, n in pairs:
        m.insert(s, s + n)
    want = brute([("x", s, s + n) for s, n in pairs]) if pairs else set()
    assert {("x", "period", s, e) for s, e in zip(m.starts, m.ends)} | {("x", "gap", s, e) for s, e in m.gaps()} == want


@pytest.mark.parametrize("bits", [2, 4, 20])
def test_blocks_of_any_size_give_the_same(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice("aab"), s := rng.randrange(400), s + rng.choice([0, 1, 3, 9, 70])) for _ in range(300)]
    rows += rows[:40] + [(k, e, s) for k, s, e in rows[40:80]]
    assert run(spark, rows, block_bits=bits, fold_rows=20) == brute(rows)


def test_long_interval_over_blocks_with_their_own_gaps(spark):
    rows = [("a", 0, 2), ("a", 5, 100), ("a", 20, 22), ("a", 40, 41), ("a", 101, 101), ("a", 110, 111), ("a", 300, 300)]
    assert run(spark, rows, block_bits=3) == brute(rows)


def test_nulls_negatives_huge_ends_and_null_entity(spark):
    rows = [(None, 1, 2), (None, 3, 4), ("a", None, 3), ("a", 3, None), ("b", -9, -3), ("b", -2, -2), ("c", 0, 10**17), ("c", 10**17 + 2, 10**17 + 2)]
    got = run(spark, rows)
    assert got == {(None, "period", 1, 4), ("b", "period", -9, -2), ("c", "period", 0, 10**17), ("c", "gap", 10**17 + 1, 10**17 + 1), ("c", "period", 10**17 + 2, 10**17 + 2)}


def test_empty_and_clashing_names(spark):
    assert run(spark, []) == set()
    df = spark.createDataFrame([(1, 5, 9, "x", 7, 8), (1, 10, 12, "y", 7, 8)], "blk long, start_pos long, end_pos long, kind string, s long, k0 long")
    got = periods_and_gaps(df, ["blk"], "start_pos", "end_pos")
    assert got.columns == ["blk", "kind", "start_pos", "end_pos"] and [tuple(r) for r in got.collect()] == [(1, "period", 5, 12)]


def test_one_entity_with_most_rows(spark):
    rows = [("hot", i * 3 % 5000, i * 3 % 5000 + 1) for i in range(20000)] + [("cold", 1, 2)]
    assert run(spark, rows, block_bits=8, fold_rows=500) == brute(rows)
