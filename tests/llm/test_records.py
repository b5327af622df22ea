"""Survivors, near-duplicates, percentiles and mixes."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import connect, rows_of_spark, rows_of_sql

from strandloom.llm import mix, neardup, percentiles, queries, survivor


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, name):
    got = rows_of_spark(queries.QUERIES[name](spark, sf))
    if name in queries.ORACLES:
        assert got == rows_of_sql(connect(sf), queries.ORACLES[name])


# ------------------------------------------------------------ survivors

def fuse(spark, rows, least=2, **kw):
    df = spark.createDataFrame(rows, "grp long, rec long, src string, v string, rank long, p_v string")
    return survivor.survivors(df, "grp", "rec", "src", {"v": F.col("v")}, {"v": [F.col("rank"), F.col("rec")]}, [F.col("rank"), F.col("rec")], least, rounds=2, **kw)


def test_survivor_takes_the_most_trusted_value(spark):
    rows = [(1, 10, "a", None, 0, "x"), (1, 11, "b", "D", 1, "x"), (1, 12, "c", "I", 1, "x"), (2, 20, "a", "D", 5, "x"), (3, 30, None, None, 0, "x"), (3, 31, None, None, 0, "x"), (None, 40, "a", "D", 0, "x"), (None, 41, "a", "D", 0, "x")]
    got = {r.grp: (r.rec, r.v, r.n_records) for r in fuse(spark, rows)[0].collect()}
    assert got == {1: (10, "D", 3), 3: (30, None, 2)}
    assert fuse(spark, rows, 1)[0].count() == 3
    assert fuse(spark, [])[0].count() == 0


def test_model_tells_good_sources_from_bad_and_keeps_several_values(spark):
    rng = random.Random(1)
    rows, rec = [], 0
    for g in range(150):
        true = {f"t{g}", f"u{g}"}
        for s in range(6):
            said = [v for v in true if rng.random() < (0.9 if s < 4 else 0.3)] + ([f"bad{rng.randrange(3)}"] if rng.random() < (0.05 if s < 4 else 0.9) else [])
            for v in said:
                rec += 1
                rows.append((g, rec, f"s{s}", v, rec, "x"))
    _, values, sources = fuse(spark, rows)
    q = {r.src: r for r in sources.collect()}
    assert min(q[f"s{s}"].sens for s in range(4)) > max(q[f"s{s}"].sens for s in (4, 5))
    assert max(q[f"s{s}"].fpr for s in range(4)) < min(q[f"s{s}"].fpr for s in (4, 5))
    v = values.collect()
    right = sum((r.p >= 0.5) == (r.value[0] in "tu") for r in v)
    assert right / len(v) > 0.93
    both = [g for g in range(150) if sum(r.p >= 0.5 for r in v if r.g == g and r.value[0] in "tu") == 2]
    assert len(both) > 100


def test_the_model_may_choose_against_the_trust_order(spark):
    """A source that often denies what all others say loses to them in the model's survivor, though it is trusted first; ties go by trust."""
    rows, rec = [], 0
    for g in range(60):
        for s, v in (("bad", f"x{g}"), ("a", "T"), ("b", "T"), ("c", "T" if g % 3 else None)):
            rec += 1
            rows.append((g, rec, s, v, 0 if s == "bad" else 1, "x"))
    rows += [(100, 1000, "new1", "P", 1, "x"), (100, 1001, "new2", "Q", 0, "x"), (101, 1002, None, None, 0, "x"), (101, 1003, None, None, 0, "x")]
    got = {r.grp: r for r in fuse(spark, rows)[0].collect()}
    assert all(got[g].v == f"x{g}" and got[g].likeliest_v == "T" and got[g].p_likeliest_v > 0.9 > got[g].p_v and got[g].n_true_v == 1 for g in range(60))
    assert got[100].likeliest_v == got[100].v == "Q" and (got[101].likeliest_v, got[101].p_likeliest_v, got[101].n_true_v) == (None, None, 0)


@pytest.mark.parametrize("small", [0, 3])
def test_large_groups_give_the_same_as_packed_ones(spark, small):
    rng = random.Random(8)
    rows = [(g, 100 * g + i, rng.choice(["a", "b", "c", None]), rng.choice([None, "x", "y", "z", f"v{i}"]), rng.randrange(4), "q") for g in range(25) for i in range(rng.randrange(1, 9))]
    one, two = fuse(spark, rows), fuse(spark, rows, small=small)
    near = lambda rs: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sorted(map(tuple, rs), key=repr)]
    for a, b in zip(one, two):
        a, b = sorted(a.columns), sorted(b.columns)
        assert a == b
    assert near(one[0].collect()) == near(two[0].collect())
    assert near(one[1].select("g", "field", "value", "n_src", "p").collect()) == near(two[1].select("g", "field", "value", "n_src", "p").collect())
    assert near(one[2].select("field", "src", "sens", "fpr").collect()) == near(two[2].select("field", "src", "sens", "fpr").collect())


def test_more_sources_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(survivor, "SOURCE_BOUND", 2)
    rows = [(1, i, f"s{i}", "D" if i else "I", i, "q") for i in range(5)]
    assert [(r.rec, r.v, r.n_records) for r in fuse(spark, rows)[0].collect()] == [(0, "I", 5)]


# ------------------------------------------------------------ near-duplicates

def alike(rows, num=4, den=5):
    texts = {}
    for r, t in rows:
        if r is not None and t is not None:
            texts[r] = min(t, texts.get(r, t))
    sets = {r: s for r, t in texts.items() if (s := {x.strip(" \t\r\n") for x in t.split(";")} - {""})}
    k = sorted(sets)
    return {(a, b) for i, a in enumerate(k) for b in k[i + 1 :] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


def edited(rng, items):
    items = list(items)
    for _ in range(rng.randrange(4)):
        w = rng.randrange(3)
        if w == 0 and len(items) > 1:
            items.pop(rng.randrange(len(items)))
        elif w == 1:
            items.insert(rng.randrange(len(items) + 1), f"K{rng.randrange(9)}={rng.randrange(9)}")
        else:
            i = rng.randrange(len(items))
            items[i] = items[i].split("=")[0] + f"={rng.randrange(30)}"
    rng.shuffle(items)
    return items


def some_rows(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        base = [f"K{j}={rng.randrange(20)}" for j in rng.sample(range(30), rng.choice([1, 2, 3, 5, 8, 13, 28]))]
        for _ in range(rng.randrange(1, 5)):
            rows.append((len(rows), rng.choice([";", " ; ", ";;"]).join(edited(rng, base))))
    rows += [(len(rows) + i, "A=1;B=2;C=3") for i in range(30)]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " ; ;"), (None, "A=1"), rows[0], rows[1]]
    return rows


@pytest.mark.parametrize("hot", [64, 2])
def test_pairs_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)  # 2: every shared bucket is parted again
    rows = some_rows(hot)
    df = spark.createDataFrame([(r, t, "x") for r, t in rows], "rec long, info string, items string")
    got = [tuple(r) for r in neardup.alike_pairs(df, "rec", "info").collect()]
    assert len(got) == len(set(got)) and set(got) == alike(rows)


def test_groups_are_the_components(spark):
    rows = some_rows(5)
    pairs = alike(rows)
    got = {r.record: r for r in neardup.alike_groups(spark.createDataFrame(rows, "rec long, info string"), "rec", "info").collect()}
    up = {r: r for r in got}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[top(a)] = top(b)
    assert len({(top(r), got[r].group_id) for r in got}) == len({top(r) for r in got}) == len({x.group_id for x in got.values()})
    assert all(got[r].n_links == sum(r in p for p in pairs) for r in got)


def test_no_rows_and_one_very_long_text(spark):
    df = spark.createDataFrame([], "rec long, info string")
    assert neardup.alike_pairs(df, "rec", "info").count() == 0 and neardup.alike_groups(df, "rec", "info").count() == 0
    big = [f"K{i}={i}" for i in range(3000)]
    rows = [(1, ";".join(big)), (2, ";".join(big[200:])), (3, ";".join(big[700:]))]
    assert {tuple(r) for r in neardup.alike_pairs(spark.createDataFrame(rows, "rec long, info string"), "rec", "info").collect()} == alike(rows)


# ------------------------------------------------------------ percentiles

def test_bounded_error_and_combination(spark):
    rng = np.random.default_rng(4)
    v = np.r_[rng.lognormal(3, 2, 4000), -rng.lognormal(1, 3, 3000), np.zeros(500)]
    rows = [("a", float(x), i % 5) for i, x in enumerate(v)] + [("b", 3.0, 0), ("b", None, 0), ("b", float("nan"), 1), (None, 2.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, day int")
    whole = percentiles.sketch(df, ["g"], "v", 0.01)
    parts = percentiles.combine(percentiles.sketch(df, ["g", "day"], "v", 0.01), ["g"])
    pcts = (1, 25, 50, 75, 99, 100)
    a = {(r.g, r.pct): r for r in percentiles.percentiles(whole, ["g"], pcts, 0.01).collect()}
    b = {(r.g, r.pct): r for r in percentiles.percentiles(parts, ["g"], pcts, 0.01).collect()}
    assert a == b and len(a) == 18
    s = np.sort(v)
    for p in pcts:
        true, r = s[max(1, -(-len(s) * p // 100)) - 1], a["a", p]
        assert abs(r.value - true) <= 0.01 * abs(true) + 1e-12 and r.at_least <= true <= r.at_most
    assert a["b", 50].value == 3.0 and a["b", 50].n_all == 1 and a[None, 1].value == 2.0
    assert percentiles.percentiles(percentiles.sketch(df.where("false"), ["g"], "v"), ["g"], (50,)).count() == 0


# ------------------------------------------------------------ mixes

def test_pivot_keeps_the_mass_and_the_expectation():
    rng = np.random.default_rng(2)
    ids, size = np.arange(501), rng.integers(1, 900, 501)
    total = np.zeros(501)
    for salt in range(400):
        p = mix.pivot(ids, size, np.full(501, 0.3), salt * 100)
        assert ((p == 0) | (p == 1)).sum() >= 500 and abs((p * size).sum() - 0.3 * size.sum()) < 1e-6
        total += p
    assert abs(total.mean() / 400 - 0.3) < 0.03 and (total > 0).all() and (total < 400).all()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "mix_name string, total_ratio double, source string, weight double, max_repeat int")


def test_shares_caps_and_missing_sources(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 60)), "big" if i % 10 else "small", "x") for i in range(1500)]
    rows += [(9000, None, "big", "x"), (9001, "", "big", "x"), (9002, "a b", None, "x"), rows[3], (None, "a", "big", "x")]
    t = targets(spark, [("m", 0.5, "big", 3.0, 1), ("m", 0.5, "small", 1.0, 2), ("m", 0.5, "gone", 1.0, None), ("n", 2.0, "small", 1.0, None), ("z", 1.0, "big", 0.0, 1), ("z", 1.0, "small", None, 1)])
    df = docs(spark, rows)
    chosen, report = mix.mix_sources(df, t, block_rows=100)
    c = chosen.collect()
    size = {i: n for i, n in {(r[0], len((r[1] or "").split())) for r in rows if r[0] is not None}}
    of = {r[0]: r[2] for r in rows}
    whole = sum(size.values())
    assert len({(r.mix_name, r.doc_id) for r in c}) == len(c) and all(r.n_tokens == size[r.doc_id] > 0 and of[r.doc_id] == r.source for r in c)
    assert max(r.copies for r in c if r.source == "big") == 1 and max(r.copies for r in c if r.mix_name == "m" and r.source == "small") <= 2
    rep = {(r.mix_name, r.source): r for r in report.collect()}
    got = {k: sum(r.copies * r.n_tokens for r in c if (r.mix_name, r.source) == k) for k in rep}
    assert all(rep[k].tokens == got[k] for k in rep)
    assert abs(got["m", "big"] - 0.6 * 0.5 * whole) < 60 and abs(got["n", "small"] - 2.0 * whole) < 60
    small = sum(size[i] for i in size if of[i] == "small")
    assert abs(got["m", "small"] - min(0.2 * 0.5 * whole, 2 * small)) < 60
    assert got["m", "gone"] == 0 and rep["m", "gone"].target_share == pytest.approx(0.2) and got["z", "big"] == got["z", "small"] == 0
    assert sum(r.actual_share for k, r in rep.items() if k[0] == "m") == pytest.approx(1.0)
    again = mix.mix_sources(df.repartition(7), t, block_rows=100)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, c))


def test_residuals_go_up_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mix, "FAN_IN", 2)
    rows = [(i, "one two three", "s", "x") for i in range(301)]
    chosen, _ = mix.mix_sources(docs(spark, rows), targets(spark, [("m", 0.37, "s", 1.0, 1)]), block_rows=40)
    assert abs(chosen.agg(F.sum("n_tokens")).first()[0] - 0.37 * 903) < 3.01


def test_empty_tables(spark):
    chosen, report = mix.mix_sources(docs(spark, []), targets(spark, [("m", 1.0, "s", 1.0, 1)]))
    assert chosen.count() == 0 and [r.tokens for r in report.collect()] == [0]
    chosen, report = mix.mix_sources(docs(spark, [(1, "a", "s", "x")]), targets(spark, []))
    assert chosen.count() == 0 and report.count() == 0


@pytest.mark.parametrize("join", [2, 3])
def test_any_number_of_joined_blocks_finds_the_same(spark, monkeypatch, join):
    monkeypatch.setattr(neardup.Blocks, "join", lambda self, d: join)
    rows = some_rows(join + 20, 40)
    got = {tuple(r) for r in neardup.alike_pairs(spark.createDataFrame(rows, "rec long, info string"), "rec", "info").collect()}
    assert got == alike(rows)


def test_more_sets_join_more_blocks():
    bits = [17, 17, 13, 12, 10, 6, 6, 5, 5, 4, 4, 4, 3, 3, 2, 2, 2, 2, 1, 1]
    joins = [neardup.Blocks(bits, sets).join(7) for sets in (10**3, 10**6, 10**9, 10**12)]
    assert joins == sorted(joins) and joins[0] == 1 and joins[-1] == 3
    assert neardup.Blocks(bits, 10**12).join(2047) == 1  # long sets keep to one block per signature


@pytest.mark.parametrize(("num", "den"), [(2, 5), (3, 10), (1, 2), (1, 1)])
def test_any_threshold_loses_no_pair(spark, num, den):
    rng = random.Random(num * 10 + den)
    rows = [(i, ";".join(f"K{j}={rng.randrange(2)}" for j in rng.sample(range(18), rng.choice([1, 2, 4, 6, 9, 11, 16])))) for i in range(70)]
    rows += [(100, ";".join(f"i{j}" for j in range(6))), (101, ";".join(f"i{j}" for j in range(11)))]  # similarity 6/11
    got = [tuple(r) for r in neardup.alike_pairs(spark.createDataFrame(rows, "rec long, info string"), "rec", "info", num=num, den=den).collect()]
    want = alike(rows, num, den)
    assert len(got) == len(set(got)) and set(got) == want and ((100, 101) in want) == (num * 11 <= 6 * den)


def test_a_record_sent_again_with_another_text_leaves_no_ghost(spark):
    base = [f"K{i}=1" for i in range(10)]
    rows = [(1, ";".join(base)), (1, ";".join(["A=1", *base[:5]])), (2, ";".join([*base[:9], "K9=2"])), (3, ";".join([*base[1:], "K0=2"]))]
    df = spark.createDataFrame(rows, "rec long, info string")
    assert neardup.alike_pairs(df, "rec", "info").count() == len(alike(rows)) == 0
    got = neardup.alike_groups(df, "rec", "info").collect()
    assert {(r.record, r.n_links, r.n_copies) for r in got} == {(1, 0, 1), (2, 0, 1), (3, 0, 1)} and len({r.group_id for r in got}) == 3 and all(r.group_id == r.class_key for r in got)


def test_memory_of_signatures_does_not_grow_with_the_longest_set(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 2**62, 30_000).tolist()] + [rng.integers(0, 2**62, 9).tolist() for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array([sorted(x) for x in lists], pa.list_(pa.int64()))], names=["id", "codes"])
    blocks = neardup.Blocks([10.0, 5.0, 2.0], len(lists))
    sizes, zeros = [], np.zeros
    monkeypatch.setattr(np, "zeros", lambda shape, *a, **k: (sizes.append(int(np.prod(shape))), zeros(shape, *a, **k))[1])
    rows = sum(b.num_rows for b in neardup._signatures(4, 5, blocks)(iter([batch])))
    assert rows > 3000 and max(sizes) <= neardup.CELLS
