import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions import genotype as gtp
from strandloom.functions import geometry as geo
from strandloom.functions import sequence as sq
from strandloom.operators import calling, graph, intervals, pairs, rollups


def one(spark, *cols, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1)])
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_geometry(spark):
    g = lambda f, *a: one(spark, f(*(F.lit(x) for x in a)))[0]
    assert g(geo.overlaps, 1, 5, 5, 9) and not g(geo.overlaps, 1, 4, 5, 9)
    assert g(geo.min_fraction, 0, 10, 5, 25) == 0.25 and g(geo.min_fraction, 3, 3, 0, 9) == 0 and g(geo.min_fraction, 10, 0, 25, 5) == 0.25
    assert g(geo.reciprocal, 3, 3, 0, 9) and g(geo.reciprocal, 0, 10, 5, 25) and not g(geo.reciprocal, 0, 100, 99, 1000)
    s = [F.lit(x) for x in (0, 1000, 50, 1000)]
    assert one(spark, geo.alike_spans(*s, 100, 0.8, True), geo.alike_spans(*s, 100, 0.3, False), geo.alike_spans_fixed(*s), geo.alike_spans_filter(*s))[:] == (True, True, True, True)
    far = [F.lit(x) for x in (0, 10, 5000, 5010)]
    assert not one(spark, geo.alike_spans(*far, 10**6, 0.8, True))[0]
    assert not one(spark, geo.alike_spans(*s, 100, 0.8, True, F.lit(10), F.lit(600)))[0]


def test_cigar(spark):
    r = one(spark, cg.left_clip("c"), cg.right_clip("c"), cg.left_clip("c", True), cg.reference_length("c"), cg.query_length("c"), cg.aligned_bases("c"), c="5H10M40D3I20M7S")
    assert r[:] == (0, 7, 5, 70, 40, 33)
    w = one(spark, cg.walk("c", F.lit(100)), c="10S5M3D4I6M")[0]
    assert [(x.op, x.len, x.ref_start) for x in w] == [("S", 10, 100), ("M", 5, 100), ("D", 3, 105), ("I", 4, 108), ("M", 6, 108)]
    assert one(spark, cg.op_count("c"), cg.left_clip("c"), cg.reference_length("c"), c="*")[:] == (0, 0, 0)
    assert one(spark, *cg.query_interval("c", F.lit(True)), c="5S90M3S")[:] == (3, 93)
    sa = one(spark, cg.split_alignments("c"), c="chr2,5,-,10S5M,60,1;bad;chr3,x,+,5M,9,0;")[0]
    assert [(x.chrom, x.pos, x.strand, x.mapq) for x in sa] == [("chr2", 5, "-", 60), ("chr3", None, "+", 9)]
    assert one(spark, cg.reverse_complement("c"), cg.gc_percent("c"), c="AacGTn")[:] == ("nACgtT", 40.0)


def test_genotypes_and_probabilities(spark):
    q = lambda p: one(spark, gtp.phred_quality(F.lit(p)))[0]
    assert [q(0.0), q(0.5), q(0.9), q(0.99), q(1.0)] == [0, 6, 20, 30, 30]
    assert one(spark, gtp.posterior([F.lit(0.9), F.lit(0.9), F.lit(None).cast("double")]))[0] == pytest.approx(0.81 / 0.82)
    gt = one(spark, *gtp.genotype(F.lit(10), F.lit(10), F.lit("DEL")), *gtp.genotype(F.lit(0), F.lit(20), F.lit("DEL")), *gtp.genotype(F.lit(0), F.lit(0), F.lit("DEL")))
    assert gt[0] == "0/1" and gt[2] == "1/1" and gt[4:] == ("./.", None)
    want = math.comb(10, 8) + math.comb(10, 9) + 1
    assert one(spark, gtp.strand_bias(F.lit(8), F.lit(2)), gtp.strand_bias(F.lit(0), F.lit(0)), gtp.strand_bias(F.lit(2000), F.lit(5)))[:] == (pytest.approx(want / 1024), 1.0, 0.0)
    assert one(spark, *(gtp.least_support(F.lit(c), 0.1) for c in (0, 10, 20.0)))[:] == (2, 2, 4)
    assert one(spark, gtp.low_support(F.lit(3), F.lit(20.0), F.lit(1), F.lit(1), 0.1), gtp.low_support(F.lit(0), F.lit(0.0), F.lit(0), F.lit(0), 0.1))[:] == (True, False)
    h = lambda *kv: one(spark, gtp.haplotype_text(F.create_map(*(F.lit(x) for x in kv))))[0]
    assert h(0, 6) == "_6" and h(1, 4, 0, 2) == "4_2" and h(1, 4, 2, 6) == "4|6"
    assert one(spark, gtp.haplotype_text(F.lit(None).cast("map<int,int>")))[0] == "."
    c = {k: F.lit(v) for k, v in dict(icn=5.0, ocn=9.0, pe=4, spanning=2, supp=1, sc=0, bnd=0, np=0, su=7, remap=0, contigs=1).items()}
    assert one(spark, *gtp.support_pair(c))[:] == (5.0, 5.0)
    assert one(spark, *gtp.support_pair_long(F.lit(9), F.lit(2), F.lit(20), F.lit(10)))[:] == (13, 10)
    assert one(spark, gtp.low_in_read_support(F.lit(1), F.lit(20.0), F.lit(0), F.lit(0), 0.1, F.lit(0), F.lit(0)), gtp.crowded_by_clips(F.lit(3), F.lit(20.0), F.lit(0), F.lit(0), 0.1))[:] == (True, True)
    assert one(spark, gtp.poorly_aligned(F.lit(2.0), F.lit(0.0), F.lit(10), F.lit(0.0), F.lit(1.0)), gtp.poorly_aligned(F.lit(2.0), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(1.0)))[:] == (True, False)


def brute_local(a, b, m, x, go, ge):
    import itertools

    H = np.zeros((len(a) + 1, len(b) + 1))
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        best = max(0, H[i - 1, j - 1] + (m if a[i - 1] == b[j - 1] else x))
        best = max([best] + [H[i - k, j] - go - (k - 1) * ge for k in range(1, i + 1)] + [H[i, j - k] - go - (k - 1) * ge for k in range(1, j + 1)])
        H[i, j] = best
    return int(H.max())


def test_sequence_kernels():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ACGT"), n)) for n in rng.integers(1, 18, 2))
        for s in sq.SCORES.values():
            got = sq.local_alignment(a, b, *s)
            assert got[0] == brute_local(a, b, *s)
        d, end = sq.infix_distance(a, b)
        best = min(lev(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert d == best
    assert sq.local_alignment("ccACGTACGT", "ttACGTACGTtt")[1:] == (2, 10, 2, 10)
    assert sq.short_repeat("AAcacacacacacacaGG") == ("AC", 1, 15, 7, 13) and sq.short_repeat("ACGTTGCA")[0] == ""
    assert sq.packed_percent("A" * 1000) < 5 < sq.packed_percent("ACGTTGCAAC") and sq.packed_percent("") == 0
    assert sq.repeat_score("AC" * 50) > sq.repeat_score("".join(rng.choice(list("ACGT"), 100))) >= 0 == sq.repeat_score("")
    assert sq.clip_is_good([40] * 30, 15) and not sq.clip_is_good([5] * 30, 15) and sq.clip_is_good([], 15) and not sq.clip_is_good([40] * 30, 15, seq="A" * 30)
    s = "".join(rng.choice(list("ACGT"), 120))
    assert sq.contigs_match(s, s[20:]) and not sq.contigs_match(s, "".join(rng.choice(list("ACGT"), 120))) and not sq.contigs_match(s[:10], s[:10])
    assert sq.consensus([s[:80], s[30:], s[10:100]]).upper() == s and sq.consensus(["ACGT"]) is None and sq.consensus([]) is None
    assert sq.gap_upper_bound([(0, 20), (10, 40), (5000, 30)], 1) == 60
    assert sq.bad_ends(np.r_[np.zeros(300), np.ones(5000)], 0.02, 100)[0] >= 300 and sq.bad_ends(np.ones(500), 0.02, 100) == (0, 0)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_registered_functions(spark):
    sq.register(spark)
    r = spark.sql("select local_score('ACGTACGT', 'ACGTACGT') a, infix_distance('ACGT', 'TTACTT') b, repeat_motif('ACACACACACACAC') c, local_score(null, 'A') d").first()
    assert r[:] == (16, 1, "AC", None)


def test_contig_rules():
    s = "ACGTTGCATGCCATTAGACCTGAATCGGATCCATTTGACGGATACCA" * 2
    assert calling.good_contig_alignment(s, s, True) and not calling.good_contig_alignment(s, "T" * 60, True)
    assert calling.remap_clip(s[:40], "G" * 30 + s[:40] + "G" * 60, True, 120)[:2] == ("DEL", 50)
    assert calling.remap_clip("ACGT" * 10, "T" * 200, True, 100)[0] is None


def test_merge_intervals_with_indexes(spark):
    df = spark.createDataFrame([("chr1", 1, 10, 0), ("chr1", 9, 11, 1), ("chr1", 20, 30, 2), ("chr1", None, 3, 3)], "c string, s long, e long, i long")
    got = sorted((r.c, r.s, r.e, r.i) for r in intervals.merge_intervals(df, ["c"], "s", "e", index="i").collect())
    assert got == [("chr1", 1, 11, [0, 1]), ("chr1", 20, 30, [2])]
    assert sorted((r.s, r.e) for r in intervals.merge_intervals(df, ["c"], "s", "e", pad=5).collect()) == [(0, 35)]


def test_range_join_is_the_nested_loop(spark):
    rng = np.random.default_rng(1)
    a = [(int(k), int(s), int(s + n)) for k, s, n in zip(rng.integers(0, 2, 60), rng.integers(-50, 300, 60), rng.integers(0, 60, 60))]
    b = [(int(k), int(s), int(s + n)) for k, s, n in zip(rng.integers(0, 2, 60), rng.integers(-50, 300, 60), rng.integers(0, 60, 60))]
    da, db = spark.createDataFrame(a, "ak long, a1 long, a2 long"), spark.createDataFrame(b, "bk long, b1 long, b2 long")
    want = sorted((*x, *y) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    for width in (7, 64, 1000):
        j = intervals.range_join(da, db, [("ak", "bk")], ("a1", "a2"), ("b1", "b2"), width)
        assert sorted(map(tuple, j.collect())) == want
        semi = intervals.range_join(da, db, [("ak", "bk")], ("a1", "a2"), ("b1", "b2"), width, "left_semi")
        anti = intervals.range_join(da, db, [("ak", "bk")], ("a1", "a2"), ("b1", "b2"), width, "left_anti")
        hit = {w[:3] for w in want}
        assert sorted(map(tuple, semi.collect())) == sorted(x for x in a if x in hit) and sorted(map(tuple, anti.collect())) == sorted(x for x in a if x not in hit)
    assert "NestedLoop" not in j._jdf.queryExecution().executedPlan().toString()


def test_proximity_and_minimizers(spark):
    rng = np.random.default_rng(5)
    n = [(i, "c", int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 400, (80, 2)))]
    df = spark.createDataFrame(n, "node long, k string, x long, y long")
    got = {(r.src, r.dst) for r in pairs.proximity_edges(df, ["k"], "node", "x", "y", 50, most=None).collect()}
    assert got == {(a[0], b[0]) for a in n for b in n if a[0] < b[0] and abs(a[2] - b[2]) < 50 and abs(a[3] - b[3]) < 50}
    m = spark.createDataFrame([("GATTACAGATTACA",), ("GAT",), ("",), (None,)], "s string").select(pairs.minimizers("s", 8, 4, hashed=False).alias("m")).collect()
    mers = ["GATTACAGATTACA"[i : i + 4] for i in range(11)]
    want = {min(mers[max(0, i - 4) : i + 1]) for i in range(11)} | {mers[-1]}
    assert set(m[0].m) == want and m[1].m == [] and m[2].m == []


def test_components_and_cuts(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(900, 901), (7, 7), (901, 900), (None, 3)], "src long, dst long")
    c = {r.node: r.component for r in graph.connected_components(e, nodes=spark.createDataFrame([(5000,), (3,)], "n long")).collect()}
    assert {c[i] for i in range(401)} == {0} and c[901] == 900 and c[5000] == 5000 and len(c) == 404
    assert graph.connected_components(e.where("false")).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(10, 11)], "src long, dst long")
    kept = graph.cut_forbidden(path, spark.createDataFrame([(0, 5)], "src long, dst long"))
    after = {r.node: r.component for r in graph.connected_components(kept, nodes=spark.range(6).toDF("n")).collect()}
    assert after[0] != after[5] and kept.count() == 5
    w = spark.createDataFrame([(1, 2, 2), (2, 3, 1), (3, 4, 2), (5, 6, 1)], "src long, dst long, weight int")
    parts = graph.partitions(w)
    assert {r.node: r.part for r in parts.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
    assert sorted(map(tuple, graph.strong_links(w, parts, 1).collect())) == [(1, 3, 1), (5, 6, 1)]


def test_length_clusters_and_best(spark):
    df = spark.createDataFrame([(i, "a", x) for i, x in enumerate([100, 101, 102, 500, 501, 900])], "id long, g string, n long")
    got = {r.id: r.cluster for r in rollups.cluster_lengths(df, ["g"], "n", "id").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}
    assert rollups.best_per(df, ["g"], [-F.col("n")], ["id"]).first().id == 5


def test_greedy_assignment(spark):
    i = spark.createDataFrame([("c", 1, 10), ("c", 2, 12), ("c", 3, 40)], "k string, item long, at long")
    s = spark.createDataFrame([("c", 100, 11), ("c", 101, 14)], "k string, site long, p long")
    got = sorted(map(tuple, pairs.assign_nearest(i, s, ["k"], "item", "at", "site", "p", 10).collect()))
    assert got == [(1, 100, 1), (2, 101, 2)]


def test_scorer(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), float(y), int(x + 2 * y + rng.normal(0, 0.3) > 0)) for x, y in rng.normal(0, 1, (400, 2))]
    df = spark.createDataFrame(rows, "a double, b double, l int")
    s = calling.Scorer.fit(df, ["a", "b"], "l")
    right = df.select(((s.prob(df) > 0.5).cast("int") == F.col("l")).alias("ok")).where("ok").count()
    assert right > 370 and s.weights["b"] > s.weights["a"] > 0


def test_canonical_order(spark):
    df = spark.createDataFrame([("c2", "c1", 1, 9, "3to5"), ("c1", "c1", 9, 1, "3to3"), ("c1", "c2", 9, 1, "5to3")], "ca string, cb string, a long, b long, ct string")
    got = [tuple(r) for r in pairs.canonical(df, [("ca", "cb"), ("a", "b")], ("ca", "cb"), ("a", "b"), "ct").collect()]
    assert got == [("c1", "c2", 9, 1, "5to3"), ("c1", "c1", 1, 9, "3to3"), ("c1", "c2", 9, 1, "5to3")]


def test_asof_takes_the_last_value_over_blocks(spark):
    rng = np.random.default_rng(6)
    left = [(k, int(a), i) for i, (k, a) in enumerate(zip(rng.choice(["x", "y", "z"], 80), rng.integers(0, 500, 80)))]
    right = [(k, int(a), float(i)) for i, (k, a) in enumerate(zip(rng.choice(["x", "y"], 40), rng.integers(0, 500, 40)))]
    dl, dr = spark.createDataFrame([(str(k), a, i) for k, a, i in left], "k string, at long, id long"), spark.createDataFrame([(str(k), a, v) for k, a, v in right], "k string, at long, v double")
    want = {i: max(((b, v) for kk, b, v in right if kk == k and b <= a), default=(None, None))[1] for k, a, i in left}
    for width in (7, 100, None):
        got = intervals.asof_join(dl, dr, ["k"], "at", ["v"], width).collect()
        assert {r.id: r.last_v for r in got} == want and len(got) == 80


def test_counts_within_reach_over_blocks(spark):
    rng = np.random.default_rng(7)
    rows = [(str(k), int(a), i) for i, (k, a) in enumerate(zip(rng.choice(["x", "y"], 150), rng.integers(-300, 900, 150)))] + [("x", None, 999)]
    df = spark.createDataFrame(rows, "k string, at long, id long")
    got = {r.id: r.n for r in intervals.count_near(df, ["k"], "at", 2, 3, "n").collect()}
    assert got == {i: None if a is None else sum(k == q and b is not None and a - 2 <= b <= a + 3 for q, b, _ in rows) for k, a, i in rows}


def test_alignments_of_many_pairs_agree_with_single_ones():
    rng = random.Random(5)
    base = lambda n: "".join(rng.choice("ACGTacgt") for _ in range(n))
    some = [base(rng.choice([0, 1, 5, 30, 80])) for _ in range(30)] + ["é" + base(9), "A" * 700]
    texts = [(rng.choice(some), rng.choice(some)) for _ in range(150)] + [(x[:60] + y[:5], y + x) for x in some for y in some[:4]]
    for s in sq.SCORES.values():
        assert sq.local_alignments(texts, *s) == [sq.local_alignment(a, b, *s) for a, b in texts]


def test_lists_of_contigs_are_aligned_once_a_pair(spark, monkeypatch):
    rng = random.Random(9)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    some = [base(80) for _ in range(6)]
    some += [x[20:] + base(9) for x in some] + [x[:30] + base(3) + x[34:] for x in some]
    lists = [([rng.choice(some) for _ in range(rng.randint(0, 2))], [rng.choice(some) for _ in range(rng.randint(0, 2))]) for _ in range(80)]
    want = [any(calling.good_contig_alignment(x, y, True) and sq.contigs_match(x, y) for x in xs for y in ys) for xs, ys in lists]
    assert len(set(want)) == 2
    monkeypatch.setattr(sq, "local_alignment", None)  # none is made for one rule alone
    assert calling.contigs_tell_one_event(lists, True) == want
    assert list(calling.any_contig_match().func(pd.Series([x for x, _ in lists]), pd.Series([y for _, y in lists]))) == want


def test_hashed_minimizers_by_their_definition(spark):
    from strandloom.operators import pairs

    rng = random.Random(13)
    texts = ["".join(rng.choice("ACGTNacgt") for _ in range(n)) for n in [0, 1, 5, 6, 7, 11, 12, 13, 40, 90] * 3] + [None, "ACGTé" * 6, "€" * 20, "😀ACG" * 5, "A" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    mers = sorted({t[i : i + 6] for t in texts if t for i in range(len(t) - 5)})
    hashes = {r.m: r.h for r in spark.createDataFrame([(m,) for m in mers], "m string").selectExpr("m", "xxhash64(m) as h").collect()}
    for r in df.select("t", pairs.minimizers("t").alias("x")).collect():
        h = [hashes[r.t[i : i + 6]] for i in range(len(r.t or "") - 5)]
        assert len(r.x) == len(set(r.x)) and set(r.x) == {min(h[max(0, i - 6) : i + 1]) for i in range(len(h))} | set(h[-1:])
    clips = df.where("t is not null").select("i", pairs.minimizers("t").alias("m")).selectExpr("'c' as k", "i", "0 as at", "m")
    assert "Python" not in pairs.minimizer_edges(clips, ["k"], "i", "at", "m")._jdf.queryExecution().optimizedPlan().toString()  # worked out before the joins
