import random
from collections import Counter

from strandloom.operators.skew import heavy_keys, skewed_stats
from strandloom.plans.problems import typed_calls


def exact(values, pct):
    v = sorted(values)
    return v[max(1, -(-len(v) * pct // 100)) - 1]


def test_heavy_and_light_give_exact_figures(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([None, *range(-50, 5000)])) for _ in range(6000)] + [(f"k{i % 400}", rng.randrange(-9, 9)) for i in range(6000)] + [(None, 7), ("none", None)]
    df = spark.createDataFrame(rows, "key string, value long").withColumn("n", __import__("pyspark.sql.functions").sql.functions.lit("x"))
    got = {r.key: r for r in skewed_stats(df, "key", "value", (50, 90), 0.05).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k or "", []).append(v)
    assert set(got) == set(by) and got["hot"].heavy and not got["k1"].heavy
    for k, vs in by.items():
        have = [v for v in vs if v is not None]
        r = got[k]
        assert (r.n, r.n_value, r.min, r.max) == (len(vs), len(have), min(have, default=None), max(have, default=None))
        if have:
            assert abs(r.mean - sum(have) / len(have)) < 1e-9 and (r.p50, r.p90) == (exact(have, 50), exact(have, 90)), k
        else:
            assert r.mean is None and r.p50 is None


def test_fractions_decimals_and_parted_buckets(spark):
    """Values keep their type; buckets of more rows than the bound are parted until the rank is found."""
    rng = random.Random(9)
    rows = [("hot", rng.choice([None, float("nan"), rng.gauss(0, 3), 2.5, -1e300, 1e-300])) for _ in range(1500)] + [(f"k{i % 40}", rng.choice([0.1, 0.2, -7.25, rng.random()])) for i in range(800)]
    df = spark.createDataFrame(rows, "key string, value double")
    for few in (1_000_000, 20):
        got = {r.key: r for r in skewed_stats(df, "key", "value", (1, 50, 99), 0.05, few).collect()}
        for k in got:
            have = [v for q, v in rows if q == k and v is not None and v == v]
            r = got[k]
            assert (r.n, r.n_value, r.min, r.max) == (sum(q == k for q, _ in rows), len(have), min(have), max(have))
            assert (r.p1, r.p50, r.p99) == tuple(exact(have, p) for p in (1, 50, 99)), (few, k)
        assert abs(got["k1"].mean - sum(v for q, v in rows if q == "k1") / got["k1"].n_value) < 1e-12
    big = [("a", 2**62 + rng.randrange(2000)) for _ in range(500)] + [("a", -(2**61) - rng.randrange(900)) for _ in range(300)]
    r = skewed_stats(spark.createDataFrame(big, "key string, value long"), "key", "value", (10, 50), 0.05, 100).first()
    assert (r.p10, r.p50) == tuple(exact([v for _, v in big], p) for p in (10, 50))


def test_no_heavy_key_is_missed(spark):
    rng = random.Random(5)
    keys = [f"u{rng.randrange(10**6)}" for _ in range(20000)] + ["a"] * 400 + ["b"] * 250
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(7)
    n = Counter(keys)
    assert {k for k, c in n.items() if c >= 0.01 * len(keys)} <= set(heavy_keys(df, "k", 0.01))


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "key string, value long")
    assert skewed_stats(df, "key", "value").count() == 0
    one = skewed_stats(spark.createDataFrame([("a", 3)], "key string, value long"), "key", "value").first()
    assert (one.n, one.p50, one.p90) == (1, 3, 3)


def test_a_call_counts_once(spark):
    rows = [(1, " <del> ", None, " CHR1", 5), (1, " <del> ", None, " CHR1", 5), (2, "DUP:TANDEM", ".", "x", 0), (3, "cnv", " chrM", "chr2", -1), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "call_id long, svtype string, chr2 string, chrom string, svlen long")
    got = sorted((r.call_id, r.svtype, r.chr2, r.length) for r in typed_calls(df).fillna("?", ["chr2"]).collect())
    assert got == [(1, "DEL", "chr1", 5), (2, "DUP", "chrX", None), (3, ".", "chrM", None), (4, ".", "?", None)]
