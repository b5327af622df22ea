"""Per-key results where a few keys hold most of the rows.

Heavy keys are found by a mergeable frequent-items sketch (no key above its bound is missed), their rows are tagged by a
broadcast join with that bounded list, and they are aggregated in two steps over salted parts; the remaining keys take the
ordinary shuffle; both results are united. Percentiles are exact: keys are narrowed, by counts, to the buckets of values that hold the
wanted ranks, and buckets that hold very many rows are parted again, so no task sees all values of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import materialize

#: A key is heavy from this share of the rows on; there can be no more than 1/HEAVY_SHARE such keys, and the sketch may name a few more.
HEAVY_SHARE = 0.01
SKETCH_ITEMS = 4096
SALTS = 64
#: Rows of a bucket from which it is parted again, and into how many parts.
BUCKET_ROWS = 1_000_000
PARTS = 1024


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, items: int = SKETCH_ITEMS) -> list[str]:
    """Every key (a string) with at least `share` of the rows of df, and perhaps some with a little less."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {min(items // 2, int(2 / share) + 1)}, {items})").alias("top")).first()
    return [r["item"] for r in got["top"] or [] if r["item"] is not None and r["count"] >= (share - 1 / items) * got["n"]] if got["n"] else []


def _ranks(n, pcts: tuple[int, ...]):
    """1-based rank of each percentile: the smallest value with at least pct % of the values at or below it."""
    return F.array(*(F.struct(F.lit(p).alias("pct"), F.greatest(F.lit(1), F.ceil(n * p / 100)).cast("long").alias("rank")) for p in pcts))


def _log_bucket(v: Column) -> Column:
    """A number that rises with the value, an eighth of an octave wide."""
    d = v.cast("double")
    return F.when(d == 0, 0).otherwise(F.signum(d) * (2000 * 8 + F.floor(F.log2(F.abs(d)) * 8))).cast("long")


def exact_percentiles(rows: DataFrame, key: str, value: str, pcts: tuple[int, ...], few_keys: bool, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """key, pct, value: exact, without bringing the values of a key together. few_keys says that keys are few by construction, so that
    what is known of their buckets may be broadcast.

    A bucket of more than `bucket_rows` rows and more than one value is parted into PARTS by value until none is left: each round narrows the
    values by that factor. Windows see buckets, not rows; the last sees the values of one bucket.
    """
    side = F.broadcast if few_keys else (lambda d: d)
    v = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("v"), _log_bucket(F.col(value)).alias("b"))
    figures = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]

    def narrowed(per: DataFrame, within: list[str], ranks: Column) -> DataFrame:
        order = W.partitionBy(key, *within).orderBy("b")
        per = per.withColumn("upto", F.sum("n").over(order))
        hit = per.select(key, *within, "b", "n", "upto", "lo", "hi", F.explode(ranks).alias("r")).where("r.rank > upto - n and r.rank <= upto")
        return hit.select(key, F.col("r.pct").alias("pct"), (F.col("r.rank") - F.col("upto") + F.col("n")).alias("at"), "b", "n", "lo", "hi")

    whole = isinstance(rows.schema[value].dataType, T.LongType)
    wide = F.col("lo") < F.col("hi") if whole else F.col("hi").cast("double") - F.col("lo").cast("double") > 1e-290
    large = (F.col("n") > bucket_rows) & wide

    def place(v: Column) -> Column:
        lo, hi = F.col("lo"), F.col("hi")
        if whole:
            return F.expr(f"(v - lo) div ((hi - lo) div {PARTS} + 1)")
        return F.least(F.lit(PARTS), F.floor((v.cast("double") - lo.cast("double")) / ((hi.cast("double") - lo.cast("double")) / PARTS)).cast("long"))

    per = v.groupBy(key, "b").agg(*figures).withColumn("all", F.sum("n").over(W.partitionBy(key)))
    hit = materialize(narrowed(per, ["all"], _ranks(F.col("all"), pcts)))
    done = None
    while not hit.where(large).isEmpty():
        big, small = hit.where(large), hit.where(~large)
        done = small if done is None else done.unionByName(small)
        spans = big.groupBy(key, "lo", "hi").agg(F.collect_list(F.struct("pct", F.col("at").alias("rank"))).alias("ranks"))  # no more than one of each percentile
        x = v.select(F.col(key).alias("__k"), "v").join(side(spans), (F.col("__k") == F.col(key)) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        x = x.select(key, F.col("lo").alias("from"), "ranks", "v", place(F.col("v")).alias("b"))
        per = x.groupBy(key, "from", "b").agg(*figures, F.first("ranks").alias("ranks"))
        hit = materialize(narrowed(per, ["from", "ranks"], F.col("ranks")))
    hit = hit if done is None else done.unionByName(hit)
    one = hit.where("lo = hi").select(key, "pct", F.col("lo").alias("value"))
    spans = hit.where("lo < hi")
    each = spans.groupBy(key, "lo", "hi").agg(F.collect_list(F.struct("pct", "at")).alias("ranks"))
    x = v.select(F.col(key).alias("__k"), "v").join(side(each), (F.col("__k") == F.col(key)) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    counts = x.groupBy(key, "lo", "v").agg(F.count(F.lit(1)).alias("n"), F.first("ranks").alias("ranks"))
    counts = counts.withColumn("upto", F.sum("n").over(W.partitionBy(key, "lo").orderBy("v")))
    found = counts.select(key, "v", "n", "upto", F.explode("ranks").alias("r")).where("r.at > upto - n and r.at <= upto")
    return one.unionByName(found.select(key, F.col("r.pct").alias("pct"), F.col("v").alias("value")))


def skewed_stats(df: DataFrame, key: str, value: str, pcts: tuple[int, ...] = (50, 90), share: float = HEAVY_SHARE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """key, heavy, n, n_value, min, max, mean and p<pct> of value, per key; a null key is the key ''.

    Every row counts: deduplicate before. Values keep their type (whole numbers as long; fractions stay). Null values, and NaN, count in n only.
    An empty table gives no rows. Columns other than key and value are ignored. The two columns are written once, in the shared folder, and
    read from there.
    """
    kind = df.schema[value].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    v = F.col(value).cast("long") if whole else F.col(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = F.when(~F.isnan(v), v)
    rows = materialize(df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), v.alias("v")))
    heavy = heavy_keys(rows, "k", share)
    names = [f"p{p}" for p in pcts]
    total = F.sum(F.col("v").cast("decimal(38,0)")) if whole else F.sum("v")
    part = [F.count(F.lit(1)).alias("n"), F.count("v").alias("n_value"), F.min("v").alias("min"), F.max("v").alias("max"), total.alias("total")]
    again = [F.sum("n").alias("n"), F.sum("n_value").alias("n_value"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("total").alias("total")]
    listed = df.sparkSession.createDataFrame([(h,) for h in heavy], "h string")

    def finished(base: DataFrame, r: DataFrame, is_heavy: bool) -> DataFrame:
        pct = exact_percentiles(r, "k", "v", pcts, is_heavy, bucket_rows).groupBy(F.col("k").alias("__pk")).agg(*(F.max(F.when(F.col("pct") == p, F.col("value"))).alias(n) for p, n in zip(pcts, names)))
        mean = F.col("total").cast("double") / F.col("n_value")
        return base.join(F.broadcast(pct) if is_heavy else pct, F.col("k") == F.col("__pk"), "left").select(F.col("k").alias(key), F.lit(is_heavy).alias("heavy"), "n", "n_value", "min", "max", mean.alias("mean"), *names)

    light = rows.join(F.broadcast(listed), F.col("k") == F.col("h"), "left_anti") if heavy else rows
    out = finished(light.groupBy("k").agg(*part), light, False)
    if not heavy:
        return out
    big = rows.join(F.broadcast(listed), F.col("k") == F.col("h")).drop("h")
    salted = big.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).groupBy("k", "salt").agg(*part)
    return out.unionByName(finished(salted.groupBy("k").agg(*again), big, True))
