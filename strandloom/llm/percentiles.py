"""Percentiles of very large columns from mergeable sketches with a guaranteed relative error.

A sketch counts values in signed logarithmic buckets: bucket i holds the magnitudes in (g^(i-1), g^i], g = (1+a)/(1-a),
so its middle is within the relative error a of every value in it. Sketches of partitions or days are added bucket by
bucket. Each bucket also keeps its least and greatest value, so a bucket of one distinct value answers exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Relative error; at this width every whole number up to 3,333 has a bucket of its own.
ALPHA = 0.00015


def sketch(df: DataFrame, group: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """The group columns, sgn, idx, n, lo, hi: one row per bucket. Null and NaN values are not counted; 0 has its own bucket.

    Aggregated before the shuffle, so what is shuffled is bounded by buckets, not by rows, and a group with a third of
    all rows costs no more than another. Groups with null are groups. An empty table gives no rows.
    """
    log_g = math.log((1 + alpha) / (1 - alpha))
    v = F.col(value).cast("double")
    rows = df.select(*group, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    idx = F.when(F.col("__v") == 0, 0).otherwise(F.ceil(F.log(F.abs("__v")) / log_g)).cast("int")
    return rows.groupBy(*group, F.signum("__v").cast("tinyint").alias("sgn"), idx.alias("idx")).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))


def combine(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Add sketches that were made with the same alpha: over days, partitions, or any coarser group."""
    return sketches.groupBy(*group, "sgn", "idx").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def percentiles(sketches: DataFrame, group: list[str], pcts: tuple[int, ...], alpha: float = ALPHA) -> DataFrame:
    """The group columns, pct, value, at_least, at_most, n_all: the smallest value with at least pct % of the values at or below it.

    value is within alpha of the true one (relative), which lies in [at_least, at_most]; where both are equal it is exact.
    The window sees the buckets of a group, of which there are at most 2 ln(max/min)/ln(g).
    """
    g = (1 + alpha) / (1 - alpha)
    order = W.partitionBy(*group).orderBy("sgn", F.col("sgn") * F.col("idx"))
    run = sketches.withColumn("__upto", F.sum("n").over(order)).withColumn("n_all", F.sum("n").over(W.partitionBy(*group)))
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("pct"), F.greatest(F.lit(1), F.ceil(F.col("n_all") * p / 100)).alias("rank")) for p in pcts)))
    hit = run.withColumn("__r", wanted).where("__r.rank > __upto - n and __r.rank <= __upto")
    middle = F.col("sgn") * F.pow(F.lit(g), F.col("idx")) * 2 / (g + 1)
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.least("hi", F.greatest("lo", middle)))
    return hit.select(*group, F.col("__r.pct").alias("pct"), value.alias("value"), F.col("lo").alias("at_least"), F.col("hi").alias("at_most"), "n_all")
