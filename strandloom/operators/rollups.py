"""Grouped statistics and clustering of evidence and of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .blocked import island_starts, neighbours, running


def spread(df: DataFrame, group: list[str], value: str, cutoff: float = 8.0) -> DataFrame:
    """Group, n, median, upper_mad, mean and sd about the median of the values under median + cutoff x upper MAD.

    Medians are exact (interpolated). The upper MAD is the median of the distances of the values above the median; a group
    with none has 0. The standard deviation is taken about the median of the kept values.
    """
    v = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("v"))
    med = v.groupBy(*group).agg(F.median("v").alias("m"))
    w = v.join(med, group)
    mad = w.groupBy(*group).agg(F.first("m").alias("m"), F.coalesce(F.median(F.when(F.col("v") > F.col("m"), F.col("v") - F.col("m"))), F.lit(0.0)).alias("upper_mad"))
    kept = v.join(mad, group).where(F.col("v") <= F.col("m") + cutoff * F.col("upper_mad"))
    mid = kept.groupBy(*group).agg(F.median("v").alias("median"), F.first("upper_mad").alias("upper_mad"))
    out = kept.select(*group, "v").join(mid, group).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.first("median").alias("median"), F.first("upper_mad").alias("upper_mad"), F.avg("v").alias("mean"), F.sqrt(F.avg(F.pow(F.col("v") - F.col("median"), 2))).alias("sd"))
    return out


def divergence_bound(rate: Column | str) -> list[Column]:
    """Mean and bound min(1, max(2.5 mean, mean + 2.5 sd)) of an error rate, as aggregates."""
    r = F.col(rate) if isinstance(rate, str) else rate
    mean, sd = F.avg(r), F.stddev_pop(r)
    return [mean.alias("mean_rate"), F.least(F.lit(1.0), F.greatest(2.5 * mean, mean + 2.5 * sd)).alias("bound")]


def sweep(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Group, best (the first position where most intervals [start, end) are open), depth there, by a running sum over the changes."""
    m = df.where(F.col(start) < F.col(end)).select(*group, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("m"))
    m = m.groupBy(*group, F.col("m.at").alias("at")).agg(F.sum("m.d").alias("d"))
    m = running(m, group, "at", ["d"], "__next", 1 << 20).withColumnRenamed("run_d", "depth")
    return m.groupBy(*group).agg(F.max(F.struct("depth", (-F.col("at")).alias("at"))).alias("x")).select(*group, (-F.col("x.at")).alias("best"), F.col("x.depth").alias("depth"))


def half_width(value: str, pct: float = 0.975) -> Column:
    """Half the confidence interval: distance of the percentile from the median, an aggregate."""
    return F.abs(F.percentile(value, F.lit(pct)) - F.median(value))


def length_eps(longest: Column, tagged: bool = False) -> Column:
    """Step between neighbours of one length cluster: min(0.045 L, L^0.45) in whole numbers, at least 1, twice that with haplotags."""
    eps = F.greatest(F.lit(1), F.least((longest * 0.045).cast("int"), F.pow(longest, F.lit(0.45)).cast("int")))
    return eps * 2 if tagged else eps


def cluster_lengths(df: DataFrame, group: list[str], length: str, row: str, least: int = 2, tagged: bool = False) -> DataFrame:
    """Row, group, cluster (number from 1 within the group, by length): sorted lengths part where the step to the next exceeds the
    eps of the longest of the group. Clusters of under `least` rows are left out."""
    x = df.where(F.col(length).isNotNull()).select(row, *group, F.col(length).alias("__len"))
    # neighbours are found among the distinct lengths of a group, of which there are few however many rows
    per = x.groupBy(*group, "__len").agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy(*group).orderBy("__len")
    per = per.withColumn("__eps", length_eps(F.max("__len").over(W.partitionBy(*group)), tagged))
    per = per.withColumn("__new", F.when(F.col("__len") - F.lag("__len").over(w) > F.col("__eps"), 1).otherwise(0))
    per = per.withColumn("cluster", (1 + F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).cast("long"))
    per = per.withColumn("__all", F.sum("__n").over(W.partitionBy(*group, "cluster"))).where(F.col("__all") >= least).select(*group, "__len", "cluster")
    return x.join(per, [*group, "__len"]).select(row, *group, "cluster")


def islands(df: DataFrame, group: list[str], at: str, apart: int, row: str) -> DataFrame:
    """A09 in one dimension: single linkage at distance `apart` is an island of the sorted positions: row, group, island (its first position)."""
    x = df.where(F.col(at).isNotNull()).select(row, *group, F.col(at).alias("__at"), (F.col(at) + apart).alias("__to"))
    return island_starts(x, group, "__at", "__to", "island").select(row, *group, "island")


def evidence(df: DataFrame, group: list[str], kind: dict[str, Column], template: str, coverage: str | None = None) -> DataFrame:
    """Per group the counters of `kind` (boolean columns: pe, supp, spanning, bnd, ...), su = pe + supp + 2 spanning + bnd and the
    number of templates; with coverage also a_freq = templates over coverage, held to 0..1, three digits."""
    counts = [F.count_if(c).alias(k) for k, c in kind.items()]
    aggs = [*counts, F.count_distinct(template).alias("templates")]
    if coverage:
        aggs.append(F.max(coverage).alias("coverage"))
    x = df.groupBy(*group).agg(*aggs)
    su = F.lit(0).cast("long")
    for k in kind:
        su = su + F.col(k) * {"pe": 1, "supp": 1, "bnd": 1, "spanning": 2}.get(k, 0)
    x = x.withColumn("su", su)
    return x.withColumn("a_freq", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("templates") / (F.col("coverage") + 1e-5))), 3)) if coverage else x


def merge_rank(su: Column, spanning: Column, halved: Column) -> Column:
    """A10: rank of the events of a cluster: su + 3 spanning, halved for imprecise paired calls of mixed types."""
    r = (su + 3 * spanning).cast("double")
    return F.when(halved, r / 2).otherwise(r)


def merge_rollup(df: DataFrame, group: list[str], best: Column, keep: list[str], sums: list[str], tops: list[str], means: list[str], weight: str) -> DataFrame:
    """One row per cluster: the `keep` columns of the row with the greatest `best`, sums, maxima and weighted means
    (rows with a null value or no weight count for nothing), and n_in_grp (A12)."""
    w = F.col(weight)
    mean = lambda c: F.sum(F.col(c) * w) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0))
    x = df.withColumn("__best", best).groupBy(*group).agg(F.max(F.struct("__best", *keep)).alias("__top"), *(F.sum(c).alias(c) for c in sums if c not in keep), *(F.max(c).alias(f"max_{c}") for c in tops), *(mean(c).alias(f"mean_{c}") for c in means), F.count(F.lit(1)).alias("n_in_grp"))
    return x.select(*group, *(F.col(f"__top.{c}").alias(c) for c in keep), *(c for c in sums if c not in keep), *(f"max_{c}" for c in tops), *(f"mean_{c}" for c in means), "n_in_grp")


def best_per(df: DataFrame, group: list[str], order: list[Column], row: list[str]) -> DataFrame:
    """The first row of each group in the given order (ascending), as one aggregate; row columns break ties and come back."""
    s = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"r_{c}") for c in row))
    return df.groupBy(*group).agg(F.min(s).alias("s")).select(*group, *(F.col(f"s.r_{c}").alias(c) for c in row))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark prunes to k rows per task before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quality_ratio(df: DataFrame, group: list[str], place: str, quality: str) -> DataFrame:
    """Group, ratio: sum of distances of qualities from the mean at their place over the sum of distances from the mean of all;
    -1 where no place has two values or nothing varies."""
    x = df.where(F.col(quality).isNotNull()).groupBy(*group, place, F.col(quality).cast("double").alias("q")).agg(F.count(F.lit(1)).alias("__k"))  # equal values of a place are one row
    at = x.groupBy(*group, place).agg(F.sum("__k").alias("__n"), (F.sum(F.col("q") * F.col("__k")) / F.sum("__k")).alias("__m"))
    all_ = x.groupBy(*group).agg((F.sum(F.col("q") * F.col("__k")) / F.sum("__k")).alias("__a"))
    x = x.join(at, [*group, place]).join(all_, group)
    x = x.groupBy(*group).agg(F.sum(F.abs(F.col("q") - F.col("__m")) * F.col("__k")).alias("p"), F.sum(F.abs(F.col("q") - F.col("__a")) * F.col("__k")).alias("a"), F.max("__n").alias("n"))
    return df.select(*group).distinct().join(x, group, "left").select(*group, F.when((F.coalesce("n", F.lit(0)) < 2) | (F.col("a") == 0), F.lit(-1.0)).otherwise(F.col("p") / F.col("a")).alias("ratio"))


def next_to(df: DataFrame, key: list[str], at: str, row: str, value: list[str]) -> DataFrame:
    """Df with the rows before and after each (structs __before and __after), for fix_neighbours; no window holds more than a block of a key."""
    return neighbours(df, key, at, row, value, "__before", "__after")


def fix_neighbours(df: DataFrame, alike_before: Column, alike_after: Column, gt: str) -> DataFrame:
    """Homozygous calls next to an alike call are heterozygous: 1/1 becomes 0/1 where either neighbour is alike. The two
    conditions use lag and lead over the order of the calls; genotypes only go down, so one pass is enough."""
    return df.withColumn("fixed_gt", F.when((F.col(gt) == "1/1") & (F.coalesce(alike_before, F.lit(False)) | F.coalesce(alike_after, F.lit(False))), "0/1").otherwise(F.col(gt)))
