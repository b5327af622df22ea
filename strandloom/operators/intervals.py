"""Interval algebra on tables. Range joins become equi-joins on position bins, so no plan holds a nested-loop join.

Conventions: `keys` are the columns that must be equal (chromosome, type). An interval table has a start and an end column;
where an operator says closed, both ends belong to the interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .blocked import count_within, island_starts, running, with_carry


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, pad: int = 0, index: str | None = None, width: int = 1 << 20) -> DataFrame:
    """Keys, start, end, n_merged of the islands of intervals that overlap or touch (start <= end); with pad, ends widened by it
    (start not under 0); with index, the sorted index values of each island. Null ends are left out. No window holds more than `width` start positions of a key."""
    x = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    if pad:
        x = x.withColumn(start, F.greatest(F.lit(0), F.col(start) - pad)).withColumn(end, F.col(end) + pad)
    if not index:  # intervals with one start are one; counted before the shuffle
        x = x.groupBy(*keys, start).agg(F.max(end).alias(end), F.count(F.lit(1)).alias("__n"))
    x = island_starts(x, keys, start, end, "__island", width)
    more = [F.array_sort(F.collect_list(index)).alias(index)] if index else []
    n = F.count(F.lit(1)) if index else F.sum("__n")
    return x.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), n.alias("n_merged"), *more).drop("__island")


def subtract_intervals(df: DataFrame, other: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Keys, start, end of what the half-open intervals of df cover and those of other do not, by a sweep over both
    boundary sets. Coverage is a set: overlaps within df count once, pieces that touch are one."""
    def marks(t: DataFrame, a: int, b: int) -> DataFrame:
        t = t.where(F.col(start) < F.col(end))
        e = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(a).alias("da"), F.lit(b).alias("db")), F.struct(F.col(end).alias("at"), F.lit(-a).alias("da"), F.lit(-b).alias("db")))).alias("m")
        return t.select(*keys, e).select(*keys, "m.*")

    m = marks(df, 1, 0).unionByName(marks(other, 0, 1)).groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    m = running(m, keys, "at", ["da", "db"], "__next", 1 << 20)
    m = m.select(*keys, F.col("at").alias(start), F.col("__next").alias(end), ((F.col("run_da") > 0) & (F.col("run_db") == 0)).alias("__in"))
    return merge_intervals(m.where("__in").drop("__in"), keys, start, end).drop("n_merged")


#: From one level of bin widths to the next.
LEVEL_STEP = 16


def _bins(lo: Column, hi: Column, width: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def range_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_span: tuple[Column | str, Column | str], right_span: tuple[Column | str, Column | str], width: int, how: str = "inner", levels: int = 1) -> DataFrame:
    """Rows of left and right with equal keys whose closed spans share a position. Column names of the sides must differ.

    Both sides are put into every bin of `width` they touch and joined on (keys, bin); a pair counts in the bin where the
    later of its starts lies, so it comes once and no distinct is needed. Choose width near the usual span: a span of s
    costs s/width + 1 rows. Where spans differ much, `levels` of widths, each LEVEL_STEP times the one before, bound that: a span lives at the first level at which
    it touches few bins and visits the coarser ones, and a pair meets at the coarser of its two levels. how: inner, left_semi or left_anti.
    """
    l1, l2, r1, r2 = (_c(x) for x in (*left_span, *right_span))
    if how in ("left_semi", "left_anti"):
        only = left.select(*(F.col(k).alias(f"__k{i}") for i, (k, _) in enumerate(keys)), l1.alias("__s"), l2.alias("__e")).distinct()
        hit = range_join(only, right, [(f"__k{i}", r) for i, (_, r) in enumerate(keys)], ("__s", "__e"), right_span, width, levels=levels)
        hit = hit.select(*(f"__k{i}" for i in range(len(keys))), "__s", "__e").distinct()
        same = (l1 == F.col("__s")) & (l2 == F.col("__e"))
        for i, (k, _) in enumerate(keys):
            same = same & (F.col(k) == F.col(f"__k{i}"))
        return left.join(hit, same, how)
    a = left.withColumn("__l1", l1).withColumn("__l2", l2).where("__l1 <= __l2")
    b = right.withColumn("__r1", r1).withColumn("__r2", r2).where("__r1 <= __r2")
    on = (F.col("__bin") == F.col("__rbin")) & (F.col("__l1") <= F.col("__r2")) & (F.col("__r1") <= F.col("__l2"))
    wide = F.lit(width)
    if levels > 1:
        def level(lo: str, hi: str) -> Column:
            c = F.lit(levels - 1)
            for i in reversed(range(levels - 1)):
                c = F.when(F.col(hi) - F.col(lo) < LEVEL_STEP * width * LEVEL_STEP**i, i).otherwise(c)
            return c

        a = a.withColumn("__la", level("__l1", "__l2")).withColumn("__lv", F.explode(F.sequence("__la", F.lit(levels - 1))))
        b = b.withColumn("__lb", level("__r1", "__r2")).withColumn("__rlv", F.explode(F.sequence("__lb", F.lit(levels - 1))))
        on = on & (F.col("__lv") == F.col("__rlv")) & (F.col("__lv") == F.greatest("__la", "__lb"))
        wide = F.element_at(F.array(*(F.lit(width * LEVEL_STEP**i) for i in range(levels))), F.col("__lv") + 1)
    a = a.withColumn("__bin", _bins(F.col("__l1"), F.col("__l2"), wide))
    b = b.withColumn("__rbin", _bins(F.col("__r1"), F.col("__r2"), wide if levels == 1 else F.element_at(F.array(*(F.lit(width * LEVEL_STEP**i) for i in range(levels))), F.col("__rlv") + 1)))
    for k, r in keys:
        on = on & (a[k] == b[r])
    out = a.join(b, on).where(F.col("__bin") == F.floor(F.greatest("__l1", "__r1") / wide))
    return out.drop("__l1", "__l2", "__r1", "__r2", "__bin", "__rbin", "__la", "__lb", "__lv", "__rlv")


def nearest_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], at: str, other: str, within: int, row: list[str]) -> DataFrame:
    """For each row of left (identified by the columns `row`) the nearest position of right on equal keys, no further
    than `within`; ties go to the smaller position. Rows without one are left out."""
    near = range_join(left, right, keys, (F.col(at) - within, F.col(at) + within), (other, other), max(1, 2 * within))
    rank = F.struct(F.abs(F.col(at) - F.col(other)).alias("d"), F.col(other).alias("o"), *(F.col(c) for c in right.columns if c != other))
    best = near.groupBy(*row).agg(F.min(rank).alias("__best"))
    return best.select(*row, F.col("__best.o").alias(other), F.col("__best.d").alias("distance"), *(F.col(f"__best.{c}") for c in right.columns if c != other and c not in row))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: list[str], width: int | None = None) -> DataFrame:
    """Each row of left with the columns last_<value> of the last row of right at or before it on equal keys (ties within right: the
    greatest value), by one sort of the union: no pair is ever made.

    The union is cut into blocks of `width` (positions; microseconds for times); a block takes the last value of the blocks before
    from one row per block, so no window holds all rows of a key.
    """
    cols = list(left.columns)
    timed = isinstance(left.schema[at].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    place = F.unix_micros(F.col(at).cast("timestamp")) if timed else F.col(at).cast("long")
    width = width or (86_400_000_000 if timed else 1 << 20)
    r = right.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max(F.struct(*(F.col(c) for c in value))).alias("__v")).select(*keys, at, F.lit(0).alias("__side"), F.struct(at, "__v").alias("__r"), *(F.lit(None).cast(left.schema[c].dataType).alias(f"__c_{c}") for c in cols))
    mine = left.select(*keys, at, F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), *(F.col(c).alias(f"__c_{c}") for c in cols))
    both = r.unionByName(mine).withColumn("__blk", F.floor(place / F.lit(width)))
    both = with_carry(both, keys, "__blk", F.max("__r"), "__carry")
    w = W.partitionBy(*keys, "__blk").orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("__last", F.coalesce(F.last("__r", ignorenulls=True).over(w), "__carry")).where("__side = 1")
    return both.select(*(F.col(f"__c_{c}").alias(c) for c in cols), *(F.col(f"__last.__v.{c}").alias(f"last_{c}") for c in value))


def count_near(df: DataFrame, keys: list[str], at: str, before: int, after: int, out: str, own: bool = True) -> DataFrame:
    """Number of rows of df on equal keys within [at - before, at + after], as column out; own tells whether the row itself counts."""
    x = count_within(df, keys, at, before, after, out)
    return x if own else x.withColumn(out, F.col(out) - 1)


def count_points(spans: DataFrame, points: DataFrame, keys: list[tuple[str, str]], span: tuple[Column | str, Column | str], at: str, row: list[str], width: int) -> DataFrame:
    """Row, n of each span: how many points lie in it (closed), 0 included. Points at one position are counted before the join."""
    p = points.groupBy(*(r for _, r in keys), at).agg(F.count(F.lit(1)).alias("__n"))
    p = p.select(*(F.col(r).alias(f"__p{i}") for i, (_, r) in enumerate(keys)), F.col(at).alias("__at"), "__n")
    hit = range_join(spans, p, [(l, f"__p{i}") for i, (l, _) in enumerate(keys)], span, ("__at", "__at"), width)
    return spans.select(*row).join(hit.groupBy(*row).agg(F.sum("__n").alias("__sum")), row, "left").select(*row, F.coalesce("__sum", F.lit(0)).cast("long").alias("n"))


def region_label(events: DataFrame, regions: DataFrame, row: list[str], chrom_a: str, at_a: str, chrom_b: str, at_b: str, keys: tuple[str, str, str]) -> DataFrame:
    """Row, kind, region of either end: extra-regional (no end in a region), hemi-regional (one end), intra_regional
    (both ends in one region), inter-regional (in two). regions (chrom, start, end by `keys`) are merged first."""
    chrom, start, end = keys
    merged = merge_intervals(regions, [chrom], start, end).select(F.col(chrom).alias("__rc"), F.col(start).alias("__rs"), F.col(start).alias("__start"), F.col(end).alias("__re"))
    both = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("c"), F.col(p).cast("long").alias("p")) for i, (c, p) in enumerate(((chrom_a, at_a), (chrom_b, at_b))))))
    ends = events.select(*row, (F.col(chrom_a) == F.col(chrom_b)).alias("__same"), both.alias("__e")).select(*row, "__same", F.col("__e.side").alias("__end"), F.col("__e.c").alias("__rc"), F.col("__e.p").alias("__rs"))
    # regions are disjoint: the last one that starts at or before a position decides; both ends go through one as-of step
    hit = asof_join(ends, merged.withColumn("__rs", F.col("__rs").cast("long")), ["__rc"], "__rs", ["__start", "__re"])
    inside = F.when(F.col("last___re") >= F.col("__rs"), F.col("last___start"))
    x = hit.groupBy(*row, "__same").agg(F.max(F.when(F.col("__end") == 0, inside)).alias("region_a"), F.max(F.when(F.col("__end") == 1, inside)).alias("region_b"))
    a, b = F.col("region_a").isNotNull(), F.col("region_b").isNotNull()
    one = F.coalesce(F.col("__same"), F.lit(False)) & (F.col("region_a") == F.col("region_b"))
    kind = F.when(~a & ~b, "extra-regional").when(a != b, "hemi-regional").when(one, "intra_regional").otherwise("inter-regional")
    return x.select(*row, kind.alias("kind"), (~a & b).alias("switched"))


def introns(exons: DataFrame, transcript: list[str], start: str, end: str) -> DataFrame:
    """Gaps between neighbouring exons of a transcript, repeated exons once: transcript, gap_start, gap_end."""
    w = W.partitionBy(*transcript).orderBy(start, end)
    x = exons.select(*transcript, start, end).distinct().withColumn("__next", F.lead(start).over(w))
    return x.where(F.col(end) < F.col("__next")).select(*transcript, F.col(end).alias("gap_start"), F.col("__next").alias("gap_end"))


def without_known_gaps(gaps: DataFrame, known: DataFrame, keys: list[tuple[str, str]], span: tuple[str, str], known_span: tuple[str, str], slack: int = 10) -> DataFrame:
    """the gaps of which no known gap on equal keys has both its start and its end nearer than `slack`. The known gaps stand in the nine cells of
    the plane (start, end) around their own, so that the anti join is on equal cells."""
    cell = lambda c: F.floor(F.col(c) / slack)
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    k = known.select(*(F.col(r).alias(f"__k{i}") for i, (_, r) in enumerate(keys)), F.col(known_span[0]).alias("__ks"), F.col(known_span[1]).alias("__ke")).distinct()
    k = k.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around)).select("*", (cell("__ks") + F.col("__dx")).alias("__kx"), (cell("__ke") + F.col("__dy")).alias("__ky"))
    g = gaps.withColumn("__cx", cell(span[0])).withColumn("__cy", cell(span[1]))
    on = (F.col("__cx") == F.col("__kx")) & (F.col("__cy") == F.col("__ky")) & (F.abs(F.col(span[0]) - F.col("__ks")) < slack) & (F.abs(F.col(span[1]) - F.col("__ke")) < slack)
    for i, (l, _) in enumerate(keys):
        on = on & (F.col(l) == F.col(f"__k{i}"))
    return g.join(k, on, "left_anti").drop("__cx", "__cy")


def shared_region(events: DataFrame, regions: DataFrame, row: str, ends: tuple[tuple[str, str], tuple[str, str]], region: tuple[str, str, str, str], width: int = 1 << 14) -> DataFrame:
    """Row, shared: whether both ends (chromosome, position) lie in one region (name, chromosome, start, end; both ends belong to it) on one chromosome.

    The regions that start at or before the first end hold the second one if the farthest of them reaches it: a running maximum over blocks of `width`
    positions, no pair of an event and a region is made.
    """
    _, chrom, start, end = region
    a, b = (F.col(p).cast("long") for _, p in ends)
    same = F.coalesce(F.col(ends[0][0]) == F.col(ends[1][0]), F.lit(False))
    ids = F.when(same, F.col(ends[0][0]))
    x = events.select(ids.alias("__k"), F.when(same & a.isNotNull() & b.isNotNull(), F.least(a, b)).alias("__at"), F.greatest(a, b).alias("__hi"), F.lit(None).cast("long").alias("__e"), F.struct(row).alias("__row"))
    r = regions.where(F.col(chrom).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(F.col(chrom).alias("__k"), F.col(start).cast("long").alias("__at")).agg(F.max(F.col(end).cast("long")).alias("__e"))
    r = r.select("__k", "__at", F.lit(None).cast("long").alias("__hi"), "__e", F.lit(None).cast(x.schema["__row"].dataType).alias("__row"))
    both = with_carry(r.unionByName(x).withColumn("__blk", F.floor(F.col("__at") / F.lit(width))), ["__k"], "__blk", F.max("__e"), "__before")
    # by range: regions that start where the first end lies count, in whatever order the rows come
    reach = F.max("__e").over(W.partitionBy("__k", "__blk").orderBy("__at").rangeBetween(W.unboundedPreceding, W.currentRow))
    both = both.withColumn("__reach", F.greatest(reach, F.col("__before"))).where("__row is not null")
    return both.select(f"__row.{row}", F.coalesce(F.col("__at").isNotNull() & (F.col("__reach") >= F.col("__hi")), F.lit(False)).alias("shared"))
