"""Depth of coverage as run lengths of a difference array; never one row per base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize
from .blocked import per_block, running
from .intervals import asof_join, range_join

BIN = 10
#: Bins whose changes one window holds.
BLOCK_BINS = 1 << 18
SATURATED = 32_000


def depth_track(df: DataFrame, key: str, start: str, end: str, bin_size: int = BIN) -> DataFrame:
    """Key, bin, to_bin (exclusive), depth, as runs of equal depth above 0.

    An interval adds one at the bin of its start and takes one off at the bin of its end, so intervals inside one bin cancel.
    Changes are summed before the shuffle; the running sum sees the changed bins of one block of a key, and one row per block. Depth saturates at SATURATED.
    """
    b = lambda c: F.floor(F.col(c) / bin_size)
    d = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(key, F.explode(F.array(F.struct(b(start).alias("bin"), F.lit(1).alias("d")), F.struct(b(end).alias("bin"), F.lit(-1).alias("d")))).alias("m"))
    d = d.groupBy(key, F.col("m.bin").alias("bin")).agg(F.sum("m.d").alias("d")).where("d <> 0")
    d = running(d, [key], "bin", ["d"], "to_bin", BLOCK_BINS).withColumnRenamed("run_d", "depth")
    return d.select(key, "bin", "to_bin", "depth").where("depth > 0").withColumn("depth", F.least("depth", F.lit(SATURATED)))


def rebin(track: DataFrame, key: str, bins: int) -> DataFrame:
    """Key, wide, mean_depth, min_depth, max_depth over wide bins of `bins` narrow ones. Narrow bins without depth count as 0."""
    wide = F.explode(F.sequence(F.floor(F.col("bin") / bins), F.floor((F.col("to_bin") - 1) / bins)))
    t = track.withColumn("wide", wide)
    n = F.least("to_bin", (F.col("wide") + 1) * bins) - F.greatest("bin", F.col("wide") * bins)
    t = t.withColumn("n", n).groupBy(key, "wide").agg(F.sum(F.col("n") * F.col("depth")).alias("s"), F.sum("n").alias("n"), F.min("depth").alias("lo"), F.max("depth").alias("max_depth"))
    return t.select(key, "wide", (F.col("s") / bins).alias("mean_depth"), F.when(F.col("n") < bins, 0).otherwise(F.col("lo")).cast("long").alias("min_depth"), F.col("max_depth").cast("long").alias("max_depth"))


def median_of_nonzero(track: DataFrame, key: str) -> DataFrame:
    """Key, median_depth: the lower median of the bins with depth, by cumulative bin counts per distinct depth."""
    per = track.groupBy(key, "depth").agg(F.sum(F.col("to_bin") - F.col("bin")).alias("n"))
    w = W.partitionBy(key)
    per = per.withColumn("upto", F.sum("n").over(w.orderBy("depth"))).withColumn("all", F.sum("n").over(w))
    return per.where("upto * 2 >= all and (upto - n) * 2 < all").select(key, F.col("depth").alias("median_depth"))


def depth_at(points: DataFrame, track: DataFrame, key: str, at: str, bin_size: int = BIN) -> DataFrame:
    """points with column depth, the depth of the bin they lie in (0 where none), by an as-of step over the union of both."""
    p = points.withColumn("__b", F.floor(F.col(at) / bin_size))
    t = track.select(F.col(key), F.col("bin").alias("__b"), "to_bin", "depth")
    x = asof_join(p, t, [key], "__b", ["to_bin", "depth"])
    return x.select(*points.columns, F.when(F.col("last_to_bin") > F.col("__b"), F.col("last_depth")).otherwise(F.lit(0)).cast("long").alias("depth"))


def _bins(lo: str, hi: str, bin_size: int) -> tuple[Column, Column]:
    """First and last bin of the positions [lo, hi); an empty window is the bin of lo."""
    first = F.floor(F.col(lo) / bin_size)
    return first, F.greatest(F.floor((F.col(hi) - 1) / bin_size), first)


def window_means(windows: DataFrame, track: DataFrame, key: str, row: list[str], spans: dict[str, tuple[str, str]], bin_size: int = BIN) -> DataFrame:
    """Row (which tells windows apart) and, under each name of `spans`, the mean depth over the bins of its [lo, hi) (positions); bins without depth count as 0.

    A mean is the difference of two running sums over the track, read in one sort with the runs: a window costs two rows, however many runs it covers.
    """
    marks = []
    for name, (lo, hi) in spans.items():
        first, last = _bins(lo, hi, bin_size)
        marks += [F.struct(F.lit(name).alias("name"), at.cast("long").alias("at"), F.lit(sign).alias("sign")) for at, sign in ((first, -1), (F.when(first.isNotNull(), last + 1), 1))]
    points = windows.select(F.col(key).alias("__k"), F.struct(*row).alias("__row"), F.explode(F.array(*marks)).alias("__p"))
    points = points.select("__k", F.col("__p.at").alias("__at"), *(F.lit(None).cast("long").alias(c) for c in ("__t", "__d")), "__row", F.col("__p.name").alias("__name"), F.col("__p.sign").alias("__sign"))
    runs = track.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col("bin").cast("long").alias("__at"), F.col("to_bin").cast("long").alias("__t"), F.col("depth").cast("long").alias("__d"))
    both = materialize(runs.select("*", *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in ("__row", "__name", "__sign"))).unionByName(points))
    both = both.withColumns({"__blk": F.floor(F.col("__at") / F.lit(BLOCK_BINS)), "__area": (F.col("__t") - F.col("__at")) * F.col("__d"), "__run": F.when(F.col("__d").isNotNull(), F.struct("__at", "__t", "__d"))})
    before = W.partitionBy("__k").orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)
    both = per_block(both, ["__k"], [F.sum("__area").alias("__a"), F.max("__run").alias("__r")], [F.sum("__a").over(before).alias("__sum"), F.max("__r").over(before).alias("__last")])
    upto = W.partitionBy("__k", "__blk").orderBy("__at").rangeBetween(W.unboundedPreceding, W.currentRow)
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = both.withColumns({"__sum": zero(F.sum("__area").over(upto)) + zero(F.col("__sum")), "__last": F.coalesce(F.last("__run", ignorenulls=True).over(upto), "__last")}).where("__row is not null")
    # the depth of all bins before a place: that of the runs that start there or before, less what the last of them covers from there on
    upto = F.col("__sum") - zero(F.greatest(F.lit(0), F.col("__last.__t") - F.col("__at")) * F.col("__last.__d"))
    both = both.select("__row", "__name", (upto * F.col("__sign")).alias("__s"), (F.col("__at") * F.col("__sign")).alias("__n"))
    of = lambda c, name: F.sum(F.when(F.col("__name") == name, F.col(c)))
    return both.groupBy("__row").agg(*((of("__s", n) / of("__n", n)).alias(n) for n in spans)).select("__row.*", *spans)


#: Windows of fewer than 2**SHORT bins are joined with the runs they cover.
SHORT = 8


def window_depth(windows: DataFrame, track: DataFrame, key: str, row: list[str], lo: str, hi: str, bin_size: int = BIN) -> DataFrame:
    """Row, mean_depth, max_depth over the bins of [lo, hi) (positions); bins without depth count as 0.

    A window of n bins, 2**v <= n < 2**(v+1), covers the end of one block of 2**v bins, the start of another and at most one whole block between. Sums and
    maxima that run through a block from either side are read at those places, three rows a window however many runs it covers. Runs stand
    in the blocks of those v that occur among the windows.
    """
    first, last = _bins(lo, hi, bin_size)
    w = windows.select(*row, key, first.cast("long").alias("__lo"), last.cast("long").alias("__hi"))
    w = materialize(w.withColumn("__v", F.greatest(F.length(F.bin(F.col("__hi") - F.col("__lo") + 1)) - 1, F.lit(SHORT - 1))))
    good = w.where(F.col(key).isNotNull() & F.col("__lo").isNotNull())
    sizes = sorted(r[0] for r in good.select("__v").distinct().collect())  # at most one for every power of two
    t = track.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col("bin").cast("long").alias("__b"), (F.col("to_bin") - 1).cast("long").alias("__t"), F.col("depth").cast("long").alias("__d"))
    short = range_join(good.where(F.col("__v") < SHORT), t, [(key, "__k")], ("__lo", "__hi"), ("__b", "__t"), 1 << SHORT)
    got = short.select(*row, ((F.least("__hi", "__t") - F.greatest("__lo", "__b") + 1) * F.col("__d")).alias("__s"), F.col("__d").alias("__m"))
    if long := [v for v in sizes if v >= SHORT]:
        parts = _block_parts(good.where(F.col("__v") >= SHORT), t, key, row, long)
        got = got.unionByName(parts) if sizes[0] < SHORT else parts
    got = got.groupBy(*row).agg(F.sum("__s").alias("__s"), F.max("__m").alias("__m"))
    return w.join(got, row, "left").select(*row, (F.coalesce("__s", F.lit(0)) / (F.col("__hi") - F.col("__lo") + 1)).alias("mean_depth"), F.coalesce("__m", F.lit(0)).cast("long").alias("max_depth"))


def _block_parts(w: DataFrame, t: DataFrame, key: str, row: list[str], sizes: list[int]) -> DataFrame:
    """row, __s, __m (sum and maximum) of the up to three parts of each window, which lie in blocks of 2**__v bins."""
    t = t.withColumn("__v", F.explode(F.array(*(F.lit(v) for v in sizes)))).withColumn("__blk", F.explode(F.expr("sequence(shiftright(__b, __v), shiftright(__t, __v))")))
    t = t.select("__k", "__v", "__blk", F.expr("greatest(__b, shiftleft(__blk, __v))").alias("__at"), F.expr("least(__t, shiftleft(__blk + 1, __v) - 1)").alias("__e"), "__d")
    part = lambda blk, at, end: F.struct(F.expr(blk).alias("blk"), F.expr(at).alias("at"), F.lit(end).alias("end"))
    a, b = "shiftright(__lo, __v)", "shiftright(__hi, __v)"
    parts = F.array(part(a, "__lo", True), F.when(F.expr(f"{b} > {a}"), part(b, "__hi", False)), F.when(F.expr(f"{b} > {a} + 1"), part(f"{a} + 1", f"shiftleft({b}, __v) - 1", False)))
    p = w.select(F.col(key).alias("__k"), "__v", F.struct(*row).alias("__row"), F.explode(parts).alias("__p")).where("__p is not null")
    p = p.select("__k", "__v", F.col("__p.blk").alias("__blk"), F.col("__p.at").alias("__at"), *(F.lit(None).cast("long").alias(c) for c in ("__e", "__d")), "__row", F.col("__p.end").alias("__end"))
    both = t.select("*", *(F.lit(None).cast(p.schema[c].dataType).alias(c) for c in ("__row", "__end"))).unionByName(p)
    block = W.partitionBy("__k", "__v", "__blk")
    upto, on = (block.orderBy(o).rangeBetween(W.unboundedPreceding, W.currentRow) for o in (F.col("__at"), F.col("__at").desc()))
    area = (F.col("__e") - F.col("__at") + 1) * F.col("__d")
    both = both.withColumns({"__us": F.sum(area).over(upto), "__um": F.max("__d").over(upto), "__last": F.last(F.when(F.col("__d").isNotNull(), F.struct("__at", "__e", "__d")), ignorenulls=True).over(upto), "__os": F.sum(area).over(on), "__om": F.max("__d").over(on)}).where("__row is not null")
    zero = lambda c: F.coalesce(c, F.lit(0))
    at, end, d = F.col("__at"), F.col("__last.__e"), F.col("__last.__d")
    # a run that starts at the place is among those from there on; one that starts before and covers it is not
    over = F.when((F.col("__last.__at") < at) & (end >= at), d)
    s = F.when(F.col("__end"), zero(F.col("__os")) + zero(over * (end - at + 1))).otherwise(zero(F.col("__us")) - zero(F.greatest(F.lit(0), end - at) * d))
    return both.select("__row.*", s.alias("__s"), F.when(F.col("__end"), F.greatest("__om", over)).otherwise(F.col("__um")).alias("__m"))


def fold_change(inner, outer, svtype):
    """Change of depth an event makes: middle over sides for DEL, sides over middle for DUP and INV, 0 for TRA and where nothing divides."""
    i, o, t = F.col(inner), F.col(outer), F.col(svtype)
    return F.when((t == "DEL") & (o > 0), i / o).when(t.isin("DUP", "INV") & (i > 0), o / i).otherwise(F.lit(0.0))
