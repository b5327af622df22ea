"""Ordered operators that never put all rows of one key into one task: rows of a key are cut into blocks of the order column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _null_safe(key: list[str], names: list[str]):
    same = F.lit(True)
    for k, n in zip(key, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return same


def with_carry(df: DataFrame, key: list[str], block: str, summary, out: str) -> DataFrame:
    """df with `out`: the greatest `summary` (an aggregate) of the blocks before a row's block, within key. The window sees one row per block."""
    names = [f"__c{i}" for i in range(len(key))]
    per = df.groupBy(*key, block).agg(summary.alias("__s"))
    run = F.max("__s").over(W.partitionBy(*key).orderBy(block).rowsBetween(W.unboundedPreceding, -1))
    per = per.select(*(F.col(k).alias(n) for k, n in zip(key, names)), F.col(block).alias("__cb"), run.alias(out))
    return df.join(per, _null_safe([*key, block], [*names, "__cb"]), "left").drop(*names, "__cb")


def island_starts(df: DataFrame, key: list[str], start: str, end: str, out: str, width: int = 1 << 20) -> DataFrame:
    """df with `out`: the start of the island a row's interval [start, end] belongs to; intervals that overlap or touch (start <= an end before) are one.

    Rows are cut into blocks of `width` start positions; what reaches into a block, and the island open at its start, come from
    one row per block, so no window holds more than the rows of one block. Rows need a start and an end.
    """
    x = df.withColumn("__blk", F.floor(F.col(start) / F.lit(width)))
    x = with_carry(x, key, "__blk", F.max(end), "__reach")
    w = W.partitionBy(*key, "__blk").orderBy(start, end)
    reach = F.greatest(F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("__reach"))
    x = x.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), F.col(start)))
    # by range, not by rows: rows of one start belong together in whatever order they come
    x = x.withColumn("__own", F.max("__new").over(W.partitionBy(*key, "__blk").orderBy(start).rangeBetween(W.unboundedPreceding, W.currentRow)))
    x = with_carry(x, key, "__blk", F.max("__new"), "__open")
    return x.withColumn(out, F.coalesce("__own", "__open")).drop("__blk", "__reach", "__new", "__own", "__open")


def count_within(df: DataFrame, key: list[str], at: str, before: int, after: int, out: str) -> DataFrame:
    """df with `out`: how many rows of its key lie within [at - before, at + after], itself included.

    Rows stand in blocks of positions far wider than the reach and, as ghosts, in the blocks they reach into; a window counts
    inside a block and the ghosts go. The null position counts nothing and gets null.
    """
    width = max(1, 64 * (before + after))
    own = F.floor(F.col(at) / F.lit(width))
    blocks = F.explode(F.sequence(F.floor((F.col(at) - after) / F.lit(width)), F.floor((F.col(at) + before) / F.lit(width))))
    x = df.where(F.col(at).isNotNull()).withColumn("__own", own).withColumn("__blk", blocks)
    w = W.partitionBy(*key, "__blk").orderBy(at).rangeBetween(-before, after)
    x = x.withColumn(out, F.count(F.lit(1)).over(w)).where("__blk = __own").drop("__own", "__blk")
    return x.unionByName(df.where(F.col(at).isNull()).withColumn(out, F.lit(None).cast("long")))


def blocked_lag(df: DataFrame, key: list[str], order: str, value: list[str], out: str, width: int = 1000) -> DataFrame:
    """df with `out`: a struct of order and value columns of the row before, by `order` (an integer) within key; null for the first.

    Order values are unique within a key. The window inside a block of `width` order values sees at most `width` rows;
    the first row of a block takes the last row of the nearest block before it, found among one row per block.
    """
    blk = F.floor(F.col(order) / F.lit(width)).alias("__blk")
    this = F.struct(F.col(order), *value)
    df = df.withColumn("__blk", blk).withColumn("__this", this)
    inside = W.partitionBy(*key, "__blk").orderBy(order)
    ends = df.groupBy(*key, "__blk").agg(F.max_by("__this", order).alias("__end"))
    ends = ends.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), F.col("__blk").alias("__b"), F.lag("__end").over(W.partitionBy(*key).orderBy("__blk")).alias("__before"))
    same = (F.col("__blk") == F.col("__b")) & _null_safe(key, [f"__k{i}" for i in range(len(key))])
    joined = df.withColumn(out, F.lag("__this").over(inside)).join(ends, same, "left")
    return joined.withColumn(out, F.coalesce(out, "__before")).drop("__blk", "__this", "__b", "__before", *(f"__k{i}" for i in range(len(key))))


def per_block(df: DataFrame, key: list[str], summaries: list, carried: list) -> DataFrame:
    """df (with __blk) joined with what one window over one row per block says: `summaries` are aggregates, `carried` columns over W of them."""
    names = [f"__p{i}" for i in range(len(key))]
    per = df.groupBy(*key, "__blk").agg(*summaries)
    per = per.select(*(F.col(k).alias(n) for k, n in zip(key, names)), F.col("__blk").alias("__pb"), *carried)
    return df.join(per, _null_safe([*key, "__blk"], [*names, "__pb"]), "left").drop(*names, "__pb")


def running(df: DataFrame, key: list[str], order: str, sums: list[str], next_: str, width: int) -> DataFrame:
    """df with run_<sum> (the sum of each column up to and with the row, by `order` within key) and `next_` (the order value of the next row).

    Order values are whole numbers and occur once per key. Windows hold the rows of one block of `width` order values; sums and the first
    place of the blocks around come from one row per block.
    """
    x = df.withColumn("__blk", F.floor(F.col(order) / F.lit(width)))
    w = W.partitionBy(*key).orderBy("__blk")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    x = per_block(x, key, [*(F.sum(s).alias(f"__s_{s}") for s in sums), F.min(order).alias("__first")], [*(F.sum(f"__s_{s}").over(before).alias(f"__b_{s}") for s in sums), F.lead("__first").over(w).alias("__then")])
    inside = W.partitionBy(*key, "__blk").orderBy(order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({**{f"run_{s}": F.sum(s).over(upto) + F.coalesce(f"__b_{s}", F.lit(0)) for s in sums}, next_: F.coalesce(F.lead(order).over(inside), "__then")})
    return x.drop("__blk", "__then", *(f"__b_{s}" for s in sums))


def numbered(df: DataFrame, key: list[str], at: str, order: list[str], out: str, width: int = 1 << 20) -> DataFrame:
    """df with `out`: the row's number from 1 by `order` (which begins with the whole number `at`) within key; rows without `at` come first."""
    x = df.withColumn("__blk", F.floor(F.col(at) / F.lit(width)))
    before = W.partitionBy(*key).orderBy(F.col("__blk").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    x = per_block(x, key, [F.count(F.lit(1)).alias("__n")], [F.sum("__n").over(before).alias("__before")])
    return x.withColumn(out, F.coalesce("__before", F.lit(0)) + F.row_number().over(W.partitionBy(*key, "__blk").orderBy(*order))).drop("__blk", "__before")


def neighbours(df: DataFrame, key: list[str], at: str, row: str, value: list[str], before: str, after: str, width: int = 1 << 20) -> DataFrame:
    """df with the structs `before` and `after`: at, row and value columns of the rows next to a row, by (at, row) within key. Rows without `at` have none."""
    this = F.struct(at, row, *value)
    x = df.withColumn("__blk", F.floor(F.col(at) / F.lit(width))).withColumn("__this", F.when(F.col(at).isNotNull(), this))
    w = W.partitionBy(*key).orderBy("__blk")
    x = per_block(x, key, [F.min("__this").alias("__lo"), F.max("__this").alias("__hi")], [F.lag("__hi").over(w).alias("__left"), F.lead("__lo").over(w).alias("__right")])
    inside = W.partitionBy(*key, "__blk").orderBy(at, row)
    have = F.col(at).isNotNull()
    x = x.withColumns({before: F.when(have, F.coalesce(F.lag("__this").over(inside), "__left")), after: F.when(have, F.coalesce(F.lead("__this").over(inside), "__right"))})
    return x.drop("__blk", "__this", "__left", "__right")
