"""Continuous periods and gaps of intervals that overlap, nest or leave gaps.

Every entity keeps an ordered map of disjoint intervals in keyed state. An inserted interval finds the
neighbours it touches by binary search, swallows them, and the gaps are what is left between neighbours.

One entity may hold any share of the rows, so the state is kept per (entity, block of start positions):

1. map side: each task folds its own rows into such maps, so repeated and nested intervals never reach the shuffle;
2. one row per block says how far the blocks before it reach (a running maximum over block rows, not over data rows);
3. after one shuffle on (entity, block) the maps are completed, knowing that reach. Periods and gaps inside a block
   are final; the one period that may run on into later blocks stays open;
4. open periods, at most one per block, are closed by a window over block rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Positions per block, as a power of two.
BLOCK_BITS = 20
#: Intervals the map-side fold holds before it hands them on.
FOLD_ROWS = 200_000
_BATCH = 20_000


class IntervalMap:
    """Ordered disjoint closed intervals over integers; neighbours without a position between them are one."""

    __slots__ = ("ends", "starts")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def insert(self, start: int, end: int) -> None:
        i = bisect_left(self.ends, start - 1)
        j = bisect_right(self.starts, end + 1)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j] = [start]
        self.ends[i:j] = [end]

    def insert_runs(self, starts: np.ndarray, ends: np.ndarray) -> None:
        """Insert runs that are disjoint and in order; many at once are merged as arrays."""
        if len(starts) <= 64 or len(starts) * 8 < len(self.starts):
            for s, e in zip(starts.tolist(), ends.tolist()):
                self.insert(s, e)
            return
        s = np.concatenate([np.asarray(self.starts, np.int64), starts])
        e = np.concatenate([np.asarray(self.ends, np.int64), ends])
        s, e, _ = merge_runs(s, e, np.zeros(len(s), np.int64))
        self.starts, self.ends = s.tolist(), e.tolist()

    def gaps(self) -> list[tuple[int, int]]:
        return [(e + 1, s - 1) for e, s in zip(self.ends, self.starts[1:])]

    def __len__(self) -> int:
        return len(self.starts)


def merge_runs(s: np.ndarray, e: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint runs of intervals per key, in order of key and start."""
    if not len(s):
        return s, e, key
    order = np.lexsort((s, key))
    s, e, key = s[order], e[order], key[order]
    reach = pd.Series(e).groupby(key).cummax().to_numpy()
    new = np.ones(len(s), bool)
    new[1:] = (key[1:] != key[:-1]) | (s[1:] - 1 > reach[:-1])
    at = np.flatnonzero(new)
    return s[at], np.maximum.reduceat(e, at), key[at]


def _codes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """A number per row, equal for rows with equal keys (null equals null) within the batch."""
    out = np.zeros(batch.num_rows, np.int64)
    for n in names:
        idx = batch.column(n).dictionary_encode()
        code = pd.Series(idx.indices.to_pandas()).fillna(-1).to_numpy(np.int64) + 1
        out = pd.factorize(out * (len(idx.dictionary) + 2) + code)[0].astype(np.int64)
    return out


def _fold(keys: list[str], limit: int):
    """Map side: keyed interval maps over the rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, IntervalMap] = {}
        held, types = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[] for _ in range(len(keys) + 2)]
            for k, m in state.items():
                for c, v in zip(cols, k):
                    c.extend([v] * len(m))
                cols[-2].extend(m.starts)
                cols[-1].extend(m.ends)
            state.clear()
            for at in range(0, len(cols[-1]), _BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + _BATCH], t) for c, t in zip(cols, types)], names=[*keys, "s", "e"])

        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(n).type for n in keys] + [pa.int64(), pa.int64()]
            code = _codes(b, keys)
            first = np.full(code.max() + 1, -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            s, e, k = merge_runs(b.column("s").to_numpy(zero_copy_only=False), b.column("e").to_numpy(zero_copy_only=False), code)
            cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
            rows = [b.column(n).take(pa.array(first[k[cut[:-1]]])).to_pylist() for n in keys]
            for i, key in enumerate(zip(*rows)):
                m = state.get(key)
                if m is None:
                    m = state[key] = IntervalMap()
                held -= len(m)
                m.insert_runs(s[cut[i] : cut[i + 1]], e[cut[i] : cut[i + 1]])
                held += len(m)
            if held > limit:
                yield from flush()
                held = 0
        if state:
            yield from flush()

    return run


def _complete(keys: list[str]):
    """Reduce side: rows come sorted by key, the row without a start first; it says how far earlier blocks reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        m, carry, top, types = IntervalMap(), None, None, None
        out: list[list] = [[] for _ in range(len(keys) + 5)]

        def put(kind: str, s, e, before=None, last=None) -> None:
            for c, v in zip(out, (*key[:-1], key[-1], kind, s, e, before, last)):
                c.append(v)

        def finish() -> None:
            starts, ends = m.starts, m.ends
            i, reach = 0, carry
            if carry is not None:  # what earlier blocks cover, or touch, belongs to an open period of theirs
                i = bisect_right(starts, carry + 1)
                reach = max([carry, *ends[i - 1 : i]])
            if i == len(starts):
                return
            if carry is not None:
                put("gap", reach + 1, starts[i] - 1)
            for j in range(i, len(starts) - 1):
                put("period", starts[j], ends[j])
                put("gap", ends[j] + 1, starts[j + 1] - 1)
            put("open", starts[-1], None, reach if carry is not None else None, top)

        def batch() -> pa.RecordBatch:
            r = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[*keys, "kind", "s", "e", "before", "last"])
            for c in out:
                c.clear()
            return r

        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(n).type for n in keys] + [pa.string()] + [pa.int64()] * 4
            code = _codes(b, keys)
            cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
            heads = list(zip(*(b.column(n).take(pa.array(cut[:-1])).to_pylist() for n in keys)))
            s = b.column("s").to_pandas().to_numpy(float)
            e_all = b.column("e")
            for i, k in enumerate(heads):
                lo, hi = int(cut[i]), int(cut[i + 1])
                if k != key:
                    if key is not None:
                        finish()
                        if len(out[0]) > _BATCH:
                            yield batch()
                    key, m, carry, top = k, IntervalMap(), None, None
                if np.isnan(s[lo]):
                    carry, top = e_all[lo].as_py(), b.column("last")[lo].as_py()
                    lo += 1
                if lo < hi:
                    ss = b.column("s").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
                    ee = e_all.slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
                    ms, me, _ = merge_runs(ss, ee, np.zeros(hi - lo, np.int64))
                    m.insert_runs(ms, me)
        if key is not None:
            finish()
        if out[0]:
            yield batch()

    return run


def periods_and_gaps(df: DataFrame, entity: list[str], start: Column | str, end: Column | str, block_bits: int = BLOCK_BITS, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Continuous periods and the gaps between them, per entity.

    Returns the entity columns, kind (period, gap), start_pos, end_pos; both ends belong to the stretch and
    stretches next to each other are one. Rows with a null end are left out, ends in wrong order are swapped,
    repeated rows change nothing, a null entity value is an entity of its own, an empty table gives no rows.
    Columns other than those named are ignored, whatever their names.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    keys = [f"k{i}" for i in range(len(entity))]
    a, b = c(start).cast("long"), c(end).cast("long")
    base = df.where(a.isNotNull() & b.isNotNull()).select(*(F.col(x).alias(k) for x, k in zip(entity, keys)), F.least(a, b).alias("s"), F.greatest(a, b).alias("e"))
    base = base.select(*keys, F.shiftright("s", block_bits).alias("blk"), "s", "e")
    key_fields = [base.schema[k] for k in [*keys, "blk"]]
    key_fields = [T.StructField(f.name, f.dataType, True) for f in key_fields]
    longs = lambda *n: [T.StructField(x, T.LongType(), True) for x in n]

    folded = base.mapInArrow(_fold([*keys, "blk"], fold_rows), T.StructType([*key_fields, *longs("s", "e")]))
    order = W.partitionBy(*keys).orderBy("blk")
    reach = (
        base.groupBy(*keys, "blk").agg(F.max("e").alias("top"))
        .select(*keys, "blk", F.max("top").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("e"), F.max("top").over(W.partitionBy(*keys)).alias("last"))
        .select(*keys, "blk", F.lit(None).cast("long").alias("s"), "e", "last")
    )
    rows = folded.withColumn("last", F.lit(None).cast("long")).unionByName(reach)
    rows = rows.repartition(*keys, "blk").sortWithinPartitions(*keys, "blk", F.col("s").asc_nulls_first())
    done = rows.mapInArrow(_complete([*keys, "blk"]), T.StructType([*key_fields, T.StructField("kind", T.StringType(), True), *longs("s", "e", "before", "last")]))

    closed = done.where("kind <> 'open'").select(*keys, "kind", "s", "e")
    opened = done.where("kind = 'open'").select(*keys, F.lit("period").alias("kind"), "s", F.coalesce(F.lead("before").over(order), "last").alias("e"))
    return closed.unionByName(opened).select(*(F.col(k).alias(x) for k, x in zip(keys, entity)), "kind", F.col("s").alias("start_pos"), F.col("e").alias("end_pos"))
