"""Streaming twins: interval maps kept per entity and block while sites arrive, windowed counts with a watermark, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.periods import IntervalMap

BLOCK_BITS = 20


def live_periods(stream: DataFrame, entity: str, start: str, end: str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """entity, block, start_pos, end_pos, n_gaps: after each batch, the periods it changed, of each (entity, block of positions).

    State is an ordered disjoint-interval map per (entity, block), so one entity spreads over many state keys; intervals over several
    blocks are cut at their borders, so a period over several blocks comes as one piece per block; n_gaps counts the gaps inside the block. The batch operator
    (periods_and_gaps) closes the pieces and lists the gaps. Output mode update; a period that grew comes again with its new ends. Null ends are left out.
    """
    lo, hi = F.least(start, end).cast("long"), F.greatest(start, end).cast("long")
    x = stream.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.col(entity).cast("string").alias("entity"), lo.alias("s"), hi.alias("e"))
    x = x.withColumn("block", F.explode(F.sequence(F.shiftright("s", block_bits), F.shiftright("e", block_bits))))
    size = 1 << block_bits
    x = x.withColumn("s", F.greatest("s", F.col("block") * size)).withColumn("e", F.least("e", F.col("block") * size + size - 1))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = IntervalMap()
        if state.exists:
            starts, ends = state.get
            m.starts, m.ends = list(starts), list(ends)
        before = set(zip(m.starts, m.ends))
        for f in frames:
            for s, e in zip(f["s"], f["e"]):
                m.insert(int(s), int(e))
        state.update((m.starts, m.ends))
        new = [p for p in zip(m.starts, m.ends) if p not in before]
        yield pd.DataFrame({"entity": [key[0]] * len(new), "block": [key[1]] * len(new), "start_pos": [p[0] for p in new], "end_pos": [p[1] for p in new], "n_gaps": [len(m) - 1] * len(new)})

    return x.groupBy("entity", "block").applyInPandasWithState(step, "entity string, block long, start_pos long, end_pos long, n_gaps long", "starts array<long>, ends array<long>", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, key: str, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """window start, key, n: tumbling or sliding counts; rows later than the watermark are left out of closed windows."""
    w = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n of sessions parted by a gap: islands in time."""
    x = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return x.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
