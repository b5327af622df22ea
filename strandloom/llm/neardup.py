"""Near-duplicate records by the items they share, without comparing all pairs.

Two item sets of a and b items with similarity (shared over all) of at least t differ in at most
d = (a + b)(1 - t)/(1 + t) items. If the universe of items is cut into more than d blocks, the two sets agree wholly in
at least one block (pigeonhole). So each set is fingerprinted per block, sets are joined on equal block fingerprints, the
Hamming distance of 32-bit parity fingerprints (never above the number of differing items) discards most candidates,
and the rest are verified on the items themselves. A set is fingerprinted for every level of d that a set alike to it may call for, at any
threshold. Blocks are balanced by how much the items under a key tell, so that none is left with
common items only, and the more sets there are the more blocks a signature joins (see Blocks). Both change the speed, never the result.

A record is one set: of a record delivered again the text that sorts first counts. Exact copies are one class and are compared
once. Signatures are counted by an aggregate that combines before its shuffle, and the count joined back, so that no task holds all sets of a
signature. Buckets with many classes are parted again, exactly: sets that are
alike share one of their first items in any fixed order, so such buckets are joined on that item as well.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.graph import connected_components
from ..session import materialize

THRESHOLD = (4, 5)
#: Keys ranked for balancing the blocks, and classes in a bucket from which it is parted again.
RANKED_KEYS = 256
HOT = 64
#: Most signatures of a set at one level of differences; beyond it a signature is of one block.
MOST_CHOICES = 2000
#: Numbers held at once while signatures are made, whatever the length of the sets.
CELLS = 1 << 22
#: An item is coded as its key's rank (11 bits) above 52 bits of its hash; codes of one set ascend from the most telling key.
_RANKS, _BITS = 2048, 52


def _items(text: Column, sep: str) -> Column:
    parts = F.transform(F.split(text, re.escape(sep)), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


class Blocks:
    """How item keys are dealt out to blocks, and how many blocks a signature joins.

    A key (text before =) tells as many bits as make two random sets agree on it with chance 2^-bits, absence included. Keys
    are known by rank, most telling first; each goes to the block that tells least so far. If d differences are allowed,
    the universe is cut into d + c blocks, of which at least c agree; a signature is one choice of c blocks. c is what makes
    signatures and chance meetings together fewest for the number of sets, so meetings stay in proportion as sets grow.
    """

    def __init__(self, bits: list[float], sets: int = 0) -> None:
        self.bits, self.sets, self.tables, self.joins = bits, sets, {}, {}

    def deal(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each rank, bits of each block."""
        if k not in self.tables:
            block, load = np.arange(_RANKS) % k, np.zeros(k)
            for r, b in enumerate(self.bits):
                block[r] = int(load.argmin())
                load[block[r]] += b
            self.tables[k] = block, load
        return self.tables[k]

    def join(self, d: int) -> int:
        """How many blocks a signature joins for d allowed differences."""
        if d not in self.joins:
            cost = {}
            for c in (1, 2, 3):
                n = math.comb(d + c, c)
                if c == 1 or n <= MOST_CHOICES:
                    rows = np.array(list(itertools.combinations(range(d + c), c)), np.int64).reshape(-1, c)
                    cost[c] = n + self.sets / 2 * float(np.exp2(-self.deal(d + c)[1][rows].sum(1)).sum())
            self.joins[d] = min(cost, key=cost.get)
        return self.joins[d]

    def choices(self, d: int) -> np.ndarray:
        """The choices of blocks for d allowed differences, one per row."""
        c = self.join(d)
        return np.array(list(itertools.combinations(range(d + c), c)), np.int64).reshape(-1, c)


def _key_bits(items: DataFrame) -> tuple[dict[str, int], Blocks]:
    """Ranks of at most RANKED_KEYS item keys, and their bits, from counts over all rows."""
    keys = items.select(F.explode("items").alias("i")).select(F.substring_index("i", "=", 1).alias("k"), "i")
    top = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("i", 0.1).alias("v")).orderBy(F.desc("v"), "k").limit(RANKED_KEYS).collect()
    most = max((r["n"] for r in top), default=1)
    tell = {r["k"]: -math.log2(max(1e-12, (r["n"] / most) ** 2 / max(1, r["v"]) + (1 - r["n"] / most) ** 2)) for r in top}
    order = sorted(tell, key=lambda k: (-tell[k], k))
    return {k: i for i, k in enumerate(order)}, Blocks([tell[k] for k in order])


def item_sets(df: DataFrame, record: str, text: str, sep: str = ";") -> tuple[DataFrame, Blocks]:
    """(sets, blocks); sets, a written table of one row per record: record, key (16 bytes, equal for equal sets), items (distinct, trimmed, not empty, in order, joined by sep), codes (sorted).
    Null and empty texts have none; of several texts of a record the least counts, before anything is compared."""
    rows = df.select(F.col(record).alias("record"), F.col(text).cast("string").alias("text")).where("record is not null and text is not null")
    ranks, blocks = _key_bits(rows.select(_items(F.col("text"), sep).alias("items")))
    known = F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)) if ranks else F.create_map(F.lit(""), F.lit(0))

    def code(x: Column) -> Column:
        k = F.substring_index(x, "=", 1)
        rank = F.coalesce(F.try_element_at(known, k), F.lit(RANKED_KEYS) + F.pmod(F.xxhash64(k), F.lit(_RANKS - RANKED_KEYS)).cast("int"))
        return F.shiftleft(rank.cast("long"), _BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(x), 64 - _BITS))

    sets = rows.groupBy("record").agg(F.min("text").alias("text")).select("record", F.array_sort(_items(F.col("text"), sep)).alias("items")).where(F.size("items") > 0)
    return materialize(sets.select("record", F.unhex(F.md5(F.array_join("items", "\n"))).alias("key"), F.array_join("items", sep).alias("items"), F.array_sort(F.transform("items", code)).alias("codes"))), blocks


def _ladder(x: int) -> int:
    return 1 << max(0, math.ceil(math.log2(x)))


def _signatures(num: int, den: int, blocks: Blocks):
    """Rows (sig, id, n, d, fp) from (id, codes): for each number d of differences a set alike to it may call for, one per choice of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = lambda m: (m * (den - num)) // (den + num)
        step = np.vectorize(lambda x: _ladder(x + 1) - 1, otypes=[np.int64])
        for b in batches:
            if not b.num_rows:
                continue
            codes, ids = b.column("codes"), b.column("id")
            starts = np.asarray(codes.offsets).astype(np.int64)
            n = np.diff(starts)
            starts = starts[:-1] - starts[0]
            h = codes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            mixed = _mixed(h)
            fp = np.zeros(len(n), np.uint32)
            np.bitwise_xor.at(fp, np.repeat(np.arange(len(n)), n), np.uint32(1) << (mixed >> np.uint64(59)).astype(np.uint32))
            low, high = step(far(n + -(-n * num // den))), step(far(n + n * den // num))
            d = 1  # no difference allowed: only copies
            while d <= high.max():
                own = np.flatnonzero((low <= d) & (d <= high))
                choice = blocks.choices(d) if len(own) else None
                while len(own):
                    k = d + choice.shape[1]
                    room = np.searchsorted(np.cumsum(n[own]), CELLS, "right")
                    some = own[: max(1, min(room, CELLS // max(k, choice.size)))]
                    own = own[len(some) :]
                    m = n[some]
                    at = np.repeat(starts[some] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    sig = np.zeros(len(some) * k, np.uint64)
                    np.bitwise_xor.at(sig, np.repeat(np.arange(len(some)) * k, m) + blocks.deal(k)[0][(h[at] >> np.uint64(_BITS)).astype(np.int64)], mixed[at])
                    sig = _mixed(sig.reshape(-1, k) + np.arange(k, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(k))
                    s = np.bitwise_xor.reduce(sig[:, choice], 2)
                    row = np.repeat(some, len(choice))
                    cols = [pa.array(s.ravel().view(np.int64)), ids.take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(np.full(len(row), d, np.int32)), pa.array(fp[row].view(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["sig", "id", "n", "d", "fp"])
                d = 2 * d + 1

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def alike_classes(sets: DataFrame, blocks: Blocks, num: int = THRESHOLD[0], den: int = THRESHOLD[1], sep: str = ";") -> DataFrame:
    """key_a, key_b of every two different sets alike by at least num/den.

    Classes are written once under short ids; block signatures are written once and counted, and those that
    occur once go no further; items are fetched only to verify what the fingerprints let through.
    """
    classes = materialize(sets.groupBy("key").agg(F.min(F.struct("record", "codes")).alias("c")).select("key", "c.record", "c.codes", F.monotonically_increasing_id().alias("id")))
    coded = classes.select("id", "codes")
    blocks.sets = classes.count()
    blocks.joins.clear()
    sigs = materialize(coded.mapInArrow(_signatures(num, den, blocks), "sig long, id long, n int, d int, fp int"))
    often = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    sigs = materialize(sigs.join(often, "sig"))
    far = f"(((a.n + b.n) * {den - num}) div {den + num})"
    near = F.expr(f"a.id < b.id and a.d = b.d and a.d >= {far} and a.n * {num} <= b.n * {den} and b.n * {num} <= a.n * {den} and bit_count(cast(a.fp ^ b.fp as bigint) & 4294967295) <= {far}")
    cool, hot = sigs.where(F.col("m") <= HOT), sigs.where(F.col("m") > HOT)
    pairs = cool.alias("a").join(cool.alias("b"), (F.col("a.sig") == F.col("b.sig")) & near).select("a.id", F.col("b.id").alias("id_b"))
    if not hot.isEmpty():
        # the first n - ceil(n num / den) + 1 codes: alike sets share one of them
        firsts = F.slice("codes", 1, F.size("codes") - F.ceil(F.size("codes") * F.lit(num) / den).cast("int") + 1)
        parted = materialize(hot.join(coded.select("id", F.explode(firsts).alias("item")), "id"))
        more = parted.alias("a").join(parted.alias("b"), (F.col("a.sig") == F.col("b.sig")) & (F.col("a.item") == F.col("b.item")) & near)
        pairs = pairs.unionByName(more.select("a.id", F.col("b.id").alias("id_b")))
    pairs = pairs.withColumnRenamed("id", "id_a").distinct()
    # the items of a class are those of its least record, the one row of the table of sets that is needed
    named = classes.select("id", "record")
    pairs = pairs.join(named.select(F.col("id").alias("id_a"), F.col("record").alias("ra")), "id_a").join(named.select(F.col("id").alias("id_b"), F.col("record").alias("rb")), "id_b").select("ra", "rb")
    a, b = (sets.select(F.col("record").alias(f"r{x}"), F.col("key").alias(f"key_{x}"), F.col("items").alias(x)) for x in "ab")
    both = pairs.join(a, "ra").join(b, "rb").select("key_a", "key_b", *(F.split(x, re.escape(sep)).alias(x) for x in "ab"))
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared * den >= (F.size("a") + F.size("b") - shared) * num).select("key_a", "key_b")


def alike_pairs(df: DataFrame, record: str, text: str, sep: str = ";", num: int = THRESHOLD[0], den: int = THRESHOLD[1]) -> DataFrame:
    """record_a < record_b: every two different records alike by at least num/den, copies included. Null and empty texts are never alike; of a record
    delivered with several texts the least counts. An empty table gives no rows; other columns are ignored."""
    sets, blocks = item_sets(df, record, text, sep)
    pairs = materialize(alike_classes(sets, blocks, num, den, sep))
    a, b = sets.select(F.col("key").alias("key_a"), F.col("record").alias("ra")), sets.select(F.col("key").alias("key_b"), F.col("record").alias("rb"))
    across = pairs.join(a, "key_a").join(b, "key_b").select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"))
    copies = a.join(b, (F.col("key_a") == F.col("key_b")) & (F.col("ra") < F.col("rb"))).select(F.col("ra").alias("record_a"), F.col("rb").alias("record_b"))
    return across.unionByName(copies)


def alike_groups(df: DataFrame, record: str, text: str, sep: str = ";", num: int = THRESHOLD[0], den: int = THRESHOLD[1]) -> DataFrame:
    """One row per record with a text: record, class_key (of its exact copies), group_id (least class_key linked to it by any
    chain of alike sets), n_copies (records of its class), n_links (other records alike to it, copies included)."""
    sets, blocks = item_sets(df, record, text, sep)
    pairs = materialize(alike_classes(sets, blocks, num, den, sep).select(F.hex("key_a").alias("key_a"), F.hex("key_b").alias("key_b")))
    sets = sets.select("record", F.hex("key").alias("key"))
    sizes = sets.groupBy("key").agg(F.count(F.lit(1)).alias("n_records"))
    both = pairs.unionByName(pairs.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    links = both.join(sizes.withColumnRenamed("key", "key_b"), "key_b").groupBy(F.col("key_a").alias("key")).agg(F.sum("n_records").alias("others"))
    comp = connected_components(pairs, "key_a", "key_b")
    per = sizes.join(links, "key", "left").join(comp.select(F.col("node").alias("key"), "component"), "key", "left")
    per = per.select("key", F.coalesce("component", "key").alias("group_id"), F.col("n_records").alias("n_copies"), (F.col("n_records") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return sets.select("record", "key").join(per, "key").select("record", F.col("key").alias("class_key"), "group_id", "n_copies", "n_links")
