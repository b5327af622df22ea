"""Column expressions on CIGAR strings, split-alignment tags and strands. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that use up reference or query.
REFERENCE_OPS = ("M", "D", "N", "=", "X")
QUERY_OPS = ("M", "I", "S", "=", "X")
ALIGNED_OPS = ("M", "=", "X")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse(cigar: Column | str) -> Column:
    """ARRAY<STRUCT<len INT, op STRING>>; null, empty and * give an empty array."""
    each = F.regexp_extract_all(F.coalesce(_c(cigar), F.lit("")), F.lit("\\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(each, lambda x: F.struct(F.regexp_extract(x, "\\d+", 0).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def op_count(cigar: Column | str) -> Column:
    return F.size(parse(cigar))


def total(cigar: Column | str, ops: tuple[str, ...]) -> Column:
    """Sum of the lengths of the given operations."""
    kept = F.filter(parse(cigar), lambda x: x["op"].isin(*ops))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x["len"])


def reference_length(cigar: Column | str) -> Column:
    return total(cigar, REFERENCE_OPS)


def query_length(cigar: Column | str) -> Column:
    return total(cigar, QUERY_OPS)


def _end_clip(cigar: Column | str, ops: str, left: bool) -> Column:
    pattern = f"^(\\d+)[{ops}]" if left else f"(\\d+)[{ops}]$"
    n = F.regexp_extract(F.coalesce(_c(cigar), F.lit("")), pattern, 1)
    return F.coalesce(F.when(n != "", n.cast("int")), F.lit(0))


def left_clip(cigar: Column | str, hard: bool = False) -> Column:
    """Length of the clip at the left end, soft or with `hard` either kind; 0 if none."""
    return _end_clip(cigar, "SH" if hard else "S", True)


def right_clip(cigar: Column | str, hard: bool = False) -> Column:
    return _end_clip(cigar, "SH" if hard else "S", False)


def has_op(cigar: Column | str, op: str, least: int) -> Column:
    """Whether an operation of at least this length occurs."""
    return F.exists(parse(cigar), lambda x: (x["op"] == op) & (x["len"] >= least))


def aligned_bases(cigar: Column | str, gaps_under: int = 30) -> Column:
    """Aligned bases plus the gaps shorter than gaps_under."""
    kept = F.filter(parse(cigar), lambda x: x["op"].isin(*ALIGNED_OPS) | (x["op"].isin("I", "D") & (x["len"] < gaps_under)))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x["len"])


def walk(cigar: Column | str, pos: Column | str) -> Column:
    """ARRAY<STRUCT<idx, op, len, ref_start>>: every operation with the reference position it starts at."""
    start = F.struct(_c(pos).cast("long").alias("at"), F.array().cast("array<struct<idx:int,op:string,len:int,ref_start:bigint>>").alias("out"))

    def step(acc, x):
        one = F.struct(F.size(acc["out"]).alias("idx"), x["op"].alias("op"), x["len"].alias("len"), acc["at"].alias("ref_start"))
        on = F.when(x["op"].isin(*REFERENCE_OPS), x["len"]).otherwise(0)
        return F.struct((acc["at"] + on).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(parse(cigar), start, step, lambda acc: acc["out"])


def extended_gap(gaps: Column, extend: int = 15, divergence: float = 0.02) -> Column:
    """Length of the longest gap with its neighbours added (W09): walking outward, first left then right, while a gap starts within
    min(3 length, log2(1 + length)/divergence) of it; gaps over `extend` add their length. gaps: ARRAY<STRUCT<s, n>> (start, length) in order."""
    n = F.transform(gaps, lambda g: g["n"])
    k = F.array_position(n, F.array_max(n)).cast("int")
    first = F.element_at(gaps, k)

    def walk_out(side: Column, total: Column) -> Column:
        def step(acc: Column, g: Column) -> Column:
            reach = F.least(3.0 * acc["t"], F.log2(1.0 + acc["t"]) / divergence)
            near = acc["o"] & (F.abs(g["s"] - first["s"]) <= reach)
            return F.struct(F.when(near & (g["n"] > extend), acc["t"] + g["n"]).otherwise(acc["t"]).alias("t"), near.alias("o"))

        return F.aggregate(side, F.struct(total.alias("t"), F.lit(True).alias("o")), step, lambda acc: acc["t"])

    left = F.reverse(F.slice(gaps, F.lit(1), k - 1))
    right = F.slice(gaps, k + 1, F.size(gaps))
    return F.when(F.size(gaps) > 0, walk_out(right, walk_out(left, first["n"])))


def query_interval(cigar: Column | str, reverse: Column) -> tuple[Column, Column]:
    """Start and end on the read as sequenced: clips of either kind count, and strands read from the other end (X11)."""
    lead, trail = left_clip(cigar, True), right_clip(cigar, True)
    inner = total(cigar, ("M", "I", "=", "X"))
    start = F.when(reverse, trail).otherwise(lead).cast("long")
    return start, start + inner


def split_alignments(sa: Column | str) -> Column:
    """ARRAY<STRUCT<chrom, pos, strand, cigar, mapq, nm>> from an SA tag (chrom,pos,strand,cigar,mapq,nm;...)."""
    each = F.filter(F.split(F.coalesce(_c(sa), F.lit("")), ";"), lambda x: F.size(F.split(x, ",")) == 6)

    def one(x):
        p = F.split(x, ",")
        return F.struct(F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).try_cast("int").alias("pos"), F.get(p, F.lit(2)).alias("strand"), F.get(p, F.lit(3)).alias("cigar"), F.get(p, F.lit(4)).try_cast("int").alias("mapq"), F.get(p, F.lit(5)).try_cast("int").alias("nm"))

    return F.transform(each, one)


def flag(bit: int, column: Column | str = "flag") -> Column:
    return _c(column).bitwiseAND(F.lit(bit)) != 0


def reverse_complement(seq: Column | str) -> Column:
    """Reverse complement that keeps the case of each base."""
    return F.reverse(F.translate(_c(seq), "ACGTUacgtu", "TGCAAtgcaa"))


def gc_percent(seq: Column | str) -> Column:
    """Share of G and C among A, C, G and T in percent; null without any."""
    s = F.upper(_c(seq))
    gc, at = F.length(F.regexp_replace(s, "[^GC]", "")), F.length(F.regexp_replace(s, "[^AT]", ""))
    return F.when(gc + at > 0, 100.0 * gc / (gc + at))


def end_position(svtype: Column | str, pos: Column | str, length: Column | str) -> Column:
    """End of an event inside a read: an insertion ends one base on, the rest by their length."""
    return F.when(_c(svtype) == "INS", _c(pos) + 1).otherwise(_c(pos) + _c(length))
