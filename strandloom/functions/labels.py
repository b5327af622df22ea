"""Rules that classify a pair of alignments as a structural variant (X35), and helpers on such pairs.

A side is a struct of pos, stop, strand ('3' forward, '5' reverse), left, right (clip lengths), q_start, q_end (on the read as sequenced).
All rules are tables of (condition, type, join, whether a and b break at their stop, length); the first that holds decides. Its number is worked
out in a step of its own, so that each condition is compiled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cigar import flag, left_clip, query_interval, reference_length, right_clip


def side(pos: str = "pos", cigar: str = "cigar", flags: str = "flag") -> Column:
    reverse = flag(16, flags)
    q1, q2 = query_interval(cigar, reverse)
    at = F.col(pos).cast("long")
    return F.struct(at.alias("pos"), (at + reference_length(cigar)).alias("stop"), F.when(reverse, "5").otherwise("3").alias("strand"), left_clip(cigar, True).alias("left"), right_clip(cigar, True).alias("right"), q1.alias("q_start"), q2.alias("q_end"))


def _break(s: Column, at_stop: Column) -> Column:
    return F.when(at_stop, s["stop"]).otherwise(s["pos"])


def _precise(s: Column, at_stop: Column) -> Column:
    return F.when(at_stop, s["right"]).otherwise(s["left"]) > 0


def a_first(a: Column, b: Column) -> Column:
    """Whether a lies first: smaller position, at a tie the smaller end."""
    return (a["pos"] < b["pos"]) | ((a["pos"] == b["pos"]) & (a["stop"] <= b["stop"]))


def two_primary(a: Column, b: Column, first: Column) -> list[tuple]:
    """Both primary, on one chromosome: facing pairs are deletions (insertions where they overlap), outward pairs duplications, pairs of one strand inversions whose clips tell the junction."""
    none = F.lit(None)
    sa, sb = a["strand"], b["strand"]
    inward = (first & (sa == "3") & (sb == "5")) | (~first & (sa == "5") & (sb == "3"))
    outward = (first & (sa == "5") & (sb == "3")) | (~first & (sa == "3") & (sb == "5"))
    over = F.when(first, a["stop"] >= b["pos"]).otherwise(b["stop"] >= a["pos"])
    some_left, some_right = (a["left"] > 0) | (b["left"] > 0), (a["right"] > 0) | (b["right"] > 0)
    only_left, only_right = some_left & ~some_right, some_right & ~some_left
    ahead = a["pos"] < b["pos"]
    fwd_pos = only_left & F.when(first, ~((b["left"] > 0) & ahead)).otherwise(F.lit(True))
    return [
        (inward & over, "INS", "3to5", first, ~first, none),
        (inward, "DEL", "3to5", first, ~first, none),
        (outward, "DUP", "5to3", ~first, first, none),
        ((sa == "5") & only_right, "INV", "3to3", True, True, none),
        (sa == "5", "INV", "5to5", False, False, none),
        (fwd_pos, "INV", "5to5", False, False, none),
        (F.lit(True), "INV", "3to3", True, True, none),
    ]


def same_read(a: Column, b: Column, first: Column, overlaps_mate: Column) -> list[tuple]:
    """Primary and supplementary alignment of one read on one chromosome; q is the gap on the read, r the gap on the reference."""
    none = F.lit(None)
    same = a["strand"] == b["strand"]
    lo_stop, hi_pos = F.when(first, a["stop"]).otherwise(b["stop"]), F.when(first, b["pos"]).otherwise(a["pos"])
    q = F.when(first, b["q_start"] - a["q_end"]).otherwise(a["q_start"] - b["q_end"])
    r = hi_pos - lo_stop
    r = r + F.when(q < 0, F.abs(q)).otherwise(0)
    over = (F.least(a["stop"], b["stop"]) > F.greatest(a["pos"], b["pos"]))
    open_in = F.when(first, (a["left"] == 0) & (b["right"] == 0)).otherwise((b["left"] == 0) & (a["right"] == 0))
    open_out = F.when(first, (a["right"] == 0) & (b["left"] == 0)).otherwise((b["right"] == 0) & (a["left"] == 0))
    both_left, both_right = (a["left"] > 0) & (b["left"] > 0), (a["right"] > 0) & (b["right"] > 0)
    return [
        (same & over & first, "DUP", "5to3", a["right"] > a["left"], b["right"] > b["left"], none),
        (same & over, "INS", "5to3", False, True, q),
        (same & open_in & (r < q) & overlaps_mate, "DUP", "5to3", ~first, first, none),
        (same & open_in & (r < q), "INS", "3to5", first, ~first, q),
        (same & open_in, "DEL", "3to5", first, ~first, r),
        (same & open_out, "DUP", "5to3", ~first, first, none),
        (same & first & (a["left"] == 0) & (b["left"] == 0), "INV", "3to3", True, True, none),
        (same & first, "INV", "5to5", False, False, none),
        (same, "BND", F.concat(a["strand"], F.lit("to"), b["strand"]), a["strand"] == "3", b["strand"] == "3", none),
        (over & first & (a["strand"] == "5") & (b["strand"] == "3"), "DUP", "5to3", False, True, none),
        (both_left, "INV", "5to5", False, False, none),
        (both_right, "INV", "3to3", True, True, none),
        (a["strand"] == "5", "INV", "5to5", False, False, none),
        (F.lit(True), "INV", "3to3", True, True, none),
    ]


def different_read(a: Column, b: Column, first: Column) -> list[tuple]:
    """A supplementary and an alignment of the mate: opposite strands as for two primaries, facing ones insertions; equal strands by clips."""
    none = F.lit(None)
    sa, sb = a["strand"], b["strand"]
    inward = (first & (sa == "3") & (sb == "5")) | (~first & (sa == "5") & (sb == "3"))
    both_left, both_right = (a["left"] > 0) & (b["left"] > 0), (a["right"] > 0) & (b["right"] > 0)
    a_lo = F.when(first, (a["right"] > 0) & (b["left"] > 0)).otherwise((b["right"] > 0) & (a["left"] > 0))
    a_hi = F.when(first, (a["left"] > 0) & (b["right"] > 0)).otherwise((b["left"] > 0) & (a["right"] > 0))
    return [
        ((sa != sb) & inward, "INS", "3to5", first, ~first, none),
        (sa != sb, "DUP", "5to3", ~first, first, none),
        (both_left, "INV", "5to5", False, False, none),
        (both_right, "INV", "3to3", True, True, none),
        (a_lo, "DEL", "3to5", first, ~first, none),
        (a_hi, "DUP", "5to3", ~first, first, none),
        (sa == "5", "INV", "5to5", False, False, none),
        (F.lit(True), "INV", "3to3", True, True, none),
    ]


def translocation(a: Column, b: Column) -> list[tuple]:
    """Two chromosomes: a side with one clip breaks there; without or with two it breaks at its end if forward, else at its position, imprecisely."""
    def stop(s: Column) -> Column:
        left, right = s["left"] > 0, s["right"] > 0
        return F.when(left != right, right).otherwise(s["strand"] == "3")

    ea, eb = stop(a), stop(b)
    digit = lambda e: F.when(e, "3").otherwise("5")
    return [(F.lit(True), "TRA", F.concat(digit(ea), F.lit("to"), digit(eb)), ea, eb, F.lit(None))]


def classify(df: DataFrame, a: str, b: str, chrom_a: str, chrom_b: str, flag_a: str, flag_b: str) -> DataFrame:
    """Df with svtype, ct, break_a, break_b, precise_a, precise_b, length of the pair of sides a and b, by the rule table for its kind:
    over two chromosomes, both primary, a read and its supplementary, or different reads."""
    fa, fb, ca, cb, sa, sb = (F.col(x) for x in (flag_a, flag_b, chrom_a, chrom_b, a, b))
    primary = lambda f: f.bitwiseAND(2304) == 0
    kind = F.when(ca != cb, 0).when(primary(fa) & primary(fb), 1).when(fa.bitwiseAND(64) == fb.bitwiseAND(64), 2).otherwise(3)
    x = df.withColumn("__first", a_first(sa, sb)).withColumn("__kind", kind).withColumn("__mate", overlaps_mate(sa, sb, ca, cb, fa, fb))
    first = F.col("__first")
    tables = [translocation(sa, sb), two_primary(sa, sb, first), same_read(sa, sb, first, F.col("__mate")), different_read(sa, sb, first)]
    rules, number = [], None
    for k, t in enumerate(tables):
        own = None
        for r in t:
            own = F.when(r[0], len(rules)) if own is None else own.when(r[0], len(rules))
            rules.append(r)
        number = F.when(F.col("__kind") == k, own) if number is None else number.when(F.col("__kind") == k, own)
    x = x.withColumn("__rule", number)

    def pick(i: int, cast: str) -> Column:
        c = None
        for n, r in enumerate(rules):
            v = (r[i] if isinstance(r[i], Column) else F.lit(r[i])).cast(cast)
            c = F.when(F.col("__rule") == n, v) if c is None else c.when(F.col("__rule") == n, v)
        return c

    x = x.withColumn("__ea", pick(3, "boolean")).withColumn("__eb", pick(4, "boolean"))
    ea, eb = F.col("__ea"), F.col("__eb")
    one = lambda s: (s["left"] > 0) != (s["right"] > 0)
    sure = lambda s, e: F.when(F.col("__kind") == 0, one(s)).otherwise(_precise(s, e))
    new = {"svtype": pick(1, "string"), "ct": pick(2, "string"), "break_a": _break(sa, ea), "break_b": _break(sb, eb), "precise_a": sure(sa, ea), "precise_b": sure(sb, eb), "length": pick(5, "long")}
    return x.withColumns(new).drop("__first", "__kind", "__mate", "__rule", "__ea", "__eb")


def overlaps_mate(a: Column, b: Column, chrom_a: Column, chrom_b: Column, flag_a: Column, flag_b: Column) -> Column:
    """Paired, mate mapped, alignments of one read on one chromosome whose spans share a position."""
    near = F.greatest(a["pos"], b["pos"]) <= F.least(a["stop"], b["stop"])
    return (flag_a.bitwiseAND(1) != 0) & (flag_a.bitwiseAND(8) == 0) & (chrom_a == chrom_b) & (flag_a.bitwiseAND(64) == flag_b.bitwiseAND(64)) & near


def masked_clips(a: Column, b: Column) -> tuple[Column, Column]:
    """The two sides with at most one clip each: the longer one; at a tie the one that faces the partner."""
    def mask(s: Column, other: Column) -> Column:
        keep_right = (s["right"] > s["left"]) | ((s["right"] == s["left"]) & (s["pos"] <= other["pos"]))
        return s.withField("left", F.when(keep_right & (s["right"] > 0), 0).otherwise(s["left"])).withField("right", F.when(~keep_right & (s["left"] > 0), 0).otherwise(s["right"]))

    return mask(a, b), mask(b, a)
