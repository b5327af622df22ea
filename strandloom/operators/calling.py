"""From classified pairs to calls: pair selection, break points of clusters, evidence of normal reads, remapping, scores."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import cigar as cg
from ..functions import labels, sequence
from ..functions.geometry import alike_spans_filter
from ..session import materialize
from . import pairs


def informative_pairs(reads: DataFrame, template: str, row: str) -> DataFrame:
    """Template, a, b: the pair that tells most of a template, lower position first: a first-in-pair primary with its
    supplementary, else the second-in-pair one with its, else the two primaries. One aggregate per template; of several
    alignments of a kind the one with the greatest row counts."""
    first, supp = cg.flag(64), cg.flag(2304)
    top = lambda c: F.max_by(F.struct("pos", row), F.when(c, F.col(row)))
    t = reads.where(F.col(template).isNotNull()).groupBy(template).agg(top(first & ~supp).alias("p1"), top(first & supp).alias("s1"), top(~first & ~supp).alias("p2"), top(~first & supp).alias("s2"))
    x, y = F.col, F.lit(None)
    a = F.when(x("p1").isNotNull() & x("s1").isNotNull(), x("p1")).when(x("p2").isNotNull() & x("s2").isNotNull(), x("p2")).when(x("p1").isNotNull() & x("p2").isNotNull(), x("p1")).otherwise(y)
    b = F.when(x("p1").isNotNull() & x("s1").isNotNull(), x("s1")).when(x("p2").isNotNull() & x("s2").isNotNull(), x("s2")).when(x("p1").isNotNull() & x("p2").isNotNull(), x("p2")).otherwise(y)
    p = t.select(template, a.alias("a"), b.alias("b")).where("a is not null")
    low = F.col("a.pos") < F.col("b.pos")
    return p.select(template, F.when(low, F.col(f"a.{row}")).otherwise(F.col(f"b.{row}")).alias("a"), F.when(low, F.col(f"b.{row}")).otherwise(F.col(f"a.{row}")).alias("b"))


def classified_pairs(reads: DataFrame, template: str, row: str) -> DataFrame:
    """Template, a, b, chrom_a, chrom_b and svtype, ct, break_a, break_b, precise_a, precise_b, length of the informative pair of each template.
    Reads are fetched by an equi-join on their row, which is what late materialisation comes to in a table."""
    r = reads.select(row, "rname", "flag", labels.side().alias("side"))
    p = informative_pairs(reads, template, row)
    a = r.select(F.col(row).alias("a"), F.col("rname").alias("chrom_a"), F.col("flag").alias("fa"), F.col("side").alias("sa"))
    b = r.select(F.col(row).alias("b"), F.col("rname").alias("chrom_b"), F.col("flag").alias("fb"), F.col("side").alias("sb"))
    j = labels.classify(p.join(a, "a").join(b, "b"), "sa", "sb", "chrom_a", "chrom_b", "fa", "fb")
    return j.select(template, "a", "b", "chrom_a", "chrom_b", "svtype", "ct", "break_a", "break_b", "precise_a", "precise_b", "length")


def split_breaks(reads: DataFrame, template: str, row: str, low_mapq: int = 1) -> DataFrame:
    """Template, row, part (first in pair or not), place, mapq, chrom_a, chrom_b and the columns of classified_pairs for every junction of
    the SA tags. An SA tag names all other alignments of its read, so one row of a read is expanded, the primary where it is there. Junctions
    with an alignment under low_mapq are of type BND."""
    part = F.col("flag").bitwiseAND(64)
    w = W.partitionBy(F.coalesce(template, F.col(row).cast("string")), part).orderBy(cg.flag(2304), row)
    one = reads.where("sa is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    j = pairs.split_neighbours(one, row, low_mapq, sides=True).where("next_chrom is not null")
    j = j.join(one.select(row, template, F.col("flag").alias("fa"), part.alias("part")), row).withColumn("fa", F.col("fa").bitwiseAND(~2304)).withColumn("fb", F.col("fa").bitwiseOR(2048))
    # of the clips only the one at the junction counts: a middle alignment of three has two
    faces = lambda c, right: F.col(c).withField("left", F.when(right, 0).otherwise(F.col(c)["left"])).withField("right", F.when(right, F.col(c)["right"]).otherwise(0))
    j = j.withColumn("side", faces("side", F.col("side.strand") == "3")).withColumn("next_side", faces("next_side", F.col("next_side.strand") == "5"))
    low = F.col("pos") <= F.col("next_pos")
    j = j.select(template, row, "part", "place", "mapq", "junction", "fa", "fb", F.when(low, F.col("chrom")).otherwise(F.col("next_chrom")).alias("chrom_a"), F.when(low, F.col("next_chrom")).otherwise(F.col("chrom")).alias("chrom_b"), F.when(low, F.col("side")).otherwise(F.col("next_side")).alias("sa"), F.when(low, F.col("next_side")).otherwise(F.col("side")).alias("sb"))
    c = labels.classify(materialize(j), "sa", "sb", "chrom_a", "chrom_b", "fa", "fb")  # the sides are read many times by the rules
    kind = F.when(F.col("junction") == "BREAKEND", "BND").otherwise(F.col("svtype"))
    return c.select(template, row, "part", "place", "mapq", "chrom_a", "chrom_b", kind.alias("svtype"), "ct", "break_a", "break_b", "precise_a", "precise_b", "length")


def clip_breaks(reads: DataFrame, template: str, row: str, least: int) -> DataFrame:
    """template, row, chrom, side, at, mapq, mins: the soft clips of at least `least` bases of reads without an SA tag, with the minimizers of the
    clipped bases; none where the bases are not kept (* or not as many as the CIGAR says)."""
    whole = F.col("seq") if "seq" in reads.columns else F.lit(None).cast("string")
    whole = F.when(F.length(whole) == cg.query_length("cigar"), F.upper(whole))
    left, right = cg.left_clip("cigar"), cg.right_clip("cigar")
    ends = F.array(F.struct(F.lit("left").alias("side"), left.alias("n"), F.col("start").alias("at"), F.left(whole, left).alias("bases")), F.struct(F.lit("right").alias("side"), right.alias("n"), F.col("stop").alias("at"), F.right(whole, right).alias("bases")))
    c = reads.where("sa is null").where(F.greatest(left, right) >= least).select(template, row, F.col("rname").alias("chrom"), "mapq", F.explode(ends).alias("e")).where(F.col("e.n") >= least)
    return c.select(template, row, "chrom", "e.side", "e.at", "mapq", F.coalesce(pairs.minimizers(F.col("e.bases")), F.array().cast("array<bigint>")).alias("mins"))


def read_contigs(reads: DataFrame, row: str, pad: int = 500) -> DataFrame:
    """Row, contig: the bases of each read within `pad` of its longer clip (of its middle where it has none), clipped bases in lower case. Reads whose bases are not
    kept (* or not as many as the CIGAR says) give none."""
    n = cg.query_length("cigar")
    x = reads.where((F.length("seq") == n) & (n > 0)).select(row, F.upper("seq").alias("__s"), cg.left_clip("cigar").alias("__l"), cg.right_clip("cigar").alias("__r"))
    size = F.length("__s")
    whole = F.concat(F.lower(F.left("__s", F.col("__l"))), F.substr("__s", F.col("__l") + 1, F.greatest(F.lit(0), size - F.col("__l") - F.col("__r"))), F.lower(F.right("__s", F.col("__r"))))
    at = F.when((F.col("__l") == 0) & (F.col("__r") == 0), F.floor(size / 2)).when(F.col("__l") >= F.col("__r"), F.col("__l")).otherwise(size - F.col("__r"))
    return x.select(row, around_event(whole, at.cast("int"), pad).alias("contig"))


def consensus_by_component(contigs: DataFrame, part_size: int = 200, cased: bool = False, least: int = 50) -> DataFrame:
    """Component, n, consensus of contigs (component, contig). Equal contigs are one with a weight; a component of more than part_size different ones
    votes in salted parts, whose votes are laid together."""
    import json

    x = contigs.groupBy("component", "contig").agg(F.count(F.lit(1)).alias("copies"))
    n = x.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / part_size).alias("parts"))
    x = x.join(n, "component").withColumn("part", F.pmod(F.xxhash64("contig"), F.col("parts")))

    def vote(pdf: pd.DataFrame) -> pd.DataFrame:
        v = sequence.votes(pdf.contig.tolist(), pdf.copies.tolist(), cased)
        return pd.DataFrame({"component": [pdf.component.iloc[0]], "part": [pdf.part.iloc[0]], "copies": [pdf.copies.sum()], "votes": [json.dumps(v)]})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [json.loads(v) for v in pdf.sort_values(["copies", "part"], ascending=[False, True]).votes]
        copies = int(pdf.copies.sum())
        return pd.DataFrame({"component": [pdf.component.iloc[0]], "n": [copies], "consensus": [sequence.voted(sequence.merge_votes(parts), copies, least, cased)]})

    v = x.groupBy("component", "part").applyInPandas(vote, "component long, part long, copies long, votes string")
    return v.groupBy("component").applyInPandas(together, "component long, n long, consensus string")


def assemble(clusters: DataFrame, cluster: list[str], least: int = 3) -> DataFrame:
    """One call per cluster of classified pairs with at least `least` of its commonest type: type, chromosomes, median breaks with
    half their 95 % interval, preciseness, length (median of the inserted lengths for INS, else the distance of the breaks; null over chromosomes), support.

    Ties between types go to the first in order. Two aggregations, both combined before their shuffle but for the exact medians.
    """
    n = clusters.groupBy(*cluster, "svtype").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*cluster).agg(F.min(F.struct((-F.col("n")).alias("n"), "svtype")).alias("t")).select(*cluster, F.col("t.svtype").alias("svtype"), (-F.col("t.n")).alias("n")).where(F.col("n") >= least).drop("n")
    x = clusters.join(best, [*cluster, "svtype"])
    ci = lambda c: F.abs(F.percentile(c, F.lit(0.975)) - F.median(c))
    g = x.groupBy(*cluster, "svtype").agg(F.min("chrom_a").alias("chrom"), F.min("chrom_b").alias("chr2"), F.floor(F.median("break_a")).alias("pos"), F.floor(F.median("break_b")).alias("end_pos"), F.floor(ci("break_a")).alias("cipos95"), F.floor(ci("break_b")).alias("ciend95"), F.bool_or("precise_a").alias("precise_a"), F.bool_or("precise_b").alias("precise_b"), F.median("length").alias("len"), F.count(F.lit(1)).alias("pe"))
    length = F.when(F.col("chrom") != F.col("chr2"), F.lit(None)).when(F.col("svtype") == "INS", F.floor("len")).otherwise(F.abs(F.col("end_pos") - F.col("pos")))
    return g.withColumn("svlen", length.cast("long")).drop("len")


def nearest_to_middle(df: DataFrame, group: list[str], value: str, row: str) -> DataFrame:
    """Group, row, value of the row whose value lies nearest to the median of its group; ties go to the least row. The rows of a group are never
    brought together: one aggregate for the medians, one for the nearest."""
    m = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.median(value).alias("__m"))
    x = df.join(m, group).where(F.col(value).isNotNull())
    best = x.groupBy(*group).agg(F.min(F.struct(F.abs(F.col(value) - F.col("__m")).alias("far"), F.col(row).alias("row"), F.col(value).alias("value"))).alias("__b"))
    return best.select(*group, F.col("__b.row").alias(row), F.col("__b.value").alias(value))


def matching_evidence(pairs: DataFrame, variant: str, pad: int, gap_len: float = 0.75) -> DataFrame:
    """Variant and whether any read tells the same event: a supplementary at both ends, a discordant mate pair of like span, an in-read gap of
    like length; with the counts of reads that cover the first end and of those with mapping quality 0.

    pairs: variant, pos, end_pos, svtype, svlen and of the read start, stop, flag, mapq, cigar, pnext, sa, chrom, chr2, rname, rnext.
    Every condition is a column, and one aggregate replaces the early exit.
    """
    c = F.col
    near = lambda p, q: F.abs(p - q) <= pad
    supp = F.exists(cg.split_alignments("sa"), lambda s: (near(s["pos"], c("end_pos")) & (s["chrom"] == c("chr2")) & (near(c("start"), c("pos")) | near(c("stop"), c("pos")))) | (near(s["pos"], c("pos")) & (s["chrom"] == c("chrom")) & (near(c("start"), c("end_pos")) | near(c("stop"), c("end_pos")))))
    lo, hi = F.least("start", "pnext"), F.greatest("start", "pnext")
    mate = (c("svtype") != "INS") & (c("rnext") == "=") & (c("flag").bitwiseAND(10) == 0) & near(lo, c("pos")) & near(hi, c("end_pos")) & alike_spans_filter("pos", "end_pos", lo, hi, 20.0, 0.75)
    over = (c("rnext") != "=") & (c("rnext") == c("chr2")) & (c("chrom") != c("chr2")) & near(c("start"), c("pos")) & near(c("pnext"), c("end_pos"))
    want = F.when(c("svtype") == "INS", "I").otherwise("D")
    gap = c("svtype").isin("INS", "DEL") & F.exists(cg.walk("cigar", "start"), lambda g: (g["op"] == want) & near(g["ref_start"], c("pos")) & (F.least(g["len"], c("svlen")) > gap_len * F.greatest(g["len"], c("svlen"))))
    some = lambda x: F.coalesce(x, F.lit(False))
    cover = (c("start") <= c("pos") - 10) & (c("stop") >= c("pos") + 10)
    return pairs.groupBy(variant).agg(F.bool_or(some(supp) | some(mate) | some(over) | some(gap)).alias("normal"), F.count_if(some(cover)).alias("covering"), F.count_if(some(cover) & (c("mapq") == 0)).alias("mapq0"))


def near_reference_gap(events: DataFrame, fasta: DataFrame, row: str, pad: int = 250, chunk: int = 1 << 16) -> DataFrame:
    """row, gap: whether the first, the middle or the last base of the `pad` bases around either end of an event is N. Windows of events that overlap
    are one and judged as one. events: row, chrom, pos, chr2, end_pos; fasta as of read_fasta. Ends on chromosomes that are not there tell nothing."""
    from ..sources.files import fetch_bases
    from .intervals import merge_intervals, range_join

    both = F.explode(F.array(F.struct(F.col("chrom").alias("c"), F.col("pos").cast("long").alias("p")), F.struct(F.col("chr2").alias("c"), F.col("end_pos").cast("long").alias("p")))).alias("e")
    ends = events.select(row, both).where("e.c is not null and e.p is not null").select(row, F.col("e.c").alias("__c"), F.greatest(F.lit(0), F.col("e.p") - pad).alias("__s"), (F.col("e.p") + pad).alias("__e"))
    win = materialize(merge_intervals(ends.select("__c", "__s", "__e"), ["__c"], "__s", "__e").select(F.col("__c").alias("wc"), F.col("__s").alias("ws"), F.col("__e").alias("we")))
    known = win.join(fasta.select(F.col("name").alias("wc")).distinct(), "wc", "left_semi")
    bases = fetch_bases(known, fasta, ["wc", "ws", "we"], "wc", "ws", "we", chunk)
    n = F.length("bases")
    at = lambda i: F.substring("bases", i.cast("int"), F.lit(1)) == "N"
    bad = bases.where(at(F.lit(1)) | at(n) | at(F.floor(n / 2) + 1)).select(F.col("wc").alias("__wc"), F.col("ws").alias("__ws"), F.col("we").alias("__we"))
    hit = range_join(ends, bad, [("__c", "__wc")], ("__s", "__e"), ("__ws", "__we"), 8192).select(row).distinct().withColumn("__hit", F.lit(True))
    return events.select(row).join(hit, row, "left").select(row, F.coalesce("__hit", F.lit(False)).alias("gap"))


def region_figures(pairs: DataFrame, variant: str, clip: int = 50, within: int = 30, small_gap: int = 30) -> DataFrame:
    """variant with the figures of the reads near it: n_aligns, n_overlap and n_overlap0 (over the first end; those with mapping quality 0), n_covering, n_clipped
    (clipped by at least `clip` within `within` of either end), sum_edits and sum_gaps (rates per aligned base) and sum_nm (edits without the large gaps).
    pairs as in matching_evidence, with nm."""
    c = F.col
    bases = cg.aligned_bases("cigar", 0)
    ops = lambda test: F.aggregate(F.filter(cg.parse("cigar"), lambda x: x["op"].isin("I", "D") & test(x["len"])), F.lit(0).cast("long"), lambda a, x: a + x["len"])
    small = F.size(F.filter(cg.parse("cigar"), lambda x: x["op"].isin("I", "D") & (x["len"] < small_gap)))
    rate = lambda x: F.when(bases > 0, x / bases)
    over = (c("start") <= c("pos") + 1) & (c("stop") >= c("pos"))
    cover = (c("start") <= c("pos") - 10) & (c("stop") >= c("pos") + 10)
    near = lambda x: (F.abs(x - c("pos")) <= within) | (F.abs(x - c("end_pos")) <= within)
    clipped = ((cg.left_clip("cigar") >= clip) & near(c("start"))) | ((cg.right_clip("cigar") >= clip) & near(c("stop")))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return pairs.groupBy(variant).agg(
        F.count(F.lit(1)).alias("n_aligns"), F.count_if(over).alias("n_overlap"), F.count_if(over & (c("mapq") == 0)).alias("n_overlap0"), F.count_if(cover).alias("n_covering"),
        F.count_if(clipped).alias("n_clipped"), zero(F.sum(rate(c("nm")))).alias("sum_edits"), zero(F.sum(rate(small))).alias("sum_gaps"), zero(F.sum(rate(c("nm") - ops(lambda n: n >= small_gap)))).alias("sum_nm"),
    )


def clip_evidence(pairs: DataFrame, variant: str, distance: int, clip: int = 15) -> DataFrame:
    """Variant, clip side and clipped bases of the reads clipped by at least `clip` within `distance` of the first end, on the side its junction (ct) opens to.
    pairs as in matching_evidence with seq and ct. Reads whose bases are not kept (*) are counted with null bases."""
    left, right = cg.left_clip("cigar"), cg.right_clip("cigar")
    use_right = F.coalesce(F.substring("ct", 1, 1), F.lit("3")) == "3"
    hit = F.when(use_right, (right >= clip) & (F.abs(F.col("stop") - F.col("pos")) <= distance)).otherwise((left >= clip) & (F.abs(F.col("start") - F.col("pos")) <= distance))
    seq = F.when(F.col("seq") != "*", F.when(use_right, F.right("seq", right)).otherwise(F.left("seq", left)))
    return pairs.where(hit).select(variant, F.when(use_right, "right").otherwise("left").alias("clip_side"), seq.alias("bases"))


def clips_match(paired: bool = True):
    """Pandas UDF: whether a clip and the clipped part of a contig are one sequence: local score over 70 % of the best possible for the shorter, or
    for paired reads both together pack into half their size."""
    import zlib

    @F.pandas_udf("boolean")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if not x or not y:
                return False
            n = min(len(x), len(y))
            if sequence.local_alignment(x, y, *sequence.SCORES["filter"])[0] > 0.7 * 2 * n:
                return True
            return paired and len(zlib.compress((x + y).encode())) / (len(x) + len(y)) < 0.5

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return udf


def any_contig_match(paired: bool = True):
    """Pandas UDF over two arrays of contigs: whether any pair of them aligns well and tells one event; the first that does ends the search."""

    @F.pandas_udf("boolean")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(contigs_tell_one_event(zip(a, b), paired), dtype=bool)

    return udf


def contigs_tell_one_event(contigs, paired: bool) -> list[bool]:
    """any_contig_match of pairs of lists of contigs. The first pairs of all rows are aligned together, then the second ones of the rows without a match,
    and so on; one alignment serves both rules."""
    rows = [[(x, y) for x in xs for y in ys] for xs, ys in contigs]
    out, left, k = [False] * len(rows), list(range(len(rows))), 0
    while left := [i for i in left if not out[i] and k < len(rows[i])]:
        texts = [rows[i][k] for i in left]
        for i, (x, y), al in zip(left, texts, sequence.local_alignments(texts, *sequence.SCORES["merge"])):
            out[i] = good_alignment(al, len(x), len(y), paired) and sequence.alignment_matches(al, len(x), len(y))
        k += 1
    return out


def remap_udf(left_side: bool = False):
    """Pandas UDF over a clip and the bases around its break, the break in their middle: kind, length and score."""

    @F.pandas_udf("kind string, length long, score long")
    def udf(clip: pd.Series, window: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([remap_clip(c, w, left_side, len(w) // 2) for c, w in zip(clip, window)], columns=["kind", "length", "score"])

    return udf


def bad_ends_udf(limit: float = 0.02, width: int = 2000):
    """pandas UDF over CIGARs: bases to leave out at the left and right end; matches as M and = say, gaps and X are none."""
    import re

    @F.pandas_udf("left_bad long, right_bad long")
    def udf(cigar: pd.Series) -> pd.DataFrame:
        out = []
        for c in cigar:
            ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDX=])", c or "")]
            m = np.repeat([o in "M=" for _, o in ops], [n for n, _ in ops]) if ops else np.zeros(0, bool)
            out.append(sequence.bad_ends(m, limit, width))
        return pd.DataFrame(out, columns=["left_bad", "right_bad"])

    return udf


def good_contig_alignment(a: str, b: str, paired: bool, nanopore: bool = False) -> bool:
    """Whether the local alignment of two contigs leaves neither a long overhang on the same side nor too many gaps: matches of 50 or 60 % of the
    shorter, both ends of one sequence within the tolerance, or the overhangs on opposite sides."""
    return good_alignment(sequence.local_alignment(a, b, *sequence.SCORES["merge"]), len(a), len(b), paired, nanopore)


def good_alignment(alignment: tuple[int, int, int, int, int], len_a: int, len_b: int, paired: bool, nanopore: bool = False) -> bool:
    """good_contig_alignment by the alignment of the two."""
    score, qs, qe, ts, te = alignment
    if not score:
        return False
    n = min(len_a, len_b)
    slack = 10 if paired else max(10, n * (0.05 if nanopore else 0.04))
    gaps, most = abs((qe - qs) - (te - ts)), 14 if nanopore else 12
    matched = min(qe - qs, te - ts)
    if matched < n * (0.5 if paired else 0.6) or gaps > most or gaps > matched * (0.07 if nanopore else 0.05):
        return False
    over = (qs > slack, len_a - qe > slack, ts > slack, len_b - te > slack)
    if not (over[0] or over[1]) or not (over[2] or over[3]):
        return True
    return not ((over[0] and (over[1] or over[2])) or (over[3] and (over[2] or over[1])))


def remap_clip(clip: str, window: str, left_side: bool, at: int) -> tuple[str | None, int, int]:
    """(type, length, score) when a clip finds its place in the reference window around a break: beyond the break on its own side it spans a deletion,
    on the other side it repeats what is there and tells a duplication-like insertion; (None, 0, score) without a good place."""
    score, qs, qe, ts, te = sequence.local_alignment(clip.upper(), window.upper(), *sequence.SCORES["remap"])
    if score < 2 * 0.8 * len(clip) or qe - qs < 0.8 * len(clip):
        return None, 0, score
    gap = at - te if left_side else ts - at
    return ("DEL", gap, score) if gap > 0 else ("INS", len(clip), score)


def reference_allele(svtype: Column, bases: Column, svlen: Column, symbolic: int = 50_000) -> tuple[Column, Column]:
    """(REF, ALT): bases are written out for deletions shorter than `symbolic`, otherwise the first base and <TYPE>."""
    short = (svtype == "DEL") & (svlen < symbolic) & (F.length(bases) > 1)
    ref = F.when(short, bases).otherwise(F.coalesce(F.nullif(F.left(bases, F.lit(1)), F.lit("")), F.lit("N")))
    return ref, F.when(short, F.left(bases, F.lit(1))).otherwise(F.concat(F.lit("<"), svtype, F.lit(">")))


def around_event(seq: Column, at: Column, pad: int = 500) -> Column:
    """The bases of a read within `pad` of an event at a 0-based place on it, case kept."""
    start = F.greatest(F.lit(0), at - pad)
    return F.substr(seq, (start + 1).cast("int"), (F.least(F.length(seq), at + pad) - start).cast("int"))


def directional_depth(points: DataFrame, track: DataFrame, key: str, row: str, at: str, left: Column, keep: int, reach: int = 400, bin_size: int = 10) -> DataFrame:
    """Row, n, mean, cv of the first `keep` bins with depth to the left (or right) of a position within `reach` bins.
    Runs of equal depth are taken in order of distance until `keep` bins are full. Values under the 2nd percentile of those kept are left out where that exceeds 0.5."""
    from .intervals import range_join

    p = points.select(F.col(row), F.col(key).alias("__k"), F.floor(F.col(at) / bin_size).alias("__b"), left.alias("__left"))
    t = track.select(F.col(key).alias("__tk"), F.col("bin").alias("__f"), (F.col("to_bin") - 1).alias("__t"), F.col("depth").alias("__d"))
    lo, hi = F.when(F.col("__left"), F.col("__b") - reach + 1).otherwise(F.col("__b")), F.when(F.col("__left"), F.col("__b")).otherwise(F.col("__b") + reach - 1)
    j = range_join(p, t, [("__k", "__tk")], (lo, hi), ("__f", "__t"), 1024)
    a, b = F.greatest("__f", lo), F.least("__t", hi)
    far = F.when(F.col("__left"), F.col("__b") - b).otherwise(a - F.col("__b"))
    w = W.partitionBy(row).orderBy("__far").rowsBetween(W.unboundedPreceding, -1)
    j = j.select(row, far.alias("__far"), (b - a + 1).alias("__n"), F.col("__d").cast("double").alias("__d")).withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    j = j.withColumn("__n", F.least(F.col("__n"), F.lit(keep) - F.col("__before"))).where("__n > 0")
    floor = j.groupBy(row).agg(F.expr("percentile(__d, 0.02, __n)").alias("__floor"))
    k = j.join(floor, row).where((F.col("__floor") <= 0.5) | (F.col("__d") >= F.col("__floor")))
    s = k.groupBy(row).agg(F.sum("__n").alias("n"), (F.sum(F.col("__n") * F.col("__d")) / F.sum("__n")).alias("mean"), (F.sum(F.col("__n") * F.col("__d") * F.col("__d")) / F.sum("__n")).alias("__sq"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("__sq") - F.col("mean") * F.col("mean")))
    return s.select(row, "n", "mean", F.when((F.col("n") > 1) & (F.col("mean") > 0), sd / F.col("mean")).otherwise(0.0).alias("cv"))


def depth_ratio_kept(left: Column, right: Column, least: float = 0.01) -> Column:
    """whether the smaller directional depth is more than `least` of the larger."""
    return F.least(left, right) / (F.greatest(left, right) + 1e-6) > least


#: Columns of the score that rest on contigs, and on two copies of each chromosome.
CONTIG_COLUMNS = ("precise", "contig_length", "rep", "rep_sc", "gc", "compress")
DIPLOID_COLUMNS = ("inner_cn", "outer_cn", "fold_change", "a_freq", "gq")


@dataclass(frozen=True)
class Scorer:
    """Probability of a call as a logistic score of its columns; another model with the same two methods can stand in for it.

    weights are per column (nulls count as `fill`), thresholds per type. `variant` gives the model for calls without contigs or for samples that
    are not diploid: the weights of the columns that mean nothing there are left out and their usual value goes into the bias.
    """

    weights: dict[str, float] = field(default_factory=lambda: {"su": 0.18, "wr": 0.25, "sr": 0.1, "sc": 0.02, "precise": 0.6, "mapq": 0.03})
    bias: float = -1.6
    fill: float = 0.0
    thresholds: dict[str, float] = field(default_factory=lambda: dict.fromkeys(("DEL", "INS", "DUP", "INV", "TRA", "BND"), 0.45))

    def variant(self, contigs: bool = True, diploid: bool = True, usual: dict[str, float] | None = None) -> Scorer:
        """The model without what rests on contigs, or on a diploid genome; `usual` are the values that stand in (0 where none is given)."""
        gone = {*(() if contigs else CONTIG_COLUMNS), *(() if diploid else DIPLOID_COLUMNS)} & set(self.weights)
        bias = self.bias + sum(self.weights[c] * (usual or {}).get(c, 0.0) for c in gone)
        return replace(self, weights={c: w for c, w in self.weights.items() if c not in gone}, bias=bias)

    def prob(self, df: DataFrame) -> Column:
        z = F.lit(self.bias)
        for c, w in self.weights.items():
            if c in df.columns:
                z = z + w * F.coalesce(F.col(c).cast("double"), F.lit(self.fill))
        return F.round(1 / (1 + F.exp(-z)), 3)

    def label(self, prob: Column, svtype: Column) -> Column:
        c = None
        for t, p in self.thresholds.items():
            c = F.when(svtype == t, prob >= p) if c is None else c.when(svtype == t, prob >= p)
        return F.when(c.otherwise(prob >= 0.5), "PASS").otherwise("lowProb")

    @staticmethod
    def fit(df: DataFrame, columns: list[str], label: str, fill: float = 0.0) -> Scorer:
        """Weights from labelled rows (label 0 or 1), by Spark's distributed logistic regression."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        x = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(fill)).alias(c) for c in columns), F.col(label).cast("double").alias("label"))
        m = LogisticRegression(maxIter=50, regParam=1e-3).fit(VectorAssembler(inputCols=columns, outputCol="features").transform(x))
        return Scorer(dict(zip(columns, (float(v) for v in m.coefficients))), float(m.intercept), fill)
