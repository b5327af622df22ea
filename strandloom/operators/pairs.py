"""Joins that make the edges of an evidence graph: templates, splits, proximity in two dimensions, shared minimizers, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import cigar as cg
from ..functions import geometry as geo
from ..functions import sequence
from ..session import materialize
from .intervals import range_join

#: Kinds of evidence and weights of edges.
EVIDENCE = {"discordant": 0, "split": 1, "deletion": 2, "insertion": 3, "breakend": 4, "skip": 5}
SITE_EDGE, TEMPLATE_EDGE, SIMILAR_EDGE = 0, 1, 2
MOST_NEIGHBOURS = 25
MOST_CLIP_PARTNERS = 5
GROUP_ROUNDS = 4
GROUP_PAIRS = 500_000


def template_edges(reads: DataFrame, template: str, row: str, order: list[str]) -> DataFrame:
    """Src, dst, weight 1 for neighbours on a template in the given order (query start), by one window; templates are small."""
    w = W.partitionBy(template).orderBy(*order, row)
    x = reads.where(F.col(template).isNotNull()).select(F.col(row).alias("src"), F.lead(row).over(w).alias("dst"))
    return x.where("dst is not null").withColumn("weight", F.lit(TEMPLATE_EDGE))


def split_neighbours(reads: DataFrame, row: str, low_mapq: int = 1, sides: bool = False) -> DataFrame:
    """The alignments of each split read in the order of the read as sequenced: row, place, chrom, pos, strand, mapq, the
    next alignment's chrom and pos, and whether the junction is a BREAKEND (either side under low_mapq) or a SPLIT.

    reads: row, rname, pos, flag, cigar, mapq, sa. Work is per row, in arrays; no shuffle. Reads without a usable SA tag give no rows.
    With `sides`, side and next_side are the two alignments as labels.side has them.
    """
    own = F.struct(F.col("rname").alias("chrom"), F.col("pos").alias("pos"), F.when(cg.flag(16), "-").otherwise("+").alias("strand"), F.col("cigar").alias("cigar"), F.col("mapq").alias("mapq"))
    others = F.transform(cg.split_alignments("sa"), lambda a: F.struct(a["chrom"].alias("chrom"), a["pos"].alias("pos"), a["strand"].alias("strand"), a["cigar"].alias("cigar"), a["mapq"].alias("mapq")))

    def placed(a):
        start, end = cg.query_interval(a["cigar"], a["strand"] == "-")
        return F.struct(start.alias("q_start"), end.alias("q_end"), a["chrom"].alias("chrom"), a["pos"].alias("pos"), a["strand"].alias("strand"), a["mapq"].alias("mapq"), a["cigar"].alias("cigar"))

    def side(a):
        at = a["pos"].cast("long")
        return F.struct(at.alias("pos"), (at + cg.reference_length(a["cigar"])).alias("stop"), F.when(a["strand"] == "-", "5").otherwise("3").alias("strand"), cg.left_clip(a["cigar"], True).alias("left"), cg.right_clip(a["cigar"], True).alias("right"), a["q_start"].alias("q_start"), a["q_end"].alias("q_end"))

    x = reads.where(F.col("sa").isNotNull()).select(row, F.array_sort(F.transform(F.concat(F.array(own), others), placed)).alias("a")).where(F.size("a") > 1)
    x = x.select(row, "a", F.posexplode("a").alias("place", "one"))
    nxt = F.try_element_at("a", F.col("place") + 2)
    x = x.select(row, (F.col("place") + 1).alias("place"), "one.*", F.col("one").alias("one"), nxt.alias("next"))
    kind = F.when(F.col("next").isNull(), F.lit(None)).when((F.col("mapq") < low_mapq) | (F.col("next.mapq") < low_mapq), "BREAKEND").otherwise("SPLIT")
    return x.select(row, "place", "q_start", "q_end", "chrom", "pos", "strand", "mapq", F.col("next.chrom").alias("next_chrom"), F.col("next.pos").alias("next_pos"), kind.alias("junction"), *([side(F.col("one")).alias("side"), side(F.col("next")).alias("next_side")] if sides else []))


def proximity_edges(nodes: DataFrame, keys: list[str], node: str, x: str, y: str, apart: int, alike: Column | None = None, most: int | None = MOST_NEIGHBOURS) -> DataFrame:
    """Src < dst of nodes with equal keys whose positions x and whose positions y differ by less than `apart`, weight 2.

    Candidates meet in cells of the plane: each node stands in its own cell and, as the other side of the join, in the nine
    around it. `alike` is a further condition on the columns a_* and b_* of the two nodes. With `most`, each node keeps its
    nearest partners (by y, then x, then node), which also keeps crowded places linear in edges; None keeps all.
    """
    cell = lambda c: F.floor(F.col(c) / apart)
    cols = [c for c in nodes.columns]
    a = nodes.select(*(F.col(c).alias(f"a_{c}") for c in cols)).withColumn("__cx", cell(f"a_{x}")).withColumn("__cy", cell(f"a_{y}"))
    b = nodes.select(*(F.col(c).alias(f"b_{c}") for c in cols))
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    b = b.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around)).withColumn("__bx", cell(f"b_{x}") + F.col("__dx")).withColumn("__by", cell(f"b_{y}") + F.col("__dy"))
    on = (F.col("__cx") == F.col("__bx")) & (F.col("__cy") == F.col("__by")) & (F.col(f"a_{node}") < F.col(f"b_{node}"))
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    dx, dy = F.abs(F.col(f"a_{x}") - F.col(f"b_{x}")), F.abs(F.col(f"a_{y}") - F.col(f"b_{y}"))
    on = on & (dx < apart) & (dy < apart)
    if alike is not None:
        on = on & alike
    e = a.join(b, on).select(F.col(f"a_{node}").alias("src"), F.col(f"b_{node}").alias("dst"), dx.alias("dx"), dy.alias("dy"))
    if most:
        w = W.partitionBy("src").orderBy("dy", "dx", "dst")
        e = e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
    return e.withColumn("weight", F.lit(SIMILAR_EDGE))


def minimizers(text: Column | str, k: int = 12, m: int = 6, hashed: bool = True) -> Column:
    """Distinct minimizers of a sequence: the least m-mer (by xxhash64, or as text) of each run of k-m+1 m-mers, of the shorter
    runs at the start, and the last m-mer. A sequence shorter than m has none."""
    t = F.col(text) if isinstance(text, str) else text
    if hashed and m < 8:  # a character has four bytes at most
        return sequence.minimizers_udf(k, m)(t)
    n = F.length(t) - m + 1
    mers = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.substr(t, i, F.lit(m))) if hashed else F.substr(t, i, F.lit(m)))
    run = k - m + 1
    # the m-mers are bound once, as the variable of an outer transform, not worked out again for each window
    windows = F.transform(F.array(mers), lambda all_: F.concat(F.transform(all_, lambda x, i: F.array_min(F.slice(all_, F.greatest(F.lit(1), i + 2 - run), F.least(i + 1, F.lit(run))))), F.slice(all_, -1, 1)))
    return F.when(n >= 1, F.array_distinct(F.element_at(windows, 1))).otherwise(F.array().cast("array<bigint>" if hashed else "array<string>"))


def minimizer_edges(clips: DataFrame, keys: list[str], node: str, at: str, mins: str, apart: int = 7, least: float = 2.0, star: bool = False) -> DataFrame:
    """Src < dst, shared, of all clips on equal keys (chromosome, side) nearer than `apart` that share minimizers so that half of all
    plus the shared ones reach `least`.

    Exact copies (equal keys, place and minimizers) are one class and compared once; the pairs of their members follow by membership. With
    `star` only the pairs of class representatives come back and one of each further member with its own: the same components, linear in copies.
    """
    # written once: in the plan below, the minimizers would be worked out again in every filter and branch
    x = materialize(clips.select(*keys, node, at, F.array_sort(mins).alias("__mins"))).where(F.size("__mins") > 0)
    own = x.groupBy(*keys, at, "__mins").agg(F.min(node).alias("__rep"))
    same = F.lit(True)
    for k in (*keys, at, "__mins"):
        same = same & (F.col(f"x.{k}") == F.col(f"o.{k}"))
    member = materialize(x.alias("x").join(own.alias("o"), same).select(F.col("__rep").alias("rep"), F.col(f"x.{node}").alias("member"), F.size("x.__mins").alias("n")))
    # both sides are one table, so that it is shuffled once: a row stands in its own cell and, near its end, in the next; a pair meets in the own cell of the later one
    cell = lambda c: F.floor(c / (4 * apart))
    one = own.withColumn("own", cell(F.col(at))).withColumn("cell", F.explode(F.sequence("own", cell(F.col(at) + apart - 1))))
    one = one.select(*keys, "__rep", at, "own", "cell", F.size("__mins").alias("n"), F.explode("__mins").alias("mm"))
    a, b = (one.select(*(F.col(c).alias(f"{side}_{c}") for c in one.columns)) for side in "ab")
    on = (F.col("a_mm") == F.col("b_mm")) & (F.col("a_cell") == F.col("b_cell")) & (F.col("a___rep") < F.col("b___rep")) & (F.abs(F.col(f"a_{at}") - F.col(f"b_{at}")) < apart) & (F.col("a_cell") == F.greatest("a_own", "b_own"))
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    e = a.join(b, on).groupBy(F.col("a___rep").alias("ra"), F.col("b___rep").alias("rb")).agg(F.count(F.lit(1)).alias("shared"), F.max(F.least("a_n", "b_n")).alias("n"))
    e = e.where(F.col("n") / 2 + F.col("shared") >= least).select("ra", "rb", "shared")
    copies = member.where(F.col("n") * 1.5 >= least)
    if star:
        inner = copies.where("rep <> member").select(F.col("rep").alias("src"), F.col("member").alias("dst"), F.col("n").cast("long").alias("shared"))
        return e.select(F.col("ra").alias("src"), F.col("rb").alias("dst"), "shared").unionByName(inner)
    left, right = (member.select(F.col("rep").alias(r), F.col("member").alias(m)) for r, m in (("ra", "ma"), ("rb", "mb")))
    outer = e.join(left, "ra").join(right, "rb").select(F.least("ma", "mb").alias("src"), F.greatest("ma", "mb").alias("dst"), "shared")
    inner = copies.select("rep", F.col("member").alias("src"), F.col("n").cast("long").alias("shared")).join(copies.select("rep", F.col("member").alias("dst")), "rep").where("src < dst").select("src", "dst", "shared")
    return outer.unionByName(inner)


def best_partners(edges: DataFrame, most: int = MOST_CLIP_PARTNERS) -> DataFrame:
    """Src, dst, shared, rank of the `most` best partners with a greater id of each clip: a ranking of the edges, which stay whole."""
    w = W.partitionBy("src").orderBy(F.desc("shared"), "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("src", "dst", "shared", "rank")


def union_edges(*edges: DataFrame) -> DataFrame:
    """Src, dst, weight of several edge tables; a pair in more than one keeps its greatest weight."""
    all_ = None
    for e in edges:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
        all_ = e if all_ is None else all_.unionByName(e)
    return all_.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def canonical(df: DataFrame, sides: list[tuple[str, str]], chrom: tuple[str, str], pos: tuple[str, str], ct: str | None = None) -> DataFrame:
    """Df with its two ends in order: by chromosome name, on one chromosome by position. `sides` are the column pairs that swap; ct turns round."""
    flip = (F.col(chrom[0]) > F.col(chrom[1])) | ((F.col(chrom[0]) == F.col(chrom[1])) & (F.col(pos[0]) > F.col(pos[1])))
    new = {}
    for a, b in sides:
        new[a], new[b] = F.when(flip, F.col(b)).otherwise(F.col(a)), F.when(flip, F.col(a)).otherwise(F.col(b))
    if ct:
        turned = F.concat(F.substring_index(ct, "to", -1), F.lit("to"), F.substring_index(ct, "to", 1))
        new[ct] = F.when(flip, turned).otherwise(F.col(ct))
    return df.withColumns(new)


def event_pairs(events: DataFrame, keys: list[str], row: str, pos_a: str, pos_b: str, ci: str, slack: int, other_sample: str | None = None) -> DataFrame:
    """Pairs of events on equal keys where the first end of one lies within slack/2 plus the confidence interval of the first end of the other.

    Columns come back as a_* and b_* with a_<row> < b_<row>; with other_sample only pairs of different samples.
    """
    reach = F.lit(slack / 2).cast("long")
    a = events.select(*(F.col(c).alias(f"a_{c}") for c in events.columns))
    b = events.select(*(F.col(c).alias(f"b_{c}") for c in events.columns))
    wide = reach + F.coalesce(F.col(f"a_{ci}"), F.lit(0))
    p = range_join(a, b, [(f"a_{k}", f"b_{k}") for k in keys], (F.col(f"a_{pos_a}") - wide, F.col(f"a_{pos_a}") + wide), (f"b_{pos_a}", f"b_{pos_a}"), max(64, slack))
    p = p.where(F.col(f"a_{row}") != F.col(f"b_{row}"))
    # the reach of one end decides; a pair found from its later row only is turned round
    turned = p.where(F.col(f"a_{row}") > F.col(f"b_{row}")).select(*(F.col(f"{'b' if c[0] == 'a' else 'a'}{c[1:]}").alias(c) for c in p.columns))
    p = p.where(F.col(f"a_{row}") < F.col(f"b_{row}")).unionByName(turned).dropDuplicates([f"a_{row}", f"b_{row}"])
    return p.where(F.col(f"a_{other_sample}") != F.col(f"b_{other_sample}")) if other_sample else p


def merge_rule(same_sample: bool) -> Column:
    """J10 without sequences: whether a pair of event_pairs is one event. Columns svtype, svlen, pos, end_pos, chrom, chr2 as a_*, b_*.

    Over two chromosomes any pair of equal type that meets is one; equal start, type and length is one; deletions also
    need a reciprocal overlap; else the ratio of the lengths has to exceed 0.5, or 0.3 where either is imprecise (ci > 0).
    """
    c = F.col
    la, lb = F.coalesce(c("a_svlen"), F.lit(0)), F.coalesce(c("b_svlen"), F.lit(0))
    ratio = F.least(la, lb) / F.nullif(F.greatest(la, lb), F.lit(0))
    same_type = c("a_svtype") == c("b_svtype")
    intra = (c("a_chrom") == c("a_chr2")) & (c("b_chrom") == c("b_chr2"))
    exact = (c("a_pos") == c("b_pos")) & same_type & (la == lb)
    imprecise = (F.coalesce(c("a_ci"), F.lit(0)) > 0) | (F.coalesce(c("b_ci"), F.lit(0)) > 0)
    lengths = (ratio > 0.5) | (imprecise & (ratio > 0.3))
    overlap = F.when(c("a_svtype") == "DEL", geo.reciprocal("a_pos", "a_end_pos", "b_pos", "b_end_pos")).otherwise(F.lit(True))
    insertion_like = F.lit(same_sample) & c("a_svtype").isin("INS", "DUP", "TRA") & c("b_svtype").isin("INS", "DUP", "TRA") & (F.abs(c("a_pos") - c("b_pos")) < 50)
    return F.coalesce((same_type & (~intra | exact | (lengths & overlap) | (c("a_svtype") == "TRA"))) | insertion_like, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def mutual_best(pairs: DataFrame, a: str, b: str, score: str, least: float) -> DataFrame:
    """Pairs that are each other's best by score (ties: the smaller partner), among those above `least`."""
    p = pairs.where(F.col(score) > least)
    wa, wb = W.partitionBy(a).orderBy(F.desc(score), b), W.partitionBy(b).orderBy(F.desc(score), a)
    p = p.withColumn("__ra", F.row_number().over(wa)).withColumn("__rb", F.row_number().over(wb))
    return p.where("__ra = 1 and __rb = 1").select(a, b, score)


def reads_near(variants: DataFrame, reads: DataFrame, row: str, read: str, pad: int) -> DataFrame:
    """Row, read of the reads whose aligned span comes within `pad` of either end of a variant on the same chromosome, each once.

    variants: row, chrom, pos, chr2, end_pos. reads: read, rname, start, stop, flag; unmapped, duplicate and failed reads (1540) are left out.
    """
    ends = F.explode(F.array(F.struct(F.col("chrom").alias("c"), F.col("pos").alias("p")), F.struct(F.col("chr2").alias("c"), F.col("end_pos").alias("p")))).alias("e")
    v = variants.select(row, ends).select(row, F.col("e.c").alias("__vc"), F.col("e.p").alias("__vp")).where("__vc is not null and __vp is not null").distinct()
    r = reads.where(F.col("flag").bitwiseAND(1540) == 0)
    hit = range_join(v, r, [("__vc", "rname")], (F.col("__vp") - pad, F.col("__vp") + pad), ("start", "stop"), max(1024, 4 * pad))
    return hit.select(row, read).distinct()


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all of two arrays, as sets; null where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def assign_nearest(items: DataFrame, centres: DataFrame, keys: list[str], item: str, at: str, centre: str, centre_at: str, within: int) -> DataFrame:
    """Item, centre, distance with each item and each centre used once, nearest pairs first.

    Greedy assignment is settled in rounds of mutual-best pairs: the nearest pair of a neighbourhood is best for both its
    members, so rounds give the same pairs as one sorted pass, without a sequential loop over rows. Pairs that hang together by an
    item or a centre do not touch others: after a few rounds such groups of up to GROUP_PAIRS pairs are finished in one sorted pass each
    (many items at one place settle one pair a round). Larger groups go on in rounds, each of which settles at least one pair.
    """
    c = centres.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(centre), F.col(centre_at).alias("__at"))
    p = range_join(items.select(*keys, item, at), c, [(k, f"__{k}") for k in keys], (F.col(at) - within, F.col(at) + within), ("__at", "__at"), max(1, 2 * within))
    p = p.select(item, centre, F.abs(F.col(at) - F.col("__at")).alias("distance"))
    wi, wc = W.partitionBy(item).orderBy("distance", centre), W.partitionBy(centre).orderBy("distance", item)
    p = materialize(p)
    schema, done, n = p.schema, None, 0
    while done is None or not p.isEmpty():
        n += 1
        if n % GROUP_ROUNDS == 0:
            best, p = _settle_groups(p, item, centre, schema)
        else:
            best = p.withColumn("__i", F.row_number().over(wi)).withColumn("__c", F.row_number().over(wc)).where("__i = 1 and __c = 1").select(item, centre, "distance")
            best = materialize(best)
            p = materialize(p.join(best.select(item), item, "left_anti").join(best.select(centre), centre, "left_anti"))
        done = best if done is None else done.unionByName(best)
        if n % 20 == 0:  # the union stays short
            done = materialize(done)
    return done


def _settle_groups(p: DataFrame, item: str, centre: str, schema) -> tuple[DataFrame, DataFrame]:
    """(assigned pairs of the groups of up to GROUP_PAIRS candidate pairs, candidate pairs of the larger groups)."""
    from .graph import connected_components

    i, c = F.xxhash64(F.lit("i"), item), F.xxhash64(F.lit("c"), centre)  # equal hashes would only join two groups
    x = p.withColumn("__node", i)
    group = connected_components(p.select(i.alias("src"), c.alias("dst"))).select(F.col("node").alias("__node"), F.col("component").alias("__group"))
    x = materialize(x.join(group, "__node").drop("__node"))
    small = x.groupBy("__group").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= GROUP_PAIRS).select("__group")

    def one_pass(pdf):
        pdf = pdf.sort_values(["distance", item, centre])
        items, centres, keep = set(), set(), []
        for a, b in zip(pdf[item].tolist(), pdf[centre].tolist()):
            free = a not in items and b not in centres
            keep.append(free)
            if free:
                items.add(a)
                centres.add(b)
        return pdf.loc[keep, [item, centre, "distance"]]

    best = materialize(x.join(small, "__group").groupBy("__group").applyInPandas(one_pass, schema))
    return best, materialize(x.join(small, "__group", "left_anti").select(item, centre, "distance"))


def site_edges(nodes: DataFrame, sites: DataFrame, keys: list[str], node: str, x: str, y: str, apart: int) -> DataFrame:
    """Src (node), dst (site), dx, dy, weight 0: sites stand among the nodes as nodes of their own, and each node is tied to those near it on both sides.
    nodes and sites have the same key and position columns; ids of sites are kept apart by the column they come back in."""
    cell = lambda c: F.floor(F.col(c) / apart)
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    a = nodes.select(*(F.col(c).alias(f"a_{c}") for c in (*keys, node, x, y))).withColumn("__cx", cell(f"a_{x}")).withColumn("__cy", cell(f"a_{y}"))
    b = sites.select(*(F.col(c).alias(f"b_{c}") for c in (*keys, node, x, y))).withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
    b = b.withColumn("__bx", cell(f"b_{x}") + F.col("__dx")).withColumn("__by", cell(f"b_{y}") + F.col("__dy"))
    dx, dy = F.abs(F.col(f"a_{x}") - F.col(f"b_{x}")), F.abs(F.col(f"a_{y}") - F.col(f"b_{y}"))
    on = (F.col("__cx") == F.col("__bx")) & (F.col("__cy") == F.col("__by")) & (dx < apart) & (dy < apart)
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return a.join(b, on).select(F.col(f"a_{node}").alias("src"), F.col(f"b_{node}").alias("dst"), dx.alias("dx"), dy.alias("dy"), F.lit(SITE_EDGE).alias("weight"))


def capped(pairs: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """At most `most` partners b of each a, an even draw that depends on the two ids only (by the order of the md5 of both)."""
    w = W.partitionBy(a).orderBy(F.md5(F.concat_ws("|", F.col(a).cast("string"), F.col(b).cast("string"))), b)
    return pairs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
