"""The workflows as table pipelines: fetch, call, run, merge, filter, sites; and the facade over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import bases as bs
from ..functions import cigar as cg
from ..functions import genotype as gtp
from ..functions import geometry as geo
from ..functions import sequence
from ..operators import calling, depth, graph, intervals, pairs, rollups
from ..session import materialize
from ..sinks import files as sink
from ..sources import files, vcf
from .config import Options

#: Columns of the event table (P10), in the order of outputs; those a workflow does not know are null. Places and groups, support, quality, sequence, depth, genotype.
EVENTS = (
    "chrom string, pos bigint, chr2 string, end_pos bigint, sample string, event_id bigint, grp bigint, n_in_grp bigint, svtype string, ct string, svlen bigint, lprec bigint, cipos95 bigint, ciend95 bigint, "
    "precise_a boolean, precise_b boolean, query_overlap bigint, query_gap bigint, jitter double, kind string, rt string, site_id string, partners string, "
    "su bigint, pe bigint, sr bigint, sc bigint, bnd bigint, wr bigint, np bigint, plus bigint, minus bigint, strand_bias double, double_clips bigint, n_unmapped_mates bigint, n_small_tlen bigint, block_edge bigint, linked bigint, "
    "mapq double, mapq_pri double, mapq_supp double, nm_pri double, nm_supp double, nm_base double, n_sa double, n_xa double, n_gaps double, max_as_supp bigint, sqc double, scw double, clip_qual_ratio double, bad_clip_count bigint, "
    "contig_a string, contig_b string, left_ins string, right_ins string, ref_seq string, variant_seq string, gc double, rep double, rep_sc double, ref_rep double, compress double, nexp bigint, stride bigint, expseq string, rpoly bigint, "
    "ref_bases bigint, ras bigint, fas bigint, remap_score bigint, remap_ed bigint, modified bigint, cov double, mcov double, inner_cn double, outer_cn double, fold_change double, "
    "neigh bigint, neigh10 bigint, gt string, gq int, a_freq double, haplotype string, phase_set bigint, prob double, mean_prob double, max_prob double, filt string, table_name string"
)


def as_events(df: DataFrame) -> DataFrame:
    """Df in the columns of EVENTS, missing ones null."""
    out = []
    for f in EVENTS.split(", "):
        name, kind = f.split(" ")
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def fetch(reads: DataFrame, opt: Options = Options(), include: DataFrame | None = None, exclude: DataFrame | None = None, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(reads with evidence, depth runs). include and exclude are interval tables (chrom, start, end); what is excluded is taken from
    what is included; with regions_only both mates have to lie in what is included. Reads in places deeper than max_cov are left out, and so are reads with edits at or over 13 times
    `divergence` (where nm is there and divergence is a number); depth counts all primary reads, the low in quality too.
    With `by`, a column of sample names, depth is of each sample by itself: the runs are by place (_place)."""
    mapped = reads.where((F.col("flag").bitwiseAND(1284) == 0) & (F.col("rname") != "*") & (cg.op_count("cigar") > 0))
    r = mapped.withColumn("start", F.col("pos").cast("long")).withColumn("stop", F.col("pos") + cg.reference_length("cigar"))
    key = "place" if by else "rname"
    r = r.withColumn("place", _place(by, "rname")) if by else r
    track = depth.depth_track(r, key, "start", "stop")
    clip = F.greatest(cg.left_clip("cigar"), cg.right_clip("cigar")) >= (opt.clip_length if opt.clip_length > 0 else 50)
    gap = cg.has_op("cigar", "I", opt.min_size) | cg.has_op("cigar", "D", opt.min_size)
    odd = cg.flag(1) & ~cg.flag(2)
    r = r.where((F.col("mapq") >= opt.mq) & (clip | gap | odd | cg.flag(2048) | F.col("sa").isNotNull()))
    if opt.divergence != "auto" and "nm" in r.columns:
        r = r.where(F.coalesce(F.col("nm") < F.greatest(F.lit(1), F.floor(cg.aligned_bases("cigar") * 13 * opt.divergence)), F.lit(True)))
    if include is not None:
        reg = intervals.subtract_intervals(include, exclude, ["chrom"], "start", "end") if exclude is not None else include
        reg = intervals.merge_intervals(reg, ["chrom"], "start", "end").select(F.col("chrom").alias("rc"), F.col("start").alias("rs"), F.col("end").alias("re"))
        r = intervals.range_join(r, reg, [("rname", "rc")], ("start", "stop"), ("rs", "re"), 8192, "left_semi")
        if opt.regions_only:  # the mate's place too, where there is one
            r = r.withColumn("__mc", F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))).withColumn("__mp", F.col("pnext").cast("long"))
            mated = (F.col("__mc") != "*") & (F.col("__mp") >= 0)
            r = r.where(~mated | mated.isNull()).unionByName(intervals.range_join(r.where(mated), reg, [("__mc", "rc")], ("__mp", "__mp"), ("rs", "re"), 8192, "left_semi")).drop("__mc", "__mp")
    elif exclude is not None:
        reg = intervals.merge_intervals(exclude, ["chrom"], "start", "end").select(F.col("chrom").alias("rc"), F.col("start").alias("rs"), F.col("end").alias("re"))
        r = intervals.range_join(r, reg, [("rname", "rc")], ("start", "start"), ("rs", "re"), 8192, "left_anti")
    if opt.max_cov > 0:
        r = depth.depth_at(r, track, key, "start").where(F.col("depth") <= opt.max_cov).drop("depth")
    return r, track


def _place(sample: str, chrom: str):
    return F.concat_ws("\t", F.coalesce(sample, F.lit("")), chrom)


def alike(opt: Options):
    """Whether two near nodes (columns a_* and b_*: chrom_a, chrom_b, break_a, break_b, gap, svtype, how) are one event: with a reciprocal overlap and second breaks nearer
    than 150 by their in-read lengths (sd) where both have one, else by the span-position rule (dist_norm, spd)."""
    c = F.col
    at = [c("a_break_a"), c("a_break_b"), c("b_break_a"), c("b_break_b")]
    far = lambda long, trust: geo.alike_spans(*at, opt.dist_norm, opt.spd, long, F.coalesce("a_gap", F.lit(0)), F.coalesce("b_gap", F.lit(0)), trust)
    rule = lambda long: F.when(c("a_svtype") == "INS", far(long, opt.trust_ins_len)).otherwise(far(long, False))
    span = F.when((c("a_how") == "sr") | (c("b_how") == "sr"), rule(True)).otherwise(rule(False)) if opt.paired else rule(True)
    overlap = (c("a_chrom_a") != c("a_chrom_b")) | geo.reciprocal(*at)
    lengths = F.abs(c("a_gap") - c("b_gap")) / F.greatest("a_gap", "b_gap") < opt.sd
    return F.when(overlap & (F.abs(at[1] - at[3]) < 150), F.coalesce(lengths, F.lit(True))).otherwise(span)


def call(reads: DataFrame, track: DataFrame, opt: Options = Options(), row: str = "read_id", sample: str = "sample", scorer: calling.Scorer | None = None, by: str | None = None) -> DataFrame:
    """Events from reads with evidence (columns of an alignment record, `row`, start, stop; seq where clips are to be compared).

    Pairs of templates, junctions of split reads, in-read gaps and clips become breaks with a type and two places (a clip has one). Breaks of one
    type near each other on both sides and clips that share minimizers are edges of weight 2, neighbours on a template of weight 1. What hangs
    together by weight 2 is a cluster, and a cluster with enough support a call; what hangs together by any edge is a group (grp). With `contigs`, the reads of a
    call whose bases are kept are assembled to a consensus (contig_a, clipped bases in lower case). Depth, neighbours, genotype by the support ladders
    and score follow. With `by`, a column of sample names (and a track by place), every sample is called by itself.
    """
    with_contigs = opt.contigs and "seq" in reads.columns
    scorer = scorer or calling.Scorer(thresholds=dict(zip(("DEL", "INS", "INV", "DUP", "TRA"), opt.thresholds)))
    apart = 300 if opt.paired else 500
    least_clip = opt.clip_length if opt.clip_length > 0 else 50
    # a name may come in several samples: templates are of a sample
    reads = reads.withColumn("sample", F.coalesce(by, F.lit("")) if by else F.lit(sample))
    reads = reads.withColumn("template", F.when(F.col("qname").isNotNull(), F.concat_ws("\t", "sample", "qname")))
    owner = reads.select(F.col(row).alias("a"), "sample")
    kept = ["node", "__row", "sample", "template", "chrom_a", "chrom_b", "svtype", "ct", "break_a", "break_b", "precise_a", "precise_b", "length", "mapq", "how"]
    sides = [("chrom_a", "chrom_b"), ("break_a", "break_b"), ("precise_a", "precise_b")]
    splits = materialize(calling.split_breaks(reads, "template", row, opt.mq).join(owner.withColumnRenamed("a", row), row))
    p = materialize(calling.classified_pairs(reads, "template", row))  # a filter must not be pushed into the rules
    p = p.join(reads.select(F.col(row).alias("a"), "sample", "flag", F.abs("tlen").alias("tlen"), "mapq"), "a").join(reads.select(F.col(row).alias("b"), F.col("flag").alias("fb")), "b")
    # a read and its supplementary tell a junction of the SA tag: counted there
    one_read = F.col("flag").bitwiseAND(64) == F.col("fb").bitwiseAND(64)
    told = splits.select("template", F.col("part").alias("__part")).distinct().withColumn("__told", F.lit(True))
    p = p.withColumn("__part", F.col("flag").bitwiseAND(64)).join(told, ["template", "__part"], "left").where(~(one_read & F.coalesce("__told", F.lit(False))))
    odd = (F.col("flag").bitwiseAND(2) == 0) | F.col("length").isNotNull() | (F.col("tlen") > opt.max_tlen)
    by_pair = p.where(odd).withColumn("node", F.col("a")).withColumn("__row", F.col("a")).withColumn("how", F.lit("pe")).select(*kept)
    by_split = splits.withColumn("node", F.xxhash64(row, "place", F.lit("split"))).withColumn("__row", F.col(row)).withColumn("how", F.lit("sr")).select(*kept)
    breaks = pairs.canonical(by_pair.unionByName(by_split), sides, ("chrom_a", "chrom_b"), ("break_a", "break_b"), "ct")
    gaps = reads.select(row, "sample", "template", "rname", "mapq", F.explode(F.filter(cg.walk("cigar", "start"), lambda g: g["op"].isin("I", "D") & (g["len"] >= opt.min_size))).alias("g"))
    t = F.when(F.col("g.op") == "I", "INS").otherwise("DEL")
    by_gap = gaps.select(F.xxhash64(row, F.col("g.idx")).alias("node"), F.col(row).alias("__row"), "sample", "template", F.col("rname").alias("chrom_a"), F.col("rname").alias("chrom_b"), t.alias("svtype"), F.lit("3to5").alias("ct"), F.col("g.ref_start").alias("break_a"), cg.end_position(t, F.col("g.ref_start"), F.col("g.len")).alias("break_b"), F.lit(True).alias("precise_a"), F.lit(True).alias("precise_b"), F.col("g.len").cast("long").alias("length"), "mapq", F.lit("wr").alias("how"))
    clips = materialize(calling.clip_breaks(reads, "template", row, least_clip).join(owner.withColumnRenamed("a", row), row).withColumn("node", F.xxhash64(row, "side", F.lit("clip"))))
    no = F.lit(None)
    by_clip = clips.select("node", F.col(row).alias("__row"), "sample", "template", F.col("chrom").alias("chrom_a"), F.col("chrom").alias("chrom_b"), F.lit("BND").alias("svtype"), no.cast("string").alias("ct"), F.col("at").alias("break_a"), F.col("at").alias("break_b"), F.lit(True).alias("precise_a"), F.lit(True).alias("precise_b"), no.cast("long").alias("length"), "mapq", F.lit("sc").alias("how"))
    nodes = materialize(breaks.unionByName(by_gap).unionByName(by_clip).where("break_a is not null and break_b is not null"))
    # equal nodes are one in the comparison of pairs, so that crowded places need no limit of partners
    same = ["sample", "svtype", "chrom_a", "chrom_b", "break_a", "break_b", "gap", "how"]
    placed = nodes.where("how <> 'sc'").withColumn("gap", F.when(F.col("how") == "wr", F.col("length")).otherwise(0)).withColumn("gap", F.nullif("gap", F.lit(0)))
    placed = materialize(placed.select("node", *same).withColumn("rep", F.min("node").over(W.partitionBy(*same))))
    copies = placed.where("node <> rep").select(F.col("rep").alias("src"), F.col("node").alias("dst"), F.lit(pairs.SIMILAR_EDGE).alias("weight"))
    near = pairs.proximity_edges(placed.where("node = rep").drop("rep"), ["sample", "svtype", "chrom_a", "chrom_b"], "node", "break_a", "break_b", apart, alike(opt), None)
    near = near.select("src", "dst", "weight").unionByName(copies)
    alike_clips = pairs.minimizer_edges(clips, ["sample", "chrom", "side"], "node", "at", "mins", star=True).withColumn("weight", F.lit(pairs.SIMILAR_EDGE))
    edges = materialize(pairs.union_edges(near, alike_clips, pairs.template_edges(nodes, "template", "node", ["chrom_a", "break_a"])))
    comp = graph.connected_components(edges.where(F.col("weight") == pairs.SIMILAR_EDGE), nodes=nodes.select("node"))
    groups = graph.connected_components(edges, nodes=nodes.select("node")).withColumnRenamed("component", "grp")
    clusters = materialize(nodes.join(comp, "node").join(groups, "node"))
    least = opt.min_support if isinstance(opt.min_support, int) else 2
    calls = materialize(calling.assemble(clusters, ["component"], least)).withColumnRenamed("pe", "n")
    kinds = [F.count_if(F.col("how") == h).alias(h) for h in ("pe", "sr", "sc", "wr")]
    figures = clusters.groupBy("component").agg(*kinds, F.avg("mapq").alias("mapq"), F.min("grp").alias("grp"), F.min("sample").alias("sample"))
    e = calls.join(figures, "component").withColumn("su", F.col("n") + F.col("wr")).withColumn("precise", (F.col("precise_a") & F.col("precise_b")).cast("int"))
    e = e.withColumn("bnd", F.when(F.col("svtype") == "BND", F.col("n")).otherwise(0)).withColumn("svlen", F.when(F.col("svtype") != "BND", F.col("svlen")))
    e = e.where((F.coalesce("svlen", F.lit(opt.min_size)) >= opt.min_size) | (F.col("chrom") != F.col("chr2")))
    e = e.join(e.groupBy("grp").agg(F.count(F.lit(1)).alias("n_in_grp")), "grp")
    if with_contigs:
        of = e.select("component").join(clusters.select("component", "__row").distinct(), "component")
        parts = of.join(calling.read_contigs(reads, row).withColumnRenamed(row, "__row"), "__row").select("component", "contig")
        u = sequence.udfs()
        made = materialize(calling.consensus_by_component(parts, cased=True).where("consensus is not null").select("component", F.col("consensus").alias("contig_a")))
        made = made.select("component", "contig_a", cg.gc_percent("contig_a").alias("gc"), u["repeat_score"]("contig_a").alias("rep"), u["packed_percent"]("contig_a").alias("compress"), u["repeat_motif"]("contig_a").alias("expseq"), bs.inserted_bases(F.col("contig_a")).alias("left_ins"))
        e = e.join(made, "component", "left")
    e = e.withColumn("event_id", F.col("component")).withColumn("place", _place("sample", "chrom") if by else F.col("chrom"))
    e = materialize(e)
    tr = track.withColumnRenamed("rname", "place")
    flank = depth.window_means(e.select("event_id", "place", F.greatest(F.lit(0), F.col("pos") - 10_000).alias("lo"), (F.col("pos") + 10_000).alias("hi")), tr, "place", ["event_id"], {"cov": ("lo", "hi")})
    inner = depth.window_means(e.where("chrom = chr2").select("event_id", "place", F.least("pos", "end_pos").alias("lo"), (F.greatest("pos", "end_pos") + 1).alias("hi")), tr, "place", ["event_id"], {"inner_cn": ("lo", "hi")})
    e = e.join(flank, "event_id", "left").join(inner, "event_id", "left").withColumn("outer_cn", F.col("cov"))
    if opt.min_support == "auto":
        e = e.where(F.col("su") >= gtp.least_support("cov", 0.05))
    e = intervals.count_near(e, ["place"], "pos", 50, 50, "neigh", own=False)
    e = intervals.count_near(e, ["place"], "pos", 10_000, 10_000, "neigh10", own=False)
    cov = F.coalesce("cov", F.lit(0.0))
    names = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("pe", "sc", "bnd", "su")} | {"icn": F.coalesce("inner_cn", cov), "ocn": cov, "spanning": F.coalesce("wr", F.lit(0)), "supp": F.coalesce("sr", F.lit(0)), "np": F.lit(0), "remap": F.lit(0)}
    names["contigs"] = F.col("contig_a").isNotNull().cast("int") if with_contigs else F.lit(0)
    loss = gtp.support_pair(names)
    gain = gtp.support_pair_gain(names) if opt.paired else gtp.support_pair_long(names["su"], names["spanning"], names["icn"], names["ocn"])
    like = F.col("svtype").isin("INS", "DUP")
    ref, alt = (F.when(like, g.cast("double")).otherwise(x) for x, g in zip(loss, gain))
    gt, gq = gtp.genotype(F.greatest(F.lit(0.0), ref), F.greatest(F.lit(0.0), alt), F.col("svtype"))
    e = e.withColumn("gt", gt).withColumn("gq", gq).withColumn("a_freq", F.round(F.least(F.lit(1.0), F.col("su") / (F.coalesce("cov", F.lit(0.0)) + 1e-5)), 3))
    model = scorer if (with_contigs and opt.diploid) or not isinstance(scorer, calling.Scorer) else scorer.variant(with_contigs, opt.diploid, {"precise": 1.0})
    e = e.withColumn("prob", model.prob(e)).withColumn("fold_change", depth.fold_change("inner_cn", "outer_cn", "svtype"))
    return as_events(e.withColumn("filt", scorer.label(F.col("prob"), F.col("svtype"))))


#: Counters that are summed over the events of a cluster, beside su.
COUNTERS = ("pe", "sr", "sc", "bnd", "wr", "np", "plus", "minus", "double_clips", "n_unmapped_mates", "n_small_tlen")


def merge(events: DataFrame, opt: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(cohort events, membership) of the events of several samples (columns of EVENTS with unique event_id).

    All samples are compared at once by a range join; the result is that of a fold over samples without its dependence on their order (U06).
    Without merge_across every event is a cluster of its own; no event is compared with more than max_comparisons others where that is over 0 (an even
    draw by hash). membership: event_id, cluster.
    """
    c = events.select("event_id", "sample", "chrom", "pos", "chr2", "end_pos", "svtype", "svlen", F.col("cipos95").alias("ci")).where("svtype is not null")
    p = pairs.event_pairs(c, ["chrom", "svtype"], "event_id", "pos", "end_pos", "ci", opt.merge_dist, None if opt.merge_within else "sample")
    if not opt.merge_across:
        p = p.where("false")
    if opt.max_comparisons > 0:
        p = pairs.capped(p, "a_event_id", "b_event_id", opt.max_comparisons)
    links = p.where(pairs.merge_rule(opt.merge_within)).select(F.col("a_event_id").alias("src"), F.col("b_event_id").alias("dst"))
    member = graph.connected_components(links, nodes=c.select("event_id")).select(F.col("node").alias("event_id"), F.col("component").alias("cluster"))
    x = events.withColumn("__su", F.coalesce("su", F.lit(0))).withColumn("total_su", F.coalesce("su", F.lit(0))).join(member, "event_id")
    rank = F.struct(rollups.merge_rank(F.col("__su"), F.coalesce("wr", F.lit(0)), F.lit(False)), F.coalesce("svlen", F.lit(0)), -F.col("event_id"))
    keep = ["event_id", "chrom", "pos", "chr2", "end_pos", "svtype", "ct", "svlen", "cipos95", "ciend95"]
    counters = [c for c in COUNTERS if c in x.columns]
    means = ["prob", *(c for c in ("mapq", "mapq_pri", "mapq_supp", "nm_pri", "nm_supp", "nm_base") if c in x.columns)]
    tops = ["prob", *(c for c in ("max_as_supp",) if c in x.columns)]
    m = rollups.merge_rollup(x, ["cluster"], rank, keep, ["total_su", *counters], tops, means, "__su")
    for c in means[1:]:
        m = m.withColumnRenamed(f"mean_{c}", c)
    for c in tops[1:]:
        m = m.withColumnRenamed(f"max_{c}", c)
    if "contig_a" in x.columns:  # the longest contig of the cluster
        longest = F.max_by("contig_a", F.struct(F.length("contig_a"), -F.col("event_id")))
        m = m.join(x.where("contig_a is not null").groupBy("cluster").agg(longest.alias("contig_a")), "cluster", "left")
    return m.withColumnRenamed("total_su", "su"), member


def filter_events(events: DataFrame, normals: DataFrame | None, opt: Options = Options(), normal_reads: DataFrame | None = None) -> DataFrame:
    """Events with filt set by the first rule that fails: mapping quality, probability, allele fraction, support, overlap with a
    normal event, what normal reads say (see _judged_by_reads). Failing rows stay only with keep_all. normal_reads: read_id, rname, start, stop, flag, mapq, cigar,
    pnext, rnext, sa, and nm and seq where they are kept."""
    c = F.col
    reason = F.when(c("mapq") < opt.min_mapq, "lowMapQ").when(c("prob") < opt.min_prob, "lowProb").when(gtp.allele_fraction("a_freq", "su", "cov") < opt.min_af, "lowAF")
    reason = reason.when(F.coalesce(gtp.low_support("su", "cov", F.coalesce("inner_cn", F.lit(0.0)), F.coalesce("outer_cn", F.lit(0.0)), opt.support_fraction), F.lit(False)), "lowSupport")
    e = events.withColumn("__why", reason)
    if normals is not None:
        w = normals.where("svlen is not null").select("svtype", "svlen", F.explode(F.array(F.struct(c("chrom").alias("c"), c("pos").alias("p")), F.struct(c("chr2").alias("c"), c("end_pos").alias("p")))).alias("x")).select(c("x.c").alias("__wc"), c("x.p").alias("__wp"), c("svtype").alias("__wt"), c("svlen").alias("__wl")).distinct()
        left = e.where("__why is null").select("event_id", c("chrom").alias("__ec"), c("svtype").alias("__et"), c("pos").alias("__ep"), c("svlen").alias("__el"))
        hit = intervals.range_join(left, w, [("__ec", "__wc"), ("__et", "__wt")], ("__ep", "__ep"), (c("__wp") - opt.interval_size, c("__wp") + opt.interval_size), 2 * opt.interval_size)
        small = (F.greatest("__el", "__wl") >= 100) & (F.greatest("__el", "__wl") <= 500)
        ratio = F.least("__el", "__wl") / F.greatest("__el", "__wl")
        hit = hit.where(ratio > F.when(small, 0.5).otherwise(0.8)).select("event_id").distinct().withColumn("__hit", F.lit("normalOverlap"))
        e = e.join(hit, "event_id", "left").withColumn("__why", F.coalesce("__why", "__hit")).drop("__hit")
    if normal_reads is not None:
        e = _judged_by_reads(materialize(e), normal_reads, opt)
        e = e.withColumn("__why", F.coalesce("__why", "__ev")).drop("__ev")
    passed = F.when(c("prob") >= opt.pass_prob, "PASS").otherwise(c("filt"))
    out = e.withColumn("filt", F.when(c("__why").isNull(), passed).otherwise(sink.label(c("filt"), c("__why"))))
    return (out if opt.keep_all else out.where("__why is null")).drop("__why")


def _judged_by_reads(e: DataFrame, normal_reads: DataFrame, opt: Options) -> DataFrame:
    """Events with column __ev, what the normal reads say of those still open (__why null): normal where one tells the same event or its clip is that of
    a contig; of long reads also lowSupport where the place is hardly covered, support inside reads is low or clips crowd, and highDivergence."""
    c = F.col
    pad = 500 if opt.paired else 1000
    have = set(normal_reads.columns)
    read = normal_reads.select("read_id", "rname", "start", "stop", "flag", "mapq", "cigar", "pnext", "rnext", "sa", *(c(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in (("nm", "int"), ("seq", "string"))))
    keep = ["event_id", "chrom", "pos", "chr2", "end_pos", "svtype", "svlen", "ct"]
    cols = set(e.columns)
    open_ = e.where("__why is null").select(*(c(k) if k in cols else F.lit(None).cast("string").alias(k) for k in keep))
    near = pairs.reads_near(open_, read, "event_id", "read_id", pad)
    x = materialize(near.join(open_, "event_id").join(read, "read_id"))
    ev = calling.matching_evidence(x, "event_id", pad).select("event_id", "normal")
    contig = F.coalesce(*(c(k) for k in ("contig_a", "contig_b") if k in cols)) if {"contig_a", "contig_b"} & cols else F.lit(None).cast("string")
    ends = e.select("event_id", *bs.clipped_ends(contig, 1)).toDF("event_id", "__left", "__right")
    clips = calling.clip_evidence(x, "event_id", 50 if opt.paired else 500, 3 if opt.paired else 50).where("bases is not null").join(ends, "event_id")
    mine = F.when(c("clip_side") == "right", c("__right")).otherwise(c("__left"))
    clips = clips.where(F.length(mine) > 0).where(calling.clips_match(opt.paired)("bases", mine)).select("event_id", F.lit(True).alias("__clip")).distinct()
    e = e.join(ev, "event_id", "left").join(clips, "event_id", "left")
    reason = F.when(c("normal"), "normal")
    if not opt.paired:
        e = e.join(calling.region_figures(x, "event_id"), "event_id", "left")
        zero = lambda n: F.coalesce(c(n).cast("double"), F.lit(0.0))
        shape = (zero("cov"), zero("inner_cn"), zero("outer_cn"), opt.support_fraction)
        told = F.coalesce(c("n_aligns"), F.lit(0)) > 0
        reason = reason.when(told & (c("chrom") == c("chr2")) & gtp.low_covering_support("n_covering", "n_overlap0"), "lowSupport")
        reason = reason.when(told & (c("chrom") == c("chr2")) & gtp.low_in_read_support(F.coalesce(c("wr"), F.lit(0)), *shape, c("n_overlap"), c("n_overlap0")), "lowSupport")
        reason = reason.when(told & c("svtype").isin("INV", "TRA") & contig.isNull() & gtp.crowded_by_clips(c("n_clipped"), *shape), "lowSupport")
    reason = reason.when(c("__clip"), "normal")
    if not opt.paired:
        base = F.coalesce(c("nm_base"), F.lit(0.0)) if "nm_base" in cols else F.lit(0.0)
        reason = reason.when(told & gtp.poorly_aligned("sum_edits", "sum_gaps", "n_aligns", base, "sum_nm", opt.max_divergence), "highDivergence")
    return e.withColumn("__ev", F.when(c("__why").isNull(), reason)).drop("normal", "__clip", "n_aligns", "n_overlap", "n_overlap0", "n_covering", "n_clipped", "sum_edits", "sum_gaps", "sum_nm")


def genotype_sites(events: DataFrame, sites: DataFrame, opt: Options = Options(), within: int = 50) -> DataFrame:
    """Events with the site nearest to each (same chromosome and type), their probability updated with the site's, the best call per
    site kept; with all_sites, sites without a call are added as 0/0."""
    s = sites.select(F.col("chrom").alias("__sc"), F.col("start").alias("__sp"), F.col("svtype").alias("__st"), F.col("id").alias("site_id"), F.col("prob").alias("__prob"))
    near = intervals.nearest_join(events.select("event_id", "chrom", "svtype", "pos"), s, [("chrom", "__sc"), ("svtype", "__st")], "pos", "__sp", within, ["event_id"]).select("event_id", "site_id", F.col("__prob").alias("site_prob"))
    e = events.drop("site_id").join(near, "event_id", "left")
    e = e.withColumn("prob", F.when(F.col("site_prob").isNotNull(), F.round(gtp.posterior([F.col("prob"), F.col("site_prob")]), 3)).otherwise(F.col("prob")))
    best = rollups.best_per(e.where("site_id is not null"), ["site_id"], [-F.coalesce("prob", F.lit(0.0))], ["event_id"]).select("event_id", F.lit(True).alias("__best"))
    e = e.join(best, "event_id", "left").where("site_id is null or __best").drop("__best", "site_prob")
    if not opt.all_sites:
        return e
    missing = sites.join(e.where("site_id is not null").select(F.col("site_id").alias("id")), "id", "left_anti")
    blank = missing.select("chrom", F.col("start").alias("pos"), F.col("chrom2").alias("chr2"), F.col("end").alias("end_pos"), "svtype", "svlen", F.col("id").alias("site_id"), F.lit("0/0").alias("gt"), *(F.lit(0).cast("long").alias(c) for c in ("su", "pe", "wr")))
    return e.unionByName(blank, allowMissingColumns=True)


def events_of_vcf(spark: SparkSession, path: str | list[str], target: str | None = None) -> DataFrame:
    """The events of VCF files in the columns of EVENTS; event_id is the record's number, or a hash where it has none."""
    e = vcf.read_events(spark, path, target)
    number = F.coalesce(F.col("id").try_cast("long"), F.xxhash64("id", "chrom", "pos"))
    return as_events(e.withColumn("event_id", number).withColumn("table_name", F.col("file")).withColumn("svlen", F.abs("svlen")).withColumn("gq", F.col("gq").try_cast("int")))


def cohort_lines(events: DataFrame, opt: Options = Options()) -> tuple[DataFrame, list[str]]:
    """(chrom, pos, line) of a multi-sample VCF of merged events, and its sample names in order.

    Of several events of a sample in one cluster the one with most support is shown; a sample without one shows 0/0. The
    names are collected: one per input sample.
    """
    samples = [r["sample"] for r in events.select("sample").distinct().orderBy("sample").collect()]
    cohort, member = merge(events, opt)
    cohort, member = materialize(cohort), materialize(member)
    own = events.join(member, "event_id").where(F.col("sample").isNotNull())
    best = rollups.best_per(own, ["cluster", "sample"], [-F.coalesce("su", F.lit(0))], ["event_id"]).select("event_id")
    wide = sink.multi_sample(own.join(best, "event_id", "left_semi"), ["cluster"], "sample", samples)
    site = cohort.withColumn("id", F.col("event_id").cast("string")).withColumn("grp", F.col("cluster")).withColumn("prob", F.col("max_prob")).withColumn("filt", F.lit("PASS"))
    lines = sink.vcf_lines(site.withColumn("cluster", F.col("cluster")), extra=["cluster"])
    head = F.substring_index("line", "\t", 9)
    return lines.join(wide, "cluster").select("chrom", "pos", F.concat_ws("\t", head, *(F.col(f"`{s}`") for s in samples)).alias("line")), samples


class Engine:
    """The workflows on one session. Options are checked when the engine is made."""

    def __init__(self, spark: SparkSession, preset: str = "pe", scorer: calling.Scorer | None = None, **options) -> None:
        self.spark, self.options, self.scorer = spark, Options.of(preset, **options), scorer

    def read(self, path: str) -> DataFrame:
        """Alignments of SAM, BAM or Parquet, by extension, with a read_id."""
        if path.endswith(".bam"):
            self.spark.dataSource.register(files.BamSource)
            r = self.spark.read.format("bam").load(path)
        elif path.endswith(".parquet"):
            return self.spark.read.parquet(path)
        else:
            r = files.read_sam(self.spark, path)
        return r.withColumn("read_id", F.xxhash64("qname", "flag", "rname", "pos", "cigar"))

    def run(self, reads: DataFrame, sample: str = "sample", include: DataFrame | None = None, exclude: DataFrame | None = None, sites: DataFrame | None = None, fasta: DataFrame | None = None) -> DataFrame:
        """Events of the reads of one sample. With a reference (read_fasta) and drop_gaps, long events near its gaps that no read spans are left out."""
        r, track = fetch(reads, self.options, include, exclude)
        e = call(materialize(r), track, self.options, sample=sample, scorer=self.scorer)
        if fasta is not None and self.options.drop_gaps:
            e = materialize(e)
            long_ = F.when((F.col("svtype") == "INS") & F.lit(self.options.paired), 250).otherwise(1000)
            at_risk = e.where((F.coalesce("wr", F.lit(0)) == 0) & ((F.col("chrom") != F.col("chr2")) | (F.coalesce("svlen", F.lit(0)) >= long_)))
            e = e.join(calling.near_reference_gap(at_risk, fasta, "event_id").where("gap").select("event_id"), "event_id", "left_anti")
        return genotype_sites(e, sites, self.options) if sites is not None else e

    def merge(self, *tables: DataFrame) -> DataFrame:
        all_ = None
        for i, t in enumerate(tables):
            t = as_events(t).withColumn("table_name", F.coalesce("table_name", F.lit(f"table{i}")))
            all_ = t if all_ is None else all_.unionByName(t)
        all_ = materialize(all_.withColumn("event_id", F.xxhash64("table_name", "event_id")))
        return merge(all_, self.options)[0]

    def filter(self, events: DataFrame, normals: DataFrame | None = None, normal_reads: DataFrame | None = None) -> DataFrame:
        return filter_events(events, normals, self.options, normal_reads)

    def sites(self, path: str, own_sample: str | None = None) -> DataFrame:
        return vcf.sites_of(vcf.read_events(self.spark, path), self.options.sites_pass_only, own_sample, self.options.sites_prob)

    def write_vcf(self, events: DataFrame, path: str, sample: str, mode: str = "errorifexists", fasta: DataFrame | None = None, metrics: bool = False) -> None:
        """The events as a VCF. verbosity 0 leaves both contigs out, 1 the second; metrics writes all FORMAT keys; with a reference the bases of deletions under symbolic_sv_size are written out."""
        e = events.drop(*(("contig_a", "contig_b"), ("contig_b",), ())[min(self.options.verbosity, 2)]).withColumn("id", F.col("event_id").cast("string"))
        if fasta is not None:
            e = materialize(e)
            span = e.select("event_id", "chrom", "pos", F.when((F.col("svtype") == "DEL") & (F.col("svlen") < self.options.symbolic_sv_size), F.col("end_pos")).otherwise(F.col("pos") + 1).alias("to"))
            e = e.drop("ref_seq").join(files.fetch_bases(span, fasta, ["event_id"], "chrom", "pos", "to"), "event_id")
            ref, alt = calling.reference_allele(F.coalesce("svtype", F.lit("BND")), F.col("bases"), F.coalesce("svlen", F.lit(0)), self.options.symbolic_sv_size)
            e = e.withColumn("ref_seq", ref).withColumn("alt", alt).drop("bases")
        sink.write_vcf(sink.vcf_lines(e, keys=sink.FULL_FORMAT if metrics else sink.FORMAT), path, [sample], mode, keys=sink.FULL_FORMAT if metrics else sink.FORMAT)
