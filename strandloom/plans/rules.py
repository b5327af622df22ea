"""Queries of the rules that keep, label and weigh reads and calls, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bases as bs
from ..functions import cigar as cg
from ..functions import genotype as gtp
from ..operators import calling, intervals, pairs, rollups
from ..session import materialize
from ..sinks import files as sink
from ..sources import files
from .catalog import _C, _CLOSE, _R, _S, _SITES, _CLIP_L, _CLIP_R, _LIST, _ALIGNED, calls, reads, sites, spans
from .problems import table
from .registry import query

# ---------------------------------------------------------------- filters on calls

#: Figures of a call that the tables do not hold, made of those they do, the same way in both languages.
_FIGURES = f"""{_C}, f AS (SELECT call_id, svtype, coalesce(svlen, 0) AS svlen, CAST(su AS DOUBLE) AS su, coalesce(ci, 0) AS ci, coalesce(prob, 0) AS prob, CAST(coalesce(su, 0) % 3 AS DOUBLE) AS wr, CAST(coalesce(su, 0) % 7 AS DOUBLE) AS icn, CAST(coalesce(su, 0) % 5 AS DOUBLE) AS ocn,
  CAST(coalesce(svlen, 0) % 40 AS DOUBLE) AS cov, CAST(coalesce(ci, 0) % 9 AS DOUBLE) AS near, CAST(coalesce(ci, 0) % 4 AS DOUBLE) AS low FROM c)"""


def _figures(spark, sf) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    part = lambda c, n: (zero(c) % n).cast("double")
    c = calls(spark, sf)
    return c.select("call_id", "svtype", zero("svlen").alias("svlen"), F.col("su").cast("double").alias("su"), zero("ci").alias("ci"), F.coalesce("prob", F.lit(0.0)).alias("prob"), part("su", 3).alias("wr"), part("su", 7).alias("icn"), part("su", 5).alias("ocn"), part("svlen", 40).alias("cov"), part("ci", 9).alias("near"), part("ci", 4).alias("low"))


_SCALED = "CASE WHEN greatest(icn, ocn) = 0 THEN cov ELSE cov * least(icn, ocn) / greatest(icn, ocn) END"
_NONE = "(greatest(icn, ocn) = 0 AND cov = 0)"


@query("F16 F17 F18 F19 F22", f"""WITH {_FIGURES}, g AS (SELECT *, {_SCALED} AS sc FROM f)
SELECT call_id, coalesce(NOT {_NONE} AND su < CASE WHEN ci > svlen THEN round_even(1.5 + 0.2 * sc, 0) ELSE round_even(1.5 + 0.1 * sc, 0) END, false) AS low_support,
  wr > 0 AND wr < least(4, round_even(1.5 + 0.05 * CASE WHEN near > 0 AND low / nullif(near, 0) > 0.3 THEN greatest(sc, near) ELSE sc END, 0)) AS low_in_read, near - low <= 2 AS low_covering,
  NOT {_NONE} AND near >= round_even(1 + 0.05 * sc, 0) AS crowded, coalesce(low / nullif(near, 0) > 0.08 OR wr / nullif(near, 0) > 0.04 OR prob > 400 * low / nullif(near, 0), false) AS poorly_aligned,
  least(icn, ocn) / (greatest(icn, ocn) + 1e-6) > 0.01 AS depth_kept FROM g""")
def somatic_rules(spark, sf):
    """The rules by which reads of normal samples put a call out, on every call."""
    f = _figures(spark, sf)
    c = F.col
    return f.select(
        "call_id", F.coalesce(gtp.low_support("su", "cov", "icn", "ocn", 0.1, "ci", "svlen"), F.lit(False)).alias("low_support"), gtp.low_in_read_support("wr", "cov", "icn", "ocn", 0.1, "near", "low").alias("low_in_read"),
        gtp.low_covering_support("near", "low").alias("low_covering"), gtp.crowded_by_clips("near", "cov", "icn", "ocn", 0.1).alias("crowded"), gtp.poorly_aligned("low", "wr", "near", "prob", "low").alias("poorly_aligned"),
        calling.depth_ratio_kept(c("icn"), c("ocn")).alias("depth_kept"),
    )


_LOW = "least(icn, ocn)"
_MOVED = "(CASE WHEN low = 1 THEN 2 ELSE 1 END * (near + wr - supp))"


@query("X32", f"""WITH {_FIGURES}, k AS (SELECT f.*, near AS sc, wr AS bnd, CAST(svlen % 2 AS DOUBLE) AS supp, CAST(ci % 2 AS DOUBLE) AS np, CAST(svlen % 11 = 3 AS INTEGER) AS pe, CAST(svlen % 13 = 5 AS INTEGER) AS remap FROM f WHERE su IS NOT NULL),
m AS (SELECT *, (CASE WHEN low = 1 THEN 2 ELSE 1 END * (sc + bnd - supp)) AS moved, CASE WHEN ocn <= 0 THEN 2 ELSE icn / ocn END AS ratio FROM k), x AS (SELECT *, greatest(0, {_LOW} - moved) AS rest FROM m)
SELECT call_id, CAST(CASE WHEN pe > 0 OR wr > 0 THEN {_LOW} WHEN remap > 0 THEN {_LOW} WHEN supp > 0 THEN CASE WHEN icn > 1.25 * ocn THEN (icn - ocn) / (icn + ocn) * ocn ELSE rest END WHEN np > 0 THEN {_LOW} WHEN icn < su THEN icn ELSE ocn END AS DOUBLE) AS loss_ref,
  CAST(CASE WHEN pe > 0 OR wr > 0 THEN pe + 0.5 * wr WHEN remap > 0 THEN CASE WHEN bnd = 0 THEN greatest(sc, supp) ELSE CASE WHEN low = 1 THEN 3.5 ELSE 2.5 END * (sc + bnd - supp) END WHEN supp > 0 THEN supp WHEN np > 0 THEN 2 * np WHEN icn < su THEN su ELSE icn END AS DOUBLE) AS loss_alt,
  CAST(CASE WHEN ratio > 1.75 THEN greatest(0, icn - 2 * (icn - ocn)) WHEN pe > 0 OR wr > 0 THEN {_LOW} WHEN remap > 0 THEN rest WHEN supp > 0 THEN rest WHEN np > 0 THEN {_LOW} - 2 * np WHEN icn > su THEN icn - su ELSE 0 END AS DOUBLE) AS gain_ref,
  CAST(CASE WHEN ratio > 1.75 THEN su WHEN pe > 0 OR wr > 0 THEN pe + 0.5 * wr WHEN remap > 0 THEN moved WHEN supp > 0 THEN supp WHEN np > 0 THEN 2 * np WHEN icn > su THEN su ELSE 0 END AS DOUBLE) AS gain_alt,
  greatest(0, CAST(trunc(greatest(icn, ocn) - (su - wr)) AS INTEGER)) AS long_ref, greatest(CAST(trunc(greatest(icn, ocn) - {_LOW}) AS INTEGER), CAST(trunc(su - wr) AS INTEGER)) AS long_alt FROM x""")
def support_ladders(spark, sf):
    """Support of either allele by the first rule that holds, for losses, for gains of paired reads and for gains of long reads."""
    k = _figures(spark, sf).where("su is not null").withColumn("sc", F.col("near")).withColumn("bnd", F.col("wr")).withColumn("supp", (F.col("svlen") % 2).cast("double")).withColumn("np", (F.col("ci") % 2).cast("double"))
    k = k.withColumn("pe", (F.col("svlen") % 11 == 3).cast("int")).withColumn("remap", (F.col("svlen") % 13 == 5).cast("int"))
    names = {n: n for n in ("icn", "ocn", "pe", "supp", "sc", "bnd", "np", "su", "remap")} | {"spanning": "wr", "contigs": "low"}
    (lr, la), (gr, ga), (nr, na) = gtp.support_pair(names), gtp.support_pair_gain(names), gtp.support_pair_long("su", "wr", "icn", "ocn")
    return k.select("call_id", lr.alias("loss_ref"), la.alias("loss_alt"), gr.alias("gain_ref"), ga.alias("gain_alt"), nr.alias("long_ref"), na.alias("long_alt"))


@query("M02", f"""WITH {_FIGURES} SELECT call_id, round(1 / (1 + exp(-(-1 + 0.1 * coalesce(su, 0) + 0.5 * wr + 0.05 * icn))), 3) AS full_model, round(1 / (1 + exp(-(-1 + 0.1 * coalesce(su, 0) + 0.05 * icn))), 3) AS no_contigs,
  round(1 / (1 + exp(-(-1 + 0.05 * 2 + 0.1 * coalesce(su, 0) + 0.5 * wr))), 3) AS no_diploid, round(1 / (1 + exp(-(-1 + 0.05 * 2 + 0.1 * coalesce(su, 0)))), 3) AS neither FROM f""")
def score_variants(spark, sf):
    """One model for all four kinds of calls: with and without contigs, of diploid samples and others."""
    f = _figures(spark, sf).withColumnRenamed("wr", "precise").withColumnRenamed("icn", "inner_cn")
    s = calling.Scorer(weights={"su": 0.1, "precise": 0.5, "inner_cn": 0.05}, bias=-1.0)
    v = {"full_model": s, "no_contigs": s.variant(contigs=False), "no_diploid": s.variant(diploid=False, usual={"inner_cn": 2.0}), "neither": s.variant(False, False, {"inner_cn": 2.0})}
    return f.select("call_id", *(m.prob(f).alias(n) for n, m in v.items()))


@query("A16", f"""WITH {_R}, g AS (SELECT sum(len) AS genome FROM (SELECT rname, max(pos) AS len FROM r WHERE rname <> '*' GROUP BY rname)), q AS (SELECT sample_name, count(*) AS n, median(CAST(CASE WHEN l > 0 THEN l END AS DOUBLE)) AS rl, sum(a) AS bases FROM (SELECT sample_name, coalesce(list_sum(list_transform(list_filter({_LIST}, lambda x: right(x, 1) IN ('M', 'I', 'S', '=', 'X')), lambda x: CAST(x[:-2] AS BIGINT))), 0) AS l, {_ALIGNED} AS a FROM r WHERE flag & 4 = 0 AND rname <> '*') GROUP BY sample_name)
SELECT sample_name, round(n * rl / genome * 0.98, 6) AS mean_cov, CAST(round_even(n * rl / genome * 0.98, 0) * 6 AS BIGINT) AS max_cov, CAST(round_even(1.5 + 0.05 * (bases / genome), 0) AS INTEGER) AS min_support FROM q, g""")
def auto_limits(spark, sf):
    """Mean and greatest coverage and least support of each sample, from its own reads; the genome is what the reads reach."""
    r = reads(spark, sf, "sample_name", "rname", "pos", "cigar", "flag", where=F.col("rname") != "*")
    genome = r.groupBy("rname").agg(F.max("pos").alias("len")).select(F.sum("len")).scalar()
    m = r.where(~cg.flag(4)).select("sample_name", cg.query_length("cigar").alias("l"), cg.aligned_bases("cigar").alias("a"))
    q = m.groupBy("sample_name").agg(F.count(F.lit(1)).alias("n"), F.median(F.when(F.col("l") > 0, F.col("l"))).alias("rl"), F.sum("a").alias("bases")).withColumn("genome", genome)
    mean, most, least = gtp.auto_limits("n", "rl", "bases", "genome")
    return q.select("sample_name", F.round(mean, 6).alias("mean_cov"), most.alias("max_cov"), least.alias("min_support"))


@query("A06 A07", f"""WITH {_C}, g AS (SELECT * FROM c WHERE grp >= 0 AND svtype IS NOT NULL AND chrom = chr2), n AS (SELECT grp, svtype, count(*) AS n FROM g GROUP BY 1, 2), b AS (SELECT grp, svtype, n, row_number() OVER (PARTITION BY grp ORDER BY n DESC, svtype) AS k FROM n),
x AS (SELECT g.*, b.n AS support FROM g JOIN b ON g.grp = b.grp AND g.svtype = b.svtype WHERE b.k = 1 AND b.n >= 2)
SELECT grp, svtype, min(chrom) AS chrom, CAST(floor(median(pos)) AS BIGINT) AS pos, CAST(floor(median(end_pos)) AS BIGINT) AS end_pos, CAST(floor(abs(quantile_cont(pos, 0.975) - median(pos))) AS BIGINT) AS cipos95, CAST(floor(abs(quantile_cont(end_pos, 0.975) - median(end_pos))) AS BIGINT) AS ciend95,
  CASE WHEN svtype = 'INS' THEN CAST(floor(median(svlen)) AS BIGINT) ELSE CAST(abs(floor(median(end_pos)) - floor(median(pos))) AS BIGINT) END AS svlen, max(support) AS n FROM x GROUP BY grp, svtype""")
def assembled_calls(spark, sf):
    """Groups of calls made into one call each: commonest type, median ends with half their intervals, length by the rule of the type."""
    c = calls(spark, sf, "grp >= 0 and svtype is not null and chrom = chr2")
    x = c.select("grp", "svtype", F.col("chrom").alias("chrom_a"), F.col("chr2").alias("chrom_b"), F.col("pos").alias("break_a"), F.col("end_pos").alias("break_b"), F.lit(True).alias("precise_a"), F.lit(True).alias("precise_b"), F.col("svlen").alias("length"))
    return calling.assemble(x, ["grp"], 2).select("grp", "svtype", "chrom", *(F.col(n).cast("long").alias(n) for n in ("pos", "end_pos", "cipos95", "ciend95", "svlen")), F.col("pe").alias("n"))


@query("A06", f"""WITH {_C}, m AS (SELECT *, median(pos) OVER (PARTITION BY svtype, chrom) AS mid FROM c WHERE svtype IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY svtype, chrom ORDER BY abs(pos - mid), call_id) AS k FROM m) SELECT svtype, chrom, call_id, pos FROM k WHERE k = 1""")
def middle_calls(spark, sf):
    """The call nearest to the median place of its type and chromosome, by two aggregates."""
    c = calls(spark, sf, "svtype is not null").select("svtype", "chrom", "call_id", "pos")
    return calling.nearest_to_middle(c, ["svtype", "chrom"], "pos", "call_id")


@query("K10 A20", f"""WITH {_C}, j AS (SELECT grp AS site, sample_name AS sample, min(call_id) AS call_id FROM c WHERE grp >= 0 AND sample_name IS NOT NULL GROUP BY 1, 2), o AS (SELECT site, sample, c.prob, c.gt, CASE WHEN c.call_id % 2 = 0 THEN round(coalesce(c.prob, 0) / 2, 3) END AS np, CASE WHEN c.call_id % 2 = 0 THEN '1/1' END AS ng FROM j JOIN c ON j.call_id = c.call_id),
n AS (SELECT *, CASE WHEN np IS NOT NULL AND (prob IS NULL OR round(np, 2) <> round(prob, 2)) THEN np ELSE prob END AS p2, CASE WHEN ng IS NOT NULL AND (gt IS NULL OR ng <> gt) THEN ng ELSE gt END AS g2 FROM o)
SELECT site, bool_or(p2 IS DISTINCT FROM prob OR g2 IS DISTINCT FROM gt) AS updated, CASE WHEN bool_or(p2 IS DISTINCT FROM prob OR g2 IS DISTINCT FROM gt) THEN round(avg(p2), 9) END AS mean_prob, CASE WHEN bool_or(p2 IS DISTINCT FROM prob OR g2 IS DISTINCT FROM gt) THEN round(max(p2), 6) END AS max_prob FROM n GROUP BY site""")
def cohort_update(spark, sf):
    """Groups as sites of a cohort: the calls of half the rows come again with other values, which replace those that differ; sites that changed get new figures."""
    c = calls(spark, sf, "grp >= 0 and sample_name is not null")
    one = c.groupBy(F.col("grp").alias("site"), F.col("sample_name").alias("sample")).agg(F.min(F.struct("call_id", "prob", "gt")).alias("r")).select("site", "sample", "r.*")
    again = one.where("call_id % 2 = 0").select("site", "sample", F.round(F.coalesce("prob", F.lit(0.0)) / 2, 3).alias("prob"), F.lit("1/1").alias("gt"))
    s = sink.update_cohort(one.select("site", "sample", "prob", "gt"), again, "site", "sample", ["prob", "gt"])[1]
    return s.select("site", "updated", F.round("mean_prob", 9).alias("mean_prob"), F.round("max_prob", 6).alias("max_prob"))


@query("A10 A11", f"""WITH {_C}, x AS (SELECT c.*, coalesce(su, 0) AS s0, coalesce(su, 0) % 3 AS wr, svtype IN ('INS', 'TRA', 'BND') AS halved FROM c WHERE grp >= 0 AND svtype IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN halved THEN (s0 + 3 * wr) / 2 ELSE s0 + 3 * wr END DESC, coalesce(svlen, 0) DESC, call_id) AS k FROM x)
SELECT grp, max(CASE WHEN k = 1 THEN call_id END) AS call_id, max(CASE WHEN k = 1 THEN svtype END) AS svtype, CAST(sum(s0) AS BIGINT) AS su, CAST(sum(wr) AS BIGINT) AS wr, round(max(prob), 6) AS max_prob, count(*) AS n_in_grp FROM k GROUP BY grp""")
def ranked_rollup(spark, sf):
    """The best event of each group by support and support inside reads, halved for the imprecise types, with the sums of the counters."""
    c = calls(spark, sf, "grp >= 0 and svtype is not null").withColumn("s0", F.coalesce("su", F.lit(0))).withColumn("w0", F.coalesce("su", F.lit(0)) % 3)
    rank = F.struct(rollups.merge_rank(F.col("s0"), F.col("w0"), F.col("svtype").isin("INS", "TRA", "BND")), F.coalesce("svlen", F.lit(0)), -F.col("call_id"))
    m = rollups.merge_rollup(c, ["grp"], rank, ["call_id", "svtype"], ["s0", "w0"], ["prob"], [], "s0")
    return m.select("grp", "call_id", "svtype", F.col("s0").alias("su"), F.col("w0").alias("wr"), F.round("max_prob", 6).alias("max_prob"), "n_in_grp")


@query("O04", f"""WITH {_C}, p AS (SELECT a.call_id AS a, b.call_id AS b FROM c a JOIN c b ON a.grp = b.grp AND a.grp >= 0 AND a.call_id <> b.call_id), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY md5(a || '|' || b), b) AS k FROM p) SELECT a, b FROM k WHERE k <= 3""")
def capped_partners(spark, sf):
    """An even draw of three partners of each call within its group: the cap is the operator. Groups of calls are small."""
    c = calls(spark, sf, "grp >= 0").select("call_id", "grp")
    p = c.select(F.col("call_id").alias("a"), "grp").join(c.select(F.col("call_id").alias("b"), "grp"), "grp").where("a <> b")
    return pairs.capped(p.select("a", "b"), "a", "b", 3)


@query("J07", f"""WITH {_C}, {_SITES}, n AS (SELECT call_id, chrom, svtype, pos, end_pos FROM c WHERE chrom = chr2 AND svtype IS NOT NULL) SELECT call_id AS src, site_id AS dst, abs(pos - s) AS dx, abs(end_pos - e) AS dy, CAST(0 AS INTEGER) AS weight FROM n JOIN u ON n.chrom = u.chrom AND abs(pos - s) < 50000 AND abs(end_pos - e) < 50000""")
def site_links(spark, sf):
    """Sites among the nodes: calls and the sites near them on both sides."""
    n = calls(spark, sf, "chrom = chr2 and svtype is not null").select("call_id", "chrom", "pos", "end_pos")
    s = sites(spark, sf).select(F.col("site_id").alias("call_id"), "chrom", F.col("s").alias("pos"), F.col("e").alias("end_pos"))
    return pairs.site_edges(n, s, ["chrom"], "call_id", "pos", "end_pos", 50_000)


# ---------------------------------------------------------------- transcripts and gaps

_EXONS = "ex AS (SELECT l_orderkey AS t, l_suppkey % 20 AS chrom, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"


def _exons(spark, sf) -> DataFrame:
    """Line items as exons: an order is a transcript, a supplier (of 20) a chromosome, days are positions."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("t"), (F.col("l_suppkey") % 20).alias("chrom"), day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))


@query("F09", f"""WITH {_EXONS}, x AS (SELECT DISTINCT t, chrom, s, e FROM ex), n AS (SELECT t, chrom, e AS gs, lead(s) OVER (PARTITION BY t, chrom ORDER BY s, e) AS ge FROM x), k AS (SELECT DISTINCT chrom, gs, ge FROM n WHERE gs < ge), q AS (SELECT DISTINCT o_orderkey AS id, o_custkey % 20 AS chrom, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s FROM orders)
SELECT id FROM q WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.chrom = q.chrom AND abs(k.gs - q.s) < 10 AND abs(k.ge - (q.s + 40)) < 10)""")
def unknown_gaps(spark, sf):
    """Gaps (40 days from an order) that are no intron of any transcript, by ten days at both ends."""
    known = intervals.introns(_exons(spark, sf), ["t", "chrom"], "s", "e")
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("chrom"), day.alias("s"), (day + 40).alias("e"))
    return intervals.without_known_gaps(q, known, [("chrom", "chrom")], ("s", "e"), ("gap_start", "gap_end")).select("id").distinct()


@query("J20", f"""WITH {_EXONS}, t AS (SELECT t, chrom, min(s) AS s, max(e) AS e FROM ex GROUP BY t, chrom), q AS (SELECT DISTINCT o_orderkey AS id, o_custkey % 20 AS chrom, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS a FROM orders)
SELECT id, EXISTS (SELECT 1 FROM t WHERE t.chrom = q.chrom AND t.s <= a AND a <= t.e AND t.s <= a + 300 AND a + 300 <= t.e) AS shared FROM q""")
def shared_transcripts(spark, sf):
    """Whether both ends of a stretch (300 days from an order) lie in one transcript's span."""
    t = _exons(spark, sf).groupBy("t", "chrom").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("chrom"), day.alias("a"), (day + 300).alias("b")).distinct()
    return intervals.shared_region(q, t, "id", (("chrom", "a"), ("chrom", "b")), ("t", "chrom", "s", "e"), 512)


# ---------------------------------------------------------------- clips, contigs, reference

@query("F06", """WITH q AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1), w AS (SELECT *, least(3, len(q)) AS w FROM q), m AS (SELECT *, list_transform(range(1, len(q) - w + 2), lambda i: list_sum(q[i:i + w - 1]) <= 10 * w) AS bad FROM w),
k AS (SELECT *, coalesce(list_position(bad, true), 0) AS first_bad FROM m) SELECT l_orderkey, CASE WHEN first_bad = 0 THEN len(q) - w + 1 ELSE first_bad - 1 END + w - 1 >= 4 AS good FROM k""")
def clip_quality(spark, sf):
    """Quantities of an order as the qualities of a clip: whether windows of three keep a mean above ten for four bases."""
    q = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("a"))  # the lines of one order
    return q.select("l_orderkey", bs.good_clip(F.transform("a", lambda x: x["q"]), 4, 3, 10).alias("good"))


_CONTIG = "c AS (SELECT DISTINCT rec_id, regexp_extract(info, '(?:^|;)\\s*CONTIG{0}=([ACGTNacgtn]+)', 1) AS s FROM vcf_records)".format


def _both_contigs(spark, sf) -> DataFrame:
    """rec_id, which (A, B), contig of either contig of a record."""
    v = table(spark, sf, "vcf_records").select("rec_id", "info").dropDuplicates(["rec_id"])
    each = F.explode(F.array(*(F.struct(F.lit(w).alias("which"), F.regexp_extract("info", f"(?:^|;)\\s*CONTIG{w}=([ACGTNacgtn]+)", 1).alias("contig")) for w in "AB"))).alias("c")
    return v.select("rec_id", each).select("rec_id", "c.*").where("contig <> ''")


@query("X24 J15", """WITH c AS (SELECT DISTINCT rec_id, info FROM vcf_records WHERE info IS NOT NULL), b AS (SELECT rec_id, 'A' AS which, regexp_extract(info, '(?:^|;)\\s*CONTIGA=([ACGTNacgtn]+)', 1) AS s FROM c UNION ALL SELECT rec_id, 'B', regexp_extract(info, '(?:^|;)\\s*CONTIGB=([ACGTNacgtn]+)', 1) FROM c),
k AS (SELECT *, length(regexp_extract(s, '^[a-z]+')) AS l, length(regexp_extract(s, '[a-z]+$')) AS r, regexp_extract_all(regexp_replace(s, '^[a-z]+|[a-z]+$', '', 'g'), '[a-z]+') AS runs FROM b WHERE s <> '')
SELECT rec_id, which, s[1:2 * l] AS left_end, CASE WHEN r > 0 THEN s[greatest(0, length(s) - 2 * r) + 1:] ELSE '' END AS right_end, coalesce(list_filter(runs, lambda x: length(x) = list_max(list_transform(runs, lambda y: length(y))))[1], '') AS inserted FROM k""")
def contig_ends(spark, sf):
    """Clipped ends and inserted bases of both contigs of every record, told by the case of the bases."""
    left, right = bs.clipped_ends(F.col("contig"))
    return _both_contigs(spark, sf).select("rec_id", "which", left.alias("left_end"), right.alias("right_end"), bs.inserted_bases(F.col("contig")).alias("inserted"))


@query("J11 X22")
def contig_cross_pairs(spark, sf):
    """Records alike enough to share minimizers at one place: whether any of the up to four pairs of their contigs tells one event."""
    from .catalog import minimizer_pairs

    both = F.array(*(F.regexp_extract("info", f"(?:^|;)\\s*CONTIG{w}=([ACGTNacgtn]+)", 1) for w in "AB"))
    v = table(spark, sf, "vcf_records").where("rec_id is not null").select("rec_id", both.alias("c")).dropDuplicates(["rec_id"])
    c = materialize(v.select("rec_id", F.filter("c", lambda x: x != "").alias("c")))  # read for both sides of a pair
    e = minimizer_pairs(spark, sf)
    j = e.join(c.select(F.col("rec_id").alias("src"), F.col("c").alias("ca")), "src").join(c.select(F.col("rec_id").alias("dst"), F.col("c").alias("cb")), "dst")
    return j.select("src", "dst", calling.any_contig_match()("ca", "cb").alias("same"))


@query("S05", """WITH v AS (SELECT DISTINCT rec_id, alt FROM vcf_records WHERE regexp_matches(alt, '^[ACGTNacgtn]+$')) SELECT rec_id, upper(alt[2:6]) AS bases FROM v WHERE length(alt) > 1 UNION ALL SELECT rec_id, 'N' FROM v WHERE length(alt) = 1""")
def reference_bases(spark, sf):
    """Alleles as a reference in pieces of four bases: five bases from the second on, over the borders of the pieces."""
    v = table(spark, sf, "vcf_records").select("rec_id", "alt").where(F.col("alt").rlike("^[ACGTNacgtn]+$")).dropDuplicates(["rec_id"])
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.length("alt") - 1) / 4).cast("int")), lambda i: F.struct(i.cast("long").alias("chunk"), F.substr("alt", i * 4 + 1, F.lit(4)).alias("seq")))
    fasta = v.select(F.col("rec_id").cast("string").alias("name"), F.explode(chunks).alias("c")).select("name", "c.*")
    w = v.select("rec_id", F.col("rec_id").cast("string").alias("c"), F.lit(1).alias("a"), F.lit(6).alias("b"))
    return files.fetch_bases(w, fasta, ["rec_id"], "c", "a", "b", 4)


@query("F13", """WITH v AS (SELECT DISTINCT rec_id, upper(regexp_extract(info, '(?:^|;)\\s*CONTIGA=([ACGTNacgtn]+)', 1)) AS s FROM vcf_records), p AS (SELECT rec_id, translate(s, 'AT', 'NN')[1:75] AS p FROM v WHERE s <> '') SELECT rec_id, p[1] = 'N' OR p[-1] = 'N' OR p[length(p) // 2 + 1] = 'N' AS gap FROM p""")
def reference_gaps(spark, sf):
    """Contigs as a reference in which A and T are unknown: events at 10 and 45 of each, with 30 bases around, whose windows meet."""
    v = table(spark, sf, "vcf_records").select("rec_id", F.translate(F.upper(F.regexp_extract("info", "(?:^|;)\\s*CONTIGA=([ACGTNacgtn]+)", 1)), "AT", "NN").alias("s")).where("s <> ''").dropDuplicates(["rec_id"])
    fasta = v.select(F.col("rec_id").cast("string").alias("name"), F.lit(0).cast("long").alias("chunk"), F.col("s").alias("seq"))
    e = v.select("rec_id", F.col("rec_id").cast("string").alias("chrom"), F.lit(10).alias("pos"), F.col("rec_id").cast("string").alias("chr2"), F.lit(45).alias("end_pos"))
    return calling.near_reference_gap(e, fasta, "rec_id", 30)


@query("J15", f"""WITH {_R}, {_S}, {_C}, cc AS (SELECT * FROM c WHERE svtype IS NOT NULL), v AS (SELECT call_id, chrom AS vc, pos AS vp FROM cc UNION SELECT call_id, chr2, end_pos FROM cc), near AS (SELECT DISTINCT call_id, read_id FROM v JOIN s ON vc = rname AND start <= vp + 500 AND stop >= vp - 500 WHERE flag & 1540 = 0),
x AS (SELECT near.call_id, cc.pos, s.stop, s.cigar, s.seq FROM near JOIN cc ON near.call_id = cc.call_id JOIN s ON near.read_id = s.read_id)
SELECT call_id, count(*) AS n, CAST(count(CASE WHEN seq <> '*' THEN 1 END) AS BIGINT) AS n_bases, CAST(coalesce(sum(CASE WHEN seq <> '*' THEN length(right(seq, {_CLIP_R('S')})) END), 0) AS BIGINT) AS bases FROM x WHERE {_CLIP_R('S')} >= 15 AND abs(stop - pos) <= 500 GROUP BY call_id""")
def clip_support(spark, sf):
    """Reads clipped to the right near a call, and the bases their clips hold."""
    c = calls(spark, sf, "svtype is not null").select("call_id", "chrom", "pos", "chr2", "end_pos", "svtype", "svlen").withColumn("ct", F.lit("3to5"))
    s = spans(spark, sf, "seq")
    x = pairs.reads_near(c, s, "call_id", "read_id", 500).join(c, "call_id").join(s.drop("pos"), "read_id")
    e = calling.clip_evidence(x, "call_id", 500)
    return e.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.count("bases").alias("n_bases"), F.coalesce(F.sum(F.length("bases")), F.lit(0)).alias("bases"))


@query("F17 F18 F19", f"""WITH {_R}, {_S}, {_C}, cc AS (SELECT * FROM c WHERE svtype IS NOT NULL), v AS (SELECT call_id, chrom AS vc, pos AS vp FROM cc UNION SELECT call_id, chr2, end_pos FROM cc), near AS (SELECT DISTINCT call_id, read_id FROM v JOIN s ON vc = rname AND start <= vp + 500 AND stop >= vp - 500 WHERE flag & 1540 = 0),
x AS (SELECT near.call_id, cc.pos, cc.end_pos, s.start, s.stop, s.mapq, s.nm, s.cigar, {_LIST} AS ops FROM near JOIN cc ON near.call_id = cc.call_id JOIN s ON near.read_id = s.read_id),
y AS (SELECT *, coalesce(list_sum(list_transform(list_filter(ops, lambda o: right(o, 1) IN ('M', '=', 'X')), lambda o: CAST(o[:-2] AS BIGINT))), 0) AS bases, len(list_filter(ops, lambda o: right(o, 1) IN ('I', 'D') AND CAST(o[:-2] AS BIGINT) < 30)) AS small,
  coalesce(list_sum(list_transform(list_filter(ops, lambda o: right(o, 1) IN ('I', 'D') AND CAST(o[:-2] AS BIGINT) >= 30), lambda o: CAST(o[:-2] AS BIGINT))), 0) AS large, start <= pos + 1 AND stop >= pos AS over_ FROM x)
SELECT call_id, count(*) AS n_aligns, CAST(count_if(over_) AS BIGINT) AS n_overlap, CAST(count_if(over_ AND mapq = 0) AS BIGINT) AS n_overlap0, CAST(count_if(start <= pos - 10 AND stop >= pos + 10) AS BIGINT) AS n_covering,
  CAST(count_if(({_CLIP_L('S')} >= 15 AND (abs(start - pos) <= 30 OR abs(start - end_pos) <= 30)) OR ({_CLIP_R('S')} >= 15 AND (abs(stop - pos) <= 30 OR abs(stop - end_pos) <= 30))) AS BIGINT) AS n_clipped,
  round(coalesce(sum(CASE WHEN bases > 0 THEN nm / bases END), 0), 6) AS sum_edits, round(coalesce(sum(CASE WHEN bases > 0 THEN small / bases END), 0), 6) AS sum_gaps, round(coalesce(sum(CASE WHEN bases > 0 THEN (nm - large) / bases END), 0), 6) AS sum_nm FROM y GROUP BY call_id""")
def region_figures(spark, sf):
    """What the reads near a call say of its place: cover, clips, edits and gaps."""
    c = calls(spark, sf, "svtype is not null").select("call_id", "chrom", "pos", "chr2", "end_pos")
    s = spans(spark, sf, "nm")
    x = pairs.reads_near(c, s, "call_id", "read_id", 500).join(c, "call_id").join(s.drop("pos"), "read_id")
    f = calling.region_figures(x, "call_id", 15)
    return f.select(*(F.round(n, 6).alias(n) if n.startswith("sum_") else n for n in f.columns))


@query("X23")
def remapped_clips(spark, sf):
    """Clipped ends of contigs laid against the aligned part of the contig, as the reference around the break: type, length and score of what they tell."""
    c = _both_contigs(spark, sf)
    x = c.select("rec_id", F.explode(F.array(*bs.clipped_ends(F.col("contig"), 1))).alias("clip"), F.regexp_replace("contig", "[a-z]", "").alias("b")).where("clip <> '' and b <> ''")
    return x.select("rec_id", calling.remap_udf()("clip", "b").alias("r")).select("rec_id", "r.*")


@query("F14")
def poor_ends(spark, sf):
    """Bases at either end of each read whose rate of edits is too high to trust, by what its CIGAR says."""
    r = reads(spark, sf, "cigar", where=F.col("cigar").rlike("[ID]"))
    return r.select("read_id", calling.bad_ends_udf(0.02, 100)("cigar").alias("e")).select("read_id", "e.*")
