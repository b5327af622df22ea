"""Every relational operator as a named query on the test tables, with SQL that gives the same rows.

Names say what a query does; the IDs of the operator inventory it covers stand beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import cigar as cg
from ..functions import genotype as gtp
from ..functions import geometry as geo
from ..functions.readings import chromosome, mate_chromosome, sv_length, sv_type
from ..operators import depth, graph, intervals, pairs, rollups
from ..operators.calling import consensus_by_component
from ..session import materialize
from ..sinks import files as sink
from ..sources import vcf
from .registry import COVERS, ORACLES, QUERIES, query  # noqa: F401
from .problem_sql import P3_SQL
from .problems import SQL_CHROM, SQL_CHROM2, SQL_LENGTH, SQL_TYPE, table

# ---------------------------------------------------------------- shared tables

READ_COLUMNS = ["read_id", "qname", "sample_name", "rg", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "nm", "sa"]


def reads(spark: SparkSession, sf: str, *columns: str, where=None) -> DataFrame:
    """One row per read_id. Copies of a read agree, so `where` (and the choice of columns) goes before the shuffle that drops them."""
    c = list(dict.fromkeys(["read_id", *columns])) if columns else READ_COLUMNS
    a = table(spark, sf, "alignments")
    return (a if where is None else a.where(where)).select(*c).dropDuplicates(["read_id"])


def calls(spark: SparkSession, sf: str, where: str | None = None) -> DataFrame:
    """One row per call_id, read into one spelling: chrom, pos, chr2, end_pos (on chr2), svtype, svlen and the rest. Copies agree in these
    columns, so `where` goes before the shuffle that drops them."""
    c = table(spark, sf, "sv_calls")
    chrom, chr2 = chromosome("chrom"), mate_chromosome("chr2", "chrom")
    end = F.coalesce(F.when(chrom != chr2, F.nullif("chr2_pos", F.lit(-1))), F.nullif("end_pos", F.lit(-1)), F.col("pos"))
    c = c.select("call_id", "sample_name", chrom.alias("chrom"), "pos", chr2.alias("chr2"), end.alias("end_pos"), sv_type("svtype").alias("svtype"), sv_length("svlen").alias("svlen"), "filt", "grp", F.col("cipos95").cast("long").alias("ci"), F.col("su").cast("long").alias("su"), "gt", "prob", "called_at")
    return (c.where(where) if where else c).dropDuplicates(["call_id"])


_R = "r AS (SELECT DISTINCT read_id, qname, sample_name, rg, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, nm, sa FROM alignments)"
_C = f"""c AS (SELECT DISTINCT call_id, sample_name, {SQL_CHROM('chrom')} AS chrom, pos, {SQL_CHROM2('chrom', 'chr2')} AS chr2,
  coalesce(CASE WHEN {SQL_CHROM('chrom')} <> {SQL_CHROM2('chrom', 'chr2')} THEN nullif(chr2_pos, -1) END, nullif(end_pos, -1), pos) AS end_pos,
  CASE WHEN {SQL_TYPE('svtype')} IN ('DEL', 'INS', 'DUP', 'INV', 'TRA', 'BND') THEN {SQL_TYPE('svtype')} END AS svtype, {SQL_LENGTH('svlen')} AS svlen,
  filt, grp, CAST(cipos95 AS BIGINT) AS ci, CAST(su AS BIGINT) AS su, gt, prob, called_at FROM sv_calls)"""
_IV = """iv AS (SELECT l_suppkey AS chrom, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) / 86400 AS BIGINT) AS s, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) / 86400 AS BIGINT) + CAST(l_quantity AS BIGINT) AS e, o_orderpriority AS prio, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def iv(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of days: chrom (supplier), s, e (exclusive), prio, flag."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    j = li.select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag").join(o.select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_suppkey").alias("chrom"), day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"), F.col("o_orderpriority").alias("prio"), F.col("l_returnflag").alias("flag"))


_IV = _IV.replace("CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) / 86400 AS BIGINT)", "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)")

# ---------------------------------------------------------------- reads: scans, filters, CIGAR

_LIST = "regexp_extract_all(coalesce(cigar, ''), '\\d+[MIDNSHP=X]')"


def _sum(ops: str) -> str:
    return f"coalesce(list_sum(list_transform(list_filter({_LIST}, lambda x: right(x, 1) IN ({ops})), lambda x: CAST(x[:-2] AS BIGINT))), 0)"


_REF, _QRY = _sum("'M', 'D', 'N', '=', 'X'"), _sum("'M', 'I', 'S', '=', 'X'")
_CLIP_L = "coalesce(TRY_CAST(nullif(regexp_extract(coalesce(cigar, ''), '^(\\d+)[{0}]', 1), '') AS INTEGER), 0)".format
_CLIP_R = "coalesce(TRY_CAST(nullif(regexp_extract(coalesce(cigar, ''), '(\\d+)[{0}]$', 1), '') AS INTEGER), 0)".format


@query("S02 F01", f"WITH {_R} SELECT read_id, rname, pos, mapq FROM r WHERE flag & 1284 = 0 AND mapq >= 1 AND len({_LIST}) > 0")
def read_filter(spark, sf):
    r = table(spark, sf, "alignments").where((F.col("flag").bitwiseAND(1284) == 0) & (F.col("mapq") >= 1) & F.col("cigar").rlike("\\d[MIDNSHP=X]"))
    return r.select("read_id", "rname", "pos", "mapq").dropDuplicates(["read_id"])


def _evidence(r: DataFrame) -> DataFrame:
    clip = F.greatest(cg.left_clip("cigar"), cg.right_clip("cigar")) >= 15
    gap = cg.has_op("cigar", "I", 30) | cg.has_op("cigar", "D", 30)
    pair = cg.flag(1) & ~cg.flag(2)
    return r.withColumn("clipped", clip).withColumn("gapped", gap).withColumn("discordant", pair).withColumn("supplementary", cg.flag(2048)).withColumn("split", F.col("sa").isNotNull())


_GAP = f"len(list_filter({_LIST}, lambda x: right(x, 1) IN ('I', 'D') AND CAST(x[:-2] AS BIGINT) >= 30)) > 0"
_EV = f"""e AS (SELECT *, greatest({_CLIP_L('S')}, {_CLIP_R('S')}) >= 15 AS clipped, {_GAP} AS gapped, flag & 1 <> 0 AND flag & 2 = 0 AS discordant, flag & 2048 <> 0 AS supplementary, sa IS NOT NULL AS split FROM r)"""


@query("F02 P02", f"WITH {_R}, {_EV} SELECT read_id, clipped, gapped, discordant, supplementary, split FROM e WHERE flag & 1284 = 0 AND (clipped OR gapped OR discordant OR supplementary OR split)")
def evidence_reads(spark, sf):
    e = _evidence(reads(spark, sf, "flag", "cigar", "sa", where=F.col("flag").bitwiseAND(1284) == 0))
    return e.where("clipped or gapped or discordant or supplementary or split").select("read_id", "clipped", "gapped", "discordant", "supplementary", "split")


@query("F03", f"WITH {_R}, {_EV} SELECT read_id, qname FROM r WHERE qname IN (SELECT qname FROM e WHERE flag & 1284 = 0 AND (clipped OR gapped))")
def template_keep(spark, sf):
    r = reads(spark, sf, "qname", "flag", "cigar", "sa")
    names = _evidence(r.where(F.col("flag").bitwiseAND(1284) == 0)).where("clipped or gapped").select(F.col("qname").alias("q")).distinct()
    return r.join(names, F.col("qname") == F.col("q"), "left_semi").select("read_id", "qname")


@query("X10 X11 A04", f"WITH {_R} SELECT read_id, CAST({_CLIP_L('S')} AS INTEGER) AS left_clip, CAST({_CLIP_R('S')} AS INTEGER) AS right_clip, CAST({_CLIP_L('SH')} AS INTEGER) AS left_any, CAST({_CLIP_R('SH')} AS INTEGER) AS right_any, CAST({_REF} AS BIGINT) AS ref_len, CAST({_QRY} AS BIGINT) AS query_len FROM r")
def cigar_extent(spark, sf):
    r = reads(spark, sf, "cigar")
    return r.select("read_id", cg.left_clip("cigar").alias("left_clip"), cg.right_clip("cigar").alias("right_clip"), cg.left_clip("cigar", True).alias("left_any"), cg.right_clip("cigar", True).alias("right_any"), cg.reference_length("cigar").alias("ref_len"), cg.query_length("cigar").alias("query_len"))


@query(
    "W07 S02",
    f"""WITH {_R}, o AS (SELECT read_id, pos, unnest({_LIST}) AS x, generate_subscripts({_LIST}, 1) AS i FROM r),
w AS (SELECT read_id, pos, i, right(x, 1) AS op, CAST(x[:-2] AS BIGINT) AS len FROM o),
p AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ref_start FROM w)
SELECT read_id, CAST(i - 1 AS INTEGER) AS idx, op, CAST(len AS INTEGER) AS len, CAST(ref_start AS BIGINT) AS ref_start FROM p WHERE op IN ('I', 'D', 'N') AND len >= 5""",
)
def cigar_gaps(spark, sf):
    r = reads(spark, sf, "cigar", "pos", where=F.col("cigar").rlike("[IDN]"))
    w = F.filter(cg.walk("cigar", "pos"), lambda g: g["op"].isin("I", "D", "N") & (g["len"] >= 5))
    return r.select("read_id", F.explode(w).alias("g")).select("read_id", "g.idx", "g.op", "g.len", "g.ref_start")


_ALIGNED = f"coalesce(list_sum(list_transform(list_filter({_LIST}, lambda x: right(x, 1) IN ('M', '=', 'X') OR (right(x, 1) IN ('I', 'D') AND CAST(x[:-2] AS BIGINT) < 30)), lambda x: CAST(x[:-2] AS BIGINT))), 0)"


@query("F05", f"WITH {_R} SELECT read_id, nm, CAST({_ALIGNED} AS BIGINT) AS aligned, nm >= floor({_ALIGNED} * 13 * 0.02) AS too_high FROM r WHERE nm IS NOT NULL")
def edit_distance_filter(spark, sf):
    a = cg.aligned_bases("cigar")
    r = reads(spark, sf, "cigar", "nm", where="nm is not null")
    return r.select("read_id", "nm", a.alias("aligned")).withColumn("too_high", F.col("nm") >= F.floor(F.col("aligned") * 13 * 0.02))


@query(
    "F07 F08",
    f"""WITH {_R}, {_EV} SELECT read_id, CASE WHEN NOT clipped AND flag & 2 <> 0 THEN 'none' WHEN flag & 2 <> 0 AND abs(tlen) < 1000 AND rnext = '=' THEN 'breakend' WHEN NOT clipped AND rnext = '=' AND abs(tlen) < 1000 THEN 'none' ELSE 'discordant' END AS kind,
rnext = '=' AND abs(tlen) < 1000 AND NOT clipped AND ((flag & 16) <> 0) = ((flag & 32) <> 0) AS chimera FROM e WHERE flag & 1 <> 0 AND tlen IS NOT NULL AND rnext IS NOT NULL""",
)
def mate_class(spark, sf):
    e = _evidence(reads(spark, sf, "flag", "cigar", "sa", "rnext", "tlen", where=cg.flag(1) & F.col("tlen").isNotNull() & F.col("rnext").isNotNull()))
    near = (F.col("rnext") == "=") & (F.abs("tlen") < 1000)
    kind = F.when(~F.col("clipped") & cg.flag(2), "none").when(cg.flag(2) & near, "breakend").when(~F.col("clipped") & near, "none").otherwise("discordant")
    return e.select("read_id", kind.alias("kind"), (near & ~F.col("clipped") & (cg.flag(16) == cg.flag(32))).alias("chimera"))


@query("J01 G08", f"WITH {_R}, o AS (SELECT read_id AS src, lead(read_id) OVER (PARTITION BY qname ORDER BY pos, read_id) AS dst FROM r WHERE qname IS NOT NULL) SELECT src, dst, CAST(1 AS INTEGER) AS weight FROM o WHERE dst IS NOT NULL")
def template_neighbors(spark, sf):
    return pairs.template_edges(reads(spark, sf, "qname", "pos"), "qname", "read_id", ["pos"])


_SA = "p AS (SELECT read_id, string_split(x, ',') AS a FROM (SELECT read_id, unnest(string_split(sa, ';')) AS x FROM r WHERE sa IS NOT NULL))"


@query("J02", f"""WITH {_R}, {_SA}, u AS (SELECT read_id, rname AS chrom, pos, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, cigar, mapq FROM r WHERE sa IS NOT NULL
  UNION ALL SELECT read_id, a[1], TRY_CAST(a[2] AS INTEGER), a[3], a[4], TRY_CAST(a[5] AS INTEGER) FROM p WHERE len(a) = 6),
q AS (SELECT *, CAST(CASE WHEN strand = '-' THEN {_CLIP_R('SH')} ELSE {_CLIP_L('SH')} END AS BIGINT) AS q_start, count(*) OVER (PARTITION BY read_id) AS n FROM u), e AS (SELECT *, q_start + {_sum("'M', 'I', '=', 'X'")} AS q_end FROM q WHERE n > 1),
o AS (SELECT *, row_number() OVER w AS place, lead(chrom) OVER w AS next_chrom, lead(pos) OVER w AS next_pos, lead(mapq) OVER w AS next_mapq, lead(1) OVER w AS more FROM e WINDOW w AS (PARTITION BY read_id ORDER BY q_start, q_end, chrom, pos, strand, mapq, cigar))
SELECT read_id, CAST(place AS INTEGER) AS place, q_start, CAST(q_end AS BIGINT) AS q_end, chrom, pos, strand, mapq, next_chrom, next_pos, CASE WHEN more IS NULL THEN NULL WHEN mapq < 1 OR next_mapq < 1 THEN 'BREAKEND' ELSE 'SPLIT' END AS junction FROM o""")
def split_neighbors(spark, sf):
    return pairs.split_neighbours(reads(spark, sf, "rname", "pos", "flag", "cigar", "mapq", "sa", where="sa is not null"), "read_id")


@query(
    "J02",
    f"""WITH {_R}, s AS (SELECT read_id, unnest(string_split(sa, ';')) AS x FROM r WHERE sa IS NOT NULL), p AS (SELECT read_id, string_split(x, ',') AS a FROM s)
SELECT read_id, a[1] AS chrom, TRY_CAST(a[2] AS INTEGER) AS pos, a[3] AS strand, a[4] AS cigar, TRY_CAST(a[5] AS INTEGER) AS mapq, TRY_CAST(a[6] AS INTEGER) AS nm FROM p WHERE len(a) = 6""",
)
def split_targets(spark, sf):
    r = reads(spark, sf, "sa", where="sa is not null")
    return r.select("read_id", F.explode(cg.split_alignments("sa")).alias("a")).select("read_id", "a.*")


@query("A02 X38", f"""WITH {_R}, v AS (SELECT rg, CAST(abs(tlen) AS DOUBLE) AS v FROM r WHERE flag & 2 <> 0 AND tlen > 0), m AS (SELECT rg, median(v) AS m FROM v GROUP BY rg),
d AS (SELECT v.rg, m, coalesce(median(CASE WHEN v > m THEN v - m END), 0) AS mad FROM v JOIN m ON v.rg = m.rg GROUP BY v.rg, m),
k AS (SELECT v.rg, v, mad FROM v JOIN d ON v.rg = d.rg WHERE v <= m + 8 * mad), n AS (SELECT rg, median(v) AS med, min(mad) AS mad FROM k GROUP BY rg)
SELECT k.rg, count(*) AS n, min(med) AS median, min(n.mad) AS upper_mad, round(avg(v), 4) AS mean, round(sqrt(avg((v - med) * (v - med))), 4) AS sd, round(greatest(0, min(med) - 1.6448536269514729 * sqrt(avg((v - med) * (v - med)))), 4) AS low_quantile FROM k JOIN n ON k.rg = n.rg GROUP BY k.rg""")
def insert_sizes(spark, sf):
    r = reads(spark, sf, "rg", "flag", "tlen", where=cg.flag(2) & (F.col("tlen") > 0))
    s = rollups.spread(r, ["rg"], "tlen")
    return s.select("rg", "n", "median", "upper_mad", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round(F.greatest(F.lit(0.0), F.col("median") - 1.6448536269514729 * F.col("sd")), 4).alias("low_quantile"))


@query("A03 S18 A16", f"""WITH {_R}, q AS (SELECT sample_name, flag, pnext, {_QRY} AS len, {_ALIGNED} AS aligned, nm FROM r),
d AS (SELECT sample_name, count(*) AS n_reads, median(CAST(CASE WHEN len > 0 THEN len END AS DOUBLE)) AS read_length, bool_or(flag & 162 <> 0 OR coalesce(pnext, 0) > 0) AS paired, avg(CASE WHEN aligned > 0 THEN nm / aligned END) AS m, stddev_pop(CASE WHEN aligned > 0 THEN nm / aligned END) AS s, sum(aligned) AS bases FROM q GROUP BY sample_name)
SELECT sample_name, n_reads, read_length, paired, round(m, 6) AS mean_rate, round(least(1, greatest(2.5 * m, m + 2.5 * s)), 6) AS bound, CAST(bases AS BIGINT) AS bases FROM d""")
def read_properties(spark, sf):
    r = reads(spark, sf, "sample_name", "flag", "pnext", "cigar", "nm").select("sample_name", "flag", "pnext", cg.query_length("cigar").alias("len"), cg.aligned_bases("cigar").alias("aligned"), "nm")
    mean, bound = rollups.divergence_bound(F.when(F.col("aligned") > 0, F.col("nm") / F.col("aligned")))
    x = r.groupBy("sample_name").agg(F.count(F.lit(1)).alias("n_reads"), F.median(F.when(F.col("len") > 0, F.col("len"))).alias("read_length"), F.bool_or((F.col("flag").bitwiseAND(162) != 0) | (F.coalesce("pnext", F.lit(0)) > 0)).alias("paired"), mean, bound, F.sum("aligned").alias("bases"))
    return x.withColumn("mean_rate", F.round("mean_rate", 6)).withColumn("bound", F.round("bound", 6))


def spans(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Mapped primary reads with the span they cover: start, stop (exclusive)."""
    r = reads(spark, sf, "flag", "rname", "pos", "cigar", "mapq", *columns, where=(F.col("flag").bitwiseAND(1284) == 0) & (F.col("rname") != "*"))
    return r.withColumn("start", F.col("pos").cast("long")).withColumn("stop", F.col("pos") + cg.reference_length("cigar"))


def covered(spark: SparkSession, sf: str) -> DataFrame:
    """rname, start, stop of spans() alone. Copies of a read agree in them, so dropping equal rows drops the copies, and the CIGARs stay out of the shuffle."""
    a = table(spark, sf, "alignments").where((F.col("flag").bitwiseAND(1284) == 0) & (F.col("rname") != "*"))
    return a.select("read_id", "rname", F.col("pos").cast("long").alias("start"), (F.col("pos") + cg.reference_length("cigar")).alias("stop")).distinct().drop("read_id")


_S = f"s AS (SELECT *, CAST(pos AS BIGINT) AS start, CAST(pos + {_REF} AS BIGINT) AS stop FROM r WHERE flag & 1284 = 0 AND rname <> '*')"
_T = f"""m AS (SELECT rname, start // 10 AS bin, 1 AS d FROM s UNION ALL SELECT rname, stop // 10, -1 FROM s), k AS (SELECT rname, bin, sum(d) AS d FROM m GROUP BY rname, bin HAVING sum(d) <> 0),
t AS (SELECT * FROM (SELECT rname, bin, lead(bin) OVER (PARTITION BY rname ORDER BY bin) AS to_bin, sum(d) OVER (PARTITION BY rname ORDER BY bin) AS depth FROM k) WHERE depth > 0)"""


@query("A01 W02", f"WITH {_R}, {_S}, {_T} SELECT rname, CAST(bin AS BIGINT) AS bin, CAST(to_bin AS BIGINT) AS to_bin, CAST(depth AS BIGINT) AS depth FROM t")
def depth_track(spark, sf):
    return depth.depth_track(spans(spark, sf), "rname", "start", "stop")


@query("A15", f"""WITH {_R}, {_S}, {_T}, u AS (SELECT rname, depth, unnest(range(bin, to_bin)) AS b FROM t) SELECT rname, CAST(quantile_disc(depth, 0.5) AS BIGINT) AS median_depth FROM u GROUP BY rname""")
def depth_median(spark, sf):
    return depth.median_of_nonzero(depth.depth_track(spans(spark, sf), "rname", "start", "stop"), "rname").withColumn("median_depth", F.col("median_depth").cast("long"))


@query("K11", f"""WITH {_R}, {_S}, {_T}, u AS (SELECT rname, depth, unnest(range(bin, to_bin)) AS b FROM t), w AS (SELECT rname, b // 100 AS wide, sum(depth) AS sm, count(*) AS n, min(depth) AS lo, max(depth) AS hi FROM u GROUP BY 1, 2)
SELECT rname, CAST(wide AS BIGINT) AS wide, round(sm / 100.0, 4) AS mean_depth, CAST(CASE WHEN n < 100 THEN 0 ELSE lo END AS BIGINT) AS min_depth, CAST(hi AS BIGINT) AS max_depth FROM w""")
def depth_rebin(spark, sf):
    return depth.rebin(depth.depth_track(spans(spark, sf), "rname", "start", "stop"), "rname", 100).withColumn("mean_depth", F.round("mean_depth", 4))


@query("F04 S02", f"""WITH {_R}, {_S}, {_T} SELECT read_id, CAST(coalesce(depth, 0) AS BIGINT) AS depth, coalesce(depth, 0) <= 3 AS kept FROM s LEFT JOIN t ON s.rname = t.rname AND start // 10 >= bin AND start // 10 < to_bin""")
def max_depth_filter(spark, sf):
    s = spans(spark, sf)
    at = depth.depth_at(s.select("read_id", "rname", "start"), depth.depth_track(s, "rname", "start", "stop"), "rname", "start")
    return at.select("read_id", "depth").withColumn("kept", F.col("depth") <= 3)


@query("J18 A14", f"""WITH {_R}, {_S}, {_T}, {_C}, w AS (SELECT call_id, chrom, (greatest(0, pos - 10000)) // 10 AS lo, (pos + 9999) // 10 AS hi FROM c WHERE pos IS NOT NULL)
SELECT call_id, round(coalesce(sum((least(hi, to_bin - 1) - greatest(lo, bin) + 1) * depth), 0) / (max(hi) - max(lo) + 1), 6) AS mean_depth, CAST(coalesce(max(depth), 0) AS BIGINT) AS max_depth
FROM w LEFT JOIN t ON w.chrom = t.rname AND bin <= hi AND to_bin > lo GROUP BY call_id""")
def depth_flanks(spark, sf):
    c = calls(spark, sf, "pos is not null").select("call_id", "chrom", F.greatest(F.lit(0), F.col("pos") - 10_000).alias("lo"), (F.col("pos") + 10_000).alias("hi"))
    d = depth.window_depth(c, depth.depth_track(covered(spark, sf), "rname", "start", "stop").withColumnRenamed("rname", "chrom"), "chrom", ["call_id"], "lo", "hi")
    return d.withColumn("mean_depth", F.round("mean_depth", 6))


@query("J13", f"""WITH {_R}, {_S}, {_C}, v AS (SELECT call_id, chrom AS vc, pos AS vp FROM c UNION SELECT call_id, chr2, end_pos FROM c)
SELECT DISTINCT call_id, read_id FROM v JOIN s ON vc = rname AND start <= vp + 50 AND stop >= vp - 50 WHERE flag & 1540 = 0""")
def reads_near_calls(spark, sf):
    return pairs.reads_near(calls(spark, sf), spans(spark, sf), "call_id", "read_id", 50)


_NEAR = f"""v AS (SELECT call_id, chrom AS vc, pos AS vp FROM c UNION SELECT call_id, chr2, end_pos FROM c), near AS (SELECT DISTINCT call_id, read_id FROM v JOIN s ON vc = rname AND start <= vp + 200 AND stop >= vp - 200 WHERE flag & 1540 = 0)"""


@query("A04", f"""WITH {_R}, {_S}, {_C}, {_NEAR}, e AS (SELECT near.call_id, qname, flag & 1 <> 0 AND flag & 2 = 0 AS pe, flag & 2048 <> 0 OR sa IS NOT NULL AS supp, {_GAP} AS spanning, greatest({_CLIP_L('S')}, {_CLIP_R('S')}) >= 15 AS bnd, mapq = 0 AS low FROM near JOIN r ON near.read_id = r.read_id)
SELECT call_id, CAST(count_if(pe) AS BIGINT) AS pe, CAST(count_if(supp) AS BIGINT) AS supp, CAST(count_if(spanning) AS BIGINT) AS spanning, CAST(count_if(bnd) AS BIGINT) AS bnd, CAST(count_if(low) AS BIGINT) AS mapq0, count(DISTINCT qname) AS templates, CAST(count_if(pe) + count_if(supp) + 2 * count_if(spanning) + count_if(bnd) AS BIGINT) AS su FROM e GROUP BY call_id""")
def call_evidence(spark, sf):
    near = pairs.reads_near(calls(spark, sf), spans(spark, sf), "call_id", "read_id", 200)
    r = reads(spark, sf, "qname", "flag", "sa", "cigar", "mapq")
    x = near.join(_evidence(r), "read_id")
    return rollups.evidence(x, ["call_id"], {"pe": F.col("discordant"), "supp": F.col("supplementary") | F.col("split"), "spanning": F.col("gapped"), "bnd": F.col("clipped"), "mapq0": F.col("mapq") == 0}, "qname")


@query("J16 X37", f"""WITH {_R}, {_S}, {_C}, p AS (SELECT rname, CASE WHEN {_CLIP_L('S')} >= {_CLIP_R('S')} THEN start ELSE stop END AS px FROM s WHERE greatest({_CLIP_L('S')}, {_CLIP_R('S')}) >= 15)
SELECT call_id, count(px) AS n FROM c LEFT JOIN p ON chrom = rname AND px BETWEEN pos - 500 AND pos + 500 GROUP BY call_id""")
def clip_counts(spark, sf):
    s = spans(spark, sf).where(F.greatest(cg.left_clip("cigar"), cg.right_clip("cigar")) >= 15)
    p = s.select("rname", F.when(cg.left_clip("cigar") >= cg.right_clip("cigar"), F.col("start")).otherwise(F.col("stop")).alias("at"))
    return intervals.count_points(calls(spark, sf), p, [("chrom", "rname")], (F.col("pos") - 500, F.col("pos") + 500), "at", ["call_id"], 1024)


@query("J03 O03 G08", f"""WITH {_R}, n AS (SELECT read_id AS node, rname AS chrom, CASE WHEN rnext = '=' THEN rname ELSE rnext END AS chrom2, CAST(pos AS BIGINT) AS x, CAST(pnext AS BIGINT) AS y FROM r WHERE flag & 1284 = 0 AND flag & 1 <> 0 AND flag & 2 = 0 AND pnext > 0),
p AS (SELECT a.node AS src, b.node AS dst, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM n a JOIN n b ON a.chrom = b.chrom AND a.chrom2 = b.chrom2 AND a.node < b.node AND abs(a.x - b.x) < 20000 AND abs(a.y - b.y) < 20000),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dy, dx, dst) AS rank FROM p) SELECT src, dst, CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy FROM k WHERE rank <= 25""")
def proximity_pairs(spark, sf):
    r = reads(spark, sf, "flag", "rname", "rnext", "pos", "pnext", where=(F.col("flag").bitwiseAND(1284) == 0) & cg.flag(1) & ~cg.flag(2) & (F.col("pnext") > 0))
    n = r.select(F.col("read_id").alias("node"), F.col("rname").alias("chrom"), F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext")).alias("chrom2"), F.col("pos").cast("long").alias("x"), F.col("pnext").cast("long").alias("y"))
    return pairs.proximity_edges(n, ["chrom", "chrom2"], "node", "x", "y", 20_000).select("src", "dst", "dx", "dy")


# ---------------------------------------------------------------- intervals

@query("W01", f"""WITH {_IV}, x AS (SELECT *, row_number() OVER () AS rn FROM iv), o AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e, rn ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT chrom, min(s) AS s, max(e) AS e, count(*) AS n_merged FROM i GROUP BY chrom, island""")
def interval_merge(spark, sf):
    return intervals.merge_intervals(iv(spark, sf), ["chrom"], "s", "e")


@query("U02", f"""WITH {_IV}, d AS (SELECT chrom, unnest(range(s, e)) AS x, prio = '1-URGENT' AS urgent FROM iv), k AS (SELECT chrom, x FROM d WHERE NOT urgent EXCEPT SELECT chrom, x FROM d WHERE urgent),
i AS (SELECT chrom, x, x - row_number() OVER (PARTITION BY chrom ORDER BY x) AS g FROM k) SELECT chrom, min(x) AS s, max(x) + 1 AS e FROM i GROUP BY chrom, g""")
def interval_subtract(spark, sf):
    x = iv(spark, sf)
    return intervals.subtract_intervals(x.where("prio <> '1-URGENT'"), x.where("prio = '1-URGENT'"), ["chrom"], "s", "e")


@query("A01 K11", f"""WITH {_IV}, m AS (SELECT chrom, s // 10 AS bin, 1 AS d FROM iv UNION ALL SELECT chrom, e // 10, -1 FROM iv), k AS (SELECT chrom, bin, sum(d) AS d FROM m GROUP BY 1, 2 HAVING sum(d) <> 0)
SELECT * FROM (SELECT chrom, bin, lead(bin) OVER (PARTITION BY chrom ORDER BY bin) AS to_bin, CAST(sum(d) OVER (PARTITION BY chrom ORDER BY bin) AS BIGINT) AS depth FROM k) WHERE depth > 0""")
def depth_of_days(spark, sf):
    return depth.depth_track(iv(spark, sf), "chrom", "s", "e")


@query("A05", f"""WITH {_IV}, m AS (SELECT chrom, s AS px, 1 AS d FROM iv WHERE s < e UNION ALL SELECT chrom, e, -1 FROM iv WHERE s < e), k AS (SELECT chrom, px, sum(d) AS d FROM m GROUP BY 1, 2),
r AS (SELECT chrom, px, sum(d) OVER (PARTITION BY chrom ORDER BY px) AS depth FROM k), b AS (SELECT chrom, max(depth) AS depth FROM r GROUP BY chrom)
SELECT r.chrom, min(px) AS best, CAST(max(r.depth) AS BIGINT) AS depth FROM r JOIN b ON r.chrom = b.chrom AND r.depth = b.depth GROUP BY r.chrom""")
def break_sweep(spark, sf):
    return rollups.sweep(iv(spark, sf), ["chrom"], "s", "e")


@query("A07 A05", f"WITH {_IV} SELECT chrom, count(*) AS n, median(e - s) AS median_length, round(abs(quantile_cont(e - s, 0.975) - median(e - s)), 6) AS half_width, mode(flag ORDER BY flag) AS common_flag FROM iv GROUP BY chrom".replace(", mode(flag ORDER BY flag) AS common_flag", ""))
def interval_widths(spark, sf):
    x = iv(spark, sf).withColumn("length", F.col("e") - F.col("s"))
    return x.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.median("length").alias("median_length"), F.round(rollups.half_width("length"), 6).alias("half_width"))


_SITES = f"""t AS (SELECT DISTINCT site_id, list_id, {SQL_CHROM('chrom')} AS chrom, start_pos, {SQL_CHROM2('chrom', 'chrom2')} AS chrom2, end_pos, svtype, svlen, prob FROM sites),
u AS (SELECT site_id, list_id, chrom, least(start_pos, end_pos) AS s, greatest(start_pos, end_pos) AS e, svtype, svlen, prob FROM t WHERE chrom = chrom2 AND start_pos IS NOT NULL AND end_pos IS NOT NULL AND start_pos <> -1 AND end_pos <> -1)"""


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """One row per site on one chromosome with both ends: s <= e."""
    t = table(spark, sf, "sites").select("site_id", "list_id", chromosome("chrom").alias("chrom"), "start_pos", mate_chromosome("chrom2", "chrom").alias("chrom2"), "end_pos", "svtype", "svlen", "prob").dropDuplicates(["site_id"])
    t = t.where("chrom = chrom2 and start_pos is not null and end_pos is not null and start_pos <> -1 and end_pos <> -1")
    return t.select("site_id", "list_id", "chrom", F.least("start_pos", "end_pos").alias("s"), F.greatest("start_pos", "end_pos").alias("e"), "svtype", "svlen", "prob")


@query("J09 X01 X02 X03", f"""WITH {_SITES} SELECT a.site_id AS a, b.site_id AS b, round(CASE WHEN a.s = a.e OR b.s = b.e THEN 0 ELSE greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / greatest(a.e - a.s, b.e - b.s) END, 6) AS fraction,
a.s = a.e OR b.s = b.e OR greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / greatest(a.e - a.s, b.e - b.s) > 0.1 AS reciprocal
FROM u a JOIN u b ON a.list_id = b.list_id AND a.chrom = b.chrom AND a.site_id < b.site_id AND a.s <= b.e AND b.s <= a.e""")
def interval_overlap_pairs(spark, sf):
    x = sites(spark, sf)
    a = x.select(F.col("site_id").alias("a"), F.col("list_id").alias("al"), F.col("chrom").alias("ac"), F.col("s").alias("as"), F.col("e").alias("ae"))
    b = x.select(F.col("site_id").alias("b"), F.col("list_id").alias("bl"), F.col("chrom").alias("bc"), F.col("s").alias("bs"), F.col("e").alias("be"))
    p = intervals.range_join(a, b, [("al", "bl"), ("ac", "bc")], ("as", "ae"), ("bs", "be"), 4096).where("a < b")
    return p.select("a", "b", F.round(geo.min_fraction("as", "ae", "bs", "be"), 6).alias("fraction"), geo.reciprocal("as", "ae", "bs", "be").alias("reciprocal"))


_FAR, _LONG = "abs((a.s + a.e) / 2 - (b.s + b.e) / 2)", "greatest(greatest(1, a.e - a.s), greatest(1, b.e - b.s))"
_DIFF = f"abs(greatest(1, a.e - a.s) - greatest(1, b.e - b.s)) / {_LONG}"


@query("X04 X05 X06", f"""WITH {_SITES} SELECT a.site_id AS a, b.site_id AS b, {_FAR} <= 2000 AND {_FAR} / 100 + {_DIFF} < 0.8 AS long_rule, {_FAR} <= 2000 AND {_FAR} / {_LONG} < 0.3 AND {_DIFF} < 0.3 AS pair_rule,
{_FAR} <= 2000 AND {_FAR} / {_LONG} < 0.2 AND {_DIFF} < 0.3 AS fixed_rule, greatest(1, {_FAR}) / {_LONG} < 20 AND {_DIFF} < 0.3 AS filter_rule
FROM u a JOIN u b ON a.list_id = b.list_id AND a.chrom = b.chrom AND a.site_id < b.site_id AND abs(a.s - b.s) <= 1000""")
def span_position_pairs(spark, sf):
    x = sites(spark, sf)
    a = x.select(F.col("site_id").alias("a"), F.col("list_id").alias("al"), F.col("chrom").alias("ac"), F.col("s").alias("as"), F.col("e").alias("ae"))
    b = x.select(F.col("site_id").alias("b"), F.col("list_id").alias("bl"), F.col("chrom").alias("bc"), F.col("s").alias("bs"), F.col("e").alias("be"))
    p = intervals.range_join(a, b, [("al", "bl"), ("ac", "bc")], (F.col("as") - 1000, F.col("as") + 1000), ("bs", "bs"), 2048).where("a < b")
    s = ("as", "ae", "bs", "be")
    return p.select("a", "b", geo.alike_spans(*s, 100, 0.8, True).alias("long_rule"), geo.alike_spans(*s, 100, 0.3, False).alias("pair_rule"), geo.alike_spans_fixed(*s).alias("fixed_rule"), geo.alike_spans_filter(*s).alias("filter_rule"))


_MERGED = """o AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT chrom, greatest(0, s - 200000) AS s, e + 200000 AS e FROM u)),
i AS (SELECT chrom, s, e, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o), reg AS (SELECT chrom AS rc, min(s) AS rs, max(e) AS re FROM i GROUP BY chrom, g)"""


@query("J08", f"WITH {_SITES}, {_MERGED}, {_C} SELECT call_id FROM c WHERE EXISTS (SELECT 1 FROM reg WHERE rc = chrom AND rs <= pos AND pos <= re)")
def region_semi(spark, sf):
    reg = intervals.merge_intervals(sites(spark, sf), ["chrom"], "s", "e", pad=200_000).select(F.col("chrom").alias("rc"), F.col("s").alias("rs"), F.col("e").alias("re"))
    return intervals.range_join(calls(spark, sf), reg, [("chrom", "rc")], ("pos", "pos"), ("rs", "re"), 1 << 17, "left_semi").select("call_id")


@query("J12", f"WITH {_SITES}, {_MERGED}, {_C} SELECT call_id FROM c WHERE NOT EXISTS (SELECT 1 FROM reg WHERE rc = chrom AND rs <= pos AND pos <= re)")
def region_anti(spark, sf):
    reg = intervals.merge_intervals(sites(spark, sf), ["chrom"], "s", "e", pad=200_000).select(F.col("chrom").alias("rc"), F.col("s").alias("rs"), F.col("e").alias("re"))
    return intervals.range_join(calls(spark, sf), reg, [("chrom", "rc")], ("pos", "pos"), ("rs", "re"), 1 << 17, "left_anti").select("call_id")


@query("J19", f"""WITH {_SITES}, {_MERGED}, {_C}, k AS (SELECT call_id, chrom, chr2, a.rs AS ra, b.rs AS rb FROM c LEFT JOIN reg a ON a.rc = chrom AND a.rs <= pos AND pos <= a.re LEFT JOIN reg b ON b.rc = chr2 AND b.rs <= end_pos AND end_pos <= b.re)
SELECT call_id, CASE WHEN ra IS NULL AND rb IS NULL THEN 'extra-regional' WHEN ra IS NULL OR rb IS NULL THEN 'hemi-regional' WHEN chrom = chr2 AND ra = rb THEN 'intra_regional' ELSE 'inter-regional' END AS kind, ra IS NULL AND rb IS NOT NULL AS switched FROM k""")
def kind_label(spark, sf):
    reg = sites(spark, sf).select("chrom", F.greatest(F.lit(0), F.col("s") - 200_000).alias("s"), (F.col("e") + 200_000).alias("e"))
    return intervals.region_label(calls(spark, sf), reg, ["call_id"], "chrom", "pos", "chr2", "end_pos", ("chrom", "s", "e"))


@query("J17", f"""WITH {_C} SELECT call_id, count(*) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) - 1 AS neigh, count(*) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) - 1 AS neigh10 FROM c""")
def density_window(spark, sf):
    c = calls(spark, sf).select("call_id", "chrom", "pos")
    x = intervals.count_near(c, ["chrom"], "pos", 50, 50, "neigh", own=False)
    return intervals.count_near(x, ["chrom"], "pos", 10_000, 10_000, "neigh10", own=False).select("call_id", "neigh", "neigh10")


@query("J16", """WITH e AS (SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events) SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY sec RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n FROM e""")
def range_count(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("at"))
    return intervals.count_near(e, ["event_type"], "at", 500, 500, "n").select("event_id", "n")


@query("J06", f"""WITH {_SITES}, {_C}, d AS (SELECT DISTINCT chrom AS sc, s FROM u), k AS (SELECT call_id, s, abs(pos - s) AS distance, row_number() OVER (PARTITION BY call_id ORDER BY abs(pos - s), s) AS n FROM c JOIN d ON chrom = sc AND s BETWEEN pos - 20000 AND pos + 20000)
SELECT call_id, s AS site_start, distance FROM k WHERE n = 1""")
def nearest_site(spark, sf):
    d = sites(spark, sf).select(F.col("chrom").alias("sc"), F.col("s").alias("site_start")).distinct()
    return intervals.nearest_join(calls(spark, sf), d, [("chrom", "sc")], "pos", "site_start", 20_000, ["call_id"]).select("call_id", "site_start", "distance")


@query("J06", """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, p.purchase AS last_event FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_nearest(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("event"))
    return intervals.asof_join(left, right, ["user_id"], "ts", ["event"]).select("event_id", "last_event")


@query("W05 U03", """WITH x AS (SELECT DISTINCT l_orderkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
n AS (SELECT l_orderkey, e, lead(s) OVER (PARTITION BY l_orderkey ORDER BY s, e) AS nx FROM x) SELECT l_orderkey, CAST(e AS BIGINT) AS gap_start, CAST(nx AS BIGINT) AS gap_end FROM n WHERE e < nx""")
def introns(spark, sf):
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    x = table(spark, sf, "lineitem").select("l_orderkey", day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))
    return intervals.introns(x, ["l_orderkey"], "s", "e")


# ---------------------------------------------------------------- calls: merging, genotypes, filters

_PAIR = f"""p AS (SELECT a.call_id AS a, b.call_id AS b, a.svtype AS ta, b.svtype AS tb, a.chrom AS ca, a.chr2 AS c2, b.chr2 AS d2, coalesce(a.svlen, 0) AS la, coalesce(b.svlen, 0) AS lb, a.pos AS pa, b.pos AS pb, a.end_pos AS ea, b.end_pos AS eb, coalesce(a.ci, 0) AS ia, coalesce(b.ci, 0) AS ib
FROM c a JOIN c b ON a.chrom = b.chrom AND a.svtype = b.svtype AND a.call_id < b.call_id AND a.sample_name <> b.sample_name AND (abs(a.pos - b.pos) <= 100 + coalesce(a.ci, 0) OR abs(a.pos - b.pos) <= 100 + coalesce(b.ci, 0)))"""
_RATIO = "least(la, lb) / nullif(greatest(la, lb), 0)"
_ONE = f"""coalesce(NOT (ca = c2 AND ca = d2) OR (pa = pb AND la = lb) OR ta = 'TRA' OR (({_RATIO} > 0.5 OR (({'ia > 0 OR ib > 0'}) AND {_RATIO} > 0.3)) AND (ta <> 'DEL' OR pa = ea OR pb = eb OR greatest(0, least(greatest(pa, ea), greatest(pb, eb)) - greatest(least(pa, ea), least(pb, eb))) / greatest(abs(ea - pa), abs(eb - pb)) > 0.1)), false)"""


def _merge_pairs(spark, sf) -> DataFrame:
    c = calls(spark, sf, "svtype is not null").select("call_id", "sample_name", "chrom", "pos", "chr2", "end_pos", "svtype", "svlen", "ci")
    p = pairs.event_pairs(c, ["chrom", "svtype"], "call_id", "pos", "end_pos", "ci", 200, "sample_name")
    return p.where(pairs.merge_rule(False)).select(F.col("a_call_id").alias("src"), F.col("b_call_id").alias("dst"))


@query("J09 J10", f"WITH {_C}, {_PAIR} SELECT a AS src, b AS dst FROM p WHERE {_ONE}")
def merge_pairs(spark, sf):
    return _merge_pairs(spark, sf)


_CLUSTER = f"""{_C}, {_PAIR}, l AS (SELECT a, b FROM p WHERE {_ONE}), bi AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
walk AS (SELECT call_id AS a, call_id AS b FROM c WHERE svtype IS NOT NULL UNION SELECT walk.a, bi.b FROM walk JOIN bi ON walk.b = bi.a), g AS (SELECT a AS call_id, min(b) AS cluster FROM walk GROUP BY a)"""


def _clusters(spark, sf) -> DataFrame:
    c = calls(spark, sf, "svtype is not null")
    return graph.connected_components(_merge_pairs(spark, sf), nodes=c.select("call_id")).select(F.col("node").alias("call_id"), F.col("component").alias("cluster"))


@query("G01 U06 J27", f"WITH RECURSIVE {_CLUSTER} SELECT call_id, cluster FROM g")
def merge_clusters(spark, sf):
    return _clusters(spark, sf)


@query("A10 A11 A12 X39 P04 A23", f"""WITH RECURSIVE {_CLUSTER}, m AS (SELECT g.cluster, c.*, row_number() OVER (PARTITION BY g.cluster ORDER BY coalesce(c.su, 0) DESC, coalesce(c.svlen, 0) DESC, c.call_id DESC) AS k FROM g JOIN c ON g.call_id = c.call_id)
SELECT cluster, max(CASE WHEN k = 1 THEN call_id END) AS call_id, max(CASE WHEN k = 1 THEN chrom END) AS chrom, max(CASE WHEN k = 1 THEN pos END) AS pos, max(CASE WHEN k = 1 THEN svtype END) AS svtype, CAST(sum(coalesce(su, 0)) AS BIGINT) AS sum_su, round(max(prob), 6) AS max_prob,
round(sum(prob * coalesce(su, 0)) / nullif(sum(CASE WHEN prob IS NOT NULL THEN coalesce(su, 0) END), 0), 9) AS mean_prob, count(*) AS n_in_grp FROM m GROUP BY cluster""")
def merge_rollup(spark, sf):
    c = calls(spark, sf).withColumn("su0", F.coalesce("su", F.lit(0))).withColumn("len0", F.coalesce("svlen", F.lit(0))).withColumn("sum_su", F.col("su0"))
    x = c.join(_clusters(spark, sf), "call_id")
    m = rollups.merge_rollup(x, ["cluster"], F.struct("su0", "len0", "call_id"), ["call_id", "chrom", "pos", "svtype"], ["sum_su"], ["prob"], ["prob"], "su0")
    return m.withColumn("max_prob", F.round("max_prob", 6)).withColumn("mean_prob", F.round("mean_prob", 9))


_PL = "('pe', 'pacbio', 'nanopore')"


@query("A11", f"""WITH {_C}, j AS (SELECT svtype, chrom, pl, prob FROM c JOIN samples s ON c.sample_name = s.sample_name WHERE svtype IS NOT NULL)
SELECT svtype, chrom, count(CASE WHEN pl = 'pe' THEN 1 END) AS n_pe, count(CASE WHEN pl = 'pacbio' THEN 1 END) AS n_pacbio, count(CASE WHEN pl = 'nanopore' THEN 1 END) AS n_nanopore, round(avg(prob), 9) AS mean_prob, round(max(prob), 6) AS max_prob FROM j GROUP BY svtype, chrom""")
def cohort_pivot(spark, sf):
    s = table(spark, sf, "samples").select("sample_name", "pl")  # a fixed table of 120 rows
    j = calls(spark, sf, "svtype is not null").join(F.broadcast(s), "sample_name")
    n = j.groupBy("svtype", "chrom").pivot("pl", ["pe", "pacbio", "nanopore"]).count()
    p = j.groupBy("svtype", "chrom").agg(F.round(F.avg("prob"), 9).alias("mean_prob"), F.round(F.max("prob"), 6).alias("max_prob"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(f"n_{c}")
    return p.join(n, ["svtype", "chrom"]).select("svtype", "chrom", zero("pe"), zero("pacbio"), zero("nanopore"), "mean_prob", "max_prob")


@query("J12 U05 X36", f"""WITH {_C}, j AS (SELECT c.*, tissue FROM c JOIN samples s ON c.sample_name = s.sample_name WHERE svtype IS NOT NULL), n AS (SELECT chrom, svtype, pos, end_pos, chr2, svlen FROM j WHERE tissue = 'normal'),
w AS (SELECT chrom, svtype, pos - 1000 AS lo, pos + 1000 AS hi, svlen FROM n UNION ALL SELECT chr2, svtype, end_pos - 1000, end_pos + 1000, svlen FROM n)
SELECT call_id, EXISTS (SELECT 1 FROM w a WHERE a.chrom = j.chrom AND a.svtype = j.svtype AND j.pos BETWEEN a.lo AND a.hi AND j.svlen IS NOT NULL AND a.svlen IS NOT NULL AND least(a.svlen, j.svlen) > 0.8 * greatest(a.svlen, j.svlen)) AS normal_overlap FROM j WHERE tissue = 'tumour'""")
def normal_overlap(spark, sf):
    s = table(spark, sf, "samples").select("sample_name", "tissue")
    j = calls(spark, sf, "svtype is not null").join(F.broadcast(s), "sample_name")
    n = j.where("tissue = 'normal' and svlen is not null")
    ends = F.explode(F.array(F.struct(F.col("chrom").alias("c"), F.col("pos").alias("p")), F.struct(F.col("chr2").alias("c"), F.col("end_pos").alias("p")))).alias("x")
    w = n.select("svtype", "svlen", ends).select(F.col("x.c").alias("wc"), F.col("x.p").alias("wp"), F.col("svtype").alias("wt"), F.col("svlen").alias("wl")).distinct()
    t = j.where("tissue = 'tumour'")
    hit = intervals.range_join(t.select("call_id", "chrom", "svtype", "pos", "svlen").where("svlen is not null"), w, [("chrom", "wc"), ("svtype", "wt")], ("pos", "pos"), (F.col("wp") - 1000, F.col("wp") + 1000), 2048)
    hit = hit.where(F.least("wl", "svlen") > 0.8 * F.greatest("wl", "svlen")).select("call_id").distinct().withColumn("hit", F.lit(True))
    return t.select("call_id").join(hit, "call_id", "left").select("call_id", F.coalesce("hit", F.lit(False)).alias("normal_overlap"))


@query("F11 F12 F15 F20 F21 K08", f"""WITH {_C}, j AS (SELECT c.*, coalesce(mean_cov, 20) AS cov FROM c JOIN samples s ON c.sample_name = s.sample_name),
f AS (SELECT call_id, filt, CASE WHEN prob < 0.1 THEN 'lowProb' WHEN greatest(0, least(1, su / 2 / (cov + 1e-5))) < 0.05 THEN 'lowAF' WHEN su < round_even(1.5 + 0.1 * cov, 0) THEN 'lowSupport' WHEN svlen < 30 AND chrom = chr2 THEN 'tooSmall' END AS reason FROM j)
SELECT call_id, reason, CASE WHEN reason IS NULL THEN coalesce(filt, 'PASS') WHEN coalesce(filt, '.') IN ('PASS', '.', '') THEN reason WHEN list_contains(string_split(filt, ';'), reason) THEN filt ELSE filt || ';' || reason END AS label FROM f""")
def filter_chain(spark, sf):
    s = table(spark, sf, "samples").select("sample_name", F.coalesce("mean_cov", F.lit(20.0)).alias("cov"))
    j = calls(spark, sf).join(F.broadcast(s), "sample_name")
    reason = F.when(F.col("prob") < 0.1, "lowProb").when(gtp.allele_fraction(F.lit(None), "su", "cov") < 0.05, "lowAF").when(F.col("su") < gtp.least_support("cov", 0.1), "lowSupport").when((F.col("svlen") < 30) & (F.col("chrom") == F.col("chr2")), "tooSmall")
    return j.select("call_id", "filt", reason.alias("reason")).select("call_id", "reason", sink.label(F.col("filt"), F.col("reason")).alias("label"))


@query("A22", f"""WITH {_C}, j AS (SELECT c.*, coalesce(mean_cov, 20) AS cov FROM c JOIN samples s ON c.sample_name = s.sample_name) SELECT CASE WHEN prob < 0.1 THEN 'lowProb' WHEN su < round_even(1.5 + 0.05 * cov, 0) THEN 'lowSupport' ELSE 'kept' END AS reason, count(*) AS n FROM j GROUP BY 1""")
def filter_tally(spark, sf):
    s = table(spark, sf, "samples").select("sample_name", F.coalesce("mean_cov", F.lit(20.0)).alias("cov"))
    j = calls(spark, sf).join(F.broadcast(s), "sample_name")
    return j.groupBy(F.when(F.col("prob") < 0.1, "lowProb").when(F.col("su") < gtp.least_support("cov", 0.05), "lowSupport").otherwise("kept").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_HET = "CASE svtype WHEN 'DUP' THEN 0.6 WHEN 'INS' THEN 0.4 WHEN 'INV' THEN 0.4 WHEN 'BND' THEN 0.4 ELSE 0.5 END"
_HOM = "CASE svtype WHEN 'DUP' THEN 0.2 ELSE 0.9 END"
_LH, _LM = (f"(alt * log10({p}) + ref * log10(1 - {p}))" for p in (_HET, _HOM))


@query("X31 O05", f"""WITH {_C}, k AS (SELECT call_id, svtype, coalesce(su, 0) AS alt, CAST(length(coalesce(filt, '')) + coalesce(ci, 0) AS BIGINT) AS ref FROM c)
SELECT call_id, CASE WHEN ref + alt <= 0 THEN './.' WHEN {_LH} > {_LM} THEN '0/1' ELSE '1/1' END AS new_gt, CASE WHEN ref + alt > 0 THEN CAST(trunc(least(200, 10 * abs({_LH} - {_LM}))) AS INTEGER) END AS new_gq FROM k""")
def genotype_likelihood(spark, sf):
    k = calls(spark, sf).select("call_id", "svtype", F.coalesce("su", F.lit(0)).alias("alt"), (F.length(F.coalesce("filt", F.lit(""))) + F.coalesce("ci", F.lit(0))).alias("ref"))
    gt, gq = gtp.genotype("ref", "alt", F.coalesce("svtype", F.lit("DEL")))
    return k.select("call_id", gt.alias("new_gt"), gq.alias("new_gq"))


@query("X34 X33 K01", f"""WITH {_C} SELECT call_id, CASE WHEN prob >= 1 THEN 30 ELSE CAST(trunc(least(30, -20 * log10(1 - prob))) AS INTEGER) END AS qual, round(CASE WHEN prob IS NULL THEN 0.5 ELSE prob * prob / (prob * prob + (1 - prob) * (1 - prob)) END, 3) AS twice FROM c""")
def phred_and_posterior(spark, sf):
    return calls(spark, sf).select("call_id", gtp.phred_quality("prob").alias("qual"), F.round(gtp.posterior([F.col("prob"), F.col("prob")]), 3).alias("twice"))


@query("X30", """WITH k AS (SELECT l_partkey, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS plus, count(CASE WHEN l_linestatus <> 'O' THEN 1 END) AS minus FROM lineitem GROUP BY 1), n AS (SELECT *, greatest(plus, minus) AS k, plus + minus AS n FROM k),
x AS (SELECT l_partkey, plus, minus, n, k, unnest(range(k, n + 1)) AS i FROM n) SELECT l_partkey, plus, minus, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))), 6) AS bias FROM x GROUP BY 1, 2, 3""")
def strand_bias(spark, sf):
    k = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("plus"), F.count_if(F.col("l_linestatus") != "O").alias("minus"))
    return k.withColumn("bias", F.round(gtp.strand_bias("plus", "minus"), 6))


@query("W03", f"""WITH {_C}, o AS (SELECT call_id, gt, svtype, chrom, pos, end_pos, lag(struct_pack(t := svtype, p := pos, e := end_pos, g := gt)) OVER w AS b, lead(struct_pack(t := svtype, p := pos, e := end_pos, g := gt)) OVER w AS a FROM c WHERE svtype IS NOT NULL WINDOW w AS (PARTITION BY sample_name, chrom ORDER BY pos, call_id))
SELECT call_id, CASE WHEN gt = '1/1' AND coalesce((b.t = svtype AND ((svtype = 'INS' AND b.p = pos) OR (svtype IN ('DEL', 'DUP', 'INV') AND abs(b.e - b.p) > 0 AND abs(end_pos - pos) > 0 AND greatest(0, least(greatest(pos, end_pos), greatest(b.p, b.e)) - greatest(least(pos, end_pos), least(b.p, b.e))) / greatest(abs(b.e - b.p), abs(end_pos - pos)) > 0.8)))
OR (a.t = svtype AND ((svtype = 'INS' AND a.p = pos) OR (svtype IN ('DEL', 'DUP', 'INV') AND abs(a.e - a.p) > 0 AND abs(end_pos - pos) > 0 AND greatest(0, least(greatest(pos, end_pos), greatest(a.p, a.e)) - greatest(least(pos, end_pos), least(a.p, a.e))) / greatest(abs(a.e - a.p), abs(end_pos - pos)) > 0.8))), false) THEN '0/1' ELSE gt END AS fixed_gt FROM o""")
def gt_adjacent_fix(spark, sf):
    c = calls(spark, sf, "svtype is not null")
    c = rollups.next_to(c, ["sample_name", "chrom"], "pos", "call_id", ["svtype", "end_pos"])

    def alike(o):
        t, p, e = (F.col(f"{o}.{x}") for x in ("svtype", "pos", "end_pos"))
        long = (F.abs(e - p) > 0) & (F.abs(F.col("end_pos") - F.col("pos")) > 0) & geo.reciprocal("pos", "end_pos", p, e, 0.8)
        return (t == F.col("svtype")) & (((F.col("svtype") == "INS") & (p == F.col("pos"))) | (F.col("svtype").isin("DEL", "DUP", "INV") & long))

    return rollups.fix_neighbours(c, alike("__before"), alike("__after"), "gt").select("call_id", "fixed_gt")


@query("W08", f"""WITH {_C}, k AS (SELECT chrom, svtype, call_id, prob, row_number() OVER (PARTITION BY chrom, svtype ORDER BY prob DESC NULLS LAST, call_id) AS n FROM c WHERE svtype IS NOT NULL) SELECT chrom, svtype, call_id FROM k WHERE n = 1""")
def best_per_site(spark, sf):
    c = calls(spark, sf, "svtype is not null")
    return rollups.best_per(c, ["chrom", "svtype"], [F.coalesce(-F.col("prob"), F.lit(9.0))], ["call_id"])


@query("O01 O03 O08 O09", f"""WITH {_C}, k AS (SELECT svtype, call_id, svlen, row_number() OVER (PARTITION BY svtype ORDER BY svlen DESC, call_id) AS rank FROM c WHERE svtype IS NOT NULL AND svlen IS NOT NULL) SELECT svtype, call_id, svlen, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 25""")
def longest_per_type(spark, sf):
    c = calls(spark, sf, "svtype is not null and svlen is not null").select("svtype", "call_id", "svlen")
    return rollups.top_k(c, ["svtype"], [F.desc("svlen"), F.col("call_id")], 25)


@query("O02 S19", f"""WITH {_C} SELECT call_id, CASE WHEN svtype IN ('INS', 'DUP') THEN 'INSDUP' ELSE coalesce(svtype, '.') END || ':' || CASE WHEN chrom = chr2 THEN chrom ELSE least(chrom, chr2) || '|' || greatest(chrom, chr2) END AS grp_key, CASE WHEN chrom = chr2 THEN least(pos, end_pos) WHEN chrom < chr2 THEN pos ELSE end_pos END AS anchor FROM c""")
def variant_keys(spark, sf):
    return vcf.variant_key(calls(spark, sf), ["call_id"])


@query("J24 U01", f"""WITH {_SITES}, {_C} SELECT site_id, chrom, s, '0/0' AS gt, CAST(0 AS BIGINT) AS su FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.chrom = u.chrom AND c.pos BETWEEN u.s - 100 AND u.s + 100)
UNION ALL SELECT CAST(NULL AS BIGINT), chrom, pos, gt, su FROM c""")
def uncalled_sites(spark, sf):
    c = calls(spark, sf)
    at = c.select(F.col("chrom").alias("cc"), F.col("pos").alias("cp")).distinct()
    none = intervals.range_join(sites(spark, sf), at, [("chrom", "cc")], (F.col("s") - 100, F.col("s") + 100), ("cp", "cp"), 1024, "left_anti")
    none = none.select("site_id", "chrom", "s", F.lit("0/0").alias("gt"), F.lit(0).cast("long").alias("su"))
    return none.unionByName(c.select("chrom", F.col("pos").alias("s"), "gt", "su"), allowMissingColumns=True)


@query("K12", f"""WITH {_C}, t AS (SELECT * FROM c WHERE chrom <> chr2) SELECT call_id, CAST(1 AS INTEGER) AS mate, chrom, pos + 1 AS pos, 'N[' || chr2 || ':' || (end_pos + 1) || '[' AS alt FROM t UNION ALL SELECT call_id, 2, chr2, end_pos + 1, ']' || chrom || ':' || (pos + 1) || ']N' FROM t""")
def bnd_explode(spark, sf):
    c = calls(spark, sf, "chrom <> chr2").withColumn("ct", F.lit(None).cast("string"))
    return sink.break_ends(c, "call_id")


@query("K01 F23 F24", f"""WITH {_C} SELECT chrom, pos, chrom || chr(9) || (pos + 1) || chr(9) || call_id || chr(9) || 'N' || chr(9) || '<' || coalesce(svtype, 'BND') || '>' || chr(9) || coalesce(CAST(CASE WHEN prob >= 1 THEN 30 ELSE CAST(trunc(least(30, -20 * log10(1 - prob))) AS INTEGER) END AS VARCHAR), '.') || chr(9) || coalesce(filt, '.') || chr(9)
 || concat_ws(';', 'SVTYPE=' || svtype, 'END=' || CASE WHEN chrom <> chr2 THEN pos + 1 ELSE end_pos + 1 END, 'CHR2=' || chr2, 'CHR2_POS=' || CASE WHEN chrom <> chr2 THEN end_pos + 1 END, 'SVLEN=' || svlen, 'SU=' || su) || chr(9) || 'GT:GQ:PSET:HP:AF:MAPQP:MAPQS:SU:WR:PE:SR:SC:BND:NMB:COV:NEIGH10:PS:MS:RMS:RED:BCC:FCC:ICN:OCN:PROB' || chr(9) || coalesce(gt, './.') || ':.:0:0:0:0:0:' || coalesce(CAST(su AS VARCHAR), '0') || repeat(':0', 16) || ':' || coalesce(printf('%.3f', prob), '0') AS line FROM c""")
def vcf_lines(spark, sf):
    c = calls(spark, sf).withColumn("id", F.col("call_id").cast("string")).drop("grp")
    return sink.vcf_lines(c.select("chrom", "pos", "chr2", "end_pos", "svtype", "svlen", "filt", "su", "gt", "prob", "id"))


_ITEM = "nullif(list_filter(list_transform(string_split(info, ';'), lambda x: trim(x)), lambda x: starts_with(x, '{0}='))[-1][{1}:], '')".format


@query("S07 S08", f"""WITH v AS (SELECT DISTINCT rec_id, info, fmt, fmt_value FROM vcf_records) SELECT rec_id, {_ITEM('SVTYPE', 8)} AS svtype, TRY_CAST({_ITEM('END', 5)} AS BIGINT) AS end_pos, TRY_CAST({_ITEM('SVLEN', 7)} AS BIGINT) AS svlen, {_ITEM('CHR2', 6)} AS chr2, TRY_CAST({_ITEM('GC', 4)} AS DOUBLE) AS gc, TRY_CAST({_ITEM('MeanPROB', 10)} AS DOUBLE) AS mean_prob FROM v""")
def info_parse(spark, sf):
    v = table(spark, sf, "vcf_records").select("rec_id", "info", "fmt", "fmt_value").dropDuplicates(["rec_id"])
    t = vcf.typed(v, "info", None, None, ["SVTYPE", "END", "SVLEN", "CHR2", "GC", "MeanPROB"])
    return t.select("rec_id", F.nullif("svtype", F.lit("")).alias("svtype"), "end_pos", "svlen", F.nullif("chr2", F.lit("")).alias("chr2"), "gc", "mean_prob")


@query("S08 X31", """WITH v AS (SELECT DISTINCT rec_id, fmt, fmt_value FROM vcf_records), s AS (SELECT rec_id, string_split(fmt, ':') AS k, string_split(fmt_value, ':') AS v FROM v) SELECT rec_id, v[list_position(k, 'GT')] AS gt, nullif(v[list_position(k, 'GQ')], '.') AS gq, TRY_CAST(nullif(v[list_position(k, 'SU')], '.') AS BIGINT) AS su, TRY_CAST(nullif(v[list_position(k, 'PROB')], '.') AS DOUBLE) AS prob FROM s""")
def format_parse(spark, sf):
    v = table(spark, sf, "vcf_records").select("rec_id", "fmt", "fmt_value").dropDuplicates(["rec_id"])
    m = v.withColumn("m", vcf.format_map("fmt", "fmt_value"))
    g = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("rec_id", g("GT").alias("gt"), F.nullif(g("GQ"), F.lit(".")).alias("gq"), F.nullif(g("SU"), F.lit(".")).try_cast("long").alias("su"), F.nullif(g("PROB"), F.lit(".")).try_cast("double").alias("prob"))


@query("A08 A09", f"""WITH {_C}, k AS (SELECT call_id, svtype, svlen, greatest(1, least(CAST(trunc(0.045 * max(svlen) OVER (PARTITION BY svtype)) AS BIGINT), CAST(trunc(power(max(svlen) OVER (PARTITION BY svtype), 0.45)) AS BIGINT))) AS eps, svlen - lag(svlen) OVER (PARTITION BY svtype ORDER BY svlen, call_id) AS step FROM c WHERE svtype IS NOT NULL AND svlen IS NOT NULL),
g AS (SELECT call_id, svtype, 1 + sum(CASE WHEN step > eps THEN 1 ELSE 0 END) OVER (PARTITION BY svtype ORDER BY svlen, call_id ROWS UNBOUNDED PRECEDING) AS cluster FROM k) SELECT call_id, svtype, CAST(cluster AS BIGINT) AS cluster FROM g QUALIFY count(*) OVER (PARTITION BY svtype, cluster) >= 2""")
def length_clusters(spark, sf):
    return rollups.cluster_lengths(calls(spark, sf, "svtype is not null"), ["svtype"], "svlen", "call_id")


@query("A09", f"""WITH {_C}, k AS (SELECT call_id, svtype, chrom, pos, CASE WHEN pos - lag(pos) OVER w <= 500 THEN NULL ELSE pos END AS f FROM c WHERE svtype IS NOT NULL WINDOW w AS (PARTITION BY svtype, chrom ORDER BY pos, call_id))
SELECT call_id, svtype, chrom, last_value(f IGNORE NULLS) OVER (PARTITION BY svtype, chrom ORDER BY pos, call_id ROWS UNBOUNDED PRECEDING) AS island FROM k""")
def single_linkage(spark, sf):
    return rollups.islands(calls(spark, sf, "svtype is not null"), ["svtype", "chrom"], "pos", 500, "call_id")


@query("A13", """WITH x AS (SELECT l_partkey, l_linenumber, l_quantity AS q FROM lineitem), m AS (SELECT *, avg(q) OVER (PARTITION BY l_partkey, l_linenumber) AS m, count(q) OVER (PARTITION BY l_partkey, l_linenumber) AS n, avg(q) OVER (PARTITION BY l_partkey) AS a FROM x)
SELECT l_partkey, round(CASE WHEN max(n) < 2 OR sum(abs(q - a)) = 0 THEN -1 ELSE sum(abs(q - m)) / sum(abs(q - a)) END, 9) AS ratio FROM m GROUP BY l_partkey""")
def quality_corr(spark, sf):
    return rollups.quality_ratio(table(spark, sf, "lineitem"), ["l_partkey"], "l_linenumber", "l_quantity").withColumn("ratio", F.round("ratio", 9))


@query("A19", """WITH c AS (SELECT user_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS hp, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, coalesce(string_agg(CASE WHEN hp <> 0 THEN CAST(n AS VARCHAR) END, '|' ORDER BY hp), '') || coalesce('_' || max(CASE WHEN hp = 0 THEN n END), '') AS hp_text FROM c GROUP BY user_id""")
def haplotype_string(spark, sf):
    hp = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    c = table(spark, sf, "events").groupBy("user_id", hp.alias("hp")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("hp", "n"))).alias("m"))  # at most four entries
    return m.select("user_id", gtp.haplotype_text(F.col("m")).alias("hp_text"))


# ---------------------------------------------------------------- graph

_ED = "ed AS (SELECT DISTINCT l_partkey AS p, 1000000000 + l_orderkey AS o FROM lineitem)"


def _edges(spark, sf) -> DataFrame:
    """Every part and order of lineitem."""
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") + 1_000_000_000).alias("dst")).distinct()


#: Components of the links l (a, b, both ways), by the least node that reaches each.
_REACH = "g(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.a, min(g.component) FROM g JOIN l ON g.node = l.b JOIN recurring.g AS k ON k.node = l.a WHERE g.component < k.component GROUP BY l.a)"
_LINKS = "l AS (SELECT p AS a, o AS b FROM ed UNION SELECT o, p FROM ed)"


@query("G01", f"WITH RECURSIVE {_ED}, {_LINKS}, {_REACH} SELECT node, component FROM g")
def conn_components(spark, sf):
    return graph.connected_components(_edges(spark, sf))


_MP = f"""{_C}, {_PAIR}, w AS (SELECT a AS src, b AS dst, CASE WHEN {_ONE} THEN 2 ELSE 1 END AS weight FROM p)"""


def _weighted(spark, sf) -> DataFrame:
    c = calls(spark, sf, "svtype is not null").select("call_id", "sample_name", "chrom", "pos", "chr2", "end_pos", "svtype", "svlen", "ci")
    p = pairs.event_pairs(c, ["chrom", "svtype"], "call_id", "pos", "end_pos", "ci", 200, "sample_name")
    return p.select(F.col("a_call_id").alias("src"), F.col("b_call_id").alias("dst"), F.when(pairs.merge_rule(False), 2).otherwise(1).alias("weight"))


_PARTS = f"{_MP}, l AS (SELECT src AS a, dst AS b FROM w WHERE weight > 1 UNION SELECT dst, src FROM w WHERE weight > 1), ends AS (SELECT src AS n FROM w UNION SELECT dst FROM w), walk AS (SELECT n AS a, n AS b FROM ends UNION SELECT walk.a, l.b FROM walk JOIN l ON walk.b = l.a), g AS (SELECT a AS node, min(b) AS part FROM walk GROUP BY a)"


@query("G02 J05", f"WITH RECURSIVE {_PARTS} SELECT node, part FROM g")
def strong_parts(spark, sf):
    return graph.partitions(pairs.union_edges(_weighted(spark, sf)))


_BETWEEN = f"{_PARTS}, x AS (SELECT least(ga.part, gb.part) AS part_a, greatest(ga.part, gb.part) AS part_b, CASE WHEN ga.part > gb.part THEN dst ELSE src END AS a, CASE WHEN ga.part > gb.part THEN src ELSE dst END AS b FROM w JOIN g ga ON src = ga.node JOIN g gb ON dst = gb.node WHERE ga.part <> gb.part)"


@query("G03", f"WITH RECURSIVE {_BETWEEN} SELECT part_a, part_b, count(*) AS n_edges, count(DISTINCT a) AS n_a, count(DISTINCT b) AS n_b FROM x GROUP BY 1, 2")
def support_matrix(spark, sf):
    e = _weighted(spark, sf)
    return graph.support_between(e, graph.partitions(e))


@query("G04", f"WITH RECURSIVE {_BETWEEN}, z AS (SELECT part, count(*) AS n FROM g GROUP BY part) SELECT part_a, part_b, count(*) AS n_edges FROM x JOIN z za ON za.part = part_a JOIN z zb ON zb.part = part_b WHERE za.n <= 500 AND zb.n <= 500 GROUP BY 1, 2 HAVING count(*) >= 2")
def strong_links(spark, sf):
    """What is kept of a component too large to call at once; the bound on nodes is the rule itself."""
    e = _weighted(spark, sf)
    return graph.strong_links(e, graph.partitions(e), 2, 500)


@query("G03", f"WITH RECURSIVE {_BETWEEN}, out_ AS (SELECT a AS n FROM x UNION SELECT b FROM x) SELECT part, count(*) AS n_inner FROM g WHERE node NOT IN (SELECT n FROM out_) GROUP BY part")
def support_inner(spark, sf):
    e = _weighted(spark, sf)
    return graph.support_within(e, graph.partitions(e))


@query("F25", f"WITH RECURSIVE {_ED}, {_LINKS}, {_REACH} SELECT component, count(*) AS n, CAST(sum(CASE WHEN node < 1000000000 THEN 2 ELSE 1 END) AS BIGINT) AS support FROM g GROUP BY component HAVING sum(CASE WHEN node < 1000000000 THEN 2 ELSE 1 END) >= 4 AND count(*) > 1")
def component_filter(spark, sf):
    return _supported(graph.connected_components(_edges(spark, sf)))


def _supported(g: DataFrame) -> DataFrame:
    x = g.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("node") < 1_000_000_000, 2).otherwise(1)).alias("support"))
    return x.where("support >= 4 and n > 1")


@query("G06", f"WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS ev, l_partkey AS ps FROM lineitem), m AS (SELECT ev, min(ps) AS lo FROM s GROUP BY ev), l AS (SELECT ps AS a, lo AS b FROM s JOIN m ON s.ev = m.ev UNION SELECT lo, ps FROM s JOIN m ON s.ev = m.ev), {_REACH} SELECT node AS l_partkey, component AS joined FROM g")
def phase_sets(spark, sf):
    return graph.phase_sets(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


# ---------------------------------------------------------------- sequences, vectors, partners

@query("X15 X16", """SELECT rec_id, reverse(translate(alt, 'ACGTUacgtu', 'TGCAAtgcaa')) AS revcomp, round(CASE WHEN length(regexp_replace(upper(alt), '[^ACGT]', '', 'g')) > 0 THEN 100.0 * length(regexp_replace(upper(alt), '[^GC]', '', 'g')) / length(regexp_replace(upper(alt), '[^ACGT]', '', 'g')) END, 6) AS gc FROM (SELECT DISTINCT rec_id, alt FROM vcf_records) WHERE regexp_matches(alt, '^[ACGTNacgtn]+$')""")
def sequence_stats(spark, sf):
    v = table(spark, sf, "vcf_records").select("rec_id", "alt").dropDuplicates(["rec_id"]).where(F.col("alt").rlike("^[ACGTNacgtn]+$"))
    return v.select("rec_id", cg.reverse_complement("alt").alias("revcomp"), F.round(cg.gc_percent("alt"), 6).alias("gc"))


def _contig_a():
    return F.regexp_extract("info", "(?:^|;)\\s*CONTIGA=([ACGTNacgtn]+)", 1)


def _contigs(spark, sf) -> DataFrame:
    v = table(spark, sf, "vcf_records").select("rec_id", "info").dropDuplicates(["rec_id"])
    return v.select("rec_id", _contig_a().alias("contig")).where("contig <> ''")


@query("W04", """WITH c AS (SELECT DISTINCT rec_id, regexp_extract(info, '(?:^|;)\\s*CONTIGA=([ACGTNacgtn]+)', 1) AS s FROM vcf_records), k AS (SELECT rec_id, s, length(s) - 5 AS n FROM c WHERE length(s) >= 6), p AS (SELECT rec_id, n, unnest(range(1, n + 1)) AS i, s FROM k), m AS (SELECT rec_id, n, i, s[i:i + 5] AS mer FROM p),
w AS (SELECT rec_id, i, n, mer, min(mer) OVER (PARTITION BY rec_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS least_mer FROM m) SELECT DISTINCT rec_id, least_mer AS mer FROM w UNION SELECT rec_id, mer FROM w WHERE i = n""")
def minimizers(spark, sf):
    return _contigs(spark, sf).select("rec_id", F.explode(pairs.minimizers("contig", hashed=False)).alias("mer"))


def _minimizer_edges(spark, sf, star: bool) -> DataFrame:
    v = table(spark, sf, "vcf_records").where("rec_id is not null").select("rec_id", "chrom", "pos", _contig_a().alias("contig")).dropDuplicates(["rec_id"]).where("contig <> ''")
    c = v.select("rec_id", "chrom", "pos", pairs.minimizers("contig").alias("mins"))
    return pairs.minimizer_edges(c, ["chrom"], "rec_id", "pos", "mins", apart=150, star=star)


_MERS = """c AS (SELECT DISTINCT rec_id, regexp_extract(info, '(?:^|;)\\s*CONTIGA=([ACGTNacgtn]+)', 1) AS s FROM vcf_records), k AS (SELECT rec_id, s, length(s) - 5 AS n FROM c WHERE length(s) >= 6), p AS (SELECT rec_id, n, unnest(range(1, n + 1)) AS i, s FROM k), m AS (SELECT rec_id, n, i, s[i:i + 5] AS mer FROM p),
w AS (SELECT rec_id, i, n, mer, min(mer) OVER (PARTITION BY rec_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS least_mer FROM m), d AS (SELECT DISTINCT rec_id, least_mer AS mer FROM w UNION SELECT rec_id, mer FROM w WHERE i = n)"""


@query("J04", f"""WITH {_MERS}, z AS (SELECT rec_id, count(*) AS z FROM d GROUP BY rec_id), v AS (SELECT rec_id, min(chrom) AS chrom, min(pos) AS pos FROM vcf_records GROUP BY rec_id), x AS (SELECT d.rec_id, mer, chrom, pos, z FROM d JOIN z ON d.rec_id = z.rec_id JOIN v ON d.rec_id = v.rec_id)
SELECT a.rec_id AS src, b.rec_id AS dst, count(*) AS shared FROM x a JOIN x b ON a.chrom = b.chrom AND a.mer = b.mer AND a.rec_id < b.rec_id AND abs(a.pos - b.pos) < 150 GROUP BY 1, 2 HAVING least(max(a.z), max(b.z)) / 2 + count(*) >= 2""")
def minimizer_text_pairs(spark, sf):
    """minimizer_pairs with minimizers by the order of their text, which SQL can follow."""
    v = table(spark, sf, "vcf_records").select("rec_id", "chrom", "pos").dropDuplicates(["rec_id"]).join(_contigs(spark, sf), "rec_id")
    c = v.select("rec_id", "chrom", "pos", pairs.minimizers("contig", hashed=False).alias("mins"))
    return pairs.minimizer_edges(c, ["chrom"], "rec_id", "pos", "mins", apart=150)


@query("J04 X26")
def minimizer_pairs(spark, sf):
    """All pairs of contigs that qualify."""
    return _minimizer_edges(spark, sf, False)


@query("J04")
def minimizer_partners(spark, sf):
    """The five best partners of each contig, as a ranking."""
    return pairs.best_partners(minimizer_pairs(spark, sf))


@query("X16", """WITH c AS (SELECT DISTINCT rec_id, upper(regexp_extract(info, '(?:^|;)\\s*CONTIGA=([ACGTNacgtn]+)', 1)) AS s FROM vcf_records), p AS (SELECT rec_id, s, unnest(range(2, 7)) AS k FROM c WHERE s <> ''), q AS (SELECT rec_id, k, s, unnest(range(1, length(s) - k + 2)) AS i FROM p WHERE length(s) >= k),
w AS (SELECT rec_id, k, i, i - lag(i) OVER (PARTITION BY rec_id, k, s[i:i + k - 1] ORDER BY i) AS far FROM q), m AS (SELECT rec_id, k, sum(CASE WHEN far IS NOT NULL THEN exp(-(far - 1) / 10.0) ELSE 0 END) / count(*) AS m FROM w GROUP BY 1, 2) SELECT c.rec_id, round(coalesce(avg(m), 0), 6) AS repeat FROM c LEFT JOIN m ON c.rec_id = m.rec_id WHERE s <> '' GROUP BY c.rec_id""")
def repeat_scores(spark, sf):
    from ..functions.sequence import udfs

    return _contigs(spark, sf).select("rec_id", F.round(udfs()["repeat_score"]("contig"), 6).alias("repeat"))


@query("X16 X17 X18")
def contig_repeats(spark, sf):
    from ..functions.sequence import udfs

    u = udfs()
    c = _contigs(spark, sf)
    return c.select("rec_id", F.round(u["repeat_score"]("contig"), 6).alias("repeat"), F.round(u["packed_percent"]("contig"), 6).alias("packed"), u["repeat_motif"]("contig").alias("motif"), u["repeat_bases"]("contig").alias("motif_bases"))


@query("J10 X19 X20 X21 M03")
def contig_pair_match(spark, sf):
    """Contigs of calls within 150 bases that share minimizers, aligned: cheap join first, alignment on what is left."""
    from ..functions.sequence import udfs

    e = minimizer_pairs(spark, sf)
    c = _contigs(spark, sf)
    j = e.join(c.select(F.col("rec_id").alias("src"), F.col("contig").alias("ca")), "src").join(c.select(F.col("rec_id").alias("dst"), F.col("contig").alias("cb")), "dst")
    u = udfs()
    return j.select("src", "dst", "shared", u["local_score"]("ca", "cb").alias("score"), u["infix_distance"]("ca", "cb").alias("edits"), u["contigs_match"]("ca", "cb").alias("same"))


_VEC = "[CAST(coalesce(su, 0) AS DOUBLE), CAST(coalesce(ci, 0) AS DOUBLE), coalesce(prob, 0), CAST(coalesce(svlen, 0) AS DOUBLE)]"


@query("J22", f"""WITH {_C}, n AS (SELECT c.*, tissue FROM c JOIN samples s ON c.sample_name = s.sample_name WHERE svtype IS NOT NULL), p AS (SELECT a.call_id AS a, b.call_id AS b, round(coalesce(list_cosine_similarity({_VEC.replace('su', 'a.su').replace('ci', 'a.ci').replace('prob', 'a.prob').replace('svlen', 'a.svlen')}, {_VEC.replace('su', 'b.su').replace('ci', 'b.ci').replace('prob', 'b.prob').replace('svlen', 'b.svlen')}), 0), 9) AS score
FROM n a JOIN n b ON a.tissue = 'tumour' AND b.tissue = 'normal' AND a.chrom = b.chrom AND a.svtype = b.svtype AND b.pos BETWEEN a.pos - 500 AND a.pos + 500), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rb FROM p WHERE score > 0.8 AND NOT isnan(score)) SELECT a, b, round(score, 6) AS score FROM k WHERE ra = 1 AND rb = 1""")
def cosine_mutual_best(spark, sf):
    s = table(spark, sf, "samples").select("sample_name", "tissue")
    n = calls(spark, sf, "svtype is not null").join(F.broadcast(s), "sample_name")
    vec = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("su", "ci", "prob", "svlen")))
    a = n.where("tissue = 'tumour'").select(F.col("call_id").alias("a"), F.col("chrom").alias("ac"), F.col("svtype").alias("at"), F.col("pos").alias("ap"), vec.alias("av"))
    b = n.where("tissue = 'normal'").select(F.col("call_id").alias("b"), F.col("chrom").alias("bc"), F.col("svtype").alias("bt"), F.col("pos").alias("bp"), vec.alias("bv"))
    p = intervals.range_join(a, b, [("ac", "bc"), ("at", "bt")], (F.col("ap") - 500, F.col("ap") + 500), ("bp", "bp"), 1024)
    p = p.select("a", "b", F.round(pairs.cosine(F.col("av"), F.col("bv")), 9).alias("score"))
    return pairs.mutual_best(p, "a", "b", "score", 0.8).withColumn("score", F.round("score", 6))


@query("U04", """WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS v FROM lineitem GROUP BY 1), t AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS u FROM lineitem GROUP BY 1)
SELECT s.l_orderkey, round(len(list_intersect(v, u)) / nullif(len(list_distinct(list_concat(v, u))), 0), 6) AS jaccard FROM s JOIN t ON s.l_orderkey = t.l_orderkey""")
def jaccard_sets(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("v"), F.collect_set("l_suppkey").alias("u"))
    return s.select("l_orderkey", F.round(pairs.jaccard("v", "u"), 6).alias("jaccard"))


@query("K03 J27", P3_SQL.strip().replace("SELECT row_id, CAST(row_number()", ", q AS (SELECT row_id, CAST(row_number()").rstrip() + ") SELECT row_id, string_agg(partner_table || ',' || partner_event_id, '|' ORDER BY item_no) AS partners FROM q GROUP BY row_id")
def partner_csv(spark, sf):
    """Partners of the merged events, parsed and written again in one form."""
    from ..operators.packed import partners

    p = partners(table(spark, sf, "merged_events"))
    g = p.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("item_no", F.col("partner_table").alias("table"), F.col("partner_event_id").alias("event")))).alias("a"))  # the partners of one row
    return g.select("row_id", sink.partner_text(F.transform("a", lambda x: F.struct(x["table"].alias("table"), x["event"].alias("event")))).alias("partners"))


@query("J27", P3_SQL.strip().replace("SELECT row_id, CAST(row_number()", ", q AS (SELECT row_id, CAST(row_number()").rstrip() + f") SELECT row_id, item_no, partner_sample, partner_type FROM q JOIN (SELECT table_name, event_id, min(sample_name) AS partner_sample, min(CASE WHEN {SQL_TYPE('svtype')} IN ('DEL', 'INS', 'DUP', 'INV', 'TRA', 'BND') THEN {SQL_TYPE('svtype')} END) AS partner_type FROM merged_events GROUP BY 1, 2) e ON e.table_name = partner_table AND e.event_id = partner_event_id")
def partner_events(spark, sf):
    """Every partner looked up among the events: row_id, item_no and the partner's sample and type."""
    from ..operators.packed import partners

    m = table(spark, sf, "merged_events")
    own = m.select(F.col("table_name").alias("partner_table"), F.col("event_id").alias("partner_event_id"), F.col("sample_name").alias("partner_sample"), sv_type("svtype").alias("partner_type")).dropDuplicates(["partner_table", "partner_event_id"])
    return partners(m).join(own, ["partner_table", "partner_event_id"]).select("row_id", "item_no", "partner_sample", "partner_type")


@query("U03", """WITH s AS (SELECT table_name, count(DISTINCT sample_name) AS n_samples, min(sample_name) AS first_sample, count(DISTINCT row_id) AS n FROM merged_events GROUP BY table_name) SELECT table_name, n_samples, first_sample, n FROM s""")
def table_samples(spark, sf):
    m = table(spark, sf, "merged_events")
    return m.groupBy("table_name").agg(F.count_distinct("sample_name").alias("n_samples"), F.min("sample_name").alias("first_sample"), F.count_distinct("row_id").alias("n"))


@query("W06", f"""WITH {_C}, o AS (SELECT call_id, chrom, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos, call_id) > 1000 THEN 1 ELSE 0 END AS cut FROM c), b AS (SELECT chrom, pos, call_id, sum(cut) OVER (PARTITION BY chrom ORDER BY pos, call_id ROWS UNBOUNDED PRECEDING) AS blob FROM o) SELECT chrom, min(pos) AS first_pos, count(*) AS n, min(call_id) AS first_call FROM b GROUP BY chrom, blob""")
def safe_shards(spark, sf):
    c = calls(spark, sf).select("call_id", "chrom", F.col("pos").alias("s"), (F.col("pos") + 1000).alias("e"))
    b = intervals.island_starts(c, ["chrom"], "s", "e", "first_pos")
    return b.groupBy("chrom", "first_pos").agg(F.count(F.lit(1)).alias("n"), F.min("call_id").alias("first_call"))


@query("J23", f"""WITH RECURSIVE {_SITES}, {_C}, p AS (SELECT call_id, site_id, abs(pos - s) AS distance, row_number() OVER (ORDER BY abs(pos - s), call_id, site_id) AS k FROM c JOIN u ON c.chrom = u.chrom AND s BETWEEN pos - 20000 AND pos + 20000),
w(k, calls, sites, hit) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), false UNION ALL SELECT p.k, CASE WHEN free THEN list_append(calls, z.call_id) ELSE calls END, CASE WHEN free THEN list_append(sites, z.site_id) ELSE sites END, free
  FROM (SELECT w.*, q.call_id, q.site_id, q.k AS nk, NOT list_contains(calls, q.call_id) AND NOT list_contains(sites, q.site_id) AS free FROM w JOIN p q ON q.k = w.k + 1) z JOIN p ON p.k = z.nk)
SELECT call_id, site_id, distance FROM w JOIN p ON w.k = p.k WHERE hit""")
def greedy_sites(spark, sf):
    return pairs.assign_nearest(calls(spark, sf), sites(spark, sf), ["chrom"], "call_id", "pos", "site_id", "s", 20_000)


@query("S04", f"""WITH {_R}, d AS (SELECT rname AS chrom, CAST(pos AS BIGINT) AS p FROM r WHERE flag & 1284 = 0 AND flag & 1 <> 0 AND flag & 2 = 0 AND rname <> '*' UNION ALL SELECT CASE WHEN rnext = '=' THEN rname ELSE rnext END, CAST(pnext AS BIGINT) FROM r WHERE flag & 1284 = 0 AND flag & 1 <> 0 AND flag & 2 = 0 AND rname <> '*' AND pnext > 0),
v AS (SELECT chrom, greatest(0, p - 1000) AS s, p + 1000 AS e, row_number() OVER () AS rn FROM d), o AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e, rn ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT chrom, min(s) AS s, max(e) AS e, count(*) AS n_merged FROM i GROUP BY chrom, g""")
def mate_regions(spark, sf):
    r = reads(spark, sf, "flag", "rname", "rnext", "pos", "pnext", where=(F.col("flag").bitwiseAND(1284) == 0) & cg.flag(1) & ~cg.flag(2) & (F.col("rname") != "*"))
    own = r.select(F.col("rname").alias("chrom"), F.col("pos").cast("long").alias("s"))
    mate = r.where("pnext > 0").select(F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext")).alias("chrom"), F.col("pnext").cast("long").alias("s"))
    x = own.unionByName(mate).withColumn("e", F.col("s"))
    return intervals.merge_intervals(x, ["chrom"], "s", "e", pad=1000)


# ---------------------------------------------------------------- calling

_SIDES = f"""sd AS (SELECT read_id, qname, rname, flag, CAST(pos AS BIGINT) AS pos, CAST(pos + {_REF} AS BIGINT) AS stop, CASE WHEN flag & 16 <> 0 THEN '5' ELSE '3' END AS st, {_CLIP_L('SH')} AS lc, {_CLIP_R('SH')} AS rc FROM r)"""
_TOP = "arg_max(read_id, read_id) FILTER (WHERE {0})".format
_PICK = f"""k AS (SELECT qname, {_TOP('flag & 64 <> 0 AND flag & 2304 = 0')} AS p1, {_TOP('flag & 64 <> 0 AND flag & 2304 <> 0')} AS s1, {_TOP('flag & 64 = 0 AND flag & 2304 = 0')} AS p2, {_TOP('flag & 64 = 0 AND flag & 2304 <> 0')} AS s2 FROM sd GROUP BY qname),
pk AS (SELECT qname, CASE WHEN p1 IS NOT NULL AND s1 IS NOT NULL THEN p1 WHEN p2 IS NOT NULL AND s2 IS NOT NULL THEN p2 WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN p1 END AS x, CASE WHEN p1 IS NOT NULL AND s1 IS NOT NULL THEN s1 WHEN p2 IS NOT NULL AND s2 IS NOT NULL THEN s2 WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN p2 END AS y FROM k),
pp AS (SELECT pk.qname, CASE WHEN a.pos < b.pos THEN x ELSE y END AS a, CASE WHEN a.pos < b.pos THEN y ELSE x END AS b FROM pk JOIN sd a ON a.read_id = x JOIN sd b ON b.read_id = y)"""


@query("J25 G08", f"WITH {_R}, {_SIDES}, {_PICK} SELECT qname, a, b FROM pp")
def informative_pairs(spark, sf):
    from ..operators import calling

    return calling.informative_pairs(reads(spark, sf, "qname", "flag", "pos"), "qname", "read_id")


@query("X35 J21", f"""WITH {_R}, {_SIDES}, {_PICK}, j AS (SELECT pp.qname, a.pos AS pa, a.stop AS ea, a.st AS sa, a.lc AS la, a.rc AS ra, b.pos AS pb, b.stop AS eb, b.st AS sb, b.lc AS lb, b.rc AS rb, a.pos < b.pos OR (a.pos = b.pos AND a.stop <= b.stop) AS f
  FROM pp JOIN sd a ON a.read_id = pp.a JOIN sd b ON b.read_id = pp.b WHERE a.rname = b.rname AND a.flag & 2304 = 0 AND b.flag & 2304 = 0)
SELECT qname, CASE WHEN (f AND sa = '3' AND sb = '5') OR (NOT f AND sa = '5' AND sb = '3') THEN CASE WHEN CASE WHEN f THEN ea >= pb ELSE eb >= pa END THEN 'INS' ELSE 'DEL' END WHEN sa <> sb THEN 'DUP' ELSE 'INV' END AS svtype,
CASE WHEN (f AND sa = '3' AND sb = '5') OR (NOT f AND sa = '5' AND sb = '3') THEN CASE WHEN f THEN ea ELSE pa END WHEN sa <> sb THEN CASE WHEN f THEN pa ELSE ea END WHEN sa = '5' THEN CASE WHEN (ra > 0 OR rb > 0) AND la = 0 AND lb = 0 THEN ea ELSE pa END
 ELSE CASE WHEN (la > 0 OR lb > 0) AND ra = 0 AND rb = 0 AND (NOT f OR NOT (lb > 0 AND pa < pb)) THEN pa ELSE ea END END AS break_a FROM j""")
def pair_types(spark, sf):
    """Type and first break of the templates whose two primaries lie on one chromosome."""
    from ..operators import calling

    r = reads(spark, sf, "qname", "flag", "pos", "rname", "cigar")
    p = calling.classified_pairs(r, "qname", "read_id").where("chrom_a = chrom_b")
    primary = r.where(F.col("flag").bitwiseAND(2304) == 0).select("read_id")
    return p.join(primary.withColumnRenamed("read_id", "a"), "a", "left_semi").join(primary.withColumnRenamed("read_id", "b"), "b", "left_semi").select("qname", "svtype", "break_a")


@query("X35 J21")
def classified_pairs(spark, sf):
    """Every informative pair whose two ends have a place, with all that its rule tells: over two chromosomes (TRA) and read with supplementary too."""
    from ..operators import calling

    r = reads(spark, sf, "qname", "flag", "pos", "rname", "cigar", where=~cg.flag(4) & (F.col("rname") != "*"))
    return calling.classified_pairs(r, "qname", "read_id")


@query("A21 A06 A07 P01 P03 F10 J01 J02 J03 J04 J05 M01")
def called_events(spark, sf):
    """The whole calling pipeline over the alignments, each sample by itself; a read without a sample name has that of its template."""
    from .config import Options
    from .pipelines import call, fetch

    r = reads(spark, sf, "sample_name", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "sa")
    named = r.groupBy("qname").agg(F.min("sample_name").alias("__named"))
    r = r.join(named, "qname", "left").withColumn("sample_name", F.coalesce("sample_name", "__named")).drop("__named")
    ev, track = fetch(materialize(r), Options.of(min_support=2), by="sample_name")
    return call(materialize(ev), materialize(track), Options.of(min_support=2), by="sample_name").select("sample", "chrom", "pos", "chr2", "end_pos", "svtype", "svlen", "su", "gt", "gq", "prob", "filt")


@query("A18", f"""WITH {_R}, {_S}, {_T}, {_C}, b AS (SELECT call_id, chrom, pos // 10 AS b FROM c WHERE pos IS NOT NULL), e AS (SELECT rname, depth, unnest(range(bin, to_bin)) AS x FROM t),
n AS (SELECT call_id, CAST(depth AS DOUBLE) AS d, row_number() OVER (PARTITION BY call_id ORDER BY x DESC) AS nth FROM b JOIN e ON chrom = rname AND x <= b AND x > b - 400), near AS (SELECT * FROM n WHERE nth <= 15),
f AS (SELECT call_id, quantile_cont(d, 0.02) AS floor_ FROM near GROUP BY call_id), h AS (SELECT near.call_id, d FROM near JOIN f ON near.call_id = f.call_id WHERE floor_ <= 0.5 OR d >= floor_)
SELECT call_id, count(*) AS n, round(avg(d), 6) AS mean, round(CASE WHEN count(*) > 1 AND avg(d) > 0 THEN sqrt(greatest(0, avg(d * d) - avg(d) * avg(d))) / avg(d) ELSE 0 END, 6) AS cv FROM h GROUP BY call_id""")
def directional_depth(spark, sf):
    from ..operators import calling

    track = depth.depth_track(spans(spark, sf), "rname", "start", "stop").withColumnRenamed("rname", "chrom")
    c = calls(spark, sf, "pos is not null")
    d = calling.directional_depth(c, track, "chrom", "call_id", "pos", F.lit(True), 15)
    return d.select("call_id", "n", F.round("mean", 6).alias("mean"), F.round("cv", 6).alias("cv"))


_WALK = f"""wo AS (SELECT read_id, pos, unnest({_LIST}) AS x, generate_subscripts({_LIST}, 1) AS i FROM r), ww AS (SELECT read_id, pos, i, right(x, 1) AS op, CAST(x[:-2] AS BIGINT) AS len FROM wo),
wp AS (SELECT read_id, op, len, pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ref_start FROM ww)"""
_CLOSE = "abs({0} - ({1})) <= 500".format
_MIN, _MAX = "least(start, pnext)", "greatest(start, pnext)"


@query("J14", f"""WITH {_R}, {_S}, {_C}, {_SA}, {_WALK}, cc AS (SELECT * FROM c WHERE svtype IS NOT NULL), v AS (SELECT call_id, chrom AS vc, pos AS vp FROM cc UNION SELECT call_id, chr2, end_pos FROM cc), near AS (SELECT DISTINCT call_id, read_id FROM v JOIN s ON vc = rname AND start <= vp + 500 AND stop >= vp - 500 WHERE flag & 1540 = 0),
x AS (SELECT cc.call_id, cc.chrom, cc.pos, cc.chr2, cc.end_pos, cc.svtype, cc.svlen, s.read_id, s.start, s.stop, s.flag, s.mapq, s.pnext, s.rnext FROM near JOIN cc ON near.call_id = cc.call_id JOIN s ON near.read_id = s.read_id),
j AS (SELECT *, EXISTS (SELECT 1 FROM p WHERE p.read_id = x.read_id AND len(a) = 6 AND ((a[1] = x.chr2 AND {_CLOSE("TRY_CAST(a[2] AS INTEGER)", "x.end_pos")} AND ({_CLOSE("x.start", "x.pos")} OR {_CLOSE("x.stop", "x.pos")})) OR (a[1] = x.chrom AND {_CLOSE("TRY_CAST(a[2] AS INTEGER)", "x.pos")} AND ({_CLOSE("x.start", "x.end_pos")} OR {_CLOSE("x.stop", "x.end_pos")})))) AS supp,
  svtype <> 'INS' AND rnext = '=' AND flag & 10 = 0 AND {_CLOSE(_MIN, "pos")} AND {_CLOSE(_MAX, "end_pos")} AND greatest(1, abs((pos + end_pos) / 2 - ({_MIN} + {_MAX}) / 2)) / greatest(1, abs(end_pos - pos), abs({_MAX} - {_MIN})) < 20
   AND abs(greatest(1, abs(end_pos - pos)) - greatest(1, abs({_MAX} - {_MIN}))) / greatest(1, abs(end_pos - pos), abs({_MAX} - {_MIN})) < 0.75 AS mate,
  rnext <> '=' AND rnext = chr2 AND chrom <> chr2 AND {_CLOSE("start", "pos")} AND {_CLOSE("pnext", "end_pos")} AS over_,
  svtype IN ('INS', 'DEL') AND EXISTS (SELECT 1 FROM wp WHERE wp.read_id = x.read_id AND wp.op = CASE WHEN x.svtype = 'INS' THEN 'I' ELSE 'D' END AND {_CLOSE("wp.ref_start", "x.pos")} AND least(wp.len, x.svlen) > 0.75 * greatest(wp.len, x.svlen) AND x.svlen IS NOT NULL) AS gap, start <= pos - 10 AND stop >= pos + 10 AS cover FROM x)
SELECT call_id, bool_or(coalesce(supp, false) OR coalesce(mate, false) OR coalesce(over_, false) OR coalesce(gap, false)) AS normal, CAST(count_if(cover) AS BIGINT) AS covering, CAST(count_if(cover AND mapq = 0) AS BIGINT) AS mapq0 FROM j GROUP BY call_id""")
def normal_evidence(spark, sf):
    """Whether any read near a call tells the same event."""
    from ..operators import calling

    c = calls(spark, sf).select("call_id", "chrom", "pos", "chr2", "end_pos", "svtype", "svlen").where("svtype is not null")
    s = spans(spark, sf, "rnext", "pnext", "sa")
    x = pairs.reads_near(c, s, "call_id", "read_id", 500).join(c, "call_id").join(s.drop("pos"), "read_id")
    return calling.matching_evidence(x, "call_id", 500)


@query("M01 F21", f"""WITH {_C} SELECT call_id, round(1 / (1 + exp(-(-1.6 + 0.18 * coalesce(su, 0)))), 3) AS score, CASE WHEN round(1 / (1 + exp(-(-1.6 + 0.18 * coalesce(su, 0)))), 3) >= CASE WHEN svtype IS NULL THEN 0.5 ELSE 0.45 END THEN 'PASS' ELSE 'lowProb' END AS label FROM c""")
def scored_calls(spark, sf):
    from ..operators.calling import Scorer

    s = Scorer(weights={"su": 0.18})
    c = calls(spark, sf)
    return c.withColumn("score", s.prob(c)).select("call_id", "score", s.label(F.col("score"), F.coalesce("svtype", F.lit(""))).alias("label"))


@query("K07 S02", f"WITH {_R}, {_S} SELECT count(*) AS n_reads, CAST(sum({_ALIGNED}) AS BIGINT) AS n_aligned_bases FROM s")
def run_figures(spark, sf):
    return sink.run_figures(spans(spark, sf), cg.aligned_bases("cigar"))


@query("X13 X27", f"""WITH {_C}, v AS (SELECT DISTINCT rec_id, alt FROM vcf_records WHERE regexp_matches(alt, '^[ACGTN]+$')), j AS (SELECT call_id, svtype, pos, svlen, alt FROM c JOIN v ON call_id = rec_id)
SELECT call_id, CASE WHEN svtype = 'INS' THEN pos + 1 ELSE pos + svlen END AS end_in_read, CASE WHEN svtype = 'DEL' AND svlen < 50000 AND length(alt) > 1 THEN alt ELSE alt[1] END AS ref_allele,
CASE WHEN svtype = 'DEL' AND svlen < 50000 AND length(alt) > 1 THEN alt[1] ELSE '<' || svtype || '>' END AS alt_allele FROM j WHERE svtype IS NOT NULL AND svlen IS NOT NULL""")
def literal_alleles(spark, sf):
    """REF and ALT written out or symbolic, and the end an event has inside a read."""
    from ..operators.calling import reference_allele

    v = table(spark, sf, "vcf_records").select(F.col("rec_id").alias("call_id"), F.col("alt").alias("bases")).where(F.col("bases").rlike("^[ACGTN]+$")).dropDuplicates(["call_id"])
    c = calls(spark, sf, "svtype is not null and svlen is not null").join(v, "call_id")
    ref, alt = reference_allele(F.col("svtype"), F.col("bases"), F.col("svlen"))
    return c.select("call_id", cg.end_position("svtype", "pos", "svlen").alias("end_in_read"), ref.alias("ref_allele"), alt.alias("alt_allele"))


@query("X14", """SELECT rec_id, substring(alt, greatest(0, length(alt) // 2 - 5) + 1, least(length(alt), length(alt) // 2 + 5) - greatest(0, length(alt) // 2 - 5)) AS part FROM (SELECT DISTINCT rec_id, alt FROM vcf_records) WHERE regexp_matches(alt, '^[ACGTNacgtn]+$')""")
def around_middle(spark, sf):
    from ..operators.calling import around_event

    v = table(spark, sf, "vcf_records").select("rec_id", "alt").dropDuplicates(["rec_id"]).where(F.col("alt").rlike("^[ACGTNacgtn]+$"))
    return v.select("rec_id", around_event(F.col("alt"), F.expr("cast(length(alt) div 2 as int)"), 5).alias("part"))


@query("J26 X12", f"""WITH {_R}, {_SIDES}, {_PICK}, j AS (SELECT pp.qname, a.rname AS ca, b.rname AS cb, a.flag AS fa, b.flag AS fb, a.pos AS pa, a.stop AS ea, a.lc AS la, a.rc AS ra, b.pos AS pb, b.stop AS eb FROM pp JOIN sd a ON a.read_id = pp.a JOIN sd b ON b.read_id = pp.b)
SELECT qname, fa & 1 <> 0 AND fa & 8 = 0 AND ca = cb AND fa & 64 = fb & 64 AND greatest(pa, pb) <= least(ea, eb) AS overlaps, CAST(CASE WHEN (ra > la OR (ra = la AND pa <= pb)) AND ra > 0 THEN 0 ELSE la END AS INTEGER) AS left_kept,
CAST(CASE WHEN NOT (ra > la OR (ra = la AND pa <= pb)) AND la > 0 THEN 0 ELSE ra END AS INTEGER) AS right_kept FROM j""")
def mate_overlap(spark, sf):
    """Whether the pair of a template overlaps itself, and the one clip of its first side that is kept."""
    from ..functions import labels
    from ..operators import calling

    r = reads(spark, sf, "qname", "flag", "pos", "rname", "cigar")
    s = r.select("read_id", "rname", "flag", labels.side().alias("side"))
    p = calling.informative_pairs(r, "qname", "read_id")
    a = s.select(F.col("read_id").alias("a"), F.col("rname").alias("ca"), F.col("flag").alias("fa"), F.col("side").alias("sa"))
    b = s.select(F.col("read_id").alias("b"), F.col("rname").alias("cb"), F.col("flag").alias("fb"), F.col("side").alias("sb"))
    j = p.join(a, "a").join(b, "b")
    kept, _ = labels.masked_clips(F.col("sa"), F.col("sb"))
    return j.select("qname", labels.overlaps_mate(*(F.col(x) for x in ("sa", "sb", "ca", "cb", "fa", "fb"))).alias("overlaps"), kept["left"].alias("left_kept"), kept["right"].alias("right_kept"))


@query("S09 P04", f"""WITH v AS (SELECT DISTINCT rec_id, chrom, pos, filt, info FROM vcf_records), t AS (SELECT rec_id, chrom, pos - 1 AS pos, filt, {_ITEM('SVTYPE', 8)} AS svtype, TRY_CAST({_ITEM('END', 5)} AS BIGINT) - 1 AS e, TRY_CAST({_ITEM('SVLEN', 7)} AS BIGINT) AS svlen, TRY_CAST({_ITEM('MeanPROB', 10)} AS DOUBLE) AS p FROM v WHERE filt = 'PASS')
SELECT rec_id, chrom, least(pos, coalesce(e, pos)) AS start_pos, greatest(pos, coalesce(e, pos)) AS end_pos, CASE WHEN starts_with(upper(svtype), 'DUP') THEN 'DUP' ELSE upper(svtype) END AS svtype, abs(svlen) AS svlen, coalesce(p, 0.6) AS prob FROM t""")
def site_list(spark, sf):
    """Records that pass, as a list of sites on their own chromosome."""
    v = table(spark, sf, "vcf_records").select("rec_id", "chrom", "pos", "filt", "info").dropDuplicates(["rec_id"])
    t = vcf.typed(v.where("filt = 'PASS'"), "info", keys=["SVTYPE", "END", "SVLEN", "MeanPROB"]).withColumn("svtype", F.nullif("svtype", F.lit("")))
    e = t.select(F.col("rec_id").alias("id"), "chrom", F.col("chrom").alias("chr2"), (F.col("pos") - 1).alias("pos"), F.coalesce(F.col("end_pos") - 1, F.col("pos") - 1).alias("end_pos"), gtp.event_type("svtype", "chrom", "chrom").alias("svtype"), "svlen", "filt", "mean_prob", F.lit(None).cast("double").alias("prob"))
    s = vcf.sites_of(e)
    return s.select(F.col("id").alias("rec_id"), "chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "svtype", "svlen", "prob")


@query("G05")
def forbidden_cuts(spark, sf):
    """Links between calls of like events, cut so that no two calls of one sample stay together in a small component."""
    e = _merge_pairs(spark, sf)
    comp = graph.connected_components(e)
    s = calls(spark, sf).select("call_id", "sample_name").join(comp, F.col("call_id") == F.col("node"))
    w = W.partitionBy("component", "sample_name").orderBy("node")
    banned = s.select(F.lag("node").over(w).alias("src"), F.col("node").alias("dst")).where("src is not null")
    return graph.cut_forbidden(e, banned)


@query("G07")
def cluster_consensus(spark, sf):
    """Consensus of the contigs of records that share minimizers at one place."""
    comp = graph.connected_components(_minimizer_edges(spark, sf, True))
    return consensus_by_component(_contigs(spark, sf).join(comp, F.col("rec_id") == F.col("node")).select("component", "contig"))


_FOLD = "list_reduce({0}, lambda acc, x: {{t: CASE WHEN acc.o AND abs(x.s - home) <= least(3 * acc.t, ln(1 + acc.t) / ln(2) / 0.02) AND x.n > 3 THEN acc.t + x.n ELSE acc.t END, o: acc.o AND abs(x.s - home) <= least(3 * acc.t, ln(1 + acc.t) / ln(2) / 0.02)}}, {{t: {1}, o: true}}).t".format


@query("W09", f"""WITH {_R}, o AS (SELECT read_id, pos, unnest({_LIST}) AS x, generate_subscripts({_LIST}, 1) AS i FROM r), w AS (SELECT read_id, pos, i, right(x, 1) AS op, CAST(x[:-2] AS BIGINT) AS len FROM o),
p AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w),
g AS (SELECT read_id, list({{s: CAST(s AS BIGINT), n: len}} ORDER BY i) AS g FROM p WHERE op IN ('I', 'D') GROUP BY read_id), m AS (SELECT read_id, g, list_max(list_transform(g, lambda x: x.n)) AS longest FROM g),
k AS (SELECT *, list_position(list_transform(g, lambda x: x.n), longest) AS k FROM m), y AS (SELECT *, g[k].s AS home, list_reverse(g[1:k - 1]) AS lo, g[k + 1:] AS hi FROM k), z AS (SELECT *, {_FOLD('lo', 'longest')} AS t1 FROM y)
SELECT read_id, longest, {_FOLD('hi', 't1')} AS extended FROM z""")
def gap_extension(spark, sf):
    """Length of the longest in-read gap of each read with its neighbouring gaps added."""
    r = reads(spark, sf, "cigar", "pos", where=F.col("cigar").rlike("[ID]"))
    g = F.filter(cg.walk("cigar", "pos"), lambda x: x["op"].isin("I", "D"))
    x = r.select("read_id", F.transform(g, lambda x: F.struct(x["ref_start"].alias("s"), x["len"].cast("long").alias("n"))).alias("g"))
    return x.select("read_id", F.array_max(F.transform("g", lambda x: x["n"])).alias("longest"), cg.extended_gap(F.col("g"), 3).alias("extended"))


@query("A14", f"""WITH {_R}, {_S}, {_T}, {_C}, w AS (SELECT call_id, svtype, chrom, least(pos, end_pos) AS a, greatest(pos, end_pos) AS b FROM c WHERE chrom = chr2 AND svtype IN ('DEL', 'DUP', 'INV')),
i AS (SELECT call_id, svtype, max(b // 10) - max(a // 10) + 1 AS n, sum((least(b // 10, to_bin - 1) - greatest(a // 10, bin) + 1) * depth) AS s FROM w LEFT JOIN t ON chrom = rname AND bin <= b // 10 AND to_bin > a // 10 GROUP BY 1, 2),
o AS (SELECT call_id, sum((least((b + 1000) // 10, to_bin - 1) - greatest((greatest(0, a - 1000)) // 10, bin) + 1) * depth) AS s, max((b + 1000) // 10) - max((greatest(0, a - 1000)) // 10) + 1 AS n FROM w LEFT JOIN t ON chrom = rname AND bin <= (b + 1000) // 10 AND to_bin > (greatest(0, a - 1000)) // 10 GROUP BY 1)
SELECT i.call_id, round(coalesce(i.s, 0) / i.n, 9) AS inner_cn, round(coalesce(o.s, 0) / o.n, 9) AS outer_cn, round(CASE WHEN svtype = 'DEL' AND coalesce(o.s, 0) > 0 THEN coalesce(i.s, 0) / i.n / (o.s / o.n) WHEN svtype <> 'DEL' AND coalesce(i.s, 0) > 0 THEN coalesce(o.s, 0) / o.n / (i.s / i.n) ELSE 0 END, 9) AS fold_change FROM i JOIN o ON i.call_id = o.call_id""")
def fold_change(spark, sf):
    """Depth inside an event and with 1,000 bases around it, and what the event changes."""
    c = calls(spark, sf, "chrom = chr2 and svtype in ('DEL', 'DUP', 'INV')").select("call_id", "svtype", "chrom", F.least("pos", "end_pos").alias("a"), F.greatest("pos", "end_pos").alias("b"))
    t = depth.depth_track(covered(spark, sf), "rname", "start", "stop").withColumnRenamed("rname", "chrom")
    c = c.withColumn("b1", F.col("b") + 1).withColumn("lo", F.greatest(F.lit(0), F.col("a") - 1000)).withColumn("hi", F.col("b") + 1001)
    x = depth.window_means(c, t, "chrom", ["call_id", "svtype"], {"inner_cn": ("a", "b1"), "outer_cn": ("lo", "hi")}).where("call_id is not null")
    x = x.withColumn("fold_change", depth.fold_change("inner_cn", "outer_cn", "svtype"))
    return x.select("call_id", *(F.round(n, 9).alias(n) for n in ("inner_cn", "outer_cn", "fold_change")))
