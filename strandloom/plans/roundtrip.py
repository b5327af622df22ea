"""Queries that write a test table by a sink and read it again by a source; the SQL is what the table held before.

Files go to the shared checkpoint folder and are removed when the session ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import depth, intervals
from ..session import tables_folder
from ..sinks import files as sink
from ..sources import files, vcf
from .catalog import _C, _CLIP_L, _CLIP_R, _GAP, _R, _S, _SITES, _T, calls, reads, sites, spans
from .config import PRESETS, Options
from .pipelines import EVENTS, as_events
from .problems import table
from .registry import query
from .rules import _EXONS, _exons


def folder(spark: SparkSession, name: str) -> str:
    return f"{tables_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _sam_lines(r: DataFrame) -> DataFrame:
    tags = F.array_compact(F.array(F.when(F.col("nm").isNotNull(), F.concat(F.lit("NM:i:"), F.col("nm").cast("string"))), F.when(F.col("sa").isNotNull(), F.concat(F.lit("SA:Z:"), F.col("sa"))), F.when(F.col("rg").isNotNull(), F.concat(F.lit("RG:Z:"), F.col("rg")))))
    core = [F.coalesce(F.col(c).cast("string"), F.lit("*" if k == "string" else "0")) for c, k in (("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "int"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "int"), ("tlen", "int"), ("seq", "string"))]
    return r.select(F.concat_ws("\t", *core, F.lit("*"), F.concat_ws("\t", tags)).alias("value"))


@query("S01", f"WITH {_R} SELECT coalesce(qname, '*') AS qname, coalesce(flag, 0) AS flag, coalesce(rname, '*') AS rname, coalesce(pos, 0) - 1 AS pos, coalesce(mapq, 0) AS mapq, coalesce(cigar, '*') AS cigar, coalesce(pnext, 0) - 1 AS pnext, coalesce(tlen, 0) AS tlen, nm, rg, sa IS NOT NULL AS split FROM r")
def sam_scan(spark, sf):
    """Every read as a SAM line under a header, read again: positions count from 0."""
    path = folder(spark, "sam")
    head = spark.createDataFrame([("@HD\tVN:1.6",), ("@RG\tID:r\tSM:s",)], "value string")
    head.unionByName(_sam_lines(reads(spark, sf))).write.text(path)
    r = files.read_sam(spark, path)
    return r.select("qname", "flag", "rname", "pos", "mapq", "cigar", "pnext", "tlen", "nm", "rg", F.col("sa").isNotNull().alias("split"))


@query("S17 S16 S15", "SELECT DISTINCT sample_name AS sample FROM samples UNION ALL SELECT sample_name || '_1' FROM samples WHERE sample_name IN (SELECT min(sample_name) FROM samples)")
def sample_names(spark, sf):
    """One SAM header per sample and one more of the first: names from the headers, a repeated name numbered; the files are listed by a pattern."""
    path = folder(spark, "heads")
    s = table(spark, sf, "samples").select("sample_name").distinct()
    s = s.withColumn("file", F.xxhash64("sample_name")).unionByName(s.agg(F.min("sample_name").alias("sample_name")).withColumn("file", F.lit(0).cast("long")))
    s.select("file", F.concat(F.lit("@RG\tID:r\tSM:"), F.col("sample_name")).alias("value")).repartition(1).write.partitionBy("file").text(path)
    found = [f for d in files.list_folders(path) for f in files.expand_paths(f"{d}/part-*", (".txt",))]
    return files.sam_samples(spark, files.sample_paths(found, -1)).select("sample")


@query("S06 S13 K06", f"WITH {_SITES} SELECT chrom, s AS start, e AS \"end\", count(*) AS n FROM u GROUP BY 1, 2, 3")
def bed_scan(spark, sf):
    path = folder(spark, "bed")
    sink.write_bed(sites(spark, sf).select("chrom", "s", "e"), path)
    return files.read_bed(spark, path).groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("n"))


@query("S12 W05", f"WITH {_EXONS}, x AS (SELECT DISTINCT t, chrom, s, e FROM ex), n AS (SELECT t, chrom, e, lead(s) OVER (PARTITION BY t, chrom ORDER BY s, e) AS nx FROM x) SELECT 'c' || chrom AS chrom, 'T' || t AS transcript_id, e AS gap_start, nx AS gap_end FROM n WHERE e < nx")
def gff_introns(spark, sf):
    """Exons written as GFF3 with other features between them, read again, and the introns between them."""
    path = folder(spark, "gff")
    x = _exons(spark, sf)
    row = lambda kind: F.concat_ws("\t", F.concat(F.lit("c"), F.col("chrom")), F.lit("s"), F.lit(kind), (F.col("s") + 1).cast("string"), F.col("e").cast("string"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=x;transcript_id=T"), F.col("t"), F.lit(";gene_name=G"))).alias("value")
    x.select(row("exon")).unionByName(x.select(row("gene"))).write.text(path)
    return intervals.introns(files.read_gff_exons(spark, path), ["chrom", "transcript_id"], "start", "end")


@query("S10 K03", "SELECT DISTINCT event_id, table_name, coalesce(nullif(svtype, ''), NULL) AS svtype, svlen, su FROM (SELECT event_id, table_name, svtype, svlen, su FROM merged_events) WHERE table_name IS NOT NULL")
def csv_scan(spark, sf):
    """Events as CSV, one folder per table of origin, read again with a schema."""
    path = folder(spark, "csv")
    m = table(spark, sf, "merged_events").where("table_name is not null").select("event_id", "table_name", "svtype", "svlen", "su").distinct()
    sink.write_csv(m.withColumn("origin", F.xxhash64("table_name")), path, separate="origin")
    return files.read_event_csv(spark, path, "event_id long, table_name string, svtype string, svlen long, su int").select("event_id", "table_name", "svtype", "svlen", "su")


@query("K04", f"WITH {_R} SELECT read_id, rname, pos FROM r WHERE flag & 1284 = 0 AND (greatest({_CLIP_L('S')}, {_CLIP_R('S')}) >= 15 OR {_GAP} OR (flag & 1 <> 0 AND flag & 2 = 0) OR flag & 2048 <> 0 OR sa IS NOT NULL)")
def staged_reads(spark, sf):
    """Reads with evidence staged by chromosome and read again."""
    from .catalog import _evidence

    path = folder(spark, "staged")
    e = _evidence(reads(spark, sf, "flag", "cigar", "sa", "rname", "pos", where=F.col("flag").bitwiseAND(1284) == 0)).where("clipped or gapped or discordant or supplementary or split")
    sink.stage_reads(e, path)
    return spark.read.schema(e.schema).parquet(path).select("read_id", "rname", "pos")


@query("K05 S14", f"WITH {_R}, {_S}, {_T} SELECT rname AS chrom, CAST(bin AS BIGINT) AS bin, CAST(to_bin AS BIGINT) AS to_bin, CAST(depth AS BIGINT) AS depth FROM t")
def depth_files(spark, sf):
    """The depth track as one binary file per chromosome, read again as runs; runs of one depth that touch were one before."""
    path = folder(spark, "depth").removeprefix("file:")
    track = depth.depth_track(spans(spark, sf), "rname", "start", "stop").withColumnRenamed("rname", "chrom")
    sink.write_depth_bins(track, path).collect()  # one row per chromosome
    return files.read_depth_files(spark, f"{path}/*.bin")


@query("K01 K09 K13 S07", f"""WITH {_C} SELECT CAST(call_id AS VARCHAR) AS id, chrom, pos, coalesce(CASE WHEN svtype LIKE 'DUP%' THEN 'DUP' WHEN svtype = 'BND' AND chrom <> chr2 THEN 'TRA' ELSE svtype END, '.') AS svtype, svlen, su, coalesce(gt, './.') AS gt FROM c""")
def vcf_scan(spark, sf):
    """Calls written as a sorted VCF with its header and read again."""
    path = folder(spark, "vcf")
    c = calls(spark, sf).withColumn("id", F.col("call_id").cast("string")).drop("grp")
    sink.write_vcf(sink.vcf_lines(c.select("chrom", "pos", "chr2", "end_pos", "svtype", "svlen", "filt", "su", "gt", "prob", "id")), path, ["s"])
    e = vcf.read_events(spark, path)
    return e.select("id", "chrom", "pos", F.coalesce("svtype", F.lit(".")).alias("svtype"), "svlen", F.when(F.col("info").contains("SU="), F.col("su")).alias("su"), "gt")


@query("K02 K09", f"""WITH {_C}, k AS (SELECT svtype, chrom, sample_name, min(coalesce(gt, './.')) AS gt FROM c WHERE svtype IS NOT NULL AND sample_name IS NOT NULL GROUP BY 1, 2, 3), s AS (SELECT DISTINCT svtype, chrom FROM k)
SELECT s.svtype, s.chrom, m.sample_name AS sample, coalesce(k.gt, '0/0') AS gt FROM s, (SELECT DISTINCT sample_name FROM samples) m LEFT JOIN k ON k.svtype = s.svtype AND k.chrom = s.chrom AND k.sample_name = m.sample_name""")
def cohort_matrix(spark, sf):
    """One FORMAT column per sample of the fixed table; told apart again by name, so that SQL can follow."""
    names = sorted(r[0] for r in table(spark, sf, "samples").select("sample_name").distinct().collect())
    c = calls(spark, sf, "svtype is not null and sample_name is not null").groupBy("svtype", "chrom", "sample_name").agg(F.min(F.coalesce("gt", F.lit("./."))).alias("gt"))
    wide = sink.multi_sample(c, ["svtype", "chrom"], "sample_name", names)
    long = wide.select("svtype", "chrom", F.explode(F.array(*(F.struct(F.lit(n).alias("sample"), F.col(f"`{n}`").alias("f")) for n in names))).alias("x"))
    return long.select("svtype", "chrom", "x.sample", F.substring_index("x.f", ":", 1).alias("gt"))


@query("P10 F23", f"WITH {_C} SELECT call_id AS event_id, chrom, svlen, CAST(NULL AS VARCHAR) AS kind, {len(EVENTS.split(', '))} AS n_columns FROM c")
def event_columns(spark, sf):
    """Calls in the columns of the event table: what they do not know is null, in its type."""
    e = as_events(calls(spark, sf).withColumn("event_id", F.col("call_id")))
    return e.select("event_id", "chrom", "svlen", "kind", F.lit(len(e.columns)).alias("n_columns"))


@query("P07", """SELECT * FROM (VALUES ('pe', 'pe', 15, 200, '3', 100.0, 0.8), ('nanopore-r9', 'nanopore', -1, 150, 'auto', 900.0, 0.6), ('nanopore-r10', 'nanopore', -1, 150, 'auto', 600.0, 0.35), ('pacbio-sequel2', 'pacbio', -1, 150, 'auto', 600.0, 0.45), ('pacbio-revio', 'pacbio', -1, 150, 'auto', 600.0, 0.35)) t(preset, pl, clip_length, max_cov, min_support, dist_norm, sd)""")
def preset_options(spark, sf):
    rows = [(p, o.pl, o.clip_length, o.max_cov, str(o.min_support), float(o.dist_norm), float(o.sd)) for p in PRESETS for o in [Options.of(p)]]
    return spark.createDataFrame(rows, "preset string, pl string, clip_length int, max_cov int, min_support string, dist_norm double, sd double")


@query("O01", f"WITH {_C}, k AS (SELECT call_id, row_number() OVER (ORDER BY chrom, pos, call_id) AS place FROM c) SELECT call_id, place FROM k")
def final_order(spark, sf):
    """The place of each call in the final sort, told by the files the sort wrote: rows of the files before, then the row's own place in its file."""
    path = folder(spark, "sorted")
    calls(spark, sf).select("chrom", "pos", "call_id").orderBy("chrom", "pos", "call_id").write.parquet(path)
    x = spark.read.schema("chrom string, pos long, call_id long").parquet(path).select("chrom", "pos", "call_id", F.col("_metadata.file_name").alias("file"))
    n = x.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("file", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per file
    inside = x.withColumn("k", F.row_number().over(W.partitionBy("file").orderBy("chrom", "pos", "call_id")))
    return inside.join(before, "file").select("call_id", (F.col("before") + F.col("k")).alias("place"))
