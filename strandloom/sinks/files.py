"""File sinks: VCF (one and many samples), break-end pairs, BED, CSV, depth tables, staged reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.genotype import phred_quality
from ..sources.vcf import FIELDS

#: FORMAT keys in their order, of the usual and of the full layout, and what an absent sample shows.
FORMAT = tuple("GT:GQ:PSET:HP:AF:MAPQP:MAPQS:SU:WR:PE:SR:SC:BND:NMB:COV:NEIGH10:PS:MS:RMS:RED:BCC:FCC:ICN:OCN:PROB".split(":"))
FULL_FORMAT = tuple("GT:GQ:PSET:HP:AF:NMP:NMS:NMB:MAPQP:MAPQS:NP:MAS:SU:WR:PE:SR:SC:BND:SQC:SCW:SQR:BE:COV:MCOV:LNK:NEIGH:NEIGH10:RB:PS:MS:SBT:NG:NSA:NXA:NMU:NDC:RMS:RED:BCC:FCC:STL:RAS:FAS:ICN:OCN:CMP:RR:JIT:PROB".split(":"))
ABSENT = ":".join(["0/0"] + ["0"] * (len(FORMAT) - 1))
FILTERS = {"PASS": "All filters passed", "lowProb": "Probability below the threshold", "normalOverlap": "Overlaps a variant of a normal sample", "normal": "Evidence in normal reads", "lowSupport": "Too few supporting reads", "lowAF": "Low allele fraction", "lowMapQ": "Low mapping quality", "highDivergence": "Region is poorly aligned"}
#: INFO keys of a record, the columns they come from, and their VCF type.
INFO = {"SVTYPE": ("svtype", "String"), "END": ("end_pos1", "Integer"), "CHR2": ("chr2", "String"), "CHR2_POS": ("chr2_pos1", "Integer"), "GRP": ("grp", "Integer"), "NGRP": ("n_in_grp", "Integer"), "CIPOS95": ("cipos95", "Integer"), "CIEND95": ("ciend95", "Integer"), "SVLEN": ("svlen", "Integer"), "SU": ("su", "Integer"), "KIND": ("kind", "String"), "CT": ("ct", "String"), "CONTIGA": ("contig_a", "String"), "CONTIGB": ("contig_b", "String"), "LEFT_SVINSSEQ": ("left_ins", "String"), "RIGHT_SVINSSEQ": ("right_ins", "String"), "MeanPROB": ("mean_prob", "Float"), "MaxPROB": ("max_prob", "Float")}


def _text(df: DataFrame, name: str, missing: str = ".") -> Column:
    if name not in df.columns:
        return F.lit(missing)
    kind = df.schema[name].dataType
    c = F.format_string("%.3f", F.col(name)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(name).cast("string")
    return F.coalesce(F.when(F.col(name).isNotNull(), c), F.lit(missing))


def whole_gq(gq: Column | str) -> Column:
    """A genotype quality as whole-number text: 30 and 30.0 give 30, what is no number gives a dot."""
    c = F.col(gq) if isinstance(gq, str) else gq
    return F.coalesce(c.cast("string").try_cast("double").cast("long").cast("string"), F.lit("."))


def format_column(df: DataFrame, keys: tuple[str, ...] = FORMAT) -> Column:
    """The FORMAT value of a row, its keys in order; a value that is not known shows 0."""
    each = {"GT": F.coalesce(F.col("gt"), F.lit("./.")) if "gt" in df.columns else F.lit("./."), "GQ": whole_gq("gq") if "gq" in df.columns else F.lit(".")}
    return F.concat_ws(":", *(each.get(k, _text(df, FIELDS[k][0], "0")) for k in keys))


def info_column(df: DataFrame, keys: dict[str, str]) -> Column:
    """INFO text from {key: column}; null columns leave their item out."""
    return F.concat_ws(";", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}="), _text(df, c))) for k, c in keys.items()))


def vcf_lines(df: DataFrame, extra: list[str] | None = None, keys: tuple[str, ...] = FORMAT) -> DataFrame:
    """Chrom, pos, line (and the columns `extra`): single-sample records. df: chrom, pos (0-based), chr2, end_pos, svtype, svlen, optional row columns. Sort is left to the writer."""
    inter = F.col("chrom") != F.col("chr2")
    x = df.withColumn("end_pos1", F.when(inter, F.col("pos") + 1).otherwise(F.col("end_pos") + 1)).withColumn("chr2_pos1", F.when(inter, F.col("end_pos") + 1))
    info = info_column(x, {k: c for k, (c, _) in INFO.items() if c in x.columns})
    qual = phred_quality("prob").cast("string") if "prob" in df.columns else F.lit(".")
    alt = F.concat(F.lit("<"), F.coalesce("svtype", F.lit("BND")), F.lit(">"))
    alt = F.coalesce("alt", alt) if "alt" in df.columns else alt
    line = F.concat_ws("\t", F.col("chrom"), (F.col("pos") + 1).cast("string"), _text(x, "id"), _text(x, "ref_seq", "N"), alt, F.coalesce(qual, F.lit(".")), _text(x, "filt"), F.coalesce(F.nullif(info, F.lit("")), F.lit(".")), F.lit(":".join(keys)), format_column(x, keys))
    return x.select(*(extra or []), "chrom", "pos", line.alias("line"))


def header(samples: list[str], contigs: list[str] = (), keys: tuple[str, ...] = FORMAT) -> list[str]:
    """Header lines."""
    out = ["##fileformat=VCFv4.2", *(f"##contig=<ID={c}>" for c in contigs), *(f'##FILTER=<ID={k},Description="{v}">' for k, v in FILTERS.items())]
    out += [f'##INFO=<ID={k},Number=1,Type={t},Description="{k}">' for k, (_, t) in INFO.items()]
    kinds = {"string": "String", "double": "Float", "bigint": "Integer"}
    out += [f'##FORMAT=<ID={k},Number=1,Type={"Integer" if k == "GQ" else kinds[FIELDS[k][1]]},Description="{k}">' for k in keys]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def write_vcf(df: DataFrame, path: str, samples: list[str], mode: str = "errorifexists", keys: tuple[str, ...] = FORMAT) -> None:
    """Records in order of chromosome and position as part files of text, the header first. df as of vcf_lines or multi_sample.

    The sort is a range shuffle, so files follow each other in order; nothing passes through the driver but the header.
    """
    spark = df.sparkSession
    head = spark.createDataFrame([("", -1 - i, h) for i, h in enumerate(header(samples, keys=keys)[::-1])], "chrom string, pos long, line string")
    head.unionByName(df.select("chrom", F.col("pos").cast("long").alias("pos"), "line")).orderBy("chrom", "pos", "line").select("line").write.mode(mode).text(path)


def multi_sample(df: DataFrame, site: list[str], sample: str, samples: list[str]) -> DataFrame:
    """Site columns and one FORMAT column per sample, in the order given; a sample without a row at a site shows 0/0."""
    f = df.select(*site, F.col(sample).alias("__s"), format_column(df).alias("__f"))
    p = f.groupBy(*site).pivot("__s", samples).agg(F.min("__f"))
    return p.select(*site, *(F.coalesce(F.col(f"`{s}`"), F.lit(ABSENT)).alias(s) for s in samples))


def break_ends(df: DataFrame, row: str) -> DataFrame:
    """The two break-end records of each event over two places: row, mate (1, 2), chrom, pos (1-based), alt in bracket notation by ct."""
    c = F.col
    a, b = F.concat(c("chrom"), F.lit(":"), (c("pos") + 1).cast("string")), F.concat(c("chr2"), F.lit(":"), (c("end_pos") + 1).cast("string"))
    ct = F.coalesce(c("ct"), F.lit("3to5"))

    def alt(other: Column, first: bool) -> Column:
        right, left = ("3to5", "5to3") if first else ("5to3", "3to5")
        return F.when(ct == right, F.concat(F.lit("N["), other, F.lit("["))).when(ct == left, F.concat(F.lit("]"), other, F.lit("]N"))).when(ct == "3to3", F.concat(F.lit("N]"), other, F.lit("]"))).otherwise(F.concat(F.lit("["), other, F.lit("[N")))

    two = F.array(F.struct(F.lit(1).alias("mate"), c("chrom").alias("chrom"), (c("pos") + 1).alias("pos"), alt(b, True).alias("alt")), F.struct(F.lit(2).alias("mate"), c("chr2").alias("chrom"), (c("end_pos") + 1).alias("pos"), alt(a, False).alias("alt")))
    return df.select(row, F.explode(two).alias("m")).select(row, "m.*")


def partner_text(partners: Column | str) -> Column:
    """ARRAY<STRUCT<table, event>> as table,event|table,event."""
    return F.array_join(F.transform(partners, lambda p: F.concat(p["table"], F.lit(","), p["event"].cast("string"))), "|")


def write_csv(df: DataFrame, path: str, separate: str | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header; `separate` writes one folder per value of that column."""
    w = df.write.mode(mode).option("header", True)
    (w.partitionBy(separate) if separate else w).csv(path)


def write_bed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated, no header, in order of chromosome and start; a strand belongs into the sixth column: chrom, start, end, name, score, strand."""
    df.orderBy(*df.columns[:2]).write.mode(mode).option("sep", "\t").csv(path)


def write_depth(track: DataFrame, path: str, key: str = "chrom", mode: str = "errorifexists") -> None:
    """Depth runs as Parquet by chromosome."""
    track.write.mode(mode).partitionBy(key).parquet(path)


def stage_reads(reads: DataFrame, path: str, mode: str = "errorifexists", flatten_quality: bool = False) -> None:
    """Reads with evidence as Parquet by chromosome, without bulky tags; qualities may be flattened."""
    bulky = [c for c in ("tags", "md") if c in reads.columns]
    x = reads.drop(*bulky)
    if flatten_quality and "qual" in x.columns:
        x = x.withColumn("qual", F.repeat(F.lit(chr(60 + 33)), F.length("qual")))
    x.write.mode(mode).partitionBy("rname").parquet(path)


def run_figures(reads: DataFrame, aligned: Column) -> DataFrame:
    """One row of counters of a scan: reads, aligned bases."""
    return reads.agg(F.count(F.lit(1)).alias("n_reads"), F.sum(aligned).alias("n_aligned_bases"))


def label(filt: Column, reason: Column) -> Column:
    """Filter text with a reason added; PASS and . give way to it."""
    have = F.when(F.coalesce(filt, F.lit(".")).isin("PASS", ".", ""), F.array().cast("array<string>")).otherwise(F.split(filt, ";"))
    all_ = F.array_union(have, F.when(reason.isNotNull(), F.array(reason)).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(all_) > 0, F.array_join(all_, ";")).otherwise(F.coalesce(filt, F.lit("PASS")))


def update_values(target: DataFrame, cohort: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Target with the values of matching cohort rows where these are not null and differ (numbers at two digits)."""
    c = cohort.select(*on, *(F.col(v).alias(f"__{v}") for v in values))
    j = target.join(c, on, "left")
    def new(v: str) -> Column:
        num = isinstance(target.schema[v].dataType, (T.DoubleType, T.FloatType))
        differs = F.round(F.col(f"__{v}"), 2) != F.round(F.col(v), 2) if num else F.col(f"__{v}") != F.col(v)
        return F.when(F.col(f"__{v}").isNotNull() & (F.col(v).isNull() | differs), F.col(f"__{v}")).otherwise(F.col(v)).alias(v)

    return j.select(*(new(c) if c in values else F.col(c) for c in target.columns))


def update_cohort(cohort: DataFrame, calls: DataFrame, site: str, sample: str, values: list[str], prob: str = "prob") -> tuple[DataFrame, DataFrame]:
    """(cohort rows with the values of the matching calls, sites). cohort and calls have one row per site and sample. sites: site, updated, mean_prob and
    max_prob over all samples, worked out again where a row of the site changed (and null elsewhere: what is written stays)."""
    new = update_values(cohort, calls, [site, sample], values)
    old = cohort.select(F.col(site).alias("__s"), F.col(sample).alias("__n"), *(F.col(v).alias(f"__o_{v}") for v in values))
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.col(f"__o_{v}"))
    x = new.join(old, F.col(site).eqNullSafe(F.col("__s")) & F.col(sample).eqNullSafe(F.col("__n")))
    g = x.groupBy(site).agg(F.bool_or(changed).alias("updated"), F.avg(prob).alias("__mean"), F.max(prob).alias("__max"))
    return new, g.select(site, "updated", F.when(F.col("updated"), F.col("__mean")).alias("mean_prob"), F.when(F.col("updated"), F.col("__max")).alias("max_prob"))


def write_depth_bins(track: DataFrame, path: str, key: str = "chrom") -> DataFrame:
    """One file of little-endian int16 per chromosome, a number per bin from bin 0 on, depths held to 32,000; the written paths come back (key, file, bins). A task writes
    a chromosome run by run, so it holds no more than the runs of one; the folder may lie on any file system Arrow knows."""
    import numpy as np
    import pandas as pd
    from pyarrow import fs

    def write(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        system, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(folder, recursive=True)
        name, at = f"{folder}/{key_[0]}.depth.bin", 0
        with system.open_output_stream(name) as out:
            for b, t, d in zip(pdf["bin"], pdf["to_bin"], pdf["depth"]):
                out.write(bytes(2 * (int(b) - at)) + np.full(int(t) - int(b), min(int(d), 32_000), "<i2").tobytes())
                at = int(t)
        return pd.DataFrame({key: [key_[0]], "file": [name], "bins": [at]})

    return track.select(key, "bin", "to_bin", "depth").groupBy(key).applyInPandas(write, f"{key} string, file string, bins long")
