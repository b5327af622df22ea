"""VCF as tables: single- and multi-sample files, their INFO and FORMAT keys as typed columns, and site lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genotype import event_type
from ..operators.blocked import numbered

#: VCF key, column and type of the keys that become columns.
FIELDS = {
    "CHR2": ("chr2", "string"), "GRP": ("grp", "bigint"), "NGRP": ("n_in_grp", "bigint"), "END": ("end_pos", "bigint"), "CHR2_POS": ("chr2_pos", "bigint"),
    "KIND": ("kind", "string"), "SVTYPE": ("svtype", "string"), "CT": ("ct", "string"), "CIPOS95": ("cipos95", "bigint"), "CIEND95": ("ciend95", "bigint"),
    "NMP": ("nm_pri", "double"), "NMB": ("nm_base", "double"), "NMS": ("nm_supp", "double"), "MAPQP": ("mapq_pri", "double"), "MAPQS": ("mapq_supp", "double"),
    "NP": ("np", "bigint"), "OL": ("query_overlap", "bigint"), "MAS": ("max_as_supp", "bigint"), "SU": ("su", "bigint"), "WR": ("wr", "bigint"),
    "PE": ("pe", "bigint"), "SR": ("sr", "bigint"), "SC": ("sc", "bigint"), "BND": ("bnd", "bigint"), "SVLEN": ("svlen", "bigint"),
    "REP": ("rep", "double"), "REPSC": ("rep_sc", "double"), "GC": ("gc", "double"), "NEXP": ("nexp", "bigint"), "STRIDE": ("stride", "bigint"),
    "EXPSEQ": ("expseq", "string"), "RPOLY": ("rpoly", "bigint"), "LPREC": ("lprec", "bigint"), "RT": ("rt", "string"), "MeanPROB": ("mean_prob", "double"),
    "MaxPROB": ("max_prob", "double"), "PROB": ("prob", "double"), "COV": ("cov", "double"), "ICN": ("inner_cn", "double"), "OCN": ("outer_cn", "double"),
    "GT": ("gt", "string"), "GQ": ("gq", "string"), "AF": ("a_freq", "double"), "NEIGH": ("neigh", "bigint"), "NEIGH10": ("neigh10", "bigint"),
    "SQC": ("sqc", "double"), "SCW": ("scw", "double"), "SQR": ("clip_qual_ratio", "double"), "BE": ("block_edge", "bigint"), "MCOV": ("mcov", "double"),
    "LNK": ("linked", "bigint"), "RB": ("ref_bases", "bigint"), "PS": ("plus", "bigint"), "MS": ("minus", "bigint"), "SBT": ("strand_bias", "double"),
    "NG": ("n_gaps", "double"), "NSA": ("n_sa", "double"), "NXA": ("n_xa", "double"), "NMU": ("n_unmapped_mates", "bigint"), "NDC": ("double_clips", "bigint"),
    "RMS": ("remap_score", "bigint"), "RED": ("remap_ed", "bigint"), "BCC": ("bad_clip_count", "bigint"), "STL": ("n_small_tlen", "bigint"), "RAS": ("ras", "bigint"),
    "FAS": ("fas", "bigint"), "CMP": ("compress", "double"), "FCC": ("fold_change", "double"), "RR": ("ref_rep", "double"), "JIT": ("jitter", "double"),
    "PSET": ("phase_set", "bigint"), "HP": ("haplotype", "string"),
    "CONTIGA": ("contig_a", "string"), "CONTIGB": ("contig_b", "string"), "LEFT_SVINSSEQ": ("left_ins", "string"), "RIGHT_SVINSSEQ": ("right_ins", "string"),
}


def info_map(info: Column | str) -> Column:
    """MAP from key to value of an INFO text; items are trimmed, an item without = is a flag with value ''; null for no items. Of a repeated key the last counts."""
    c = F.col(info) if isinstance(info, str) else info
    items = F.filter(F.transform(F.split(c, ";"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: (x != "") & (x != "."))
    # The last of a key wins without relying on a session setting. Items and keys are bound once, as variables of an outer transform.
    bound = F.struct(items.alias("it"), F.transform(items, lambda x: F.substring_index(x, "=", 1)).alias("k"))

    def entries(b: Column) -> Column:
        value = lambda x: F.when(x.contains("="), F.regexp_extract(x, "^[^=]*=(.*)$", 1)).otherwise("")
        each = F.transform(b["it"], lambda x, i: F.struct(F.element_at(b["k"], i + 1).alias("k"), value(x).alias("v"), i.alias("i")))
        last = F.filter(each, lambda s: ~F.array_contains(F.slice(b["k"], s["i"] + 2, F.greatest(F.size(b["k"]), F.lit(1))), s["k"]))
        return F.map_from_entries(F.transform(last, lambda s: F.struct(s["k"], s["v"])))

    return F.when(F.size(items) > 0, F.element_at(F.transform(F.array(bound), entries), 1))


def format_map(fmt: Column | str, value: Column | str) -> Column:
    """MAP from FORMAT key to the sample's value; keys without a value are left out, null for none. Of a repeated key the last counts."""
    k, v = (F.split(F.col(x) if isinstance(x, str) else x, ":") for x in (fmt, value))
    n = F.least(F.size(k), F.size(v))
    last = lambda x, i: (i < n) & ~F.array_contains(F.slice(k, i + 2, F.greatest(n - i - 1, F.lit(0))), x)
    places = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: last(F.get(k, i), i))
    return F.when(n > 0, F.map_from_entries(F.transform(places, lambda i: F.struct(F.get(k, i), F.get(v, i)))))


def typed(df: DataFrame, info: str = "info", fmt: str | None = None, value: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Df with one typed column per key (all of FIELDS, or `keys`); a FORMAT value goes before an INFO value; what cannot be read as its type is null."""
    m = df.withColumn("__i", info_map(info))
    m = m.withColumn("__f", format_map(fmt, value)) if fmt else m
    def one(key: str) -> Column:
        v = F.try_element_at("__i", F.lit(key))
        if fmt:
            f = F.try_element_at("__f", F.lit(key))
            v = F.coalesce(F.when(f != ".", f), v)
        name, kind = FIELDS[key]
        return (v if kind == "string" else v.try_cast(kind)).alias(name)

    return m.select(*df.columns, *(one(k) for k in keys or FIELDS if FIELDS[k][0] not in df.columns))


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Chrom, pos (0-based), id, ref_seq, alt, qual, filt, info, fmt, samples (names), values (one per sample), file. Any number of samples.

    Header lines of each file give its sample names; they are joined by file, a table with one row per file.
    """
    line = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    names = line.where(F.col("value").startswith("#CHROM")).select(F.col("file"), F.slice(F.split("value", "\t"), 10, 1_000_000).alias("samples"))
    f = line.where(~F.col("value").startswith("#") & (F.col("value") != "")).select("file", F.split("value", "\t").alias("f")).where(F.size("f") >= 8)
    c = lambda i: F.try_element_at("f", F.lit(i))
    rows = f.select("file", c(1).alias("chrom"), (c(2).try_cast("long") - 1).alias("pos"), c(3).alias("id"), c(4).alias("ref_seq"), c(5).alias("alt"), c(6).try_cast("double").alias("qual"), c(7).alias("filt"), c(8).alias("info"), c(9).alias("fmt"), F.slice("f", 10, 1_000_000).alias("values"))
    return rows.join(names, "file", "left")


def long_samples(vcf: DataFrame, target: str | None = None) -> DataFrame:
    """One row per record and sample: the record's columns, sample, value. With target only that sample; it is required by callers that need one of several."""
    x = vcf.select(*(c for c in vcf.columns if c not in ("samples", "values")), F.explode(F.arrays_zip("samples", "values")).alias("s"))
    x = x.select(*(c for c in x.columns if c != "s"), F.col("s.samples").alias("sample"), F.col("s.values").alias("value"))
    return x.where(F.col("sample") == target) if target else x


def read_events(spark: SparkSession, path: str | list[str], target: str | None = None) -> DataFrame:
    """The typed event table of VCF files; end_pos of an event over two chromosomes is CHR2_POS, missing ends are pos; positions 0-based."""
    t = typed(long_samples(read_vcf(spark, path), target), "info", "fmt", "value")
    chr2 = F.coalesce("chr2", "chrom")
    end = F.coalesce(F.when(F.coalesce("chr2", "chrom") != F.col("chrom"), F.col("chr2_pos") - 1), F.col("end_pos") - 1, F.col("chr2_pos") - 1, F.col("pos"))
    return t.withColumn("chr2", chr2).withColumn("end_pos", end).withColumn("svtype", event_type("svtype", "chrom", "chr2"))


def sites_of(events: DataFrame, pass_only: bool = True, own_sample: str | None = None, default_prob: float = 0.6) -> DataFrame:
    """Chrom, start, chrom2, end, svtype, idx, id, svlen, prob of a list of sites from read_events: PASS rows only, rows where
    own_sample has the variant left out, ends in order, lengths absolute, prob from MeanPROB, PROB or the default."""
    e = events.where((F.col("filt") == "PASS")) if pass_only else events
    if own_sample:
        e = e.where(~((F.col("sample") == own_sample) & ~F.coalesce(F.col("gt"), F.lit("0/0")).isin("0/0", "0|0", "./.", "0")))
    same = F.col("chrom") == F.col("chr2")
    flip = same & (F.col("end_pos") < F.col("pos"))
    e = e.select("chrom", F.when(flip, F.col("end_pos")).otherwise(F.col("pos")).alias("start"), F.col("chr2").alias("chrom2"), F.when(flip, F.col("pos")).otherwise(F.col("end_pos")).alias("end"), "svtype", "id", F.abs("svlen").alias("svlen"), F.coalesce("mean_prob", "prob", F.lit(default_prob)).alias("prob")).distinct()
    e = numbered(e, ["chrom"], "start", ["start", "end", "id"], "idx")
    return e.withColumn("idx", F.col("idx") - 1)


def variant_key(df: DataFrame, row: list[str]) -> DataFrame:
    """Row, group (type with INS and DUP together, and chromosome or ordered pair of them), anchor (the smaller position on one chromosome)."""
    t = F.when(F.col("svtype").isin("INS", "DUP"), "INSDUP").otherwise(F.coalesce("svtype", F.lit(".")))
    same = F.col("chrom") == F.col("chr2")
    place = F.when(same, F.col("chrom")).otherwise(F.concat_ws("|", F.least("chrom", "chr2"), F.greatest("chrom", "chr2")))
    anchor = F.when(same, F.least("pos", "end_pos")).when(F.col("chrom") < F.col("chr2"), F.col("pos")).otherwise(F.col("end_pos"))
    return df.select(*row, F.concat_ws(":", t, place).alias("grp_key"), anchor.alias("anchor"))
