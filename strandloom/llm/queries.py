"""Queries of the problems that belong to training data and record fusion (p2, p4, p7, p8, p9, p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.readings import sv_length, sv_type
from ..session import materialize
from . import mix, neardup, percentiles, split, survivor, tokens
from .sql import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _survivors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = _table(spark, sf, "sv_calls").where("grp >= 0 and call_id is not null")
    c = c.select("call_id", "grp", "sample_name", "svtype", "svlen", "filt", "su", "called_at").dropDuplicates(["call_id"])
    trust = [F.when(F.col("filt") == "PASS", 0).otherwise(1), F.col("su").isNull().cast("int"), F.coalesce(-F.col("su").cast("long"), F.lit(0)), F.col("call_id")]
    late = F.unix_micros(F.col("called_at").cast("timestamp"))
    newest = [late.isNull().cast("int"), F.coalesce(-late, F.lit(0)), F.col("call_id")]
    return survivor.survivors(c, "grp", "call_id", "sample_name", {"svtype": sv_type("svtype"), "svlen": sv_length("svlen")}, {"svtype": trust, "svlen": newest}, trust)


def p2_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """The survivor of each group with the probability of its values."""
    s = _survivors(spark, sf)[0]
    return s.select("grp", "call_id", "n_records", F.coalesce("svtype", F.lit(".")).alias("svtype"), F.coalesce(F.col("svlen").cast("long"), F.lit(-1)).alias("svlen"), F.round("p_svtype", 6).alias("p_svtype"), F.round("p_svlen", 6).alias("p_svlen"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_survivors(spark, sf).select("grp", "call_id", "svtype", "svlen")


def p2_fused(spark: SparkSession, sf: str) -> DataFrame:
    """The model's own survivor: per field the value the fitted qualities make likeliest, in how many values judged true; only ties go by trust. The record
    it stands under is the most trusted one, which the model has no part in."""
    s = _survivors(spark, sf)[0]
    return s.select("grp", "call_id", F.coalesce("likeliest_svtype", F.lit(".")).alias("svtype"), F.coalesce(F.col("likeliest_svlen").cast("long"), F.lit(-1)).alias("svlen"), F.round("p_likeliest_svtype", 6).alias("p_svtype"), F.round("p_likeliest_svlen", 6).alias("p_svlen"), F.col("n_true_svtype").alias("n_true_svtype"), F.col("n_true_svlen").alias("n_true_svlen"))


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every claimed value of a field of a group, with its probability and whether it is judged true; several may be."""
    v = _survivors(spark, sf)[1]
    return v.select(F.col("g").alias("grp"), "field", "value", "n_src", F.round("p", 6).alias("p_true"), (F.col("p") >= 0.5).alias("judged_true"))


def p2_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sensitivity and false-positive rate of each source (sample_name, empty for null) per field."""
    q = _survivors(spark, sf)[2]
    return q.select("field", F.col("src").alias("sample_name"), F.round("sens", 6).alias("sensitivity"), F.round("fpr", 6).alias("false_positive_rate"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    p = neardup.alike_pairs(_table(spark, sf, "vcf_records"), "rec_id", "info")
    return p.select(F.col("record_a").alias("rec_id_a"), F.col("record_b").alias("rec_id_b"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.alike_groups(_table(spark, sf, "vcf_records"), "rec_id", "info").withColumnRenamed("record", "rec_id")


#: The limits of |tlen| per percentile.
LIMITS = {50: 500, 90: 800, 99: 3000}


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    """One row per read_id with a size: rg, day, size."""
    a = _table(spark, sf, "alignments").where("tlen is not null and tlen <> 0")
    a = a.groupBy("read_id").agg(F.min(F.struct("rg", F.abs(F.col("tlen").cast("long")).alias("size"))).alias("r"))
    return a.select("r.rg", "r.size")


def p7_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of |tlen| per rg, with the bounds of the true value."""
    s = percentiles.sketch(_reads(spark, sf), ["rg"], "size")
    return percentiles.percentiles(s, ["rg"], tuple(LIMITS))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    p = p7_percentiles(spark, sf)
    limit = F.create_map(*(F.lit(x) for kv in LIMITS.items() for x in kv))[F.col("pct")]
    return p.where(F.col("value") > limit).select("rg", "pct")


def p7_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches per rg and day, kept as a table and combined to months: rg, month, pct, value. A read counts on the day of its
    first row; null days are a month of their own."""
    a = _table(spark, sf, "alignments").where("tlen is not null and tlen <> 0")
    a = a.groupBy("read_id").agg(F.min(F.struct("rg", F.abs(F.col("tlen").cast("long")).alias("size"), F.to_date("aligned_at").alias("day"))).alias("r")).select("r.*")
    daily = materialize(percentiles.sketch(a, ["rg", "day"], "size"))
    months = percentiles.combine(daily.withColumn("month", F.date_format("day", "yyyy-MM")), ["rg", "month"])
    return percentiles.percentiles(months, ["rg", "month"], tuple(LIMITS)).select("rg", "month", "pct", "value", "n_all")


def p7_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """How far the sketches compress, and what that costs: per rg the values, the buckets at the error used and at one in a hundred, and the median at either."""
    fine, coarse = (percentiles.sketch(_reads(spark, sf), ["rg"], "size", a) for a in (percentiles.ALPHA, 0.01))
    n = lambda s, c: s.groupBy("rg").agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias(c))
    mid = lambda s, a, c: percentiles.percentiles(s, ["rg"], (50,), a).select("rg", F.col("value").alias(c))
    a, b = n(fine, "buckets"), n(coarse, "buckets_coarse").select(F.col("rg").alias("g2"), "buckets_coarse")
    c, d = mid(fine, percentiles.ALPHA, "median"), mid(coarse, 0.01, "median_coarse").select(F.col("rg").alias("g4"), "median_coarse")
    c = c.select(F.col("rg").alias("g3"), "median")
    x = a.join(b, F.col("rg").eqNullSafe(F.col("g2"))).join(c, F.col("rg").eqNullSafe(F.col("g3"))).join(d, F.col("rg").eqNullSafe(F.col("g4")))
    return x.select("rg", "n_values", "buckets", "buckets_coarse", "median", "median_coarse")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(_table(spark, sf, "documents"), "text", ["doc_id"])


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mix.mix_sources(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of every mix with their copies."""
    return _mix(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every source of every mix."""
    return _mix(spark, sf)[1]


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_texts(_table(spark, sf, "documents"), "text", ["doc_id"])


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_pieces(spark, sf).where("piece_no = 2").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_survivors, p2_fused, p2_values, p2_sources, p4_found, p4_groups, p7_found, p7_percentiles, p7_daily, p7_sketches, p8_ids, p9_mix, p9_shares, p10_found, p10_pieces)}
