"""Queries of the data-pipeline problems that belong to the core (p1, p3, p5, p6), with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.readings import chromosome, mate_chromosome, sv_length, sv_type
from ..operators.drift import consistent_table, schema_changes, union_schema
from ..operators.packed import partners
from ..operators.periods import periods_and_gaps
from ..operators.skew import skewed_stats
from .problem_sql import P3_SQL, P6_CHANGES_SQL, P6_SCHEMA_SQL, P6_SQL, P6_TABLE_SQL


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def site_stretches(sites: DataFrame) -> DataFrame:
    """Sites with both positions on one chromosome, as list_id, chrom, a, b. A null chrom is no chromosome."""
    s = sites.where("start_pos is not null and end_pos is not null and start_pos <> -1 and end_pos <> -1")
    s = s.select("list_id", chromosome("chrom").alias("chrom"), mate_chromosome("chrom2", "chrom").alias("chrom_b"), F.col("start_pos").alias("a"), F.col("end_pos").alias("b"))
    return s.where("chrom = chrom_b")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return periods_and_gaps(site_stretches(table(spark, sf, "sites")), ["list_id", "chrom"], "a", "b")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return partners(table(spark, sf, "merged_events"))


def typed_calls(calls: DataFrame) -> DataFrame:
    """One row per call_id: key (type/chromosome of chr2; . for a missing type), its parts and the length."""
    c = calls.select("call_id", F.coalesce(sv_type("svtype"), F.lit(".")).alias("svtype"), mate_chromosome("chr2", "chrom").alias("chr2"), sv_length("svlen").alias("length"))
    return c.dropDuplicates(["call_id"]).withColumn("key", F.concat_ws("/", "svtype", "chr2"))


def p5_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, share in whole per mille and length figures of every (type, chromosome of chr2)."""
    calls = typed_calls(table(spark, sf, "sv_calls"))
    stats = skewed_stats(calls, "key", "length")
    s = stats.withColumn("calls_all", stats.select(F.sum("n")).scalar())
    part = F.split("key", "/", 2)
    return s.select(part[0].alias("svtype"), F.when(F.size(part) > 1, part[1]).alias("chr2"), F.col("n").alias("calls"), F.floor(F.col("n") * 1000 / F.col("calls_all")).cast("int").alias("share_permille"), F.col("n_value").alias("n_svlen"), F.col("min").alias("min_svlen"), F.col("max").alias("max_svlen"), F.round("mean", 4).alias("mean_svlen"), F.col("p50").alias("p50_svlen"), F.col("p90").alias("p90_svlen"), F.col("calls_all"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    s = p5_stats(spark, sf)
    return s.where("calls * 100 >= calls_all * 4").select("svtype", "chr2", F.expr("cast(calls * 100 div calls_all as int)").alias("share_pct"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_changes(spark, sf).select("feed_id", "file_no", "field_name", "change_kind")


def p6_changes(spark: SparkSession, sf: str) -> DataFrame:
    return schema_changes(table(spark, sf, "call_files"), table(spark, sf, "field_alias"))


def p6_schema(spark: SparkSession, sf: str) -> DataFrame:
    """The union schema: per field the files and names it occurs in and the type all its values are promoted to."""
    return union_schema(table(spark, sf, "call_files"), table(spark, sf, "field_alias"))


#: Units of a length.
UNITS = {"": 1, "b": 1, "bp": 1, "k": 1000, "kb": 1000, "kbp": 1000, "m": 1_000_000, "mb": 1_000_000, "mbp": 1_000_000}


def read_length(text: Column) -> Column:
    """A length as text read as a whole number: one element of a JSON list stands for the list, thousands may be set off by commas, a fraction is cut,
    a unit of UNITS counts. Null for anything else."""
    one = F.regexp_replace(F.lower(text), '^\\s*\\[?\\s*"?|"?\\s*\\]?\\s*$', "")
    form = r"^(-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:e[+-]?\d+)?)\s*([a-z]*)$"
    number = F.regexp_extract(one, form, 1)
    unit = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[F.regexp_extract(one, form, 2)]
    value = F.regexp_replace(number, ",", "").try_cast("double") * unit
    return F.when(F.abs(value) < 9e18, value.cast("long"))


def read_list(text: Column) -> Column:
    """The one element of a JSON list of text, or the text itself."""
    return F.regexp_replace(text, '^\\s*\\[\\s*"([^"]*)"\\s*\\]\\s*$', "$1")


def p6_table(spark: SparkSession, sf: str) -> DataFrame:
    """All lines in the union schema, read into the project's spellings; the fields as they came are beside them, and unread names those with
    a value that could not be read."""
    t = consistent_table(table(spark, sf, "call_files"), table(spark, sf, "field_alias"), ["row_id", "feed_id", "file_no", "line_no"])
    raw = {c: (F.col(c).cast("string") if c in t.columns else F.lit(None).cast("string")) for c in ("svtype", "svlen", "chr2")}
    kind, size, place = sv_type(read_list(raw["svtype"])), read_length(raw["svlen"]), chromosome(read_list(raw["chr2"]))
    unread = F.concat_ws(",", F.when(raw["svtype"].isNotNull() & kind.isNull(), "svtype"), F.when(raw["svlen"].isNotNull() & size.isNull(), "svlen"))
    return t.select("row_id", "feed_id", "file_no", "line_no", "readable", kind.alias("svtype"), sv_length(size).alias("svlen"), place.alias("chr2"), *(raw[c].alias(f"{c}_text") for c in raw), unread.alias("unread"))


_CHROM = "'chr' || upper(regexp_replace(trim({0}, ' \t\r\n'), '^(?i)chr', ''))"
_CHROM2 = "CASE WHEN {1} IS NULL OR trim({1}, ' \t\r\n') IN ('', '.') THEN " + _CHROM + " ELSE " + _CHROM.replace("{0}", "{1}") + " END"
SQL_CHROM = _CHROM.format
SQL_CHROM2 = _CHROM2.format
SQL_TYPE = "split_part(upper(regexp_replace(trim({0}, ' \t\r\n'), '[<>]', '', 'g')), ':', 1)".format
SQL_LENGTH = "CASE WHEN {0} NOT IN (0, -1) THEN abs({0}) END".format

P1_SQL = f"""
WITH s AS (
  SELECT list_id, {SQL_CHROM('chrom')} AS chrom, {SQL_CHROM2('chrom', 'chrom2')} AS chrom_b, least(start_pos, end_pos) AS s, greatest(start_pos, end_pos) AS e
  FROM sites WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL AND start_pos <> -1 AND end_pos <> -1),
o AS (
  SELECT list_id, chrom, s, e, max(e) OVER (PARTITION BY list_id, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM (SELECT DISTINCT * FROM s) WHERE chrom = chrom_b),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY list_id, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o),
p AS (SELECT list_id, chrom, island, min(s) AS s, max(e) AS e FROM i GROUP BY list_id, chrom, island),
g AS (SELECT list_id, chrom, e + 1 AS s, lead(s) OVER (PARTITION BY list_id, chrom ORDER BY s) - 1 AS e FROM p)
SELECT list_id, chrom, 'period' AS kind, s AS start_pos, e AS end_pos FROM p
UNION ALL SELECT list_id, chrom, 'gap', s, e FROM g WHERE e IS NOT NULL
"""

_P5_CALLS = f"""
c AS (
  SELECT call_id, min(CASE WHEN {SQL_TYPE('svtype')} IN ('DEL', 'INS', 'DUP', 'INV', 'TRA', 'BND') THEN {SQL_TYPE('svtype')} ELSE '.' END) AS svtype,
         min({SQL_CHROM2('chrom', 'chr2')}) AS chr2, min({SQL_LENGTH('svlen')}) AS length
  FROM sv_calls GROUP BY call_id),
t AS (SELECT count(*) AS calls_all FROM c)"""

P5_STATS_SQL = f"""
WITH {_P5_CALLS}
SELECT svtype, chr2, count(*) AS calls, CAST(count(*) * 1000 // max(calls_all) AS INTEGER) AS share_permille, count(length) AS n_svlen, min(length) AS min_svlen, max(length) AS max_svlen,
       round(avg(length), 4) AS mean_svlen, quantile_disc(length, 0.5) AS p50_svlen, quantile_disc(length, 0.9) AS p90_svlen, max(calls_all) AS calls_all
FROM c, t GROUP BY svtype, chr2
"""

P5_SQL = f"""
WITH {_P5_CALLS}
SELECT svtype, chr2, CAST(count(*) * 100 // max(calls_all) AS INTEGER) AS share_pct FROM c, t GROUP BY svtype, chr2 HAVING count(*) * 100 >= max(calls_all) * 4
"""

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p5_found": p5_found, "p5_stats": p5_stats, "p6_found": p6_found, "p6_changes": p6_changes, "p6_schema": p6_schema, "p6_table": p6_table}
ORACLES = {"p1_found": P1_SQL, "p3_found": P3_SQL, "p6_found": P6_SQL, "p6_changes": P6_CHANGES_SQL, "p6_schema": P6_SCHEMA_SQL, "p6_table": P6_TABLE_SQL, "p5_found": P5_SQL, "p5_stats": P5_STATS_SQL}
