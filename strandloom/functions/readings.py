"""Column expressions that read dirty genomic fields into one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The types a structural variant may have.
SV_TYPES = ("DEL", "INS", "DUP", "INV", "TRA", "BND")
_BLANK = " \t\r\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(_BLANK))


def chromosome(c: Column | str) -> Column:
    """Trimmed, without a leading chr of any case, upper case, chr in front. Null stays null."""
    return F.concat(F.lit("chr"), F.upper(F.regexp_replace(trimmed(c), "^(?i)chr", "")))


def mate_chromosome(c2: Column | str, c1: Column | str) -> Column:
    """Chromosome of c2; null, empty and . mean the chromosome of c1."""
    t = trimmed(c2)
    return F.when(t.isNull() | t.isin("", "."), chromosome(c1)).otherwise(chromosome(c2))


def sv_type(c: Column | str) -> Column:
    """Type without angle brackets, upper case, cut at the first colon; null unless it is one of SV_TYPES."""
    t = F.substring_index(F.upper(F.regexp_replace(trimmed(c), "[<>]", "")), ":", 1)
    return F.when(t.isin(*SV_TYPES), t)


def sv_length(c: Column | str) -> Column:
    """Absolute length; null, 0 and -1 are missing."""
    x = _col(c).cast("long")
    return F.when((x != 0) & (x != -1), F.abs(x))
