"""Column expressions on qualities, contigs and alignments that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def good_clip(qualities: Column, least: int, width: int = 10, floor: int = 10) -> Column:
    """whether a clip, its qualities (ARRAY) outward from the boundary, is good for `least` bases: windows of `width` count until the mean of
    one falls to `floor`; a window counts for one base, the first for all of its own. Without qualities it passes."""
    n = F.size(qualities)
    w = F.least(F.lit(width), n)
    sums = F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.aggregate(F.slice(qualities, i, w), F.lit(0).cast("long"), lambda a, q: a + q))
    bad = F.array_position(F.transform(sums, lambda s: s <= floor * w), True)
    good = F.when(bad == 0, n - w + 1).otherwise(bad - 1)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(True)).otherwise(good + w - 1 >= least)


def clipped_ends(contig: Column, stretch: int = 2) -> tuple[Column, Column]:
    """The clipped (lower-case) ends of a contig, each with as much of what follows as `stretch` asks; empty where there is none."""
    left, right = F.length(F.regexp_extract(contig, "^[a-z]+", 0)), F.length(F.regexp_extract(contig, "[a-z]+$", 0))
    n = F.length(contig)
    start = F.greatest(F.lit(0), n - right * stretch)
    return F.substr(contig, F.lit(1), left * stretch), F.when(right > 0, F.substr(contig, start + 1, n - start)).otherwise("")


def inserted_bases(contig: Column) -> Column:
    """The longest run of inserted (lower-case) bases inside a contig, its clipped ends apart; the first of equal ones, empty for none."""
    inner = F.regexp_replace(contig, "^[a-z]+|[a-z]+$", "")
    runs = F.regexp_extract_all(inner, F.lit("[a-z]+"), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
    return F.coalesce(F.get(F.filter(runs, lambda r: F.length(r) == longest), F.lit(0)), F.lit(""))
