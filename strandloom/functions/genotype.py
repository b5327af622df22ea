"""Column expressions for genotypes, probabilities and labels of variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chance of an alternative read given a heterozygous and a homozygous genotype, by kind of event.
P_ALT = {"DEL": (0.5, 0.9), "TRA": (0.5, 0.9), "SKIP": (0.5, 0.9), "INS": (0.4, 0.9), "INV": (0.4, 0.9), "BND": (0.4, 0.9), "DUP": (0.6, 0.2)}
MOST_GQ = 200
MOST_PHRED = 30
MOST_TRIALS = 1000


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _by_type(svtype: Column, place: int) -> Column:
    c = None
    for kind, p in P_ALT.items():
        c = F.when(svtype == kind, p[place]) if c is None else c.when(svtype == kind, p[place])
    return c.otherwise(P_ALT["DEL"][place])


def log_likelihood(ref, alt, p: Column) -> Column:
    """log10 likelihood of alt among ref + alt reads without the choose term, which all genotypes share."""
    return _c(alt) * F.log10(p) + _c(ref) * F.log10(1 - p)


def genotype(ref, alt, svtype) -> tuple[Column, Column]:
    """(GT, GQ): 0/1 or 1/1 by the larger likelihood, quality ten times their difference, at most 200; ./. and null without reads."""
    ref, alt, t = _c(ref), _c(alt), _c(svtype)
    het, hom = log_likelihood(ref, alt, _by_type(t, 0)), log_likelihood(ref, alt, _by_type(t, 1))
    none = (ref + alt) <= 0
    gt = F.when(none, "./.").when(het > hom, "0/1").otherwise("1/1")
    gq = F.when(~none, F.least(F.lit(float(MOST_GQ)), 10 * F.abs(het - hom)).cast("int"))
    return gt, gq


def strand_bias(plus, minus) -> Column:
    """One-sided binomial chance of at least max(plus, minus) of all reads on one strand, trials at most 1000; 1 without reads.

    Summed in logarithms from the most unlikely term on, so nothing overflows.
    """
    plus, minus = _c(plus), _c(minus)
    k, n = F.greatest(plus, minus), F.least(plus + minus, F.lit(MOST_TRIALS))
    term0 = F.aggregate(F.sequence(F.lit(1), F.greatest(n - k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.when(n - k >= i, F.log((k + i) / i)).otherwise(0.0)) - n * F.log(F.lit(2.0))

    def add(acc, i):
        t = F.when(i == k, acc["t"]).otherwise(acc["t"] + F.log((n - i + 1) / i))
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    many = F.aggregate(F.sequence(k, F.greatest(n, k)), F.struct(term0.alias("t"), F.lit(0.0).alias("s")), add, lambda acc: acc["s"])
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(many)


def phred_quality(prob) -> Column:
    """min(30, whole part of -10 log10((1 - p)^2)); 30 for p = 1."""
    p = _c(prob)
    return F.when(p >= 1, F.lit(MOST_PHRED)).otherwise(F.least(F.lit(float(MOST_PHRED)), -20 * F.log10(1 - p)).cast("int"))


def posterior(probs: list[Column], start: float = 0.5) -> Column:
    """Chance that an event is real after independent observations, folded from `start`; nulls are passed over."""
    p = F.lit(start)
    for q in probs:
        q = _c(q)
        both = p * q
        p = F.when(q.isNull(), p).otherwise(F.when(both + (1 - p) * (1 - q) > 0, both / (both + (1 - p) * (1 - q))).otherwise(p))
    return p


def least_support(coverage, fraction: float) -> Column:
    """round(1.5 + fraction x coverage), half to even."""
    return F.bround(1.5 + fraction * _c(coverage), 0).cast("int")


def scaled_coverage(coverage, inner, outer) -> Column:
    """Coverage scaled by the smaller over the larger of inner and outer copy number; unscaled where both are 0 (F16)."""
    most = F.greatest(_c(inner), _c(outer))
    return F.when(most == 0, _c(coverage)).otherwise(_c(coverage) * F.least(_c(inner), _c(outer)) / most)


def low_support(su, coverage, inner, outer, fraction: float, repeat_length=None, length=None) -> Column:
    """Support under the least support of the scaled coverage; the fraction doubles where the repeat is longer than the event (F16)."""
    cov = scaled_coverage(coverage, inner, outer)
    least = least_support(cov, fraction)
    if repeat_length is not None:
        least = F.when(_c(repeat_length) > _c(length), least_support(cov, 2 * fraction)).otherwise(least)
    nothing = (F.greatest(_c(inner), _c(outer)) == 0) & (_c(coverage) == 0)
    return ~nothing & (_c(su) < least)


def low_in_read_support(wr, coverage, inner, outer, fraction: float, n_overlap, n_mapq0) -> Column:
    """In-read support above 0 but under min(4, least support with half the fraction)."""
    cov = scaled_coverage(coverage, inner, outer)
    cov = F.when(F.coalesce(_c(n_mapq0) / F.nullif(_c(n_overlap), F.lit(0)), F.lit(0.0)) > 0.3, F.greatest(cov, _c(n_overlap).cast("double"))).otherwise(cov)
    return (_c(wr) > 0) & (_c(wr) < F.least(F.lit(4), least_support(cov, fraction / 2)))


def low_covering_support(n_covering, n_mapq0) -> Column:
    """No more than two reads with a mapping quality over the place."""
    return F.coalesce(_c(n_covering), F.lit(0)) - F.coalesce(_c(n_mapq0), F.lit(0)) <= 2


def crowded_by_clips(n_clipped, coverage, inner, outer, fraction: float) -> Column:
    """Clipped reads at or above round(1 + half the fraction x scaled coverage)."""
    cov = scaled_coverage(coverage, inner, outer)
    nothing = (F.greatest(_c(inner), _c(outer)) == 0) & (_c(coverage) == 0)
    return ~nothing & (_c(n_clipped) >= F.bround(1 + fraction / 2 * cov, 0))


def poorly_aligned(sum_edits, sum_gaps, n_aligned, nm_variant, nm_normal, most: float = 0.08) -> Column:
    """Mean edits above `most`, mean gaps above half of it, or the variant's edit rate above four times the normal one."""
    n = F.nullif(_c(n_aligned), F.lit(0))
    bad = (_c(sum_edits) / n > most) | (_c(sum_gaps) / n > most / 2) | (_c(nm_variant) > 4 * 100 * _c(nm_normal) / n)
    return F.coalesce(bad, F.lit(False))


def allele_fraction(af, su, coverage) -> Column:
    """Given fraction, else half the support over coverage, held to 0..1."""
    return F.coalesce(_c(af), F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(su) / 2 / (_c(coverage) + 1e-5))))


def event_type(svtype, chrom_a, chrom_b) -> Column:
    """BND over two chromosomes is TRA, any kind of DUP is DUP."""
    t = F.upper(_c(svtype))
    return F.when((t == "BND") & (_c(chrom_a) != _c(chrom_b)), "TRA").when(t.startswith("DUP"), "DUP").otherwise(t)


def haplotype_text(counts: Column) -> Column:
    """Counts per haplotype (MAP<INT, INT>, 0 for unphased) as text: `4|6_2`, `_6` if only unphased, `.` if none."""
    phased = F.array_sort(F.filter(F.map_entries(counts), lambda e: e["key"] != 0))
    text = F.array_join(F.transform(phased, lambda e: e["value"].cast("string")), "|")
    free = F.try_element_at(counts, F.lit(0))
    return F.when(F.coalesce(F.size(counts), F.lit(0)) <= 0, ".").otherwise(F.concat(text, F.when(free.isNotNull(), F.concat(F.lit("_"), free.cast("string"))).otherwise("")))


def support_pair(c: dict[str, Column | str]) -> tuple[Column, Column]:
    """(ref, alt) support of deletion-like events from copy numbers and counters.

    c names the columns icn, ocn, pe, spanning, supp, sc, bnd, np, su, remap, contigs (number of contigs). The first rule
    that holds gives the pair.
    """
    v = {k: _c(x) for k, x in c.items()}
    low = F.least(v["icn"], v["ocn"])
    moved = F.when(v["contigs"] == 1, 2).otherwise(1) * (v["sc"] + v["bnd"] - v["supp"])
    drop = F.when(v["icn"] > 1.25 * v["ocn"], (v["icn"] - v["ocn"]) / (v["icn"] + v["ocn"]) * v["ocn"])
    rules = [
        ((v["pe"] > 0) | (v["spanning"] > 0), low, v["pe"] + 0.5 * v["spanning"]),
        (v["remap"] > 0, low, F.when(v["bnd"] == 0, F.greatest(v["sc"], v["supp"])).otherwise(F.when(v["contigs"] == 1, 3.5).otherwise(2.5) * (v["sc"] + v["bnd"] - v["supp"]))),
        (v["supp"] > 0, F.coalesce(drop, F.greatest(F.lit(0.0), low - moved)), v["supp"]),
        (v["np"] > 0, low, 2 * v["np"]),
        ((v["icn"] != -1) & (v["icn"] < v["su"]), v["icn"], v["su"]),
        ((v["icn"] != -1) & (v["ocn"] != -1), v["ocn"], v["icn"]),
    ]
    ref = alt = None
    for cond, r, a in rules:
        r, a = r.cast("double"), a.cast("double")
        ref = F.when(cond, r) if ref is None else ref.when(cond, r)
        alt = F.when(cond, a) if alt is None else alt.when(cond, a)
    return ref.otherwise(0.0), alt.otherwise(0.0)


def support_pair_gain(c: dict[str, Column | str]) -> tuple[Column, Column]:
    """(ref, alt) support of insertion- and duplication-like events of paired reads (X32); columns as in support_pair."""
    v = {k: _c(x) for k, x in c.items()}
    low = F.least(v["icn"], v["ocn"])
    ratio = F.when(v["ocn"] <= 0, F.lit(2.0)).otherwise(v["icn"] / v["ocn"])
    moved = F.when(v["contigs"] == 1, 2).otherwise(1) * (v["sc"] + v["bnd"] - v["supp"])
    rest = F.greatest(F.lit(0.0), low - moved)
    rules = [
        (ratio > 1.75, F.greatest(F.lit(0.0), v["icn"] - 2 * (v["icn"] - v["ocn"])), v["su"]),
        ((v["pe"] > 0) | (v["spanning"] > 0), low, v["pe"] + 0.5 * v["spanning"]),
        (v["remap"] > 0, rest, moved),
        (v["supp"] > 0, rest, v["supp"]),
        (v["np"] > 0, low - 2 * v["np"], 2 * v["np"]),
        (v["icn"] > v["su"], v["icn"] - v["su"], v["su"]),
    ]
    ref = alt = None
    for cond, r, a in rules:
        r, a = r.cast("double"), a.cast("double")
        ref = F.when(cond, r) if ref is None else ref.when(cond, r)
        alt = F.when(cond, a) if alt is None else alt.when(cond, a)
    return ref.otherwise(0.0), alt.otherwise(0.0)


def support_pair_long(su, spanning, inner, outer) -> tuple[Column, Column]:
    """(ref, alt) support of insertion-like events of long reads."""
    low, high = F.least(_c(inner), _c(outer)), F.greatest(_c(inner), _c(outer))
    s = _c(su) - _c(spanning)
    return F.greatest(F.lit(0), (high - s).cast("int")), F.greatest((high - low).cast("int"), s.cast("int"))


def auto_limits(mapped, read_length, bases, genome) -> tuple[Column, Column, Column]:
    """(mean coverage, greatest coverage, least support): 0.98 of mapped reads times their length over the genome, six times that in whole numbers, and
    the least support at 0.05 of the aligned bases over the genome (A16)."""
    mean = _c(mapped) * _c(read_length) / _c(genome) * 0.98
    return mean, (F.bround(mean, 0) * 6).cast("long"), least_support(_c(bases) / _c(genome), 0.05)
