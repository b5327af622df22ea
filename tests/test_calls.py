"""Calls from split reads and clips alone, on small tables of reads."""

import random

from strandloom.plans import catalog
from strandloom.plans.config import Options
from strandloom.plans.pipelines import call, fetch
from strandloom.session import materialize

READS = "read_id long, sample_name string, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, sa string"


def called(spark, rows, **options):
    opt = Options.of(min_support=3, **options)
    reads = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], READS)
    ev, track = (materialize(x) for x in fetch(reads, opt, by="sample_name"))
    return call(ev, track, opt, by="sample_name").collect()


def test_every_pair_is_classified(spark, tmp_path):
    rows = [(1, "s1", "t", 97, "chr1", 100, 60, "100M", "chr2", 500, 0, "*", None), (2, "s1", "t", 145, "chr2", 500, 60, "100M", "chr1", 100, 0, "*", None)]
    rows += [(3, "s1", "u", 65, "chr1", 1000, 60, "60M40S", "=", 1200, 0, "*", None), (4, "s1", "u", 2113, "chr1", 5000, 60, "60H40M", "=", 1200, 0, "*", None)]
    spark.createDataFrame(rows, READS).write.parquet(f"{tmp_path}/alignments.parquet")
    got = {r.qname: r for r in catalog.classified_pairs(spark, str(tmp_path)).collect()}
    assert (got["t"].svtype, got["t"].chrom_a, got["t"].chrom_b, got["t"].ct, got["t"].break_a, got["t"].break_b, got["t"].precise_a) == ("TRA", "chr1", "chr2", "3to5", 200, 500, False)
    assert (got["u"].svtype, got["u"].ct, got["u"].break_a, got["u"].break_b, got["u"].precise_a, got["u"].precise_b, got["u"].length) == ("DEL", "3to5", 1060, 5000, True, True, 3940)


def single(name, chrom, pos, cigar, seq="*", sa=None, sample="s1"):
    return (sample, name, 0, chrom, pos, 60, cigar, "*", 0, 0, seq, sa)


def test_contigs_of_calls(spark):
    """Reads whose bases are kept become a consensus with its clip in lower case; the calls are the same without them."""
    rng = random.Random(4)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    body, clip = base(60), base(40)
    rows = [single(f"d{i}", "chr1", 1000 + i, f"{60 - i}M40S", body[i:] + clip, sa=f"chr1,5000,+,{60 - i}S40M,60,0;") for i in range(4)]
    (e,) = called(spark, rows)
    assert e.contig_a == body + clip.lower() and e.gc == 100 * sum(c in "GC" for c in body + clip) / 100 and 0 < e.compress <= 100
    (plain,) = called(spark, rows, contigs=False)
    assert plain.contig_a is None and (plain.svtype, plain.pos, plain.end_pos, plain.su, plain.gt) == (e.svtype, e.pos, e.end_pos, e.su, e.gt) == ("DEL", 1060, 5000, 4, "0/1")


def test_split_reads_and_clips_alone(spark):
    rows = [single(f"d{i}", "chr1", 1000 + i, f"{60 - i}M40S", sa=f"chr1,5000,+,{60 - i}S40M,60,0;") for i in range(4)]
    rows += [single(f"t{i}", "chr2", 8000 + i, f"{60 - i}M40S", sa=f"chr3,700,+,{60 - i}S40M,60,0;") for i in range(3)]
    rows += [single(f"x{i}", "chr4", 1000, "50M100S", sa="chr4,3000,+,50S50M50S,60,0;chr4,9000,+,100S50M,60,0;") for i in range(3)]
    for i in range(3):  # with the supplementary row: counted once
        rows.append(single(f"s{i}", "chr5", 1000, "60M40S", sa="chr5,5000,+,60S40M,60,0;"))
        rows.append(("s1", f"s{i}", 2048, "chr5", 5000, 60, "60H40M", "*", 0, 0, "*", "chr5,1000,+,60M40S,60,0;"))
    rng = random.Random(1)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    clip = base(40)
    for i in range(4):
        rows.append(single(f"c{i}", "chr6", 1000 + i, f"{60 - i}M40S", base(60 - i) + clip))
        rows.append(single(f"n{i}", "chr7", 1000 + i, f"{60 - i}M40S", base(100 - i)))  # clips that share nothing
    # two lengths at one place, and one event in two samples deeper together than max_cov
    rows += [single(f"g{i}", "chr8", 1000, "50M60D50M") for i in range(3)] + [single(f"h{i}", "chr8", 1000, "50M310D50M") for i in range(3)]
    rows += [single(f"m{i}{s}", "chr9", 1000, "50M60D50M", sample=s) for i in range(5) for s in ("s1", "s2")]
    events = called(spark, rows, max_cov=9)
    assert sorted((r.sample, r.chrom, r.pos, r.svlen, r.wr) for r in events if r.chrom in ("chr8", "chr9")) == [("s1", "chr8", 1050, 60, 3), ("s1", "chr8", 1050, 310, 3), ("s1", "chr9", 1050, 60, 5), ("s2", "chr9", 1050, 60, 5)]
    got = {(r.svtype, r.chrom, r.pos, r.chr2, r.end_pos, r.sr, r.sc, r.su) for r in events if r.chrom < "chr8"}
    dels = {("DEL", "chr1", 1060, "chr1", 5000, 4, 0, 4), ("DEL", "chr4", 1050, "chr4", 3000, 3, 0, 3), ("DEL", "chr4", 3050, "chr4", 9000, 3, 0, 3), ("DEL", "chr5", 1060, "chr5", 5000, 3, 0, 3)}
    assert got == dels | {("TRA", "chr2", 8060, "chr3", 700, 3, 0, 3), ("BND", "chr6", 1060, "chr6", 1060, 0, 4, 4)}
