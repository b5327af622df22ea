import gzip
import struct

import pytest
from pyspark.sql import functions as F

from strandloom.plans.config import PRESETS, Options
from strandloom.plans.pipelines import Engine, as_events, fetch
from strandloom.sinks import files as sink
from strandloom.sources import files, vcf


def sam_lines():
    out = ["@HD\tVN:1.6", "@SQ\tSN:c1\tLN:20000", "@RG\tID:r\tSM:alpha"]
    rec = lambda q, f, c, p, m, cig, rn, pn, tl, *tags: out.append("\t".join(map(str, [q, f, c, p, m, cig, rn, pn, tl, "*", "*", *tags])))
    for i in range(60):  # a background of proper pairs
        rec(f"b{i}", 99, "c1", 500 + 150 * i, 60, "100M", "=", 700 + 150 * i, 300, "NM:i:0")
        rec(f"b{i}", 147, "c1", 700 + 150 * i, 60, "100M", "=", 500 + 150 * i, -300, "NM:i:0")
    for i in range(8):  # a deletion of about 1500
        rec(f"d{i}", 97, "c1", 4000 + i, 60, "100M", "=", 5600 + i, 1700, "NM:i:0")
        rec(f"d{i}", 145, "c1", 5600 + i, 60, "100M", "=", 4000 + i, -1700, "NM:i:0")
    for i in range(6):  # to another chromosome
        rec(f"t{i}", 97, "c1", 9000 + i, 60, "100M", "c2", 300 + i, 0)
        rec(f"t{i}", 145, "c2", 300 + i, 60, "100M", "c1", 9000 + i, 0)
    for i in range(5):  # an insertion of 80 inside reads
        rec(f"i{i}", 0, "c1", 12000 - 5 * i, 60, f"{50 + 5 * i}M80I50M", "*", 0, 0, "HP:i:1")
    return out


@pytest.fixture(scope="module")
def sam(tmp_path_factory):
    p = tmp_path_factory.mktemp("sam") / "x.sam"
    p.write_text("\n".join(sam_lines()) + "\n")
    return str(p)


def test_sam(spark, sam):
    r = files.read_sam(spark, sam)
    assert r.count() == 60 * 2 + 16 + 12 + 5
    x = r.where("qname = 'i0'").first()
    assert (x.pos, x.pnext, x.cigar, x.hp, x.nm) == (11999, -1, "50M80I50M", 1, None) and x.tags == {"HP": "1"}
    assert files.sam_samples(spark, sam).first().sample == "alpha"
    assert files.is_paired(r, ["file"]).first().paired


def test_sam_positions_and_repeated_tags(spark, tmp_path):
    (tmp_path / "s.sam").write_text("q\t0\tc1\t100\t60\t60M40S\t=\t7\t0\t*\t*\tSA:Z:c1,500,+,60S40M,60,0;x,y;\tHP:i:1\tHP:i:2\n")
    r = files.read_sam(spark, str(tmp_path / "s.sam")).first()
    assert (r.pos, r.pnext, r.sa, r.hp, r.tags["HP"]) == (99, 6, "c1,499,+,60S40M,60,0;x,y;", 2, "2")
    assert files.list_files(str(tmp_path / "*.sam")) == files.list_files(str(tmp_path)) == [f"{tmp_path}/s.sam"] and files.list_files(str(tmp_path / "n*")) == []


def test_bam(spark, tmp_path):
    def record(name, flag, rid, pos, cigar, seq, tags):
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        code = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", rid, pos, len(name) + 1, 37, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + bytes(a << 4 | b for a, b in zip(code[::2], code[1::2])) + b"\xff" * len(seq) + tags
        return struct.pack("<i", len(body)) + body

    head = b"@SQ\tSN:c1\tLN:99\n"
    data = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 99)
    data += record("q1", 16, 0, 9, [(2, "S"), (3, "M")], "ACGTN", b"NMC\x02" + b"SAZc1,5,+,3M,9,0;\0" + b"ZBBc" + struct.pack("<i", 2) + b"\1\2")
    data += record("q2", 4, -1, -1, [], "", b"")
    p = tmp_path / "a.bam"
    p.write_bytes(gzip.compress(data[:40]) + gzip.compress(data[40:]))
    spark.dataSource.register(files.BamSource)
    got = spark.read.format("bam").load(str(p)).collect()
    assert [(r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq, r.nm, r.sa) for r in got] == [("q1", 16, "c1", 9, "2S3M", "ACGTN", 2, "c1,4,+,3M,9,0;"), ("q2", 4, "*", -1, "*", "*", None, None)]


def test_bed_gff_fasta_depth_csv(spark, tmp_path):
    (tmp_path / "a.bed").write_text("# x\nchr1\t5\t9\tname\nchr2\t1\t2\n")
    assert [tuple(r) for r in files.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 5, 9), ("chr2", 1, 2)]
    (tmp_path / "b.bed").write_text("chr1\tx\t9\nchr2\n")
    assert files.read_bed(spark, str(tmp_path / "b.bed"), strict=False).count() == 0
    (tmp_path / "g.gff3").write_text("#\nc1\ts\texon\t5\t9\t.\t-\t.\tID=1;transcript_id=T1;gene_name=G\nc1\ts\tgene\t5\t9\t.\t-\t.\tID=1\n")
    assert [tuple(r) for r in files.read_gff_exons(spark, str(tmp_path / "g.gff3")).collect()] == [("c1", 4, 9, "-", "T1", "G")]
    (tmp_path / "r.fa").write_text(">c1 x\nACGTac\ngtNN\n>c2\nTTTT\n>c3\n")
    fa = files.read_fasta(spark, str(tmp_path / "r.fa"), 4)
    assert sorted(map(tuple, fa.collect())) == [("c1", 0, "ACGT"), ("c1", 1, "acgt"), ("c1", 2, "NN"), ("c2", 0, "TTTT")]
    s = spark.createDataFrame([(1, "c1", 2, 9), (2, "c9", 0, 3), (3, "c1", -5, 2), (4, "c2", 1, 99)], "id long, c string, a long, b long")
    assert {r.id: r.bases for r in files.fetch_bases(s, fa, ["id"], "c", "a", "b", 4).collect()} == {1: "GTACGTN", 2: "N", 3: "AC", 4: "TTT"}
    (tmp_path / "c1.x.bin").write_bytes(struct.pack("<6h", 0, 3, 3, 0, 5, 5))
    assert sorted(map(tuple, files.read_depth_files(spark, str(tmp_path / "c1.x.bin")).collect())) == [("c1", 1, 3, 3), ("c1", 4, 6, 5)]
    (tmp_path / "e.csv").write_text("event_id,svtype\n1,DEL\n")
    assert files.read_event_csv(spark, str(tmp_path / "e.csv"), "event_id long, svtype string").first()[:] == (1, "DEL")
    (tmp_path / "l.txt").write_text(f"{tmp_path}/a.bam\n{tmp_path}/own.bam\n{tmp_path}/x.bed\n")
    assert files.expand_paths(str(tmp_path / "l.txt"), leave_out=("own",)) == [f"{tmp_path}/a.bam"]
    assert files.sample_paths(["a", "b"], 5) == files.sample_paths(["a", "b"], 5) and files.sample_paths(["a"], -1) == ["a"]
    assert files.parse_region("chr1:1,000-2000") == ("chr1", 1000, 2000) and files.parse_region("chr1") == ("chr1", 0, None)


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chr1\t101\t7\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=301;SVLEN=-200;SU=3;PRECISE\tGT:GQ:SU\t0/1:30:9\t0/0:.:0
chr1\t500\t8\tN\t<TRA>\t5\tlowProb\tSVTYPE=BND;CHR2=chr2;CHR2_POS=900;SU=x\tGT\t0/1\t1/1
chr2\t50\t9\tN\t<DUP>\t.\tPASS\tSVTYPE=DUP:TANDEM;END=20;MeanPROB=0.8\tGT\t./.\t0/1
"""


def test_vcf_round_trip(spark, tmp_path):
    (tmp_path / "m.vcf").write_text(VCF)
    e = {(r.id, r["sample"]): r for r in vcf.read_events(spark, str(tmp_path / "m.vcf")).collect()}
    assert len(e) == 6
    a, b = e["7", "s1"], e["8", "s2"]
    assert (a.pos, a.end_pos, a.svtype, a.svlen, a.su, a.gq) == (100, 300, "DEL", -200, 9, "30") and e["7", "s2"].gq is None
    assert (b.svtype, b.chr2, b.end_pos, b.su, b.gt) == ("TRA", "chr2", 899, None, "1/1")
    assert vcf.read_events(spark, str(tmp_path / "m.vcf"), "s1").count() == 3
    s = {r.id: r for r in vcf.sites_of(vcf.read_events(spark, str(tmp_path / "m.vcf"), "s1")).collect()}
    assert set(s) == {"7", "9"} and (s["9"].start, s["9"].end, s["9"].svtype, s["9"].prob) == (19, 49, "DUP", 0.8) and s["7"].svlen == 200
    assert {r.id for r in vcf.sites_of(vcf.read_events(spark, str(tmp_path / "m.vcf"), "s1"), own_sample="s1").collect()} == {"9"}
    ev = vcf.read_events(spark, str(tmp_path / "m.vcf"), "s1")
    sink.write_vcf(sink.vcf_lines(ev), str(tmp_path / "out"), ["s1"])
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert text.startswith("##fileformat=VCFv4.2") and "chr1\t101\t7\tN\t<DEL>" in text
    back = {r.id: r for r in vcf.read_events(spark, str(tmp_path / "out")).collect()}
    assert set(back) == {"7", "8", "9"} and (back["7"].pos, back["7"].svtype, back["7"].gq) == (100, "DEL", "30") and back["8"].end_pos == 899 and back["7"].end_pos == 300


def test_info_last_value_of_a_repeated_key_counts(spark):
    m = spark.createDataFrame([(" A=1; B ;A=2;;C=x=y",), ("",), (None,), (".",)], "i string").select(vcf.info_map("i").alias("m")).collect()
    assert m[0].m == {"B": "", "A": "2", "C": "x=y"} and [r.m for r in m[1:]] == [None, None, None]


def test_whole_quality(spark):
    got = spark.createDataFrame([("30",), ("30.0",), (".",), (None,)], "g string").select(sink.whole_gq("g").alias("g")).collect()
    assert [r.g for r in got] == ["30", "30", ".", "."]


def test_multi_sample_labels_and_updates(spark, tmp_path):
    df = spark.createDataFrame([("c", 1, "s1", "0/1", 5), ("c", 2, "s2", "1/1", 6)], "chrom string, pos long, sample string, gt string, su long")
    got = {r.pos: (r.s1, r.s2) for r in sink.multi_sample(df, ["chrom", "pos"], "sample", ["s1", "s2"]).collect()}
    assert got[1][1] == sink.ABSENT and got[2][0] == sink.ABSENT and got[1][0].startswith("0/1:.:0:0:0:0:0:5:0")
    lab = spark.createDataFrame([("PASS", "x"), ("a", "x"), ("a", "a"), (None, None), ("a", None)], "f string, r string").select(sink.label(F.col("f"), F.col("r")).alias("l"))
    assert [r.l for r in lab.collect()] == ["x", "a;x", "a", "PASS", "a"]
    t = spark.createDataFrame([(1, 0.5, "a"), (2, 0.5, "b")], "id long, p double, g string")
    c = spark.createDataFrame([(1, 0.501, "z")], "id long, p double, g string")
    assert sorted(map(tuple, sink.update_values(t, c, ["id"], ["p", "g"]).collect())) == [(1, 0.5, "z"), (2, 0.5, "b")]
    sink.write_csv(df, str(tmp_path / "csv"), separate="sample")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sink.write_bed(df.select("chrom", "pos", "su"), str(tmp_path / "bed"))
    assert [tuple(r) for r in files.read_bed(spark, str(tmp_path / "bed")).collect()] == [("c", 1, 5), ("c", 2, 6)]


def test_options():
    o = Options.of("nanopore-r9", sd=0.7)
    assert (o.pl, o.dist_norm, o.sd, o.paired, o.mq) == ("nanopore", 900, 0.7, False, 1) and Options.of().paired
    with pytest.raises(ValueError):
        Options.of(no_such=1)
    with pytest.raises(ValueError):
        Options.of("none")
    assert len(PRESETS) == 5 and dict(o.shown())["sd"] == 0.7


def test_engine_finds_planted_events(spark, sam, tmp_path):
    eng = Engine(spark, min_support=3)
    e = eng.run(eng.read(sam), "alpha")
    got = {(r.svtype, r.chrom, r.chr2): r for r in e.collect()}
    assert set(got) == {("DEL", "c1", "c1"), ("TRA", "c1", "c2"), ("INS", "c1", "c1")}
    d, i = got["DEL", "c1", "c1"], got["INS", "c1", "c1"]
    assert abs(d.pos - 4103) <= 5 and abs(d.end_pos - 5603) <= 5 and d.pe == 8 and abs(d.svlen - 1500) <= 8
    assert i.pos == 12049 and i.svlen == 80 and i.wr == 5
    assert d.cov > 0 and d.gt in ("0/1", "1/1") and d.prob > 0
    include = spark.createDataFrame([("c1", 3000, 7000)], "chrom string, start long, end long")
    only = eng.run(eng.read(sam), "alpha", include=include)
    assert {r.svtype for r in only.collect()} == {"DEL"}
    none = eng.run(eng.read(sam), "alpha", include=include, exclude=include)
    assert none.count() == 0
    sites = spark.createDataFrame([("c1", 4110, "c1", 5600, "DEL", "site1", 1500, 0.9, 0), ("c1", 99, "c1", 200, "DUP", "site2", 101, 0.9, 1)], "chrom string, start long, chrom2 string, end long, svtype string, id string, svlen long, prob double, idx int")
    known = Engine(spark, min_support=3, all_sites=True).run(eng.read(sam), "alpha", sites=sites).collect()
    assert {r.site_id for r in known if r.site_id} == {"site1", "site2"} and [r.gt for r in known if r.site_id == "site2"] == ["0/0"]
    assert next(r.prob for r in known if r.site_id == "site1") > d.prob
    eng.write_vcf(e, str(tmp_path / "calls"), "alpha")
    back = {r.svtype: r for r in vcf.read_events(spark, str(tmp_path / "calls")).collect()}
    assert len(back) == 3 and {t: r.pos for t, r in back.items()} == {r.svtype: r.pos for r in got.values()}
    written = {r.value.split("\t")[4]: int(r.value.split("\t")[1]) for r in spark.read.text(str(tmp_path / "calls")).collect() if r.value[0] != "#"}
    assert written["<INS>"] == 12050 and abs(written["<DEL>"] - 4103) <= 4 and abs(written["<TRA>"] - 9103) <= 4  # 1-based, as planted: reads at 12000 match 50 bases before it


def ev(spark, rows):
    return as_events(spark.createDataFrame(rows, "event_id long, sample string, chrom string, pos long, chr2 string, end_pos long, svtype string, svlen long, su long, wr long, prob double, cov double, mapq double, filt string"))


def test_merge_and_filter(spark):
    rows = [(1, "a", "c", 1000, "c", 2000, "DEL", 1000, 9, 0, 0.9, 20.0, 60.0, "PASS"), (2, "a", "c", 9000, "c", 9000, "INS", 300, 9, 0, 0.9, 20.0, 60.0, "PASS"), (3, "a", "c", 30000, "c", 31000, "DUP", 1000, 3, 0, 0.9, 20.0, 60.0, "PASS")]
    other = [(1, "b", "c", 1020, "c", 2010, "DEL", 990, 5, 0, 0.5, 20.0, 60.0, "PASS"), (2, "b", "c", 9000, "c", 9000, "DUP", 300, 9, 0, 0.9, 20.0, 5.0, "PASS")]
    eng = Engine(spark)
    m = {(r.svtype, r.pos): r for r in eng.merge(ev(spark, rows), ev(spark, other)).collect()}
    assert len(m) == 4 and m["DEL", 1000].n_in_grp == 2 and m["DEL", 1000].su == 14 and m["DEL", 1000].mean_prob == pytest.approx((0.9 * 9 + 0.5 * 5) / 14)
    f = {(r.event_id, r.filt) for r in Engine(spark, keep_all=True).filter(ev(spark, rows), ev(spark, other)).collect()}
    assert f == {(1, "normalOverlap"), (2, "PASS"), (3, "lowSupport")}
    assert {r.event_id for r in eng.filter(ev(spark, rows), ev(spark, other)).collect()} == {2}
    reads = spark.createDataFrame([(1, "c", 8950, 9100, 0, 60, "50M290I50M", 0, "*", None)], "read_id long, rname string, start long, stop long, flag int, mapq int, cigar string, pnext int, rnext string, sa string")
    assert {r.filt for r in Engine(spark, keep_all=True).filter(ev(spark, rows[1:2]), None, reads).collect()} == {"normal"}


def test_long_normal_reads_put_calls_out(spark):
    """Low cover, low support inside reads, clips of the contig and poor alignment, each with its label."""
    rows = [(i, "a", "c", 1000 * i, "c", 1000 * i + 300, "DEL", 300, 9, 0, 0.9, 20.0, 60.0, "PASS") for i in (1, 10, 20, 30, 40)]
    e = ev(spark, rows).withColumn("wr", F.when(F.col("event_id") == 20, 1).otherwise(0)).withColumn("ct", F.lit("3to5"))
    e = e.withColumn("contig_a", F.when(F.col("event_id") == 30, "ACGTACGTAC" * 4 + ("gattacacat" * 6)))
    read = lambda i, at, n, cigar="1000M", nm=2, seq="*": [(100 * i + k, "c", at - 500, at + 500, 0, 60, cigar, 0, "*", None, nm, seq) for k in range(n)]
    reads = read(1, 1000, 2) + read(2, 10_000, 9) + read(3, 20_000, 9) + read(4, 30_000, 9) + read(5, 40_000, 9, nm=300)
    reads += [(999, "c", 29_500, 30_000, 0, 60, "500M60S", 0, "*", None, 1, "A" * 500 + "GATTACACAT" * 6)]
    n = spark.createDataFrame(reads, "read_id long, rname string, start long, stop long, flag int, mapq int, cigar string, pnext int, rnext string, sa string, nm int, seq string")
    got = {r.event_id: r.filt for r in Engine(spark, "pacbio-revio", keep_all=True).filter(e, None, n).collect()}
    assert got == {1: "lowSupport", 10: "PASS", 20: "lowSupport", 30: "normal", 40: "highDivergence"}


def test_fetch_keeps_depth_and_leaves_out_crowded_places(spark, sam):
    r = files.read_sam(spark, sam).withColumn("read_id", F.xxhash64("qname", "flag"))
    e, track = fetch(r, Options.of(max_cov=3))
    assert track.agg(F.max("depth")).first()[0] >= 8 and e.where("qname like 'd%' and flag = 97").count() < 8


def test_shell_commands(spark, sam, tmp_path):
    from strandloom.__main__ import main

    t = str(tmp_path)
    main(["--set", "min_support=3", "run", sam, f"{t}/a", "--sample", "s1"], spark)
    main(["--set", "min_support=3", "fetch", sam, f"{t}/st"], spark)
    main(["--set", "min_support=3", "call", f"{t}/st", f"{t}/b", "--sample", "s2"], spark)
    a, b = ({(r.svtype, r.pos, r.end_pos) for r in vcf.read_events(spark, f"{t}/{x}").collect()} for x in "ab")
    assert len(a) == 3 and a == b
    main(["merge", f"{t}/a", f"{t}/b", f"{t}/m"], spark)
    rows = vcf.long_samples(vcf.read_vcf(spark, f"{t}/m")).collect()
    assert {r["sample"] for r in rows} == {"s1", "s2"} and len(rows) == 6 and not any(r.value == sink.ABSENT for r in rows)
    main(["--overwrite", "filter", f"{t}/a", f"{t}/f", "--normal-vcf", f"{t}/b"], spark)
    assert vcf.read_events(spark, f"{t}/f").count() < 3
    with pytest.raises(Exception, match="exists"):
        main(["filter", f"{t}/a", f"{t}/f", "--normal-vcf", f"{t}/b"], spark)
