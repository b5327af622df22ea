"""python -m strandloom run | fetch | call | merge | filter: the workflows from a shell."""

from __future__ import annotations

import argparse
import ast

from pyspark.sql import functions as F

from .plans.config import PRESETS, Options
from .plans.pipelines import Engine, call, cohort_lines, events_of_vcf, fetch
from .session import build_session, materialize
from .sinks import files as sink
from .sources import files


def _value(text: str) -> tuple[str, object]:
    name, _, value = text.partition("=")
    try:
        return name, ast.literal_eval(value)
    except (ValueError, SyntaxError):
        return name, value


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("strandloom")
    p.add_argument("--master")
    p.add_argument("--preset", default="pe", choices=list(PRESETS))
    p.add_argument("--set", action="append", default=[], type=_value, metavar="OPTION=VALUE", help="options: " + ", ".join(n for n, _ in Options().shown()))
    p.add_argument("--overwrite", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name, inputs, text in (("run", "reads", "alignments to calls"), ("fetch", "reads", "reads with evidence and depth, as Parquet"), ("call", "staged", "calls from what fetch wrote")):
        s = sub.add_parser(name, help=text)
        s.add_argument(inputs)
        s.add_argument("out")
        s.add_argument("--sample", default="sample")
        s.add_argument("--search", help="BED of regions to look at")
        s.add_argument("--exclude", help="BED of regions to leave out")
        s.add_argument("--sites", help="VCF of known sites")
    s = sub.add_parser("merge", help="several VCF files to one cohort VCF")
    s.add_argument("vcf", nargs="+")
    s.add_argument("out")
    s = sub.add_parser("filter", help="calls that no normal sample shows")
    s.add_argument("vcf")
    s.add_argument("out")
    s.add_argument("--target-sample")
    s.add_argument("--normal-vcf", action="append", default=[])
    s.add_argument("--normal-reads")
    return p


def main(argv: list[str] | None = None, spark=None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or build_session(master=a.master)
    eng = Engine(spark, a.preset, **dict(a.set))
    mode = "overwrite" if a.overwrite else "errorifexists"
    bed = lambda p: files.read_bed(spark, p) if p else None
    if a.command in ("run", "call"):
        sites = eng.sites(a.sites, a.sample) if a.sites else None
        if a.command == "run":
            events = eng.run(eng.read(a.reads), a.sample, bed(a.search), bed(a.exclude), sites)
        else:
            events = call(spark.read.parquet(f"{a.staged}/reads"), spark.read.parquet(f"{a.staged}/depth"), eng.options, sample=a.sample)
        eng.write_vcf(materialize(events), a.out, a.sample, mode)
    elif a.command == "fetch":
        reads, track = fetch(eng.read(a.reads), eng.options, bed(a.search), bed(a.exclude))
        sink.stage_reads(reads, f"{a.out}/reads", mode)
        sink.write_depth(track, f"{a.out}/depth", "rname", mode)
    elif a.command == "merge":
        events = events_of_vcf(spark, a.vcf)
        events = materialize(events.withColumn("event_id", F.xxhash64("table_name", "sample", "event_id")))
        lines, samples = cohort_lines(events, eng.options)
        sink.write_vcf(lines, a.out, samples, mode)
    else:
        events = events_of_vcf(spark, a.vcf, a.target_sample)
        normals = events_of_vcf(spark, a.normal_vcf) if a.normal_vcf else None
        if normals is not None:  # a site is normal where any sample of these files has the variant
            normals = normals.where(~F.coalesce("gt", F.lit("./.")).isin("0/0", "0|0", "./."))
        reads = None
        if a.normal_reads:
            r, _ = fetch(eng.read(a.normal_reads), eng.options)
            reads = materialize(r)
        kept = materialize(eng.filter(events, normals, reads))
        sink.write_vcf(sink.vcf_lines(kept.withColumn("id", F.col("event_id").cast("string"))), a.out, [a.target_sample or "sample"], mode)


if __name__ == "__main__":
    main()
