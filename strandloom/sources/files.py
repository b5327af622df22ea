"""File sources: alignments (SAM, BAM), variants (VCF), regions (BED), exons (GFF3), sequences (FASTA), depth files, CSV events.

Text formats are read by Spark's own splittable text reader and parsed with built-in expressions; gz files are read whole by one task each, as
the codec demands. BAM is binary and read by a DataSource, one partition per file, in Arrow batches. Files that Python opens (BAM, FASTA, lists) may
lie on any file system Arrow knows. Positions of every reader, those inside SA tags too, count from 0.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import itertools
import os
import random
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window as W

#: The columns of an alignment record.
READS = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, nm int, as_ int, sa string, xa string, hp int, ps int, md string, rg string"
_TAGS = {"nm": "NM", "as_": "AS", "sa": "SA", "xa": "XA", "hp": "HP", "ps": "PS", "md": "MD", "rg": "RG"}
BATCH_ROWS = 10_000
_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), os.path.abspath(path))


def list_files(pattern: str) -> list[str]:
    """Files of a path, of a directory, or of a pattern in the last part of a path, in order; on any file system Arrow knows."""
    system, path = _opened(pattern)
    head = pattern[: len(pattern) - len(path)] if pattern.endswith(path) else ""
    if any(c in path for c in "*?["):
        folder, last = path.rsplit("/", 1)
        found = [f.path for f in system.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)) if f.is_file and fnmatch.fnmatch(f.base_name, last)]
    else:
        info = system.get_file_info(path)
        found = [path] if info.is_file else [f.path for f in system.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True)) if f.is_file]
    return sorted(head + f for f in found)


def list_folders(path: str) -> list[str]:
    """Folders right under a path, in order."""
    system, inner = _opened(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(head + f.path for f in system.get_file_info(arrow_fs.FileSelector(inner, allow_not_found=True)) if f.type == arrow_fs.FileType.Directory)


def _last_of_each(entries: Column) -> Column:
    """MAP of an array of structs (k, v); of a repeated key the last counts, whatever the session says of repeated keys."""
    keys = F.transform(entries, lambda e: e["k"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), e["k"])))


def zero_based_sa(sa: Column) -> Column:
    """An SA tag with its positions counted from 0; blocks that are none stay as they are."""
    def one(block: Column) -> Column:
        f = F.split(block, ",")
        at = F.get(f, F.lit(1)).try_cast("int")
        return F.when((F.size(f) == 6) & at.isNotNull(), F.array_join(F.transform(f, lambda x, i: F.when(i == 1, (at - 1).cast("string")).otherwise(x)), ",")).otherwise(block)

    return F.array_join(F.transform(F.split(sa, ";"), one), ";")


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of SAM text, header lines left out; tags as typed columns and all of them, as they are, in the map `tags` (of a repeated tag
    the last); file is where a row came from. pos and pnext count from 0, -1 is none."""
    line = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.col("_metadata.file_path").alias("file")).where(~F.get("f", F.lit(0)).startswith("@") & (F.size("f") >= 11))
    each = F.transform(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring_index(t, ":", 1).alias("k"), F.regexp_extract(t, "^[^:]*:[^:]*:(.*)$", 1).alias("v")))
    kinds = dict(x.split(" ") for x in READS.split(", "))

    def core(i: int, c: str) -> Column:
        v = F.get("f", F.lit(i)).try_cast(kinds[c])
        return (v - 1 if c in ("pos", "pnext") else v).alias(c)

    def tag(c: str, t: str) -> Column:
        v = F.try_element_at("tags", F.lit(t))
        return (zero_based_sa(v) if c == "sa" else v.try_cast(kinds[c])).alias(c)

    rows = line.withColumn("each", each).select("f", "file", _last_of_each(F.col("each")).alias("tags"))
    return rows.select(*(core(i, c) for i, c in enumerate(list(kinds)[:11])), "tags", "file").select(*list(kinds)[:11], *(tag(c, t) for c, t in _TAGS.items()), "tags", "file")


def sam_samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """File, sample: the SM of the first @RG line, else the stem of the file name; further files of a name get _1, _2, ..."""
    head = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    own = head.groupBy("file").agg(F.min(F.when(F.col("value").startswith("@RG"), F.regexp_extract("value", "\tSM:([^\t]+)", 1))).alias("sm"))
    stem = F.regexp_extract("file", "([^/]+?)(?:\\.[^./]+)?$", 1)
    named = own.select("file", F.coalesce(F.nullif("sm", F.lit("")), stem).alias("name"))
    n = F.row_number().over(W.partitionBy("name").orderBy("file")) - 1
    return named.select("file", F.when(n == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), n.cast("string"))).alias("sample"))


def is_paired(reads: DataFrame, group: list[str]) -> DataFrame:
    """Group, paired: whether any read has a proper pair, reverse mate or second-in-pair flag (162) or a mate position."""
    return reads.groupBy(*group).agg(F.bool_or((F.col("flag").bitwiseAND(162) != 0) | (F.coalesce("pnext", F.lit(0)) > 0)).alias("paired"))


def _bam_records(path: str) -> Iterator[tuple]:
    system, inner = _opened(path)
    with system.open_input_stream(inner, compression=None) as raw, gzip.open(raw, "rb") as f:  # BGZF blocks are gzip members
        if f.read(4) != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        f.read(struct.unpack("<i", f.read(4))[0])
        names = []
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            n = struct.unpack("<i", f.read(4))[0]
            names.append(f.read(n)[:-1].decode())
            f.read(4)
        ref = lambda i: names[i] if i >= 0 else "*"
        while head := f.read(4):
            b = f.read(struct.unpack("<i", head)[0])
            rid, pos, l_name, mapq, _, n_cig, flag, l_seq, nrid, npos, tlen = struct.unpack_from("<iiBBHHHiiii", b)
            at = 32
            name = b[at : at + l_name - 1].decode()
            at += l_name
            cig = "".join(f"{v >> 4}{_OPS[v & 15]}" for v in struct.unpack_from(f"<{n_cig}I", b, at)) or "*"
            at += 4 * n_cig
            raw = b[at : at + (l_seq + 1) // 2]
            seq = "".join(_BASES[x >> 4] + _BASES[x & 15] for x in raw)[:l_seq] or "*"
            at += len(raw)
            q = b[at : at + l_seq]
            qual = "*" if not q or q[0] == 255 else bytes(x + 33 for x in q).decode()
            tags = _bam_tags(b, at + l_seq)
            mate = "=" if nrid == rid and nrid >= 0 else ref(nrid)
            num = lambda t: int(tags[t]) if t in tags else None
            yield (name, flag, ref(rid), pos, mapq, cig, mate, npos, tlen, seq, qual, num("NM"), num("AS"), _zero_based(tags.get("SA")), tags.get("XA"), num("HP"), num("PS"), tags.get("MD"), tags.get("RG"))


def _zero_based(sa: str | None) -> str | None:
    """zero_based_sa for a plain string."""
    if sa is None:
        return None
    blocks = [b.split(",") for b in sa.split(";")]
    return ";".join(",".join([*f[:1], str(int(f[1]) - 1), *f[2:]] if len(f) == 6 and f[1].lstrip("-").isdigit() else f) for f in blocks)


def _bam_tags(b: bytes, at: int) -> dict[str, object]:
    size = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    out: dict[str, object] = {}
    while at < len(b):
        tag, kind = b[at : at + 2].decode(), chr(b[at + 2])
        at += 3
        if kind in size:
            out[tag] = struct.unpack_from("<" + size[kind], b, at)[0]
            at += struct.calcsize(size[kind])
        elif kind == "A":
            out[tag] = chr(b[at])
            at += 1
        elif kind in "ZH":
            end = b.index(0, at)
            out[tag] = b[at:end].decode()
            at = end + 1
        elif kind == "B":
            sub, n = size[chr(b[at])], struct.unpack_from("<i", b, at + 1)[0]
            out[tag] = list(struct.unpack_from(f"<{n}{sub}", b, at + 5))
            at += 5 + n * struct.calcsize(sub)
        else:
            raise ValueError(f"tag type {kind}")
    return out


class BamSource(DataSource):
    """spark.dataSource.register(BamSource); spark.read.format("bam").load(path or glob)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options["path"])


class _BamReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in list_files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32()}
        names, types = zip(*((n, kinds[k]) for n, k in (x.split(" ") for x in READS.split(", "))))
        records = _bam_records(partition.value)
        while rows := list(itertools.islice(records, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))


def read_bed(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """Chrom, start, end of BED text or gz; comment lines are left out. Not strict: rows whose ends are no numbers are left out, else they fail."""
    f = spark.read.text(path).where("value <> '' and not startswith(value, '#') and not startswith(value, 'track') and not startswith(value, 'browser')").select(F.split("value", "\t").alias("f"))
    num = lambda i: (F.get("f", F.lit(i)).cast("long") if strict else F.try_element_at("f", F.lit(i + 1)).try_cast("long"))
    b = f.select(F.get("f", F.lit(0)).alias("chrom"), num(1).alias("start"), num(2).alias("end"))
    return b if strict else b.where("start is not null and end is not null")


def read_gff_exons(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Chrom, start (0-based), end, strand, transcript_id, gene_name of the exon rows of GFF3."""
    f = spark.read.text(path).where("not startswith(value, '#')").select(F.split("value", "\t").alias("f")).where((F.size("f") >= 9) & (F.get("f", F.lit(2)) == "exon"))
    attr = lambda k: F.nullif(F.regexp_extract(F.get("f", F.lit(8)), f"(?:^|;)\\s*{k}=([^;]*)", 1), F.lit(""))
    return f.select(F.get("f", F.lit(0)).alias("chrom"), (F.get("f", F.lit(3)).cast("long") - 1).alias("start"), F.get("f", F.lit(4)).cast("long").alias("end"), F.get("f", F.lit(6)).alias("strand"), attr("transcript_id").alias("transcript_id"), attr("gene_name").alias("gene_name")).where("transcript_id is not null")


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """Name, chunk, seq: the sequences in pieces of `chunk` bases. A task streams its file; nothing is held but one piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                yield from _fasta_pieces(p, chunk)

    paths = list_files(path)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, "name string, chunk long, seq string")


def _fasta_pieces(path: str, chunk: int) -> Iterator[pa.RecordBatch]:
    def batch(name, no, seq):
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([no], pa.int64()), pa.array([seq])], names=["name", "chunk", "seq"])

    name, no, held = None, 0, ""
    system, inner = _opened(path)
    with system.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else None) as raw, io.TextIOWrapper(raw) as f:
        for line in f:
            if line[0] == ">":
                if name is not None and held:
                    yield batch(name, no, held)
                name, no, held = line[1:].split()[0], 0, ""
                continue
            held += line.strip()
            while len(held) >= chunk:
                yield batch(name, no, held[:chunk])
                no, held = no + 1, held[chunk:]
    if name is not None and held:
        yield batch(name, no, held)


def fetch_bases(spans: DataFrame, fasta: DataFrame, row: list[str], chrom: str, start: str, end: str, chunk: int = 1 << 16) -> DataFrame:
    """Row, bases (upper case) of [start, end), by an equi-join on the pieces a span touches; N where nothing is known of the chromosome."""
    s = spans.select(*row, F.col(chrom).alias("__c"), F.greatest(F.lit(0), F.col(start)).alias("__s"), F.col(end).alias("__e"))
    e = s.withColumn("__k", F.explode(F.sequence(F.floor(F.col("__s") / chunk), F.floor((F.greatest("__e", F.col("__s") + 1) - 1) / chunk))))
    j = e.join(fasta.select(F.col("name").alias("__n"), F.col("chunk").alias("__j"), "seq"), (F.col("__c") == F.col("__n")) & (F.col("__k") == F.col("__j")))
    lo = F.greatest(F.lit(0), F.col("__s") - F.col("__k") * chunk)
    hi = F.least(F.lit(chunk), F.col("__e") - F.col("__k") * chunk)
    part = F.struct("__k", F.substring("seq", (lo + 1).cast("int"), F.greatest(F.lit(0), hi - lo).cast("int")).alias("b"))
    got = j.groupBy(*row).agg(F.upper(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["b"]), "")).alias("bases"))
    return spans.select(*row).join(got, row, "left").select(*row, F.coalesce(F.nullif("bases", F.lit("")), F.lit("N")).alias("bases"))


def read_depth_files(spark: SparkSession, path: str, bin_size: int = 10) -> DataFrame:
    """Chrom, bin, to_bin, depth (runs above 0) of binary depth files, little-endian int16 per bin, one file per chromosome named <chrom>.*.bin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                d = np.frombuffer(data, "<i2").astype(np.int64)
                at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
                to = np.r_[at[1:], len(d)]
                keep = d[at] > 0
                yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(p).split(".")[0]] * int(keep.sum())), pa.array(at[keep]), pa.array(to[keep]), pa.array(d[at][keep])], names=["chrom", "bin", "to_bin", "depth"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "chrom string, bin long, to_bin long, depth long")


def read_event_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """Events from CSV with a header; give a schema for large inputs, for inferring one reads the data twice."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def expand_paths(spec: str, extensions: tuple[str, ...] = (".bam", ".cram", ".sam"), leave_out: tuple[str, ...] = ()) -> list[str]:
    """Files of a glob, of a directory, or of a text file that lists them; only those extensions, without files whose stem is in leave_out."""
    if spec.endswith(".txt"):
        system, inner = _opened(spec)
        with system.open_input_stream(inner) as f:
            found = [x.strip() for x in f.read().decode().splitlines() if x.strip()]
    else:
        found = list_files(spec)
    stem = lambda p: os.path.splitext(os.path.basename(p))[0]
    return [p for p in found if p.endswith(extensions) and stem(p) not in leave_out]


def sample_paths(paths: list[str], n: int, seed: int = 42) -> list[str]:
    """N of the files, with replacement; all of them for a negative n."""
    return list(paths) if n < 0 or not paths else random.Random(seed).choices(paths, k=n)


def parse_region(text: str) -> tuple[str, int, int | None]:
    """Chrom:start-end, chrom:start or chrom."""
    chrom, _, span = text.rpartition(":") if ":" in text else (text, "", "")
    lo, _, hi = span.replace(",", "").partition("-")
    return chrom, int(lo) if lo else 0, int(hi) if hi else None
