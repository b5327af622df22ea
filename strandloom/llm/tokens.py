"""Token ids of whole corpora by a public byte-level BPE vocabulary.

Forced boundaries: a byte pair that occurs inside no token of the vocabulary can never be merged across, so a text may be
cut between the two bytes wherever the pre-tokenizer is sure to give the same pieces on either side; the fragments are
encoded on their own and their ids put together again. Nearly every word starts with such a cut, so a batch of texts
falls into few distinct fragments: they are found, counted and put together with Arrow kernels over the text buffer, and
only fragments not met before by this worker are encoded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary files are; a parameter of every operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that parts text before merges, as the vocabulary's publisher gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text handled at once, and fragments a worker remembers.
SLICE_BYTES = 4 << 20
MEMORY = 400_000
#: Last bytes of characters that are white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_SPACE_ENDS = (0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def forced_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """For each pair of bytes (first * 256 + second), whether a cut between them changes nothing.

    The pair is inside no token, and the pre-tokenizer is safe: the first byte ends a character that is no white space
    and no apostrophe, the second starts a character that is no apostrophe. Then either the pattern parts the text here
    anyway, or the piece goes on in the same class of characters and is only parted sooner.
    """
    inside = np.zeros(65536, bool)
    for t in ranks:
        if len(t) > 1:
            b = np.frombuffer(t, np.uint8).astype(np.int64)
            inside[b[:-1] * 256 + b[1:]] = True
    first = np.zeros(256, bool)
    first[0x21:0x7F] = True
    first[0x80:0xC0] = True
    first[[0x27, *_SPACE_ENDS]] = False
    second = np.ones(256, bool)
    second[0x80:0xC0] = False
    second[0x27] = False
    return ~inside & np.repeat(first, 256) & np.tile(second, 256)


class Encoder:
    """Vocabulary, forced pairs and the fragments met so far, one per worker process and vocabulary."""

    def __init__(self, data: bytes) -> None:
        import tiktoken

        self.ranks = read_ranks(data)
        self.forced = forced_pairs(self.ranks)
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.known: dict[bytes, list[int]] = {}
        size = max(self.ranks.values()) + 1
        self.token_bytes = np.zeros(size, np.int32)
        for t, r in self.ranks.items():
            self.token_bytes[r] = len(t)

    def _ids(self, fragment: bytes) -> list[int]:
        got = self.known.get(fragment)
        if got is None:
            got = self.bpe.encode_ordinary(fragment.decode("utf-8", "replace"))
            if len(fragment) <= 64:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[fragment] = got
        return got

    def _slice(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between bounds (offsets into data), and the number of ids of each."""
        lo, hi = int(bounds[0]), int(bounds[-1])
        if lo == hi:
            return np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)
        buf = np.ascontiguousarray(data[lo:hi])
        pair = buf[:-1].astype(np.uint16) << 8 | buf[1:]
        mark = np.zeros(len(buf) + 1, bool)
        mark[1:-1] = self.forced[pair]
        mark[bounds - lo] = True
        offsets = np.flatnonzero(mark).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(buf)])
        coded = parts.dictionary_encode()
        each = [self._ids(f) for f in coded.dictionary.to_pylist()]
        lens = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((i for x in each for i in x), np.int32, int(lens.sum()))
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = lens[at]
        starts = np.cumsum(lens) - lens
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(int(ends[-1]))]
        upto = np.r_[0, ends][np.searchsorted(offsets, bounds - lo)]
        return ids, np.diff(upto)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(rows, ids one after another, number of ids of each row) of consecutive slices of the rows. Null is empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            yield to - at, *self._slice(data, offsets[at : to + 1])
            at = to


@lru_cache(maxsize=4)
def _encoder(data: bytes) -> Encoder:
    return Encoder(data)


_sent: dict[tuple, object] = {}


def vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary file as a broadcast variable (under 1 MB, whatever the corpus), so that only the driver needs the file."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        with open(path, "rb") as f:
            _sent[key] = spark.sparkContext.broadcast(f.read())
    return _sent[key]


def encoder_of(vocab) -> Encoder:
    return _encoder(vocab.value)


def _schema(df: DataFrame, keep: list[str], more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields), more])


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = VOCABULARY, out: str = "ids") -> DataFrame:
    """The `keep` columns and the ids (array of int) of every row's whole text, without special tokens, whose strings are ordinary text.

    Null and empty texts give an empty list; repeated rows are kept as they are; columns not in `keep` are ignored, so
    their names cannot clash. No shuffle: rows stay where they are read.
    """
    keep = keep or []
    vocab = vocabulary(df.sparkSession, path)

    def run(batches):
        enc = encoder_of(vocab)
        for b in batches:
            at = 0
            for rows, ids, n in enc.encode(b.column(len(keep))):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, rows) for c in b.columns[: len(keep)]), lists], names=[*b.schema.names[: len(keep)], out])
                at += rows

    return _narrow(df, text, keep).mapInArrow(run, _schema(df, keep, f"`{out}` array<int>"))


def token_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """As `encode`, with the number of ids instead of the ids."""
    keep = keep or []
    vocab = vocabulary(df.sparkSession, path)

    def run(batches):
        enc = encoder_of(vocab)
        for b in batches:
            at = 0
            for rows, _, n in enc.encode(b.column(len(keep))):
                yield pa.RecordBatch.from_arrays([*(c.slice(at, rows) for c in b.columns[: len(keep)]), pa.array(n, pa.int64())], names=[*b.schema.names[: len(keep)], out])
                at += rows

    return _narrow(df, text, keep).mapInArrow(run, _schema(df, keep, f"`{out}` long"))


def _narrow(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select(*keep, F.col(text).cast("string").alias("__text"))
