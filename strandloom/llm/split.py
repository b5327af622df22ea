"""Texts above a size limit as pieces under it, cut at natural boundaries, each piece beginning with the end of the one before.

Sizes are tokens of a public vocabulary; a text is encoded once. The separators form a hierarchy: section, paragraph or code block, line,
sentence, word, character. A text is parted at the first level; a part that is still too large is parted at the next, and so on
down to the character, so coarse parts stay whole where they fit. The parts are then packed greedily: a piece takes the overlap with the piece before and as many
parts as fit.

The limit holds for a piece as part of the text's tokens and when it is encoded again. Encoded again, only what lies outside the first and the last
certain cut of a piece (see tokens.forced_pairs) can come out in other tokens, so only those few bytes are encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import VOCABULARY, Encoder, _narrow, _schema, encoder_of, vocabulary

LIMIT = 2000
OVERLAP = 64
GRADES = ("section", "paragraph", "line", "sentence", "word", "character")
#: Where each grade of boundary may lie: at the end of a match, except where a section or code block starts.
_SECTION = re.compile(rb"\n(?=#{1,6} )|\n(?=(?:-{3,}|={3,}|\*{3,})[ \t]*\n)")
_PARAGRAPH = re.compile(rb"\n[ \t\r]*\n+|\n(?=```)|(?:^|\n)```[ \t]*\n")
_LINE = re.compile(rb"\n")
_SENTENCE = re.compile(rb"[.!?]['\")\]]*(?=\s)")
_WORD = re.compile(rb"(?<=[^ \t\r\n])(?=[ \t\r\n])")


def boundaries(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Grade (0 coarsest) of the cut after each token, given the byte each token ends at; 9 where the cut would part a character."""
    grade = np.full(len(data) + 1, 5, np.int8)
    raw = np.frombuffer(data, np.uint8)
    for level, pattern in ((4, _WORD), (3, _SENTENCE), (2, _LINE), (1, _PARAGRAPH), (0, _SECTION)):
        grade[[m.end() for m in pattern.finditer(data)]] = level
    grade[:-1][(raw & 0xC0) == 0x80] = 9
    return grade[ends]


def natural_parts(grade: np.ndarray, most: int, whole: np.ndarray | None = None) -> np.ndarray:
    """Ends of the parts (tokens after them), none over `most` tokens: a part too large at one level of the hierarchy is parted at the next.

    At the level of characters a part takes as many tokens as fit. `whole` are further ends of characters, which serve only where grade has
    none; where not even one character fits it is taken whole.
    """
    n = len(grade)
    ends = np.flatnonzero(grade < 9) + 1
    further = ends if whole is None else whole

    def last(of: np.ndarray, lo: int, most: int) -> int | None:
        i = int(np.searchsorted(of, lo + most, "right")) - 1
        return int(of[i]) if i >= 0 and of[i] > lo else None

    def part(lo: int, hi: int, level: int) -> list[int]:
        if hi - lo <= most:
            return [hi]
        if level == len(GRADES) - 1:
            out = []
            while hi - lo > most:
                to = last(ends, lo, most) or last(further, lo, most)
                if to is None:
                    i = int(np.searchsorted(further, lo, "right"))
                    to = int(further[i]) if i < len(further) else hi
                if to >= hi:
                    break
                lo = to
                out.append(lo)
            return [*out, hi]
        inner = lo + 1 + np.flatnonzero(grade[lo : hi - 1] <= level)
        out, at = [], lo
        for end in [*inner.tolist(), hi]:
            out += part(at, end, level + 1) if end - at > most else [end]
            at = end
        return out

    return np.array(part(0, n, 0), np.int64)


def pack(ends: np.ndarray, limit: int, overlap: int, fits, cuts: np.ndarray, clean: np.ndarray) -> list[tuple[int, int]]:
    """(first token, token after the last) of each piece: the overlap and as many parts as fit. fits(first, after) may refuse a piece; then a part less is
    taken, then characters less of the one part (ends in `cuts`), then overlap less (from where `clean` says that a character begins)."""
    out, start, fresh, i, n = [], 0, 0, 0, int(ends[-1])
    while fresh < n:
        j = max(i, int(np.searchsorted(ends, start + limit, "right")) - 1)
        after = int(ends[j])
        while not (after - start <= limit and fits(start, after)):
            if j > i:
                j -= 1
                after = int(ends[j])
                continue
            k = int(np.searchsorted(cuts, min(after - 1, start + limit), "right")) - 1
            if k >= 0 and cuts[k] > fresh:
                after = int(cuts[k])
            elif start < fresh:
                start, j = start + max(1, (fresh - start) // 2), i
                while start < fresh and not clean[start]:
                    start += 1
                after = int(ends[i])
            else:
                raise ValueError("a single character is over the limit")
        out.append((start, after))
        if after == ends[j]:
            i = j + 1
        fresh, start = after, max(after - overlap, 0)
        while start < fresh and not clean[start]:
            start += 1
    return out


def certain_cuts(enc: Encoder, data: bytes) -> np.ndarray:
    """Whether a cut before each byte leaves the tokens of both sides as they are."""
    raw = np.frombuffer(data, np.uint8)
    sure = np.ones(len(data) + 1, bool)
    sure[1:-1] = enc.forced[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
    return sure


def pieces(enc: Encoder, text: str, ids: np.ndarray, limit: int, overlap: int) -> list[tuple]:
    """(first token, tokens, overlap tokens, grade, text) of the pieces of a text of more than `limit` tokens."""
    data = text.encode()
    begin = np.r_[0, np.cumsum(enc.token_bytes[ids])]
    grade = boundaries(data, begin[1:])
    whole = np.flatnonzero(grade < 9) + 1
    # cuts after which the overlap begins with a whole character go before the rest
    clean = np.r_[True, grade < 9]
    grade = np.where(clean[np.maximum(np.arange(1, len(grade) + 1) - overlap, 0)], grade, 9)
    sure = certain_cuts(enc, data)
    firm = np.flatnonzero(sure[begin])  # tokens that begin at a certain cut

    def size(a: int, b: int) -> int:
        return len(enc.bpe.encode_ordinary(data[begin[a] : begin[b]].decode("utf-8", "replace"))) if a < b else 0

    def fits(a: int, b: int) -> bool:
        lo, hi = int(firm[np.searchsorted(firm, a)]), int(firm[np.searchsorted(firm, b, "right") - 1])
        if lo >= hi:
            return size(a, b) <= limit
        return size(a, lo) + (hi - lo) + size(hi, b) <= limit

    out, before = [], 0
    for a, b in pack(natural_parts(grade, max(1, limit - overlap), whole), limit, overlap, fits, whole, clean):
        out.append((a, b - a, before - a if before else 0, GRADES[min(grade[b - 1], 5)] if b < len(ids) else "end", data[begin[a] : begin[b]].decode("utf-8", "replace")))
        before = b
    return out


def split_texts(df: DataFrame, text: str = "text", keep: list[str] | None = None, limit: int = LIMIT, overlap: int = OVERLAP, path: str = VOCABULARY, whole: bool = False) -> DataFrame:
    """One row per piece: the `keep` columns, piece_no (from 1), first_token, n_tokens, n_overlap, cut_at, piece.

    Texts of at most `limit` tokens give no rows, or with `whole` their one piece; null texts give none, nor do empty
    ones. Every piece has at most `limit` tokens, both as a part of the whole text's tokens and when encoded again;
    every piece but the first begins with the last `overlap` tokens of the one before; without these overlaps the pieces
    are the text. Only where the overlap would begin inside a character, or a single character would not fit beside it, is it shorter; a limit under the tokens of one
    character is an error. Columns not in `keep` are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    keep = keep or []
    vocab = vocabulary(df.sparkSession, path)
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(vocab)
        for b in batches:
            at = 0
            for rows, ids, n in enc.encode(b.column(k)):
                take, cols = [], [[] for _ in range(6)]
                upto = np.r_[0, np.cumsum(n)]
                for i in np.flatnonzero(n > 0 if whole else n > limit):
                    own = ids[upto[i] : upto[i + 1]]
                    body = b.column(k)[at + int(i)].as_py()
                    for no, p in enumerate(pieces(enc, body, own, limit, overlap) if len(own) > limit else [(0, len(own), 0, "end", body)], 1):
                        take.append(at + int(i))
                        for c, v in zip(cols, (no, *p)):
                            c.append(v)
                if take:
                    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(take)) for c in b.columns[:k]), *(pa.array(c, t) for c, t in zip(cols, types))], names=[*b.schema.names[:k], "piece_no", "first_token", "n_tokens", "n_overlap", "cut_at", "piece"])
                at += rows

    return _narrow(df, text, keep).mapInArrow(run, _schema(df, keep, "piece_no int, first_token int, n_tokens int, n_overlap int, cut_at string, piece string"))
