"""Sequence functions that built-in expressions cannot say: local alignment, infix edit distance, repeats, consensus.

Each has a plain Python/numpy kernel and a pandas UDF over it. Alignment cost is the product of the lengths; callers filter
pairs by cheap expressions first. Null sequences give null.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Match, mismatch, gap open and gap extension of the four uses of local alignment.
SCORES = {"default": (2, -3, 5, 2), "merge": (2, -3, 10, 1), "remap": (2, -8, 6, 1), "filter": (2, -3, 4, 1)}


def local_alignment(query: str, target: str, match: int = 2, mismatch: int = -3, gap_open: int = 5, gap_extend: int = 2) -> tuple[int, int, int, int, int]:
    """(score, query start, query end, target start, target end) of the best affine local alignment, ends exclusive; case is folded.

    A gap of n costs gap_open + (n - 1) gap_extend. Rows are computed as arrays; the gap along a row is a running maximum.
    Starts come from aligning the reversed prefixes.
    """
    score, qe, te = _best_end(query.upper(), target.upper(), match, mismatch, gap_open, gap_extend)
    if score == 0:
        return 0, 0, 0, 0, 0
    _, ql, tl = _best_end(query[:qe][::-1].upper(), target[:te][::-1].upper(), match, mismatch, gap_open, gap_extend, want=score)
    return score, qe - ql, qe, te - tl, te


def _best_end(q: str, t: str, match: int, mismatch: int, go: int, ge: int, want: int | None = None) -> tuple[int, int, int]:
    a, b = np.frombuffer(q.encode(), np.uint8), np.frombuffer(t.encode(), np.uint8)
    n = len(b)
    if not n or not len(a):
        return 0, 0, 0
    h, e = np.zeros(n + 1, np.int64), np.full(n + 1, -(10**9), np.int64)
    step = np.arange(n + 1) * ge
    best = (0, 0, 0)
    for i, base in enumerate(a, 1):
        e = np.maximum(e - ge, h - go)
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(h[:-1] + np.where(b == base, match, mismatch), 0)
        new = np.maximum(new, e)
        new[0] = 0
        # gap along the row: best over k < j of new[k] - go - (j - k - 1) ge
        run = np.maximum.accumulate(new + step)
        new[1:] = np.maximum(new[1:], run[:-1] - go - step[:-1])
        h = new
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), i, j)
            if want is not None and best[0] >= want:
                break
    return best


#: Cells of one row of the alignments that are computed together.
CELLS = 1 << 16


def local_alignments(texts: list[tuple[str, str]], match: int = 2, mismatch: int = -3, gap_open: int = 5, gap_extend: int = 2) -> list[tuple[int, int, int, int, int]]:
    """local_alignment of every pair of texts, many at a time; equal pairs are aligned once."""
    found = dict.fromkeys((a.upper(), b.upper()) for a, b in texts)
    fit = list(found)
    ends = _best_ends(fit, match, mismatch, gap_open, gap_extend)
    starts = _best_ends([(a[:qe][::-1], b[:te][::-1]) for (a, b), (_, qe, te) in zip(fit, ends)], match, mismatch, gap_open, gap_extend)
    for x, (score, qe, te), (_, ql, tl) in zip(fit, ends, starts):
        found[x] = (score, qe - ql, qe, te - tl, te) if score else (0, 0, 0, 0, 0)
    return [found[a.upper(), b.upper()] for a, b in texts]


def _best_ends(texts: list[tuple[str, str]], match: int, mismatch: int, go: int, ge: int) -> list[tuple[int, int, int]]:
    """_best_end of every pair. Pairs of about equal lengths stand side by side, padded with bytes that no text holds and that match nothing:
    behind an end no score exceeds the best before it."""
    out = [(0, 0, 0)] * len(texts)
    coded = [(np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)) for a, b in texts]
    order = sorted((i for i, (a, b) in enumerate(coded) if len(a) and len(b)), key=lambda i: (len(coded[i][1]), len(coded[i][0])))
    while order:
        k = max(1, CELLS // (len(coded[order[0]][1]) + 1))
        while k > 1 and k * (len(coded[order[min(k, len(order)) - 1]][1]) + 1) > 2 * CELLS:
            k //= 2
        some, order = order[:k], order[k:]
        n, m = (max(len(coded[i][side]) for i in some) for side in (1, 0))
        q, t = np.full((m, len(some)), 255, np.uint8), np.full((len(some), n), 254, np.uint8)
        for r, i in enumerate(some):
            q[: len(coded[i][0]), r], t[r, : len(coded[i][1])] = coded[i]
        h, e = np.zeros((len(some), n + 1), np.int32), np.full((len(some), n + 1), -(10**9), np.int32)
        step, rows = np.arange(n + 1, dtype=np.int32) * ge, np.arange(len(some))
        best, bi, bj = (np.zeros(len(some), np.int64) for _ in range(3))
        for i in range(m):
            e = np.maximum(e - ge, h - go)
            new = np.zeros_like(h)
            new[:, 1:] = np.maximum(h[:, :-1] + np.where(t == q[i][:, None], np.int32(match), np.int32(mismatch)), 0)
            new = np.maximum(new, e)
            new[:, 0] = 0
            run = np.maximum.accumulate(new + step, axis=1)
            new[:, 1:] = np.maximum(new[:, 1:], run[:, :-1] - go - step[:-1])
            h = new
            j = h.argmax(axis=1)
            v = h[rows, j]
            up = v > best
            best[up], bi[up], bj[up] = v[up], i + 1, j[up]
        for r, i in enumerate(some):
            out[i] = int(best[r]), int(bi[r]), int(bj[r])
    return out


def infix_distance(query: str, target: str) -> tuple[int, int]:
    """(fewest edits, end in the target) of the query against any part of the target."""
    n = len(target)
    b = np.frombuffer(target.encode("utf-32-le"), np.uint32)
    row = np.zeros(n + 1, np.int64)
    step = np.arange(n + 1)
    for i, ch in enumerate(np.frombuffer(query.encode("utf-32-le"), np.uint32), 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (b != ch), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    j = int(row.argmin())
    return int(row[j]), j


def repeat_score(seq: str) -> float:
    """How much of a sequence repeats itself nearby: for words of 2 to 6 bases, the mean over positions of exp(-distance to the
    last same word / 10), averaged over word lengths; 0 for none."""
    s = seq.upper()
    per = []
    for k in range(2, 7):
        last: dict[str, int] = {}
        total, n = 0.0, len(s) - k + 1
        for i in range(n):
            w = s[i : i + k]
            if w in last:
                total += float(np.exp(-(i - last[w] - 1) / 10))
            last[w] = i
        if n > 0:
            per.append(total / n)
    return sum(per) / len(per) if per else 0.0


def packed_percent(seq: str) -> float:
    """Size after zlib in percent of the size before; 0 for an empty sequence."""
    return 100.0 * len(zlib.compress(seq.encode())) / len(seq) if seq else 0.0


def short_repeat(seq: str, most: int = 6, copies: int = 3, least: int = 10) -> tuple[str, int, int, int, int]:
    """(motif, start, end, copies, expanded) of the longest run of a motif of 1 to `most` bases with at least `copies` copies and over
    `least` bases; expanded counts its bases in lower case (inserted). Ties: the shorter motif, the earlier run. No run: ('', 0, 0, 0, 0)."""
    s = seq.upper()
    best = ("", 0, 0, 0, 0)
    for k in range(1, most + 1):
        i = 0
        while i + k * copies <= len(s):
            j = i + k
            while j < len(s) and s[j] == s[j - k]:
                j += 1
            n = (j - i) // k
            if n >= copies and n * k > least and n * k > best[2] - best[1]:
                best = (s[i : i + k], i, i + n * k, n, sum(c.islower() for c in seq[i : i + n * k]))
            i = max(i + 1, j - k + 1)
    return best


def clip_is_good(qualities: list[int], least: int, width: int = 10, floor: int = 10, seq: str | None = None) -> bool:
    """whether a clip, its qualities outward from the boundary, has at least `least` good windows: windows of `width` count until
    their mean quality falls to `floor`, those of one base only do not count. Without qualities it passes."""
    if not qualities:
        return True
    q = np.asarray(qualities, float)
    w = min(width, len(q))
    means = np.convolve(q, np.ones(w) / w, "valid")
    good = 0
    for i, m in enumerate(means):
        if m <= floor:
            break
        if seq is None or len(set(seq[i : i + w].upper())) > 1:
            good += 1
    return good + w - 1 >= least


def contigs_match(a: str, b: str, least: int = 42, rel: float = 0.7, diff: int = 8) -> bool:
    """Whether two contigs tell one event: their best local alignment, with the part neither end overhangs as the expected length,
    covers `rel` of the expected score or falls short of it by at most `diff`; expected lengths under `least` never match."""
    return alignment_matches(local_alignment(a, b, *SCORES["merge"]), len(a), len(b), least, rel, diff)


def alignment_matches(alignment: tuple[int, int, int, int, int], len_a: int, len_b: int, least: int = 42, rel: float = 0.7, diff: int = 8) -> bool:
    """contigs_match by the alignment of the two."""
    score, qs, qe, ts, te = alignment
    if score == 0:
        return False
    expected = 2 * (min(qs, ts) + max(qe - qs, te - ts) + min(len_a - qe, len_b - te))
    return expected >= least and (score / expected > rel or expected - score <= diff)


def consensus(seqs: list[str], weights: list[int] | None = None, least: int = 50, cased: bool = False) -> str | None:
    """Consensus of overlapping sequences by heaviest path through their word graph.

    Every sequence is laid against the growing backbone by its best local alignment; columns vote by weight (copies of a sequence). Returns
    null under `least` bases. Ends seen by a single sequence are written in lower case; with `cased` the case of a base is voted too, and means
    what it means in the sequences (lower: clipped or inserted).
    """
    return voted(votes(seqs, weights, cased), sum(weights) if weights else len(seqs), least, cased)


def votes(seqs: list[str], weights: list[int] | None = None, cased: bool = False) -> list[dict[str, int]]:
    """The votes of the sequences by column of their backbone."""
    w = weights or [1] * len(seqs)
    return merge_votes([[{c: w[i]} for c in (seqs[i] if cased else seqs[i].upper())] for i in sorted(range(len(seqs)), key=lambda i: (-len(seqs[i]), seqs[i]))])


def merge_votes(parts: list[list[dict[str, int]]]) -> list[dict[str, int]]:
    """One table of votes of several, in order: each is laid by its leading bases against the backbone so far; what overhangs extends it."""
    columns = [dict(c) for c in parts[0]] if parts else []
    for part in parts[1:]:
        s = _leading(part)
        score, qs, qe, ts, te = local_alignment(s, _leading(columns))
        if score < 2 * min(20, len(s)) * 0.6:
            continue
        for k in range(min(qe - qs, te - ts)):  # an ungapped vote inside the aligned stretch
            for base, n in part[qs + k].items():
                columns[ts + k][base] = columns[ts + k].get(base, 0) + n
        if te == len(columns) and qe < len(s):
            columns += [dict(c) for c in part[qe:]]
        if ts == 0 and qs > 0:
            columns = [dict(c) for c in part[:qs]] + columns
    return columns


def _lead(column: dict[str, int]) -> str:
    """The base with most votes in either case, in the case that most of them have."""
    by: dict[str, int] = {}
    for c, n in column.items():
        by[c.upper()] = by.get(c.upper(), 0) + n
    best = max(by, key=lambda x: (by[x], x))
    return best.lower() if column.get(best.lower(), 0) > column.get(best, 0) else best


def _leading(columns: list[dict[str, int]]) -> str:
    return "".join(map(_lead, columns))


def voted(columns: list[dict[str, int]], copies: int, least: int = 50, cased: bool = False) -> str | None:
    """The consensus of columns of votes, from `copies` sequences in all."""
    if len(columns) < least:
        return None
    return "".join(b if cased or sum(c.values()) > 1 or copies == 1 else b.lower() for c, b in zip(columns, _leading(columns)))


def gap_upper_bound(gaps: list[tuple[int, int]], at: int, extend: int = 15, divergence: float = 0.02) -> int:
    """Length of the gap `at` with its neighbours added, walking outward while the stretch between stays within min(3 length,
    log2(1 + length)/divergence) and the neighbour is over `extend`. gaps: (start on the read, length) in order."""
    import math

    total = gaps[at][1]
    for step in (-1, 1):
        i = at + step
        while 0 <= i < len(gaps):
            reach = min(3 * total, math.log2(1 + total) / divergence)
            if abs(gaps[i][0] - gaps[at][0]) > reach:
                break
            if gaps[i][1] > extend:
                total += gaps[i][1]
            i += step
    return total


def bad_ends(matches: np.ndarray, limit: float, width: int = 2000) -> tuple[int, int]:
    """bases to leave out at the left and right end of an alignment (1 match, 0 not) because the rate of non-matches in the window from
    that end exceeds min(limit, max(0.008, 3 mean, mean + 3 sd))."""
    bad = 1 - np.asarray(matches, float)
    if not len(bad):
        return 0, 0
    w = min(width, len(bad))
    rate = np.convolve(bad, np.ones(w) / w, "valid")
    top = min(limit, max(0.008, 3 * rate.mean(), rate.mean() + 3 * rate.std()))
    over = rate > top
    left = int(np.argmin(over)) if not over.all() else len(over)
    right = int(np.argmin(over[::-1])) if not over.all() else len(over)
    return (left + w - 1 if left else 0), (right + w - 1 if right else 0)


def _two(kernel, returns: str):
    @F.pandas_udf(returns)
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernel(x, y) for x, y in zip(a, b)])

    return udf


def _one(kernel, returns: str):
    @F.pandas_udf(returns)
    def udf(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kernel(x) for x in a])

    return udf


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64(rows: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of every row of a matrix of bytes, under 32 a row."""
    n = rows.shape[1]
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    word = lambda a, b: sum((rows[:, i].astype(np.uint64) << np.uint64(8 * (i - a)) for i in range(a, b)), np.zeros(len(rows), np.uint64))
    h, at = word(0, 0) + _P5 + np.uint64(42 + n), 0
    for at in range(0, n - 7, 8):
        h = turn(h ^ (turn(word(at, at + 8) * _P2, 31) * _P1), 27) * _P1 + _P4
    at = n // 8 * 8
    if at + 4 <= n:
        h, at = turn(h ^ (word(at, at + 4) * _P1), 23) * _P2 + _P3, at + 4
    for i in range(at, n):
        h = turn(h ^ (word(i, i + 1) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _mer_hashes(text: str, m: int) -> np.ndarray:
    mers = [text[i : i + m].encode() for i in range(len(text) - m + 1)]
    out = np.zeros(len(mers), np.int64)
    for n in {len(x) for x in mers}:
        some = [i for i, x in enumerate(mers) if len(x) == n]
        out[some] = xxhash64(np.frombuffer(b"".join(mers[i] for i in some), np.uint8).reshape(-1, n))
    return out


def hashed_minimizers(texts: list[str | None], k: int, m: int) -> list[np.ndarray]:
    """The distinct minimizers of each text, by xxhash64 of its m-mers, in order of their value; the m-mers of all texts are hashed together."""
    out = [np.zeros(0, np.int64)] * len(texts)
    held = [i for i, t in enumerate(texts) if t is not None and len(t) >= m]
    if not held:
        return out
    size = np.array([len(texts[i]) - m + 1 for i in held])
    first = np.cumsum(size) - size
    plain = np.array([texts[i].isascii() for i in held])
    of = np.repeat(np.arange(len(held)), size)
    place = np.arange(len(of)) - first[of]
    buf = np.frombuffer("".join(texts[i] if p else "A" * len(texts[i]) for i, p in zip(held, plain)).encode(), np.uint8)
    h = xxhash64(np.lib.stride_tricks.sliding_window_view(buf, m)[np.arange(len(of)) + of * (m - 1)])
    for j in np.flatnonzero(~plain):
        h[first[j] : first[j] + size[j]] = _mer_hashes(texts[held[j]], m)
    low = h.copy()
    for d in range(1, k - m + 1):
        low[d:] = np.where(place[d:] >= d, np.minimum(low[d:], h[:-d]), low[d:])
    of, low = np.r_[of, np.arange(len(held))], np.r_[low, h[first + size - 1]]
    order = np.lexsort((low, of))
    of, low = of[order], low[order]
    new = np.r_[True, (of[1:] != of[:-1]) | (low[1:] != low[:-1])]
    for i, x in zip(held, np.split(low[new], np.searchsorted(of[new], np.arange(1, len(held))))):
        out[i] = x
    return out


def minimizers_udf(k: int, m: int):
    """Pandas UDF of hashed_minimizers."""

    @F.pandas_udf("array<bigint>")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(hashed_minimizers(list(texts), k, m), dtype=object)

    return udf


def udfs() -> dict:
    """Pandas UDFs by the name they are registered under."""
    return {
        "local_score": _two(lambda a, b: local_alignment(a, b)[0], "int"),
        "infix_distance": _two(lambda a, b: infix_distance(a, b)[0], "int"),
        "contigs_match": _two(contigs_match, "boolean"),
        "repeat_score": _one(repeat_score, "double"),
        "packed_percent": _one(packed_percent, "double"),
        "repeat_motif": _one(lambda s: short_repeat(s)[0], "string"),
        "repeat_bases": _one(lambda s: short_repeat(s)[2] - short_repeat(s)[1], "int"),
    }


def register(spark) -> None:
    """Make the sequence functions callable from SQL."""
    for name, f in udfs().items():
        spark.udf.register(name, f)


def merge_sorted(*streams):
    """K09 for iterators of (key, line): one ordered stream."""
    return heapq.merge(*streams)
