"""Several values packed into one field: one row per value, with its place kept.

A field is read as a lattice over its tokens: quoted spans (atomic), words, numbers and the runs of characters between
them. Arcs are a pair (name, joiner, id), a quoted pair, an id alone, a name alone (no value) and a delimiter. All that
weighs the arcs is learned from the whole column by expectation-maximisation: how frequent each name is, how often it
comes with an id and how often alone, which runs of characters join and which part, and how often an id comes alone. A
Viterbi pass then picks the likeliest path of each field, so that one separator may join after one name and part after another.
That a comma and a colon join a name to an id is a rule of the format; it enters as prior counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of characters that join a name to the id after it, and how many joins each is worth before any field is read.
JOINERS, PRIOR = (",", ":"), 50.0
#: Names are counted in so many buckets by hash, whatever their number: names in one bucket share their counts.
BUCKETS = 1 << 13
#: How many occurrences the share of all names weighs against a name's own in how often it comes with an id.
BACK_OFF = 2.0
ROUNDS = 12

_TOKEN = re.compile(r'"(?:[^"]|"")*"|\'(?:[^\']|\'\')*\'|[\w.\-]+|[^\w.\-"\']+|["\']')
_ID = re.compile(r"\d+(?:\.0+)?")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_QUOTED_PAIR = re.compile(r"(.*)[,:]\s*(\d+(?:\.0+)?)\s*", re.DOTALL)
_BIG = 1 << 63
_LEAST = 1e-9


def _id(text: str) -> int | None:
    n = int(text.partition(".")[0])
    return n if n < _BIG else None


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def sep_class(text: str) -> str:
    """The characters of a run that are not blank, at most two of them and ? for any beyond ASCII, else the kind of blank: under 1,000 classes."""
    solid = "".join(text.split())
    if solid:
        return "".join(c if c < "\x7f" else "?" for c in solid[:2])
    return "\n" if "\n" in text else "\t" if "\t" in text else " "


def tokens(text: str) -> list[tuple[str, str, int | None]]:
    """(kind, name or separator class, id) of each token: kind is N name, I id, P quoted pair, S separator, X no value."""
    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        c = t[0]
        if c in "\"'" and len(t) > 1:
            inner = t[1:-1].replace(c + c, c)
            if (p := _QUOTED_PAIR.fullmatch(inner)) and (n := _id(p[2])) is not None:
                out.append(("P", p[1].rstrip(), n))
            elif _ID.fullmatch(inner) and (n := _id(inner)) is not None:
                out.append(("I", "", n))
            else:
                out.append(("N", inner, None) if inner.strip() else ("X", "", None))
        elif c.isalnum() or c in "_.-":
            if _ID.fullmatch(t):
                n = _id(t)
                out.append(("I", "", n) if n is not None else ("X", "", None))
            elif _NUMBER.fullmatch(t) or not any(x.isalnum() for x in t):
                out.append(("X", "", None))
            else:
                out.append(("N", t, None))
        else:
            out.append(("S", sep_class(t), None))
    return out


class Model:
    """Log weights of the arcs.

    join and part are the chances of each class of characters among joiners and among delimiters; bare is the chance that a
    value is an id alone; frequency and paired tell per bucket of names how frequent they are and how often an id comes with them.
    """

    def __init__(self, join: dict[str, float], part: dict[str, float], bare: float, frequency: np.ndarray, paired: np.ndarray) -> None:
        log = lambda d: {k: math.log(max(v, _LEAST)) for k, v in d.items()}
        self.join, self.part = log(join), log(part)
        self.bare, self.named = math.log(max(bare, _LEAST)), math.log(max(1 - bare, _LEAST))
        self.frequency = np.log(np.maximum(frequency, _LEAST))
        self.paired = np.clip(paired, _LEAST, 1 - _LEAST)
        self.known: dict[str, tuple[float, float]] = {}

    @staticmethod
    def plain(joiners: tuple[str, ...] = JOINERS) -> Model:
        """Without learning: those join and nothing else does."""
        return Model(dict.fromkeys(joiners, 1 / len(joiners)), {}, 0.5, np.full(BUCKETS, 1 / BUCKETS), np.full(BUCKETS, 0.5))

    def of(self, name: str) -> tuple[float, float]:
        """Log weights of the name with an id and alone."""
        got = self.known.get(name)
        if got is None:
            b = bucket(name)
            got = self.named + self.frequency[b] + math.log(self.paired[b]), self.named + self.frequency[b] + math.log(1 - self.paired[b])
            if len(self.known) < BUCKETS:
                self.known[name] = got
        return got

    def split(self, text: str | None) -> list[tuple[str | None, int]]:
        """(name or None, id) of the values, by the likeliest path through the lattice."""
        if not text:
            return []
        t = tokens(text)
        n = len(t)
        least = math.log(_LEAST)  # characters that were never seen part
        best: list[float] = [0.0] + [-math.inf] * n
        back: list[tuple[int, tuple | None]] = [(0, None)] * (n + 1)
        for i, (kind, word, ident) in enumerate(t):
            at = best[i]
            if kind == "N":
                pair, gain = self.of(word)
                if i + 2 < n and t[i + 1][0] == "S" and t[i + 2][0] == "I":
                    best[i + 3], back[i + 3] = at + pair + self.join.get(t[i + 1][1], 2 * least), (i, (word, t[i + 2][2]))
                value = None
            elif kind == "P":
                gain, value = self.of(word)[0] if word else 0.0, (word or None, ident)
            elif kind == "I":
                gain, value = self.bare, (None, ident)
            else:
                gain, value = self.part.get(word, least) if kind == "S" else 0.0, None
            if at + gain > best[i + 1]:
                best[i + 1], back[i + 1] = at + gain, (i, value)
        out, j = [], n
        while j:
            j, value = back[j]
            if value:
                out.append(value)
        return out[::-1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side of the learning. Kinds: open (name bucket, characters, before an id), pair (quoted), alone, bare (id) and part (characters)."""
    got: Counter = Counter()

    def flush() -> pa.RecordBatch:
        kind, name, sep = zip(*got)
        r = pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(name, pa.int32()), pa.array(sep, pa.string()), pa.array(got.values(), pa.int64())], names=["kind", "name", "sep", "n"])
        got.clear()
        return r

    for b in batches:
        for text in b.column(0).to_pylist():
            t = tokens(text) if text else []
            held = 0  # tokens that an open pair has used
            for i, (kind, word, _) in enumerate(t):
                if kind == "N":
                    if i + 2 < len(t) and t[i + 1][0] == "S" and t[i + 2][0] == "I":
                        got["open", bucket(word), t[i + 1][1]] += 1
                        held = i + 3
                    else:
                        got["alone", bucket(word), ""] += 1
                elif i < held:
                    continue
                elif kind == "S":
                    got["part", 0, word] += 1
                elif kind == "I":
                    got["bare", 0, ""] += 1
                elif kind == "P":
                    got["pair", bucket(word), ""] += 1
        if len(got) > 100_000:
            yield flush()
    if got:
        yield flush()


def learn(df: DataFrame, field: str, rounds: int = ROUNDS) -> Model:
    """Fit the arcs on the whole column, by one scan.

    What stands open is every name with characters and an id after it: one value with a joiner, or a name alone, a delimiter and
    an id alone. The E-step gives each (name, characters) its chance of being one value; the M-step re-estimates how often each
    name is paired (backing off to the share of all names), the use of each class of characters as joiner and as delimiter, and the rate of
    ids alone. Only counts by bucket of names and class of characters reach the driver, both bounded by construction. An empty
    column gives the prior.
    """
    counts = df.select(F.col(field).cast("string").alias("text")).mapInArrow(_count, "kind string, name int, sep string, n long").groupBy("kind", "name", "sep").agg(F.sum("n").alias("n"))
    rows = counts.collect()
    seps = sorted({*JOINERS, *(r["sep"] for r in rows if r["kind"] in ("open", "part"))})
    at = {s: i for i, s in enumerate(seps)}
    of = lambda k: [r for r in rows if r["kind"] == k]
    open_ = of("open")
    name, sep, n = (np.array([x[k] if k != "sep" else at[x[k]] for x in open_], np.int64) for k in ("name", "sep", "n"))
    pair, alone, part = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(len(seps))
    for kind, into in (("pair", pair), ("alone", alone)):
        for r in of(kind):
            into[r["name"]] += r["n"]
    for r in of("part"):
        part[at[r["sep"]]] += r["n"]
    bare = float(sum(r["n"] for r in of("bare")))
    first = np.array([PRIOR if s in JOINERS else 0.0 for s in seps])
    share = np.where(first[sep] > 0, 0.98, 0.5)
    for _ in range(rounds):
        joined, parted = share * n, (1 - share) * n
        p, a = pair + np.bincount(name, joined, BUCKETS), alone + np.bincount(name, parted, BUCKETS)
        every = (p.sum() + 1) / (p.sum() + a.sum() + 2)
        paired = (p + BACK_OFF * every) / (p + a + BACK_OFF)
        j, d = first + np.bincount(sep, joined, len(seps)) + 1e-3, part + np.bincount(sep, parted, len(seps)) + 1e-3
        join, delimit = j / j.sum(), d / d.sum()
        alone_id = (bare + parted.sum() + 1) / (bare + 2 * parted.sum() + joined.sum() + pair.sum() + alone.sum() + 2)
        one, two = paired[name] * join[sep], (1 - paired[name]) * delimit[sep] * alone_id
        share = one / (one + two)
    frequency = (pair + alone + np.bincount(name, n, BUCKETS) + 1e-3) / (pair.sum() + alone.sum() + n.sum() + 1e-3 * BUCKETS)
    return Model(dict(zip(seps, join.tolist())), dict(zip(seps, delimit.tolist())), alone_id, frequency, paired)


def _explode(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, name, ids = [], [], [], []
            for i, text in enumerate(b.column("__text").to_pylist()):
                for k, (w, n) in enumerate(model.split(text), 1):
                    at.append(i)
                    no.append(k)
                    name.append(w)
                    ids.append(n)
            kept = [b.column(c).take(pa.array(at, pa.int64())) for c in b.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(no, pa.int32()), pa.array(name, pa.string()), pa.array(ids, pa.int64())], names=[c for c in b.schema.names if c != "__text"] + ["item_no", "item_name", "item_id"])

    return run


def split_packed(df: DataFrame, field: str, keep: list[str], model: Model | None = None) -> DataFrame:
    """One row per value of `field`: the `keep` columns, item_no (its place from 1), item_name (null for an id alone), item_id.

    Null, empty and "none" fields give no rows; repeated values all count; names without an id and empty places take no
    place; ids above 63 bits are no ids. Rows are not deduplicated here: pass one row per key. Other columns are ignored.
    """
    model = model or learn(df, field)
    narrow = df.select(*keep, F.col(field).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != "__text")
    return narrow.mapInArrow(_explode(model), f"{fields}, item_no int, item_name string, item_id long")


def partners(events: DataFrame) -> DataFrame:
    """row_id, item_no, partner_table, partner_event_id: one row per partner of each row_id; an id alone belongs to the row's table."""
    once = events.select("row_id", "table_name", "partners").where("row_id is not null").dropDuplicates(["row_id"])
    items = split_packed(once, "partners", ["row_id", "table_name"], learn(events, "partners"))
    return items.select("row_id", "item_no", F.coalesce("item_name", "table_name").alias("partner_table"), F.col("item_id").alias("partner_event_id"))
