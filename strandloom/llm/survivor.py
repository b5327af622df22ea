"""One surviving record per group of duplicates, its values chosen field by field.

Every source that says anything of a field of a group claims the values it gives and, silently, denies the others. A
latent truth model gives each source two qualities per field, sensitivity (true values it claims) and false-positive rate
(false values it claims), and each value a probability of being true; expectation-maximisation fits both. Values are
judged on their own, so several values of one field may be true together. The denials are never written out: a value
starts from the sum of what all sources of its group would add by denying it, and each claim corrects that.

Two survivors come out beside each other. One takes, per field, the first value in a given trust order, and its probability: where an answer is
fixed by rank, no quality model can give it. The other is the model's own: per field the likeliest value, the trust order parting ties only, and the number of
values judged true.

Groups of up to SMALL records are laid down once as one row each; every round of the fit is then one pass over that table, by
array kernels, and only sums per source are shuffled. Larger groups are never brought together: their claims stay rows,
and the same sums are taken by joins and aggregations that combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_broadcast, materialize

ROUNDS = 6
#: Records of a group up to which it is one row, and sources up to which their qualities go to the tasks; beyond either, rows and joins do the same.
SMALL = 512
SOURCE_BOUND = 100_000
#: Priors as counts: true values claimed and not, false values claimed and not, true and false values. First qualities.
SENSITIVITY, FALSE_CLAIMS, TRUTH = (5.0, 5.0), (1.0, 9.0), (1.0, 1.0)
FIRST = (0.7, 0.2)
_EDGE = 1e-4
#: Probabilities this near each other are one for the choice of a value, so that the order of sums decides nothing.
_DIGITS = 9
JUDGED_TRUE = 0.5


class _Batch:
    """The claims of the groups of a batch, one field after another, as arrays."""

    def __init__(self, batch: pa.RecordBatch, fields: int) -> None:
        c = batch.column(1)
        flat = c.flatten()
        self.n = np.diff(np.asarray(c.offsets)).astype(np.int64)
        self.group = np.repeat(np.arange(len(self.n)), self.n)
        src = flat.field("src").dictionary_encode()
        self.names = src.dictionary.to_pylist()
        self.src = src.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat, self.fields = flat, fields

    def field(self, i: int) -> tuple:
        """Rows with a value; for each its value's number; per value its group and text; (value, source) and (group, source) pairs once."""
        v = self.flat.field(f"v{i}")
        at = np.flatnonzero(pc.is_valid(v).to_numpy(zero_copy_only=False))
        coded = v.take(pa.array(at)).dictionary_encode()
        g, s = self.group[at], self.src[at]
        text = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        width = max(1, len(coded.dictionary))
        both, val = np.unique(g * width + text, return_inverse=True)
        wide = max(1, len(self.names))
        vs, gs = np.unique(val * wide + s), np.unique(g * wide + s)
        return at, val, both // width, (coded.dictionary, both % width), (vs // wide, vs % wide), (gs // wide, gs % wide)

    def truth(self, f: tuple, quality: dict) -> np.ndarray:
        """E-step: probability of each value."""
        _, _, of, _, (vv, vs), (gg, gs) = f
        q = np.array([quality.get(n, FIRST) for n in self.names]).reshape(-1, 2)
        deny = np.log((1 - q[:, 0]) / (1 - q[:, 1]))
        more = np.log(q[:, 0] / q[:, 1]) - deny
        base = np.bincount(gg, deny[gs], len(self.n))
        logit = np.log(TRUTH[0] / TRUTH[1]) + base[of] + np.bincount(vv, more[vs], len(of))
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _sums(quality, fields: int):
    """Per field and source over the task's groups: tp, fp (of its claims), t, f (of all values of its groups)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quality.value
        sums: dict[tuple[int, str], np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            m = np.array(list(sums.values())).reshape(-1, 4)
            r = pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.string()), *(pa.array(m[:, j]) for j in range(4))], names=["field", "src", "tp", "fp", "t", "f"])
            sums.clear()
            return r

        for batch in batches:
            b = _Batch(batch, fields)
            for i in range(fields):
                f = b.field(i)
                _, _, of, _, (vv, vs), (gg, gs) = f
                p = b.truth(f, q[i])
                t, w, n = np.bincount(of, p, len(b.n)), np.bincount(of, 1 - p, len(b.n)), len(b.names)
                new = np.stack([np.bincount(vs, p[vv], n), np.bincount(vs, 1 - p[vv], n), np.bincount(gs, t[gg], n), np.bincount(gs, w[gg], n)], 1)
                for k in np.unique(gs).tolist():
                    key = (i, b.names[k])
                    sums[key] = sums[key] + new[k] if key in sums else new[k]
            if len(sums) > SOURCE_BOUND:
                yield flush()
        if sums:
            yield flush()

    return run


def _values(quality, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch, len(fields))
            for i, name in enumerate(fields):
                f = b.field(i)
                _, _, of, (texts, text), (vv, _), _ = f
                p = b.truth(f, quality.value[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array([name] * len(of), pa.string()), texts.take(pa.array(text)).cast(pa.string()), pa.array(np.bincount(vv, minlength=len(of))), pa.array(p)], names=["g", "field", "value", "n_src", "p"])

    return run


def _survivors(quality, fields: list[str], width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch, len(fields))
            keys = lambda rank: [rank.field(f"t{j}").to_numpy(zero_copy_only=False) for j in range(width)][::-1]

            def first(group: np.ndarray, rank: pa.StructArray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
                """Groups that occur, and the place of the first row of each by `before`, then by rank."""
                order = np.lexsort([*keys(rank), *([] if before is None else [before]), group])
                which, at = np.unique(group[order], return_index=True)
                return which, order[at]

            which, at = first(b.group, b.flat.field("rank"))
            keep = np.flatnonzero(b.n[which] >= least)
            cols = [batch.column(0).take(pa.array(which[keep])), b.flat.field("rec").take(pa.array(at[keep])), pa.array(b.n[which[keep]])]
            for i in range(len(fields)):
                f = b.field(i)
                p, rows = b.truth(f, quality.value[i]), f[0]
                g, place = first(b.group[rows], b.flat.field(f"k{i}").take(pa.array(rows)))
                row = np.full(len(b.n), -1, np.int64)
                row[g] = rows[place]
                chance = np.full(len(b.n), np.nan)
                chance[g] = p[f[1][place]]
                mine = row[which[keep]]
                cols.append(b.flat.field(f"v{i}").take(pa.array(mine, mask=mine < 0)))
                cols.append(pa.array(chance[which[keep]], mask=mine < 0))
                likely = -np.round(p[f[1]], _DIGITS)
                g, place = first(b.group[rows], b.flat.field(f"k{i}").take(pa.array(rows)), likely)
                row[g] = rows[place]
                chance[g] = p[f[1][place]]
                cols.append(b.flat.field(f"v{i}").take(pa.array(row[which[keep]], mask=mine < 0)))
                cols.append(pa.array(chance[which[keep]], mask=mine < 0))
                cols.append(pa.array(np.bincount(f[2], p >= JUDGED_TRUE, len(b.n))[which[keep]].astype(np.int64)))
            yield pa.RecordBatch.from_arrays(cols, names=["g", "rec", "n_records", *(f"{x}{i}" for i in range(len(fields)) for x in "vpmqt")])

    return run


class _Rows:
    """The same model for groups too large for one row: claims as rows."""

    def __init__(self, rows: DataFrame, fields: int) -> None:
        one = [F.struct(F.lit(i).alias("field"), F.col(f"v{i}").alias("value"), F.col(f"k{i}").alias("rank")) for i in range(fields)]
        mine = F.struct(F.lit(-1).alias("field"), F.col("rec").cast("string").alias("value"), F.col("rank").alias("rank"))
        x = rows.select("g", "src", F.explode(F.array(mine, *one)).alias("c")).select("g", "src", "c.*").where("value is not null")
        self.facts = materialize(x.groupBy("g", "field", "value").agg(F.min("rank").alias("rank")))
        self.claims = materialize(x.where("field >= 0").select("g", "field", "value", "src").distinct())
        self.said = self.claims.select("g", "field", "src").distinct()

    def values(self, sources: DataFrame) -> DataFrame:
        q = bounded_broadcast(sources)
        deny = F.log((1 - F.coalesce("sens", F.lit(FIRST[0]))) / (1 - F.coalesce("fpr", F.lit(FIRST[1]))))
        more = F.log(F.coalesce("sens", F.lit(FIRST[0])) / F.coalesce("fpr", F.lit(FIRST[1]))) - deny
        base = self.said.join(q, ["field", "src"], "left").groupBy("g", "field").agg(F.sum(deny).alias("base"))
        each = self.claims.join(q, ["field", "src"], "left").groupBy("g", "field", "value").agg(F.sum(more).alias("gain"), F.count(F.lit(1)).alias("n_src"))
        logit = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), float(np.log(TRUTH[0] / TRUTH[1])) + F.col("base") + F.col("gain")))
        return each.join(base, ["g", "field"]).select("g", "field", "value", "n_src", (1 / (1 + F.exp(-logit))).alias("p"))

    def sums(self, sources: DataFrame) -> DataFrame:
        v = materialize(self.values(sources))
        hits = self.claims.join(v, ["g", "field", "value"]).groupBy("field", "src").agg(F.sum("p").alias("tp"), F.sum(1 - F.col("p")).alias("fp"))
        whole = v.groupBy("g", "field").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("f"))
        could = self.said.join(whole, ["g", "field"]).groupBy("field", "src").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
        return hits.join(could, ["field", "src"]).select("field", "src", "tp", "fp", "t", "f")

    def survivors(self, values: DataFrame, fields: int, least: int) -> DataFrame:
        known = self.facts.join(values.select("g", "field", "value", "p"), ["g", "field", "value"], "left")
        mine = lambda i, *k: F.min(F.when(F.col("field") == i, F.struct(*k)))
        likely = (-F.round("p", _DIGITS)).alias("likely")
        true = lambda i: F.count_if((F.col("field") == i) & (F.col("p") >= JUDGED_TRUE)).alias(f"t{i}")
        out = known.groupBy("g").agg(mine(-1, "rank", "value", "p").alias("r"), F.sum((F.col("field") == -1).cast("long")).alias("n_records"), *(c for i in range(fields) for c in (mine(i, "rank", "value", "p").alias(f"f{i}"), mine(i, likely, "rank", "value", "p").alias(f"b{i}"), true(i))))
        each = [F.col(n).alias(m) for i in range(fields) for n, m in ((f"f{i}.value", f"v{i}"), (f"f{i}.p", f"p{i}"), (f"b{i}.value", f"m{i}"), (f"b{i}.p", f"q{i}"), (f"t{i}", f"t{i}"))]
        return out.where(F.col("n_records") >= least).select("g", F.col("r.value").alias("rec"), "n_records", *each)


def survivors(df: DataFrame, group: str, record: str, source: str, fields: dict[str, Column], trust: dict[str, list[Column]], record_trust: list[Column], least: int = 2, rounds: int = ROUNDS, small: int = SMALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survivor, values, sources).

    survivor: group, record (first in record_trust), n_records, and per field its value as text and p_<field>, likeliest_<field> and
    p_likeliest_<field> (the model's choice) and n_true_<field>, for every group with at least `least` records. values: g, field, value, n_src, p of every claimed value. sources: field, src, sens, fpr. fields gives each field as a
    column, null where missing; trust gives per field the sort keys (longs, ascending, no nulls) that put its most trusted value
    first. df has one row per record; null groups are left out; a null source is the source ''; a field without any value is
    null, and so is its probability. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark, names = df.sparkSession, list(fields)
    width = max(map(len, [*trust.values(), record_trust]))
    order = lambda ks: F.struct(*((ks[i] if i < len(ks) else F.lit(0)).cast("long").alias(f"t{i}") for i in range(width)))
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), F.col(record).alias("rec"), order(record_trust).alias("rank"), *(c for i, f in enumerate(names) for c in (fields[f].cast("string").alias(f"v{i}"), order(trust[f]).alias(f"k{i}"))))
    few = rows.select("src").distinct().limit(SOURCE_BOUND + 1).count() <= SOURCE_BOUND
    large = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (small if few else 0)).select("g"))
    none = large.isEmpty()
    side = None if none else bounded_broadcast(large)
    many = None if none else _Rows(rows.join(side, "g", "left_semi"), len(names))
    rest = rows if none else rows.join(side, "g", "left_anti")
    packed = F.collect_list(F.struct("src", "rec", "rank", *(f"{x}{i}" for i in range(len(names)) for x in "vk"))).alias("c")
    groups = materialize(rest.groupBy("g").agg(packed))  # at most `small` records each

    kind = "field int, src string, sens double, fpr double"
    sources, quality = spark.createDataFrame([], kind), spark.sparkContext.broadcast([{} for _ in names])
    for _ in range(rounds):
        sums = groups.mapInArrow(_sums(quality, len(names)), "field int, src string, tp double, fp double, t double, f double")
        if many:
            sums = sums.unionByName(many.sums(sources))
        s = sums.groupBy("field", "src").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "t", "f")))
        held = lambda c: F.greatest(F.lit(_EDGE), F.least(F.lit(1 - _EDGE), c))
        sens = (F.col("tp") + SENSITIVITY[0]) / (F.col("t") + sum(SENSITIVITY))
        fpr = (F.col("fp") + FALSE_CLAIMS[0]) / (F.col("f") + sum(FALSE_CLAIMS))
        sources = materialize(s.select("field", "src", held(sens).alias("sens"), held(fpr).alias("fpr")))
        if few:  # no more rows than SOURCE_BOUND times the fields: the parameters of the model
            q: list[dict] = [{} for _ in names]
            for r in sources.collect():
                q[r["field"]][r["src"]] = (r["sens"], r["fpr"])
            quality = spark.sparkContext.broadcast(q)

    g_type, r_type = rows.schema["g"].dataType, rows.schema["rec"].dataType
    field = lambda n, t: T.StructField(n, t, True)
    value_type = T.StructType([field("g", g_type), field("field", T.StringType()), field("value", T.StringType()), field("n_src", T.LongType()), field("p", T.DoubleType())])
    out_type = T.StructType([field("g", g_type), field("rec", r_type), field("n_records", T.LongType()), *(field(f"{x}{i}", {"v": T.StringType(), "m": T.StringType(), "t": T.LongType()}.get(x, T.DoubleType())) for i in range(len(names)) for x in "vpmqt")])
    values = groups.mapInArrow(_values(quality, names), value_type)
    out = groups.mapInArrow(_survivors(quality, names, width, least), out_type)
    if many:
        v = materialize(many.values(sources))
        named = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("field") + 1)
        values = values.unionByName(v.withColumn("field", named))
        more = many.survivors(v, len(names), least)
        out = out.unionByName(more.withColumn("rec", F.col("rec").cast(r_type)))
    named = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("field") + 1)
    out = out.select(F.col("g").alias(group), F.col("rec").alias(record), "n_records", *(F.col(f"{x}{i}").alias(as_.format(n)) for i, n in enumerate(names) for x, as_ in (("v", "{}"), ("p", "p_{}"), ("m", "likeliest_{}"), ("q", "p_likeliest_{}"), ("t", "n_true_{}"))))
    return out, values, sources.withColumn("field", named)
