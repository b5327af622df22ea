"""Mixes of sources to target weights, by dependent rounding.

A source's part of a mix is its target in tokens. Every document of the source gets the same expected number of copies,
the part over the tokens of the source, no more than the cap: whole copies are certain, the fraction is a probability.
Pivotal rounding makes the fractions whole without losing tokens: two documents pass tokens of probability between them,
in a random direction that leaves both expectations as they were, until one of them is certain. A task pairs the
documents of its block in a tree of arrays and hands on the one document that is left; those are paired again, by blocks
of blocks, until one per mix and source is left and drawn. So a source misses its part by less than one document.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import VOCABULARY, token_counts

BLOCK_ROWS = 20_000
FAN_IN = 256
SEED = 17
_EPS = 1e-9


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on ids and salt only, so that a task run again draws the same."""
    with np.errstate(over="ignore"):
        x = _mixed(ids.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    return (x >> np.uint64(11)).astype(float) / 2**53


def pivot(ids: np.ndarray, size: np.ndarray, p: np.ndarray, salt: int) -> np.ndarray:
    """Round p in [0, 1] so that the sum of size * p stays and at most one p is left between 0 and 1."""
    p = p.astype(float).copy()
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    level = 0
    while len(open_) > 1:
        m = len(open_) // 2 * 2
        i, j = open_[:m:2], open_[1:m:2]
        si, sj = size[i].astype(float), size[j].astype(float)
        up = np.minimum((1 - p[i]) * si, p[j] * sj)
        down = np.minimum(p[i] * si, (1 - p[j]) * sj)
        move = np.where(uniform(ids[i], salt + 1 + level) < down / (up + down), up, -down)
        p[i] += move / si
        p[j] -= move / sj
        near = np.concatenate([i, j])
        p[near] = np.where(p[near] < _EPS, 0.0, np.where(p[near] > 1 - _EPS, 1.0, p[near]))
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
        level += 1
    p[p <= _EPS] = 0.0
    p[p >= 1 - _EPS] = 1.0
    return p


def _salt(mix: str, source: str, seed: int) -> int:
    h = seed
    for c in f"{mix}\x00{source}".encode():
        h = (h * 1_000_003 + c) % (1 << 61)
    return h


_OUT = "mix_name string, source string, doc_id long, n_tokens long, copies int, p double"


def _first(plan: dict[str, list[tuple]]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        ids, size = pdf["doc_id"].to_numpy(np.int64), pdf["n_tokens"].to_numpy(np.int64)
        out = []
        for mix, each, salt in plan[key[0]]:
            sure = math.floor(each + _EPS)
            p = pivot(ids, size, np.full(len(ids), max(0.0, each - sure)), salt)
            part = (p > 0) & (p < 1)
            copies = sure + (p == 1).astype(int)
            keep = (copies > 0) | part
            out.append(pd.DataFrame({"mix_name": mix, "source": key[0], "doc_id": ids[keep], "n_tokens": size[keep], "copies": copies[keep].astype(np.int32), "p": np.where(part, p, np.nan)[keep]}))
        return pd.concat(out, ignore_index=True).astype({"p": object}).where(lambda d: d.notna(), None) if out else pd.DataFrame(columns=["mix_name", "source", "doc_id", "n_tokens", "copies", "p"])

    return run


def _again(seed: int, level: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
        salt = _salt(key[0], key[1], seed) + 1000 * level
        ids = pdf["doc_id"].to_numpy(np.int64)
        p = pivot(ids, pdf["n_tokens"].to_numpy(np.int64), pdf["p"].to_numpy(float), salt)
        if last:
            p = np.where((p > 0) & (p < 1), (uniform(ids, salt + 999) < p).astype(float), p)
        part = (p > 0) & (p < 1)
        pdf["copies"] = (pdf["copies"].to_numpy() + (p == 1)).astype(np.int32)
        pdf["p"] = pd.Series(np.where(part, p, np.nan)).astype(object).where(part, None)
        return pdf[["mix_name", "source", "doc_id", "n_tokens", "copies", "p"]]

    return run


def plan_parts(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per mix and source: target_share, target_tokens, source_tokens, max_repeat, each (expected copies of a document).

    targets (mix_name, total_ratio, source, weight, max_repeat) is a small fixed table, sizes (source, source_tokens) has one
    row per source. The total of a mix is total_ratio of all tokens. Weights that are null or under 0 count as 0; a null
    cap is no cap, one under 0 is 0. What a capped or missing source falls short of is not given to others.
    """
    t = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max("total_ratio").alias("total_ratio"), F.sum(F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(0.0)))).alias("weight"), F.max("max_repeat").alias("max_repeat"), F.max(F.col("max_repeat").isNull()).alias("free"))
    share = t.groupBy("mix_name").agg(F.sum("weight").alias("all_weight"))
    x = t.join(F.broadcast(share), "mix_name").join(sizes, "source", "left").withColumn("all_tokens", sizes.select(F.coalesce(F.sum("source_tokens"), F.lit(0))).scalar())
    x = x.withColumn("target_share", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0))
    x = x.withColumn("target_tokens", F.col("target_share") * F.greatest(F.lit(0.0), F.coalesce("total_ratio", F.lit(0.0))) * F.col("all_tokens"))
    want = F.when(F.coalesce("source_tokens", F.lit(0)) > 0, F.col("target_tokens") / F.col("source_tokens")).otherwise(0.0)
    each = F.when(F.col("free"), want).otherwise(F.least(want, F.greatest(F.lit(0), F.col("max_repeat")).cast("double")))
    return x.select("mix_name", "source", "target_share", "target_tokens", F.coalesce("source_tokens", F.lit(0)).cast("long").alias("source_tokens"), F.when(~F.col("free"), F.col("max_repeat")).alias("max_repeat"), each.alias("each"))


def mix_sources(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(documents of the mixes, report).

    documents: mix_name, source, doc_id, n_tokens, copies (1 to max_repeat), one row per document used. report: per mix and
    source target_share, target_tokens, source_tokens, max_repeat, n_documents, n_copies, tokens, actual_share (of what
    the mix came to). Documents of a null source are in no mix but count in the total; null and empty texts have no
    size and are in no mix; a doc_id delivered again counts once, by its longest text. The draw depends on the seed and the
    ids only, not on partitions.
    """
    counted = token_counts(documents.where("doc_id is not null"), "text", ["doc_id", "source"], path)
    docs = materialize(counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("d")).select("doc_id", "d.n_tokens", "d.source"))
    sizes = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("n"))
    parts = materialize(plan_parts(targets, sizes.select("source", "source_tokens")))
    plan: dict[str, list[tuple]] = {}
    for r in sorted(parts.where("each > 0").collect(), key=lambda r: (r["mix_name"], r["source"])):  # rows of the fixed table mix_targets
        plan.setdefault(r["source"], []).append((r["mix_name"], r["each"], _salt(r["mix_name"], r["source"], seed)))
    blocks = max(1, -(-docs.count() // block_rows))
    used = docs.where(F.col("source").isin(list(plan)) & (F.col("n_tokens") > 0)).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    drawn = materialize(used.groupBy("source", "block").applyInPandas(_first(plan), _OUT))
    done, left, level = drawn.where("p is null"), drawn.where("p is not null"), 1
    while True:  # each round leaves at most one document per FAN_IN blocks
        last = blocks <= FAN_IN
        grouped = left.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(1 if last else -(-blocks // FAN_IN))))
        left = grouped.groupBy("mix_name", "source", "block").applyInPandas(_again(seed, level, last), _OUT)
        if last:
            break
        left = materialize(left)
        done, left = done.unionByName(left.where("p is null")), left.where("p is not null")
        blocks, level = -(-blocks // FAN_IN), level + 1
    chosen = done.unionByName(left).where("copies > 0").drop("p")
    got = chosen.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("copies").cast("long")).alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    whole = got.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    report = parts.join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = report.select("mix_name", "source", "target_share", F.round("target_tokens", 3).alias("target_tokens"), "source_tokens", "max_repeat", zero("n_documents"), zero("n_copies"), zero("tokens"), F.when(F.col("mix_tokens") > 0, F.coalesce("tokens", F.lit(0)) / F.col("mix_tokens")).otherwise(0.0).alias("actual_share"))
    return chosen, report
