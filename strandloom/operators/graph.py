"""Graph operators over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MAX_ROUNDS = 60
#: Distinct edges, counted, up to which one task settles the components; the result is the same.
FEW_EDGES = 1_000_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None) -> DataFrame:
    """node, component (the least node of its component), by alternating large-star and small-star steps.

    Edges are undirected; loops, repeated edges and null ends change nothing. nodes (one column) adds nodes without edges.
    Rounds are logarithmic in the size of a component; each round is written to the shared checkpoint folder, so lineage
    stays short and lost executors cost one round at most. Nothing but a count and a checksum reaches the driver. An edge table that is counted to hold
    no more than FEW_EDGES edges is settled by one task in a single pass.
    """
    a, b = F.least(src, dst), F.greatest(src, dst)
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(b.alias("u"), a.alias("v"))
    own = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    if nodes is not None:
        own = own.union(nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null")).distinct()
    own = materialize(own)
    e = materialize(e.where("u <> v").distinct())
    if e.count() <= FEW_EDGES:
        kind = e.schema["u"].dataType.simpleString()
        found = e.coalesce(1).mapInArrow(_settle, f"u {kind}, v {kind}")
        return own.join(found.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    state = None
    for _ in range(MAX_ROUNDS):
        # large star: every neighbour above u is tied to the least of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its neighbours below it are tied to the least of them (edges have u > v)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return own.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node of its component) of the edges of one task: least labels pass along edges, and along labels, until nothing changes."""
    t = [b for b in batches if b.num_rows]
    if not t:
        return
    t = pa.Table.from_batches(t)
    names = pc.unique(pa.chunked_array([*t["u"].chunks, *t["v"].chunks]))
    names = names.take(pc.sort_indices(names))
    u, v = (pc.index_in(t[c], value_set=names).to_numpy().astype(np.int64) for c in "uv")
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, label[u], label[v])
        np.minimum.at(new, label[v], label[u])
        while not np.array_equal(deeper := new[new], new):
            new = deeper
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], names=["u", "v"])


def partitions(edges: DataFrame, weight: str = "weight", above: int = 1) -> DataFrame:
    """Node, part: components over the edges heavier than `above`; nodes on lighter edges only are parts of their own."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return connected_components(edges.where(F.col(weight) > above), nodes=ends).withColumnRenamed("component", "part")


def support_between(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """part_a < part_b, n_edges, n_a, n_b: edges between two parts and how many nodes of either they touch. Counts, not sets of
    nodes: what a part links may be large."""
    a = parts.select(F.col("node").alias("src"), F.col("part").alias("pa"))
    b = parts.select(F.col("node").alias("dst"), F.col("part").alias("pb"))
    e = edges.select("src", "dst").join(a, "src").join(b, "dst").where("pa <> pb")
    flip = F.col("pa") > F.col("pb")
    e = e.select(F.least("pa", "pb").alias("part_a"), F.greatest("pa", "pb").alias("part_b"), F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("b"))
    return e.groupBy("part_a", "part_b").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("a").alias("n_a"), F.count_distinct("b").alias("n_b"))


def support_within(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Part, n_inner: nodes without an edge to another part."""
    a = parts.select(F.col("node").alias("src"), F.col("part").alias("pa"))
    b = parts.select(F.col("node").alias("dst"), F.col("part").alias("pb"))
    out = edges.select("src", "dst").join(a, "src").join(b, "dst").where("pa <> pb")
    outer = out.select(F.col("src").alias("node")).union(out.select("dst")).distinct()
    return parts.join(outer, "node", "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("n_inner"))


def strong_links(edges: DataFrame, parts: DataFrame, least: int, most_nodes: int = 500) -> DataFrame:
    """Pairs of parts with at least `least` edges between them and no more than most_nodes nodes each: what is kept of a component too large to call at once."""
    n = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    s = support_between(edges, parts).where(F.col("n_edges") >= least)
    s = s.join(n.select(F.col("part").alias("part_a"), F.col("n").alias("na")), "part_a").join(n.select(F.col("part").alias("part_b"), F.col("n").alias("nb")), "part_b")
    return s.where((F.col("na") <= most_nodes) & (F.col("nb") <= most_nodes)).select("part_a", "part_b", "n_edges")


def cut_forbidden(edges: DataFrame, forbidden: DataFrame, most_nodes: int = 50) -> DataFrame:
    """Edges without those cut so that no forbidden pair stays linked, within components of up to most_nodes nodes.

    In each component the forbidden pairs are taken in order; a breadth-first walk from the first node, neighbours in order,
    cuts the edge by which it reaches the second. Components that are triangles, stars of over three nodes or larger than most_nodes are left alone.
    """
    import pandas as pd

    comp = connected_components(edges)
    e = edges.select("src", "dst").join(comp.select(F.col("node").alias("src"), "component"), "src").withColumn("ban", F.lit(0))
    f = forbidden.select("src", "dst").join(comp.select(F.col("node").alias("src"), "component"), "src").join(comp.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst").where("component = c2")
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = f.select("component").distinct().join(size.where(F.col("n") <= most_nodes), "component").select("component")
    kept = e.join(small, "component", "left_anti").select("src", "dst")
    work = e.join(small, "component").select("component", "src", "dst", "ban").unionByName(f.join(small, "component").select("component", "src", "dst", F.lit(1).alias("ban")))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        links: dict = {}
        for s, d in pdf.loc[pdf.ban == 0, ["src", "dst"]].itertuples(index=False):
            links.setdefault(s, set()).add(d)
            links.setdefault(d, set()).add(s)
        n = len(links)
        hub = any(len(x) == n - 1 for x in links.values())
        if not (n == 3 or (n > 3 and hub)):
            for s, d in sorted(set(map(tuple, pdf.loc[pdf.ban == 1, ["src", "dst"]].to_numpy().tolist()))):
                while True:
                    seen, queue, hit = {s}, [s], None
                    while queue and hit is None:
                        at = queue.pop(0)
                        for x in sorted(links.get(at, ())):
                            if x == d:
                                hit = at
                                break
                            if x not in seen:
                                seen.add(x)
                                queue.append(x)
                    if hit is None:
                        break
                    links[hit].discard(d)
                    links[d].discard(hit)
        rows = sorted({(min(a, b), max(a, b)) for a, x in links.items() for b in x})
        return pd.DataFrame(rows, columns=["src", "dst"])

    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in ("src", "dst"))
    done = work.groupBy("component").applyInPandas(cut, kinds)
    return kept.unionByName(done)


def phase_sets(support: DataFrame, event: str, phase: str) -> DataFrame:
    """Phase, joined: phase sets supported by one event belong together. An event links its least phase set to its others: a star, not all pairs."""
    s = support.where(F.col(phase).isNotNull()).select(event, phase).distinct()
    low = s.groupBy(event).agg(F.min(phase).alias("dst"))
    links = s.join(low, event).select(F.col(phase).alias("src"), "dst")
    return connected_components(links).select(F.col("node").alias(phase), F.col("component").alias("joined"))
