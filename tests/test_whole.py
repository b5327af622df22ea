"""Whole-table queries and operators without caps, against brute force on small tables."""

import random

from strandloom.operators import pairs
from strandloom.plans import catalog


def components(edges):
    low = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_graph_queries_take_every_row(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(1, 60), rng.randint(1, 80), rng.randint(1, 7), float(rng.randint(1, 50))) for _ in range(70)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = components([(p, o + 1_000_000_000) for o, p, _, _ in rows])
    got = {r.node: r.component for r in catalog.conn_components(spark, str(tmp_path)).collect()}
    assert got == want
    size = {}
    for node, c in want.items():
        n, s = size.get(c, (0, 0))
        size[c] = n + 1, s + (2 if node < 1_000_000_000 else 1)
    got = {r.component: (r.n, r.support) for r in catalog.component_filter(spark, str(tmp_path)).collect()}
    assert got == {c: x for c, x in size.items() if x[1] >= 4 and x[0] > 1}
    got = {r.l_partkey: r.joined for r in catalog.phase_sets(spark, str(tmp_path)).collect()}
    assert got == {n: c for n, c in want.items() if n < 1_000_000_000}


def test_components_in_one_task_and_by_rounds_agree(spark, monkeypatch):
    from strandloom.operators import graph

    rng = random.Random(17)
    rows = [(rng.randint(1, 90), rng.randint(1, 90)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(None, 3), (4, 4)]
    df = spark.createDataFrame(rows, "src long, dst long")
    words = df.selectExpr("'n' || src as src", "'n' || dst as dst")
    few = [sorted(map(tuple, graph.connected_components(d, nodes=d.select("src")).collect())) for d in (df, words)]
    assert dict(few[0]) == components([r for r in rows if None not in r])
    monkeypatch.setattr(graph, "FEW_EDGES", -1)
    assert few == [sorted(map(tuple, graph.connected_components(d, nodes=d.select("src")).collect())) for d in (df, words)]
    assert graph.connected_components(df.where("false")).count() == 0


def test_range_join_of_spans_of_all_lengths(spark):
    from strandloom.operators.intervals import range_join

    rng = random.Random(23)
    span = lambda: (lambda s, n: (s, s + n))(rng.randint(-500, 90_000), rng.choice([0, 1, 7, 90, 3000, 60_000]))
    a, b = ([(i, *span()) for i in range(60)] for _ in range(2))
    da, db = spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, x long, y long")
    want = sorted((i, j) for i, s, e in a for j, x, y in b if s <= y and x <= e)
    for levels in (1, 2, 4):
        got = range_join(da.withColumn("k", da.i % 1), db.withColumn("q", db.j % 1), [("k", "q")], ("s", "e"), ("x", "y"), 32, levels=levels).select("i", "j").collect()
        assert sorted(map(tuple, got)) == want
    semi = range_join(da.withColumn("k", da.i % 1), db.withColumn("q", db.j % 1).where("y - x < 10"), [("k", "q")], ("s", "e"), ("x", "y"), 32, "left_semi", 3)
    assert {r.i for r in semi.collect()} == {i for i, s, e in a if any(s <= y and x <= e and y - x < 10 for _, x, y in b)}


def test_copies_of_a_row_agree_in_every_column_that_queries_read(sf):
    """Which copy a deduplication keeps decides nothing."""
    from oracle import connect

    con = connect(sf)
    for name, key, columns in (("alignments", "read_id", "qname, sample_name, rg, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, nm, sa"), ("sv_calls", "call_id", "sample_name, chrom, pos, alt, filt, svtype, svlen, end_pos, chr2, chr2_pos, grp, cipos95, su, gt, gq, prob, called_at"), ("vcf_records", "rec_id", "chrom, pos, alt, filt, info, fmt, fmt_value"), ("merged_events", "row_id", "table_name, event_id, sample_name, svtype, partners"), ("sites", "site_id", "list_id, chrom, start_pos, chrom2, end_pos, svtype, svlen, prob")):
        assert con.execute(f"select count(distinct {key}) = (select count(*) from (select distinct {key}, {columns} from {name} where {key} is not null)) from {name}").fetchone()[0], name


def greedy(items, centres, within):
    p = sorted((abs(x - y), i, c) for i, x in items for c, y in centres if abs(x - y) <= within)
    used_i, used_c, out = set(), set(), []
    for d, i, c in p:
        if i not in used_i and c not in used_c:
            used_i.add(i)
            used_c.add(c)
            out.append((i, c, d))
    return sorted(out)


def test_assignment_beyond_fifty_rounds(spark):
    rng = random.Random(5)
    items = [(i, 1000) for i in range(70)] + [(100 + i, 5000 + rng.randint(0, 60)) for i in range(15)]
    centres = [(i, 1000 + rng.randint(0, 9)) for i in range(65)] + [(100 + i, 5000 + rng.randint(0, 60)) for i in range(15)]
    a = spark.createDataFrame([("k", *x) for x in items], "k string, item long, at long")
    b = spark.createDataFrame([("k", *x) for x in centres], "k string, site long, p long")
    got = sorted(map(tuple, pairs.assign_nearest(a, b, ["k"], "item", "at", "site", "p", 20).collect()))
    assert got == greedy(items, centres, 20) and len(got) > 65


def test_minimizer_edges_keep_every_pair(spark):
    rng = random.Random(7)
    rows = [(i, "a", 100 + rng.randint(0, 12), sorted(rng.sample(range(9), rng.randint(1, 5)))) for i in range(40)]
    rows += [(100 + i, "a", 105, [1, 2, 3]) for i in range(9)] + [(200 + i, "b", 50, [4]) for i in range(3)]
    df = spark.createDataFrame(rows, "node long, k string, at long, mins array<long>")
    want = {(a, b, len(set(m) & set(n))) for a, k, p, m in rows for b, l, q, n in rows if a < b and k == l and abs(p - q) < 7 and set(m) & set(n) and min(len(m), len(n)) / 2 + len(set(m) & set(n)) >= 2}
    got = [tuple(r) for r in pairs.minimizer_edges(df, ["k"], "node", "at", "mins").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    star = [tuple(r)[:2] for r in pairs.minimizer_edges(df, ["k"], "node", "at", "mins", star=True).collect()]
    assert components(star) == components([w[:2] for w in want]) and len(star) < len(want)


def test_whole_contigs_are_judged():
    from strandloom.functions.sequence import contigs_match

    rng = random.Random(11)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = base(60)
    assert contigs_match(base(10_050) + shared, shared + base(60))


def test_large_components_are_voted(spark):
    from strandloom.functions.sequence import consensus

    rng = random.Random(13)
    true = "".join(rng.choice("ACGT") for _ in range(90))
    err = lambda s: "".join(rng.choice("ACGT") if rng.random() < 0.04 else c for c in s)
    rows = [(1, err(true)) for _ in range(300)] + [(2, true[:70])] * 250 + [(2, true[10:])]
    got = {r.component: (r.n, r.consensus) for r in catalog.consensus_by_component(spark.createDataFrame(rows, "component long, contig string")).collect()}
    assert got[1][0] == 300 and got[1][1][5:-5] == true[5:-5]  # a wrong base at the very end of the backbone is not outvoted
    assert got[2] == (251, true[:70] + true[70:].lower()) == (251, consensus([c for k, c in rows if k == 2]))


def test_both_ends_in_one_region_make_no_pairs(spark):
    from strandloom.operators.intervals import shared_region

    rng = random.Random(31)
    at = lambda: rng.randint(-60, 900)
    regions = [(i, rng.choice(["a", "b", None]), s, s + rng.choice([0, 5, 90, 700])) for i in range(50) for s in [at()]] + [(90, "a", None, 5), (91, "b", 5, None), (92, "a", 50, 40)]
    events = [(i, rng.choice(["a", "b", None]), at(), rng.choice(["a", "b"]), at()) for i in range(120)] + [(200, "a", None, "a", 7), (201, "c", 1, "c", 2), (202, "a", 45, "a", 45)]
    r = spark.createDataFrame(regions, "name long, c string, s long, e long")
    q = spark.createDataFrame(events, "id long, ca string, a long, cb string, b long")
    want = {i: ca is not None and ca == cb and None not in (a, b) and any(k == ca and None not in (s, e) and s <= min(a, b) and max(a, b) <= e for _, k, s, e in regions) for i, ca, a, cb, b in events}
    for width in (16, 512):
        df = shared_region(q, r, "id", (("ca", "a"), ("cb", "b")), ("name", "c", "s", "e"), width)
        assert {x.id: x.shared for x in df.collect()} == want and df.count() == len(want)
    # the joins left are those of a block with what lies before it
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def dense_track(rng, keys, n):
    """Runs of depth (key, bin, to_bin, depth), some that touch, some long."""
    runs = []
    for k in keys:
        b = -40
        for _ in range(n):
            b += rng.choice([0, 0, 1, 30, 600])
            runs.append((k, b, (b := b + rng.choice([1, 1, 2, 9, 700])), rng.randint(1, 40)))
    return runs


def windows_of(rng, n):
    size = lambda: rng.choice([0, 1, 25, 800, 2550, 2560, 2570, 5120, 20_000, 90_000])
    return [(i, rng.choice(["a", "b", "c", None]), s, s + size()) for i in range(n) for s in [rng.choice([rng.randint(-900, 60_000), 2560 * rng.randint(0, 20)])]] + [(n, "a", None, None), (n + 1, "a", None, 50)]


def under(runs, k, lo, hi):
    """Sum, maximum and number of bins of a window by its definition."""
    if lo is None:
        return None, None, None
    a, b = lo // 10, max((hi - 1) // 10, lo // 10)
    hit = [(min(t - 1, b) - max(f, a) + 1, d) for q, f, t, d in runs if q == k and f <= b and t > a]
    return sum(n * d for n, d in hit), max((d for _, d in hit), default=0), b - a + 1


def test_means_of_windows_by_running_sums(spark, monkeypatch):
    from strandloom.operators import depth

    monkeypatch.setattr(depth, "BLOCK_BINS", 256)
    rng = random.Random(41)
    runs, windows = dense_track(rng, ["a", "b"], 60), windows_of(rng, 150)
    t, w = spark.createDataFrame(runs, "k string, bin long, to_bin long, depth long"), spark.createDataFrame(windows, "id long, k string, lo long, hi long")
    df = depth.window_means(w.selectExpr("*", "lo - 500 as lo2", "hi + 500 as hi2"), t, "k", ["id"], {"inner": ("lo", "hi"), "outer": ("lo2", "hi2")})
    got = {r.id: (r.inner, r.outer) for r in df.collect()}
    mean = lambda k, lo, hi: (lambda s, _, n: None if n is None else s / n)(*under(runs, k, lo, hi))
    assert got == {i: (mean(k, lo, hi), None if lo is None else mean(k, lo - 500, hi + 500)) for i, k, lo, hi in windows}


def test_depth_of_windows_by_blocks(spark):
    from strandloom.operators import depth

    rng = random.Random(43)
    runs, windows = dense_track(rng, ["a", "b"], 60), windows_of(rng, 150)
    t, w = spark.createDataFrame(runs, "k string, bin long, to_bin long, depth long"), spark.createDataFrame(windows, "id long, k string, lo long, hi long")
    for part in (w, w.where("hi - lo > 5000"), w.where("hi - lo < 1000"), w.where("id < 0")):
        got = {r.id: (r.mean_depth, r.max_depth) for r in depth.window_depth(part, t, "k", ["id"], "lo", "hi").collect()}
        ids = {r.id for r in part.collect()}
        assert got == {i: (None if n is None else s / n, m or 0) for i, k, lo, hi in windows if i in ids for s, m, n in [under(runs, k, lo, hi)]}
    # long windows are read at three places, not joined with their runs
    plan = depth.window_depth(w.where("hi - lo > 5000"), t, "k", ["id"], "lo", "hi")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
