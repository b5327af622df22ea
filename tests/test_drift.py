import json

from pyspark.sql import functions as F

from strandloom.operators.blocked import blocked_lag
from strandloom.operators.drift import consistent_table, promote, promoted, read_line, schema_changes, union_schema
from strandloom.plans.problems import read_length

ALIAS = [("svlen", "svlen"), ("SVLEN", "svlen"), ("info.SVLEN", "svlen"), ("svtype", "svtype"), ("chr2", "chr2")]


def tables(spark, rows):
    return spark.createDataFrame(rows, "row_id long, feed_id long, file_no int, line_no int, payload string"), spark.createDataFrame(ALIAS, "alias_path string, field_name string")


def changes(spark, files):
    rows = [(i, f, n, k, p) for i, (f, n, k, p) in enumerate((f, n, k, p) for f, n, ps in files for k, p in enumerate(ps))]
    return sorted((r.feed_id, r.file_no, r.field_name, r.change_kind) for r in schema_changes(*tables(spark, rows)).collect())


def test_kinds_of_change(spark):
    got = changes(spark, [
        (1, 1, ['{"svlen": 5, "chr2": null}', "{broken", "", None]),
        (1, 3, ['{"SVLEN": 7.0, "chr2": 4}']),
        (1, 4, ['{"info": {"SVLEN": [7]}}', "[]", "5"]),
        (1, 7, ['{"info": {"SVLEN": null}, "svtype": "DEL"}']),
        (2, 1, ['{"svtype": "DEL"}']),
    ])
    assert got == sorted([(1, 3, "svlen", "renamed"), (1, 3, "svlen", "retyped"), (1, 4, "svlen", "renamed"), (1, 4, "svlen", "retyped"), (1, 4, "chr2", "removed"), (1, 7, "svtype", "added")])


def test_file_of_broken_lines_and_file_sent_twice(spark):
    got = changes(spark, [(1, 1, ['{"svlen": 5}']), (1, 2, ["nope"]), (1, 3, ['{"svlen": 5}']), (1, 3, ['{"svlen": 5}'])])
    assert got == [(1, 2, "svlen", "removed"), (1, 3, "svlen", "added")]


def test_empty_and_null_numbers(spark):
    assert changes(spark, []) == []
    df, alias = tables(spark, [(1, None, 1, 1, '{"svlen": 1}'), (2, 1, None, 1, '{"svlen": 1}')])
    assert schema_changes(df, alias).count() == 0
    assert schema_changes(df, alias.where("false")).count() == 0


def brute(rows, alias):
    files = {}
    for feed, no, payload in rows:
        f = files.setdefault((feed, no), {})
        try:
            o = json.loads(payload or "")
        except ValueError:
            continue
        for path, field in alias:
            x, ok = o, isinstance(o, dict)
            for p in path.split("."):
                ok = ok and isinstance(x, dict) and p in x
                x = x[p] if ok else None
            if ok:
                names, kinds = f.setdefault(field, (set(), set()))
                names.add(path)
                if x is not None:
                    kinds.add(type(x).__name__)
    out = set()
    for (feed, no), f in files.items():
        before = [n for (g, n) in files if g == feed and n < no]
        if not before:
            continue
        old = files[feed, max(before)]
        for field in {*f, *old}:
            if field not in old or field not in f:
                out.add((feed, no, field, "added" if field in f else "removed"))
                continue
            if f[field][0] != old[field][0]:
                out.add((feed, no, field, "renamed"))
            if f[field][1] and old[field][1] and f[field][1] != old[field][1]:
                out.add((feed, no, field, "retyped"))
    return out


def test_whole_table_against_brute_force(spark, sf):
    df, alias = spark.read.parquet(f"{sf}/call_files.parquet"), spark.read.parquet(f"{sf}/field_alias.parquet")
    want = brute([(r.feed_id, r.file_no, r.payload) for r in df.collect()], [(r.alias_path, r.field_name) for r in alias.collect()])
    got = [(r.feed_id, r.file_no, r.field_name, r.change_kind) for r in schema_changes(df, alias).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_lattice(spark):
    assert [promote(b) for b in (0, 1, 2, 4, 6, 8, 3, 48, 34, 66, 70, 130, 9)] == [None, "string", "integer", "number", "number", "array", "string", "json", "string", "integer", "string", "string", "json"]
    assert [r.p for r in spark.range(256).withColumn("b", F.col("id").cast("int")).select("id", promoted("b").alias("p")).orderBy("id").collect()] == [promote(b) for b in range(256)]
    assert all(promote(a | b) == promote(b | a) and promote(a | a) == promote(a) for a in range(64) for b in range(64))
    assert read_line('{"a": NaN}') is None and read_line("[" * 100_000) is None and read_line('{"a": ' + "9" * 5000 + "}") == {"a": "9" * 5000}


def test_the_table_has_the_types_of_the_folded_headers(spark):
    big = "9" * 5000
    rows = [(1, 1, 1, 1, '{"SVLEN": 27616, "svtype": ["DUP"], "chr2": 4}'), (2, 1, 1, 2, '{"svlen": 8143.50, "chr2": null}'), (3, 1, 1, 3, "{"), (4, 1, 1, 4, None), (5, None, 2, 1, '{"info": {"SVLEN": 3}, "chr2": 5, "svtype": "DEL"}'), (5, 1, 2, 1, '{"svtype": {"a": [1.50, "x"]}}')]
    df, alias = tables(spark, rows)
    clash = df.withColumn("readable", df.row_id).withColumn("svlen", df.row_id)
    t = consistent_table(clash, alias, ["row_id"])
    assert dict(t.dtypes) == {"row_id": "bigint", "readable": "boolean", "chr2": "bigint", "svlen": "double", "svtype": "string"}
    got = sorted(tuple(r) for r in t.fillna(-9).fillna("-").collect())
    assert got == [(1, True, 4, 27616.0, '["DUP"]'), (2, True, -9, 8143.5, "-"), (3, False, -9, -9.0, "-"), (4, False, -9, -9.0, "-"), (5, True, -9, -9.0, '{"a":[1.50,"x"]}'), (5, True, 5, 3.0, "DEL")]
    df, alias = tables(spark, [(1, 1, 1, 1, f'{{"svlen": {big}, "chr2": true}}'), (2, 1, 1, 1, '{"svlen": 7.0, "chr2": "x"}')])
    assert sorted(tuple(r) for r in consistent_table(df, alias, ["row_id"]).collect()) == [(1, True, "true", big, None), (2, True, "x", "7.0", None)]
    assert consistent_table(df.where("false"), alias, ["row_id"]).count() == 0 and union_schema(df.where("false"), alias).where("union_type is null and n_files = 0").count() == 3
    assert consistent_table(df, alias.where("false"), ["row_id"]).columns == ["row_id", "readable"]


def test_lengths_with_units_and_lists(spark):
    want = {"27,616": 27616, "8143 bp": 8143, "1kb": 1000, "[7]": 7, '["7"]': 7, "[7,8]": None, "1.5 Mb": 1500000, "7.0": 7, "-3": -3, "x": None, "": None, "3 apples": None, "1,2": None, "9" * 400: None, None: None, "1e3": 1000}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.n for r in df.select("t", read_length(F.col("t")).alias("n")).collect()} == want


def test_blocked_lag(spark):
    df = spark.createDataFrame([(k, i * 7, i) for k in ("a", None) for i in range(50)], "k string, o long, v long")
    got = {(r.k, r.o): r.b for r in blocked_lag(df, ["k"], "o", ["v"], "b", 20).collect()}
    assert len(got) == 100 and got["a", 0] is None and all(got[k, i * 7].v == i - 1 for k in ("a", None) for i in range(1, 50))
