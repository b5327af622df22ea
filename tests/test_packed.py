import re

import pytest

from strandloom.operators.packed import Model, learn, partners, split_packed, tokens

M = Model.plain()

CASES = {
    "tbl_a,1|tbl_b:2.0": [("tbl_a", 1), ("tbl_b", 2)],
    "[('T9', 3051), ('batch O, left', 418), (\"it's new\", 7)]": [("T9", 3051), ("batch O, left", 418), ("it's new", 7)],
    '["tbl_a,5757", "lane 4; rerun,9487"]': [("tbl_a", 5757), ("lane 4; rerun", 9487)],
    '"lane 4; rerun":788|"tbl_b":10170': [("lane 4; rerun", 788), ("tbl_b", 10170)],
    '"day ""two""",3489; x-1,4': [('day "two"', 3489), ("x-1", 4)],
    "{13698, 5000.0}": [(None, 13698), (None, 5000)],
    "a,1,b,2,a,1": [("a", 1), ("b", 2), ("a", 1)],
    "a , 1 | | ;; a:2 / 9": [("a", 1), ("a", 2), (None, 9)],
    "lonely|7": [(None, 7)],
    "lonely": [],
    "set()": [], "[]": [], ".": [], "|": [], " ": [], "": [], "NA": [], "None": [],
    "a,1.5|b,2e3|c,-4": [],
    "v1.2-calls,12": [("v1.2-calls", 12)],
    "a,5,7": [("a", 5), (None, 7)],
    "a\t5": [(None, 5)],
    '"x,5",7': [("x", 5), (None, 7)],
    '"unclosed,5': [("unclosed", 5)],
    "a,99999999999999999999|b,1": [("b", 1)],
}


@pytest.mark.parametrize("text", CASES)
def test_split(text):
    assert M.split(text) == CASES[text]


def test_null_text_and_long_text():
    assert M.split(None) == []
    assert len(M.split("|".join(f"t{i},{i}" for i in range(50_000)))) == 50_000
    assert M.split("x" * 200_000) == []


def test_model_learns_joiners_of_the_column(spark):
    df = spark.createDataFrame([("a#1|b#2|c#3",)] * 50 + [("q",), ("5|6",)] * 20 + [("d|5",)], "p string")
    m = learn(df, "p")
    assert m.join["#"] > m.part["#"] and m.join["|"] < m.part["|"]
    assert m.split("a#1|b#2") == [("a", 1), ("b", 2)]


def test_frequencies_of_names_choose_the_split(spark):
    """One separator joins after a name that comes with ids and parts after a word that stands alone elsewhere."""
    df = spark.createDataFrame([("tbl:1;tbl/2;tbl:3",)] * 40 + [("none",), ("none;none",)] * 60 + [("none/5",)] * 8 + [("7/8/9",)] * 20, "p string")
    m = learn(df, "p")
    assert m.split("tbl/2") == [("tbl", 2)]
    assert m.split("none/5") == [(None, 5)]
    few = learn(df.where("p not like 'none' and p not like 'none;none'"), "p")  # without the lone words none is a name
    assert few.split("none/5") == [("none", 5)]


def test_any_number_of_names_and_an_empty_column(spark):
    df = spark.createDataFrame([(f"n{i},{i}|m{i}:{i}",) for i in range(20_000)], "p string")
    m = learn(df, "p")
    assert all(m.split(f"n{i},{i};x") == [(f"n{i}", i)] for i in range(0, 20_000, 97)) and m.split("unseen,4") == [("unseen", 4)]
    assert learn(df.where("false"), "p").split("a,1|b:2|3") == [("a", 1), ("b", 2), (None, 3)]


def test_rows_keys_and_clashing_columns(spark):
    rows = [(1, "t", "a,1|2", 9, "z"), (1, "t", "a,1|2", 9, "z"), (2, "t", None, 9, "z"), (3, "t", "", 9, "z"), (None, "t", "a,1", 9, "z")]
    df = spark.createDataFrame(rows, "row_id long, table_name string, partners string, item_no long, item_name string")
    assert sorted(map(tuple, partners(df).collect())) == [(1, 1, "a", 1), (1, 2, "t", 2)]
    assert partners(df.where("false")).count() == 0
    assert split_packed(df.where("row_id = 1"), "partners", ["row_id"], M).count() == 4


def test_against_a_plain_reading(spark, sf):
    """An independent reading by one regular expression of the forms that occur."""
    form = re.compile(r'''"((?:[^"]|"")*?)[,:]\s*(\d+)(?:\.0+)?\s*"|'((?:[^']|'')*?)[,:]\s*(\d+)(?:\.0+)?\s*'|(?:"((?:[^"]|"")*)"|'((?:[^']|'')*)'|([A-Za-z0-9_.\-]*[A-Za-z_][A-Za-z0-9_.\-]*))\s*[,:]\s*(\d+)(?:\.0+)?(?![\w.\-])|(?<![\w.\-])(\d+)(?:\.0+)?(?![\w.\-])''')
    df = spark.read.parquet(f"{sf}/merged_events.parquet")
    want = set()
    for r in df.select("row_id", "table_name", "partners").distinct().collect():
        for n, m in enumerate(form.finditer(r.partners or ""), 1):
            name = next((x for x in (m[1], m[3], m[5], m[6], m[7]) if x is not None), None)
            q = '""' if m[1] is not None or m[5] is not None else "''"
            ident = next(x for x in (m[2], m[4], m[8], m[9]) if x is not None)
            want.add((r.row_id, n, (name.replace(q, q[0]) if name is not None else r.table_name), int(ident)))
    got = [tuple(r) for r in partners(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_tokens_keep_quotes_whole():
    assert [k for k, _, _ in tokens("'a;b' , 3")] == ["N", "S", "I"]
