"""Evidence segments on literal sources."""

import json

from pyspark.sql import functions as F

from evidentia.functions.checks import provision_kind
from evidentia.operators import segments as G


def leaves(value, at=""):
    """The plain version."""
    if isinstance(value, str):
        return [(at, value)] if value else []
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    return [x for k, v in items for x in leaves(v, f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}")]


def test_json_leaves(spark):
    deep = "end"
    for k in range(20):
        deep = {f"k{k}": deep} if k % 2 else [deep]
    values = ["root", "", {"a/b": {"~": ["x", "", None, 1, True, {"": "y", " ": "z"}]}}, [], {}, [[], {}, [None]], {"é": "ü"}, 7, [["a"] * 3, {"b": [{"c~/d": "e"}]}]]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(90, None), (91, "{"), (92, ""), (93, json.dumps(deep))]
    got = G.json_leaves(spark.createDataFrame(rows, "artifact_id int, json string")).collect()
    want = sorted((i, p, x) for i, v in enumerate(values) for p, x in leaves(v))
    assert sorted((r.artifact_id, r.pointer, r.text) for r in got if not r.unread) == want
    assert [(r.artifact_id, r.text, r.pointer.count("/")) for r in got if r.unread] == [(93, None, 12)]
    all_of = G.json_leaves(spark.createDataFrame([(93, json.dumps(deep))], "artifact_id int, json string"), levels=20).collect()
    assert [(r.pointer, r.text) for r in all_of] == leaves(deep)


def test_running_offsets(spark):
    n = [list(range(k)) for k in (0, 1, 2, 255, 256, 257, 1000)]
    got = spark.createDataFrame([(x,) for x in n], "n array<int>").select(G.running_offsets(F.col("n")).alias("at"))
    assert sorted(r["at"] for r in got.collect()) == sorted([sum(x[:i]) for i in range(len(x))] for x in n)


def test_lines_and_splits(spark):
    text = "one\r\n\n  \rFormula: a = b. Example: 3\nExample: only\nla formulaé Illustration : x\nno Example: x"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "last")], "artifact_id int, text string")
    got = [(r.artifact_id, r.locator, r.provision_id, r.text, r.kind) for r in G.segment_evidence(lines=docs).collect()]
    assert sorted(got) == [
        ("1", "text:line=1:offset=0", "text-line-1", "one", "provision"),
        ("1", "text:line=4:offset=9:example-offset=16", "text-line-4-example", "Example: 3", "example"),
        ("1", "text:line=4:offset=9:formula-offset=0", "text-line-4-formula", "Formula: a = b. ", "formula"),
        ("1", "text:line=5:offset=36", "text-line-5", "Example: only", "example"),
        ("1", "text:line=6:offset=50:example-offset=12", "text-line-6-example", "Illustration : x", "example"),
        ("1", "text:line=6:offset=50:formula-offset=0", "text-line-6-formula", "la formulaé ", "formula"),
        ("1", "text:line=7:offset=79", "text-line-7", "no Example: x", "example"),
        ("4", "text:line=1:offset=0", "text-line-1", "last", "provision"),
    ]


def test_cells_and_spans(spark):
    book = spark.createDataFrame([("w", "A b/'!", "B2", "=1+1", "2"), ("w", "S", "A1", None, "for instance"), ("w", "S", "A2", None, None), ("w", "S", "A3", "", "x")], "artifact_id string, sheet string, address string, formula string, stored string")
    got = {(r.locator, r.provision_id, r.text, r.kind) for r in G.segment_evidence(workbook=book).collect()}
    assert got == {("sheet=A%20b%2F'!:cell=B2:formula", "A b/'!!B2-formula", "=1+1", "formula"), ("sheet=A%20b%2F'!:cell=B2:stored-value", "A b/'!!B2-stored-value", "2", "example"), ("sheet=S:cell=A1:stored-value", "S!A1-stored-value", "for instance", "example"), ("sheet=S:cell=A3:stored-value", "S!A3-stored-value", "x", "example")}
    spans = spark.createDataFrame([("p", 1, 0, 3, "abc"), ("p", 0, 0, 3, "abc"), ("p", 1, -1, 2, "abc"), ("p", 1, 0, 4, "abc"), ("p", 2, 5, 5, ""), ("p", 2, None, 5, "x")], "artifact_id string, page int, start int, end int, text string")
    assert [r.locator for r in G.segment_evidence(pages=spans).collect()] == ["pdf:page=1:offset=0:endOffset=3"]
    cells = spark.createDataFrame([("t", 0, 0, "a"), ("t", 0, 1, ""), ("t", 2, 1, None)], "artifact_id string, row int, col int, value string")
    assert [(r.locator, r.provision_id) for r in G.segment_evidence(delimited=cells).collect()] == [("row=1:column=1", "row-1-column-1")]
    plan = G.segment_evidence(delimited=cells, pages=spans, workbook=book)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_patterns_run_only_where_their_words_are(spark):
    """Word bounds cost most of the time over long texts: a text without the words never meets them. Odd letters around
    the words, and every end of a line, are as before."""
    texts = ["EXAMPLE", "counterexample", "IllustrationK", "for  instance", "x=y", "timeshare", "Multiplied By", "formulas", None, "", "Kexample: 1 = 2", "a = b KEXAMPLE: 3"]
    df = spark.createDataFrame(list(enumerate(texts)), "artifact_id int, text string")
    kinds = [r.k for r in df.select("artifact_id", provision_kind(F.col("text")).alias("k")).orderBy("artifact_id").collect()]
    assert kinds == ["example", "provision", "provision", "provision", "formula", "provision", "formula", "provision", None, "provision", "formula", "formula"]
    got = {r.text for r in G.segment_evidence(lines=df.filter("artifact_id = 11")).collect()}
    assert got == {"a = b K", "EXAMPLE: 3"}
    ends = spark.createDataFrame([(1, "é\r\n\n\r\rz\r"), (2, "\r\n"), (3, "")], "artifact_id int, text string")
    rows = sorted((r.artifact_id, r.line, r.offset, r.value) for r in G.line_rows(ends).collect())
    assert rows == [(1, 1, 0, "é"), (1, 2, 3, ""), (1, 3, 4, ""), (1, 4, 5, ""), (1, 5, 6, "z"), (1, 6, 8, ""), (2, 1, 0, ""), (2, 2, 2, ""), (3, 1, 0, "")]
    plan = df.select(provision_kind(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan and plan.index("Contains") < plan.index("RLIKE")
