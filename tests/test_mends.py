"""Literal cases of tab selection, catalog sections, reference matches, policy tables, field inventory, mock populations and
summaries."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.functions import checks as C
from evidentia.operators import architecture as A
from evidentia.operators import casework as W
from evidentia.operators import inventory as V
from evidentia.operators import registry as Y
from evidentia.operators import tables as T
from evidentia.sources import populations as P

_SHEETS = "sheet_id int, name string, hidden boolean, content_hash string, lineage string, traits array<string>"
_RULES = "position int, pattern string, role string, required array<string>, requirement string"


def test_tabs(spark):
    sheets = spark.createDataFrame([
        (1, "Actives", True, "x", "l", None), (2, "actives ", False, "y", "l", ["Union"]),  # a hidden one blocks nobody
        (3, "Retired", False, "z", "l", []), (4, "RETIRED", False, "z", "l", []),  # copies: the first is admitted
        (5, "Deferred", False, "a", "l", []), (6, "deferred", False, "a", "other", []),  # one content, two lineages
        (7, "Tables", False, "t", "l", []), (8, "Elsewhere", None, "e", "l", []), (9, "Union only", False, "u", "l", []), (10, None, False, "n", "l", None),
    ], _SHEETS)
    rules = spark.createDataFrame([(1, "act*", "first", ["pay"], "nobody"), (2, "act*", "second", ["Pay  Rate"], " UNION"), (3, "retired", "third", ["age", "pay"], None), (4, "union", "fourth", [], "x"), (5, "a(*", "none", [], None)], _RULES)
    seen = spark.createDataFrame([(2, "pay rate"), (3, "AGE")], "sheet_id int, field string")
    got = {r.sheet_id: (r.role, r.missing, r.unmet, r.status) for r in A.select_tabs(sheets, rules, seen, ("Tables",)).collect()}
    assert got == {
        1: (None, 0, 0, "hidden"), 2: ("second", 0, 1, "selected"), 3: ("third", 1, 0, "incomplete"), 4: (None, 0, 0, "duplicate"), 5: (None, 0, 0, "collision"), 6: (None, 0, 0, "collision"),
        7: ("support", 0, 0, "support"), 8: (None, 0, 0, "unmatched"), 9: (None, 0, 1, "requirement"), 10: (None, 0, 0, "unmatched"),
    }
    assert A.select_tabs(sheets.limit(0), rules, seen).count() == 0


def test_patterns_stand_for_themselves(spark):
    df = spark.createDataFrame([("a(b", "a(*", True), ("a.b", "A.*", True), ("axb", "a.*", False), ("x\\Ey", "x\\E*", True), ("ab", "a*b*", True), ("a)", "(*", False)], "v string, p string, want boolean")
    assert df.filter(C.tab_matches(F.col("v"), F.col("p")) != F.col("want")).count() == 0


def test_sections_by_the_decision_in_force(spark):
    rows = [
        ("released", 1, "r1", "pass", "released", 1, "amendment", None, None), ("revoked", 1, "r1", "pass", "released", 1, "amendment", None, None), ("revoked", 1, "r1", "pass", "revoked", 2, "amendment", None, None),
        ("back", 1, "r2", "safety-block", "rejected", 1, "other", None, None), ("back", 1, "r1", "safety-block", "released", 2, "other", None, None), ("norole", 1, "r1", "pass", "rejected", 1, None, 0, True),
        ("open", 1, "r1", "pass", None, 1, "amendment", None, None), ("lost", 1, "r1", None, "released", 1, "amendment", None, None), ("two", 1, "r1", "pass", "eligible", 1, "a", None, None), ("two", 1, "r2", "pass", "eligible", 2, "b", None, None),
        ("child", 1, "r1", "pass", "eligible", 1, "amendment", 2, True), ("bare", 1, "r1", "pass", "eligible", 1, None, 1, True),
    ]
    df = spark.createDataFrame(rows, "artifact_id string, _n int, receipt_id string, screened string, decision string, position int, role string, parents int, extracted boolean")
    got = {r.artifact_id: (r.receipt_id, r.section, r.issue) for r in W.catalog_sections(df).collect()}
    assert got == {
        "released": ("r1", "caseEvidence", None), "revoked": ("r1", "excludedQuarantined", None), "back": ("r1", "referenceOnly", None), "norole": ("r1", "excludedQuarantined", None), "open": ("r1", None, "UNDECIDED"),
        "lost": ("r1", None, "UNSCREENED"), "two": ("r1", None, "ROLE_CONFLICT"), "child": ("r1", None, "CONTAINMENT"), "bare": ("r1", None, "NO_ROLE"),
    }


def test_matches_without_shared_items(spark):
    profile = spark.createDataFrame([(1, "field", "a"), (1, "field", "b")], "doc_id int, kind string, item string")
    refs = spark.createDataFrame([(1, "field", "a"), (2, "field", "z")], "ref_id int, kind string, item string")
    sizes = spark.createDataFrame([(1, 5, 5), (2, 5, None)], "doc_id int, cells long, formulas long")
    known = spark.createDataFrame([(1, 50, 5, "b"), (2, 5, 5, "z"), (3, 5, 5, "y"), (4, 4, 0, "a"), (5, 0, 0, "a")], "ref_id int, cells long, formulas long, file_name string")
    got = [tuple(r) for r in Y.weighted_matches(profile, refs, sizes, known, 4).orderBy("doc_id", "rank").collect()]
    # half of the fields and the same formulas; then all of cells and formulas, by file name
    assert got == [(1, 1, 1, 3250 + 70 + 300), (1, 2, 3, 1000), (1, 3, 2, 1000), (1, 4, 4, 560), (2, 1, 3, 700), (2, 2, 2, 700), (2, 3, 4, 560), (2, 4, 1, 70)]


def test_large_policy_table_gives_the_same(spark):
    descs = spark.createDataFrame([(1, "Plan Year"), (2, "none")], "desc_id int, text string")
    few = spark.createDataFrame([("plan year", "year")], "pattern string, generic string")
    many = few.unionByName(spark.range(10_100).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("pattern"), F.lit("x").alias("generic")))
    assert sorted(T.map_generic_field(descs, many).collect()) == sorted(T.map_generic_field(descs, few).collect())


def test_inventory(spark):
    tabs = spark.createDataFrame([(1, "Data", "population"), (2, "Tables", "support"), (3, "Same", "support"), (4, " same", "support")], "sheet_id int, name string, role string")
    cells = spark.createDataFrame([
        (1, "A1", "Pay", None), (1, "B1", "Else", None), (1, "A7", "9", "=B7"), (1, "C7", "9", "=B7"), (1, "A8", "Pay", None), (2, "A1", "Loose", None), (2, "B2", "Pay", None), (2, "C2", "Word", None), (2, "D2", None, None), (3, "A1", "Pay", None), (9, "A1", "Pay", None),
    ], "sheet_id int, address string, value string, formula string")
    named = spark.createDataFrame([(2, "C2")], "sheet_id int, address string")
    seen = spark.createDataFrame([(1, " pay"), (1, "ELSE")], "sheet_id int, field string")
    words = spark.createDataFrame([("pay", None, "pay"), ("PAY", "data", "wage"), ("loose", "other", "no")], "pattern string, context string, generic string")
    got = {tuple(r) for r in V.field_inventory(tabs, cells, named, seen, words).collect()}
    assert got == {
        (1, "A1", "Pay", "wage", "header", "mapped"), (1, "B1", "Else", None, "header", "unmapped"), (1, "A7", "Pay", "wage", "formula", "mapped"), (1, "C7", "", "", "formula", "own-name"),
        (2, "B2", "Pay", "pay", "support", "mapped"), (2, "C2", "Word", None, "support", "unmapped"), (3, None, "same", None, None, "collision"),
    }
    assert V.field_inventory(tabs.limit(0), cells, named, seen, words).count() == 0


def test_mock_population_in_any_partitions(spark):
    fields = ["Employee-ID", "birth date", "Pay amount", "note"]
    state, want = 4_000_000_001, []
    for row in range(300):
        draws = []
        for _ in fields:
            state = (state * 1_664_525 + 1_013_904_223) % 2**32
            draws.append(state / 2**32)
        want.append((row, f"MOCK-{row + 1:06d}", f"19{40 + (row + 1) % 50}-01-01", int(draws[2] * 10_000) / 100, f"synthetic-4-{int(draws[3] * 1_000_000)}"))
    for parts in (1, 7):
        rows = spark.range(300).repartition(parts).withColumnRenamed("id", "row")
        assert sorted(tuple(r) for r in P.mock_population(rows, fields, 4_000_000_001).collect()) == want
    for bad in ([], ["a", "a"], [" a"]):
        with pytest.raises(ValueError):
            P.mock_population(spark.range(1).withColumnRenamed("id", "row"), bad, 1)


def test_summaries_of_odd_nesting(spark, tmp_path):
    files = {
        "good.json": json.dumps({"document": {"doc_id": "d", "other": [1]}, "items": [{"item_id": 1, "answer": "é", "references": [{"section": "§1", "page_pdf": 3}, {"excerpt": ""}]}, {"item_id": 2, "references": []}, {"item_id": 3}]}, indent=1),
        "odd.json": json.dumps({"document": None, "items": [None, {"item_id": " "}, {"item_id": "7"}, {"item_id": "7", "references": [None]}]}),
        "empty.json": "{}", "broken.json": '{"items": [',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    items, refs, issues = P.read_qa_summaries(spark, str(tmp_path))
    assert {(r.file, r.doc_id, r.position, r.item_id) for r in items.collect()} == {("good.json", "d", 0, "1"), ("good.json", "d", 1, "2"), ("good.json", "d", 2, "3"), ("odd.json", None, 0, None), ("odd.json", None, 1, " "), ("odd.json", None, 2, "7"), ("odd.json", None, 3, "7")}
    assert {(r.file, r.item_id, r.position, r.section, r.page_pdf, r.excerpt) for r in refs.collect()} == {("good.json", "1", 0, "§1", "3", None), ("good.json", "1", 1, None, None, ""), ("odd.json", "7", 0, None, None, None)}
    assert {tuple(r) for r in issues.collect()} == {("empty.json", None, "NO_ITEMS"), ("broken.json", None, "MALFORMED"), ("odd.json", 0, "NO_ID"), ("odd.json", 1, "NO_ID"), ("odd.json", 3, "DUPLICATE_ID")}


def test_provisions(spark):
    from evidentia.operators import evidence as E

    long = "the plan pays a benefit of one percent of pay for each year of service"
    rows = [(1, long), (2, long.upper() + "!"), (3, long + " now"), (4, "another text of many words that has nothing in common"), (5, "two words"), (6, "words TWO"), (7, "é"), (8, None), (9, long)]
    got = {tuple(r) for r in E.near_duplicate_provisions(spark.createDataFrame(rows, "candidate_id int, restatement string")).collect()}
    # 9 is a copy of 1; a text without ASCII words is linked to the first such
    assert got == {(1, 2, 1.0), (1, 3, round(13 / 14, 6)), (2, 3, round(13 / 14, 6)), (5, 6, 1.0), (7, 8, 1.0)}


def test_override_issues(spark):
    own = F.sha2(F.to_json(F.struct("override_id", "scope"), {"ignoreNullFields": "false"}), 256)
    o = spark.createDataFrame([
        ("a", "c", "s", "h", "r", 1, None, None), ("b", "c", "s", "h", "r", 2, "a", "a"), ("d", "c", "s", "h", "r", 1, "b", "b"), ("e", "c", "t", "h", "r", 9, "b", "b"), ("f", "c", "s", "h", "other", 1, None, None),
        ("g", "x", "s", "h", "r", 1, None, None), ("i", "c", "s", "h2", "r", 1, "gone", None), ("k", "c", "s", "h", "r", 1, None, None), ("k", "c", "s", "h", "r", 2, None, None),
    ], "override_id string, case_id string, scope string, sha256 string, role string, issued_at int, prior_id string, of string")
    before = F.sha2(F.to_json(F.struct(F.col("of").alias("override_id"), F.lit("s").alias("scope"))), 256)
    o = o.withColumn("prior_hash", F.when(F.col("of").isNotNull(), before)).withColumn("content_hash", own).drop("of")
    catalog = spark.createDataFrame([("c", "h", "r", "released"), ("c", "h2", "r", "released"), ("c", "h2", "r", "released")], "case_id string, sha256 string, role string, review_status string")
    got = sorted(tuple(r) for r in A.override_issues(o, catalog, ("override_id", "scope")).collect())
    assert got == [("b", "BRANCH"), ("d", "LINK"), ("e", "LINK"), ("f", "ARTIFACT"), ("g", "ARTIFACT"), ("i", "ARTIFACT"), ("i", "LINK"), ("k", "DUPLICATE_ID")]
    assert A.override_issues(o.limit(0), catalog, ("override_id", "scope")).count() == 0
