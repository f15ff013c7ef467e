"""Small literal cases; whole tables are held against DuckDB by the oracle of each query."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.operators import decisions as D
from evidentia.operators import evidence as E
from evidentia.operators import graphs as G
from evidentia.operators import rules as R
from evidentia.operators import tables as T
from evidentia.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_raw_value_kinds(spark):
    rows = [(" ", "blank"), (None, "null"), ("=1+1", "formula-text"), ("-5", "formula-text"), ("0012", "leading-zero-text"), ("0", "literal-zero"), ("INVALID", "malformed"), ("12.5", "text")]
    df = spark.createDataFrame(rows, "v string, k string")
    assert df.filter(S.classify_raw_value(F.col("v"), F.lit(True)) != F.col("k")).count() == 0
    assert df.filter(S.classify_raw_value(F.col("v"), F.lit(False)) != "missing").count() == 0


def test_dates_never_roll_over(spark):
    got = spark.createDataFrame([("2021-02-30",), ("2/3/2021",), ("March 4, 2021",), ("2021-02-28",)], "t string").select(S.parse_evidence_date(F.col("t")).cast("string").alias("d")).collect()
    assert [r.d for r in got] == [None, "2021-02-03", "2021-03-04", "2021-02-28"]


def test_replay_first_error_wins(spark):
    base = [("a", 1, "x", "d1", 1, None, "approve", "approved"), ("a", 2, "x", "d2", 2, "d1", "revoke", "revoked"), ("b", 1, " ", "e1", 1, None, "approve", "approved"), ("c", 1, "x", "f1", 1, None, "approve", "approved"), ("c", 2, "x", "f2", 2, "f1", "approve", "approved")]
    log = spark.createDataFrame(base, "subject string, position int, actor string, decision_id string, ordinal int, prior_id string, action string, status string")
    log = log.withColumn("content_hash", D.log_hash(*(F.col(c) for c in ("subject", "decision_id", "prior_id", "action", "status"))))
    from pyspark.sql import Window

    log = log.withColumn("prior_hash", F.lag("content_hash").over(Window.partitionBy("subject").orderBy("position")))
    got = {r.subject: (r.status, r.error) for r in D.replay_decisions(log, "review").collect()}
    assert got == {"a": ("revoked", None), "b": (None, "ACTOR"), "c": (None, "TRANSITION")}
    bad = log.withColumn("content_hash", F.when(F.col("decision_id") == "d2", "0").otherwise(F.col("content_hash")))
    assert {r.subject: r.error for r in D.replay_decisions(bad, "review").collect()}["a"] == "HASH"


def test_periods_are_half_open(spark):
    r = spark.createDataFrame([(1, "s", "2020-01-01", "2021-01-01"), (2, "s", "2021-01-01", None)], "rule_id int, scope string, start_date string, end_date string").withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    assert [x.rule_id for x in R.rules_effective_on(r, F.lit("2021-01-01").cast("date")).collect()] == [2]
    assert [tuple(x) for x in R.conflicting_rules(r.withColumn("text", F.col("rule_id").cast("string"))).collect()] == [("s", 1, 2)]


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 4), (3, 5)], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    assert {(r.id, r.cycle) for r in G.cycle_members(e).collect()} == {(2, 2), (3, 2), (4, 4)}
    assert {(r.id, r.level) for r in G.execution_order(n, e).collect()} == {(1, 1), (6, 1), (2, None), (3, None), (4, None), (5, None)}
    assert {(r.id, r.status) for r in G.compile_status(n, e, n.filter("id = 6")).collect()} == {(1, "compiled"), (2, "cycle-blocked"), (3, "cycle-blocked"), (4, "cycle-blocked"), (5, "dependency-blocked"), (6, "failed")}


def test_similarity_plans_have_no_cartesian_product(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("artifact_id"), "text")
    plan = E.near_duplicate_pairs(docs, 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_near_duplicates_link_wordless_texts_and_give_copies_back(spark):
    docs = spark.createDataFrame([(1, "!!"), (2, "a b c d"), (3, "--"), (4, "a b c d"), (5, None), (6, "A b, c d"), (7, "!!")], "artifact_id long, text string")
    assert sorted(map(tuple, E.near_duplicate_pairs(docs, 0.6).collect())) == [(1, 3, 1.0), (1, 5, 1.0), (2, 6, 1.0)]
    assert sorted((r.artifact_id, r.representative_id) for r in E.near_duplicate_members(docs).collect()) == [(1, 1), (2, 2), (3, 3), (4, 2), (5, 5), (6, 6), (7, 1)]


def test_near_duplicates_of_a_hot_shingle_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 3)
    rows = [(i, "the same long first part of a family of texts " + " ".join(f"w{i * k % 5}" for k in range(i % 4))) for i in range(40)]
    sets = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(t, (i, {tuple(w[k : k + 3]) for k in range(len(w) - 2)}))
    first = sorted(sets.values(), key=lambda x: x[0])
    want = {(i, j) for i, a in first for j, b in first if i < j and len(a & b) / len(a | b) >= 0.6}
    got = [(r.from_id, r.to_id) for r in E.near_duplicate_pairs(spark.createDataFrame(rows, "artifact_id long, text string"), 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


@pytest.mark.parametrize("block", [256, 1])
def test_supersession_links_every_earlier_candidate(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rows = [("p", 1, 1, "one two three four five six"), ("p", 2, 2, "one two three four five six"), ("p", 2, 3, "This was amended."), ("p", 3, 4, "It is REPLACED by this"), ("p", 4, 5, "one two three four five six seven"), ("q", 5, 6, "one two three four five six"), ("p", 5, 7, "irreplaceable")]
    got = R.detect_supersession(spark.createDataFrame(rows, "provision string, position int, candidate_id int, text string"))
    want = {(1, 2, "amendment", 1.0, 0.7), (1, 3, "amendment", 0.0, 0.25), (1, 4, "supersession", 0.0, 0.25), (2, 4, "supersession", 0.0, 0.25), (3, 4, "supersession", 0.0, 0.25), (1, 5, "amendment", 0.8, 0.56), (2, 5, "amendment", 0.8, 0.56)}
    told = [(r.from_id, r.to_id, r.kind, r.similarity, r.confidence) for r in got.collect()]
    assert len(told) == len(want) and set(told) == want


def test_supersession_links_equal_their_oracle_where_there_are_links(spark, tmp_path):
    texts = ["one two three four five six", "one two three four five six seven", "This was amended.", "", "!", "replaces x", "a b", "b a a", "irreplaceable", "restated: one two three four five"]
    pd.DataFrame([(c, k, x) for c in (1, 2) for k, x in enumerate(texts[c - 1 :] + texts)], columns=["conv_id", "turn", "text"]).to_parquet(tmp_path / "conversations.parquet")
    got = catalog.QUERIES["supersession_links"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet')")
    want = con.execute(catalog.ORACLE["supersession_links"]).df()[list(got.columns)]
    assert len(want) > 50 and sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def test_references_match_on_short_accented_and_numbered_tokens(spark, tmp_path):
    pd.DataFrame([(1, "the cat sat on a mat"), (2, "Été à Zürich"), (3, "b2 2024"), (4, "x " * 3)], columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(1, "The cat"), (2, "l'ÉTÉ, zürich"), (3, "B2 in 2024"), (4, "x y")], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    got = {tuple(r) for r in catalog.QUERIES["match_references_all_tokens"](spark, str(tmp_path)).select("doc_id", "ref_id", "score").collect()}
    assert got == {(1, 1, 100), (2, 2, 100), (3, 3, 50)}
    assert spark.createDataFrame([("a" * 40 + " " + "b" * 41 + " 12 a_1 e\u0301t A_1",)], "t string").select(S.signal_tokens(F.col("t")).alias("s")).first().s == ["a" * 40, "a_1", "e\u0301t"]


def test_groups_and_sets_are_not_collected(spark):
    a = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, "x"), (5, "")], "artifact_id int, sha256 string")
    members = E.exact_duplicate_members(a)
    assert sorted(map(tuple, members.collect())) == [("x", 1, 1, 3), ("x", 3, 1, 3), ("x", 4, 1, 3)]
    one = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2), ("q", 1), ("r", 1), ("s", None), ("s", 1), (None, 1)], "g string, v int")
    two = spark.createDataFrame([("p", 2), ("p", 1), ("q", 1), ("q", 2), ("s", 1), ("t", 1), (None, 1)], "g string, v int")
    equal = T.set_equals(one, two, "g", "v")
    told = [(None, False), (None, False), ("p", True), ("q", False), ("r", False), ("s", False), ("t", False)]
    assert sorted(map(tuple, equal.collect()), key=str) == sorted(told, key=str)
    for df in (members, equal):
        assert "collect_" not in df._jdf.queryExecution().executedPlan().toString()


def test_table_structure_and_exact_distinct_values(spark):
    files = {"ok": ["ab", "xy", "zz"], "twice": ["aa", "xy"], "ragged": ["ab", "x"], "one": ["a", "x"]}
    cells = [(f, r, c, v) for f, rows in files.items() for r, row in enumerate(rows) for c, v in enumerate(row)] + [("bare", 1, 0, "x")]
    got = {r.file: tuple(r)[1:] for r in T.table_structure(spark.createDataFrame(cells, "file string, row int, col int, value string")).collect()}
    assert got == {"ok": (2, 2, 2, 2, True, 0.8), "twice": (2, 1, 2, 2, False, 0.5), "ragged": (2, 1, 1, 2, False, 0.5), "one": (1, 1, 1, 1, True, 0.0), "bare": (0, 1, 1, 1, False, 0.0)}
    f = T.profile_fields(spark.createDataFrame([(1, "f", "a"), (2, "f", "a"), (3, "f", None), (4, "f", "0")], "row int, field string, value string")).first()
    assert (f.cells, f.distinct_values, f.null_cells, f.literal_zero_cells) == (4, 2, 1, 1)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_oracle(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(catalog.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)

    def text(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if not isinstance(x, list) and pd.isna(x):
            return ""
        return f"{x:.6g}" if isinstance(x, float) else f"{float(x):.6g}" if isinstance(x, int) and not isinstance(x, bool) else str(x)

    told = lambda df: sorted("|".join(map(text, r)) for r in df[cols].itertuples(index=False))
    assert told(got) == told(want)
