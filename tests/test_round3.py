"""Findings of round 3."""

import itertools
import random
import re
import unicodedata
from collections import Counter

import duckdb
from pyspark.sql import functions as F


from evidentia.functions import checks as C
from evidentia.operators import architecture as A
from evidentia.operators import evidence as E
from evidentia.operators import graphs as G
from evidentia.operators import tables as T
from evidentia.plans import catalog, governance  # noqa: F401


def _as_sql(spark, folder, name, **tables):
    """The rows of a query over ``tables``, which must be those of its SQL."""
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == Counter(want)
    return rows


_KEYS = (0, 1, 2, 1_048_575, 1_048_576, 1_048_577, 9_999_999, 10_000_000)


def test_identities_end_with_the_sheet(spark, tmp_path):
    part = spark.createDataFrame([(k, "n", 3) for k in _KEYS], "p_partkey long, p_name string, p_size int")
    rows = {r[0]: r[2:] for r in _as_sql(spark, tmp_path, "identities", part=part)}
    assert rows[1_048_576] == (1_048_576 % 26 + 1, 1_048_576) and rows[1_048_577] == rows[0] == rows[10_000_000] == (None, None)


def test_dependencies_end_with_the_sheet(spark, tmp_path):
    part = spark.createDataFrame([(k, "Brand#1") for k in _KEYS], "p_partkey long, p_brand string")
    lines = [(n, k, s, i) for n, (k, s, i) in enumerate((k, s, i) for k in _KEYS for s in (3, 4) for i in (1, 2, 3))]
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    issues = Counter(r[2] for r in _as_sql(spark, tmp_path, "resolve_dependencies", part=part, lineitem=lineitem))
    # by sheet row: 0, 1, 1, 2, 2, 3 (unknown), the last three rows of the sheet, and those beyond it
    assert issues == {"EXTERNAL": 16, "MALFORMED": 16 + 8, "UNKNOWN": 1, None: 7}


def test_rows_without_a_key_are_dealt(spark):
    left = spark.range(1000).selectExpr("if(id % 4 = 0, id div 8, null) as prior_id", "id as override_id")
    right = spark.range(100).selectExpr("id as prior_id", "id * 10 as x")
    got = A.beside(left, right.hint("merge"), "prior_id", "override_id").withColumn("task", F.spark_partition_id())
    rows = got.collect()
    assert Counter((r.prior_id, r.override_id, r.x) for r in rows) == Counter((i // 8 if i % 4 == 0 else None, i, i // 8 * 10 if i % 4 == 0 and i < 800 else None) for i in range(1000))
    plan = A.override_issues(left.selectExpr("override_id", "0 case_id", "0 scope", "0 sha256", "'' role", "0 issued_at", "prior_id", "'' prior_hash", "'' content_hash"), spark.range(0).selectExpr("0 case_id", "0 sha256", "'' role", "'' review_status"), ("scope",))
    assert "_spot" in plan._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = Counter(r.task for r in A.beside(left, right.hint("merge"), "prior_id", "override_id").filter("prior_id is null").withColumn("task", F.spark_partition_id()).collect())
        assert max(tasks.values()) < 300
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_composed_forms_in_small_batches(spark):
    texts = [None, "", "plain", "é", "xéy", "́a", "café é", "a\ņ́́c", "각", "kK", "\U0001d15e z", "ab" * 5000 + "ö" * 3, "ạ̇"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("form", C.nfc(F.col("text")))
    assert {r.id: r.form for r in df.collect()} == {i: x and unicodedata.normalize("NFC", x) for i, x in enumerate(texts)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" in plan


def test_references_are_matched_after_one_shuffle_by_document(spark):
    rows = [(i % 30, w) for i in range(600) for w in (f"t{i % 7}", f"t{i % 11}", "none")]
    refs = [(r, f"t{r * k % 11}") for r in range(9) for k in (1, 2, 3)] + [(9, "t3"), (9, "t3")]
    df = T.match_references_topk(spark.createDataFrame(rows, "doc_id long, token string"), F.broadcast(spark.createDataFrame(refs, "ref_id long, token string")))
    want, held = [], {r: {t for q, t in refs if q == r} for r in range(10)}
    for d in range(30):
        shared = {r: len(ts & {t for q, t in rows if q == d}) for r, ts in held.items()}
        best = sorted((-int(n / len(held[r]) * 100 + 0.5), -n, r) for r, n in shared.items() if n)[:5]
        want += [(d, k + 1, r, -s) for k, (s, _, r) in enumerate(best)]
    assert sorted(map(tuple, df.collect())) == sorted(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(doc_id#\w+, (ref_id|token)", plan)


def test_rounds_broadcast_nothing(spark):
    edges = spark.range(2, 64).selectExpr("id div 2 as src", "id as dst")
    blocks = G.propagate_blocks(edges, spark.range(64).filter("id % 9 = 5"))
    levels = G.execution_order(spark.range(1, 64), edges)
    for df in (blocks, levels):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.level for r in levels.collect()} == {i: i.bit_length() for i in range(1, 64)}
    a, b = (G.cut(spark.range(9)), G.cut(spark.range(5)))
    assert "Broadcast" not in a.join(b, "id")._jdf.queryExecution().executedPlan().toString()


def test_families_of_near_copies_meet_once(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 4)
    rng = random.Random(4)
    rows, words = [], [f"w{i}" for i in range(400)]
    for family in range(4):
        base = rng.choices(words, k=60)
        for edits in (0, 0, 1, 1, 1, 2, 2, 3, 4, 5, 6, 8):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(60)] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(100 + i, t) for i, t in enumerate(("a", "A b", "a b!", "", None, "?", "a b c", "a  b c"))]
    docs = spark.createDataFrame(rows, "artifact_id long, text string").repartition(3)
    sets = {}
    for i, t in rows:
        w = re.sub(r"[\W_]+", " ", (t or "").lower()).split()
        sets.setdefault(t or "", (i, {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()))
    for threshold in (0.3, 0.6, 0.9):
        want = {(i, j, round(len(a & b) / len(a | b), 6)) for i, a in sets.values() for j, b in sets.values() if i < j and a and b}
        want = {x for x in want if x[2] >= threshold} | {(103, 105, 1.0)}
        pairs = E.near_duplicate_pairs(docs, threshold)
        got = list(map(tuple, pairs.collect()))
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    # texts are cut into shingles once, not once for each of the five uses of their sets
    assert "regexp_replace" not in pairs._jdf.queryExecution().executedPlan().toString()


def _dealt(df, key):
    return {int(n) for n in re.findall(rf"hashpartitioning\({key}#\w+, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())}


def test_links_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "TASK_ROWS", 20)
    orders = spark.range(300).selectExpr("id as o_orderkey", "id % 17 as o_custkey", "timestamp'1996-01-01' + make_dt_interval(int(id * 7 % 90)) as o_orderdate")
    issues = Counter(r[1] for r in _as_sql(spark, tmp_path, "supersession_issues", orders=orders))
    assert set(issues) == {"UNBOUND", "SEQUENCE", "BRANCH", "SEVERAL_ROOTS"}
    assert _dealt(catalog.QUERIES["supersession_issues"](spark, str(tmp_path)), "predecessor_id") == {15}


def test_ranges_are_dealt_once_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(A, "TASK_ROWS", 10)
    rng = random.Random(13)
    rows = [[(rng.randrange(3), rng.randrange(9), rng.randrange(12), rng.choice([None, *range(4, 20)])) for _ in range(18)] for _ in range(3)]
    rows[0] += rows[0][:4]
    got = A.intersect_condition_ranges([spark.createDataFrame(r, "scenario long, rule_id long, start_date long, end_date long") for r in rows])
    want = {}
    for x in itertools.product(*rows):
        start, end = max(r[2] for r in x), min((r[3] for r in x if r[3] is not None), default=None)
        if len({r[0] for r in x}) == 1 and (end is None or start <= end):
            want.setdefault((x[0][0], start, end), set()).update(r[1] for r in x)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((*k, len(v))) for k, v in want.items()) and len(want) > 20
    assert _dealt(got, "scenario") == {6}
    assert not re.search(r"SortMergeJoin \[scenario.*\n.*Exchange hashpartitioning\(scenario#\w+, \d+\), ENSURE", got._jdf.queryExecution().executedPlan().toString())


def test_facts_are_dealt_before_conditions_multiply_them(spark, tmp_path):
    orders = spark.range(60).selectExpr("id as o_orderkey", "concat(id % 3, if(id % 2 = 0, '-URGENT', '-HIGH')) as o_orderpriority", "substr('FOP', int(id % 3) + 1, 1) as o_orderstatus", "id * 5000.5 as o_totalprice")
    assert len(_as_sql(spark, tmp_path, "select_scenarios", orders=orders)) == 300
    plan = catalog.QUERIES["select_scenarios"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(case_id#\w+, \d+\), REPARTITION_BY_COL", plan)
    assert not re.search(r"hashpartitioning\(case_id#\w+, scenario_id#\w+, condition_id", plan)
