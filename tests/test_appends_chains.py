"""Appends that fail, repeat or race; audit chains in any batches, after a restart, and past their timer."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.operators import decisions as D
from evidentia.sources import appends as A
from evidentia.streaming import chains as C

HASHED = ("record_id", "status")


def _records(spark, rows):
    """(record_id, status, prior_id, prior status): the hash of the prior one is made of its status."""
    df = spark.createDataFrame(rows, "record_id long, status string, prior_id long, was string")
    before = F.sha2(F.to_json(F.struct(F.col("prior_id").alias("record_id"), F.col("was").alias("status")), {"ignoreNullFields": "false"}), 256)
    return df.select("record_id", "status", "prior_id", F.when(F.col("prior_id").isNotNull(), before).alias("prior_hash"), A.record_hash(*HASHED).alias("content_hash"))


def _check(df):
    return A.record_issues(df, HASHED)


def test_appends_commit_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    assert A.read_log(spark, path) is None and A.swept(spark, path) == []
    first = _records(spark, [(1, "open", None, None), (2, "open", None, None)])
    assert A.validated_append(spark, path, first, "one", _check).number == 1
    # one record succeeds a record of the log: old and new are checked together
    assert A.validated_append(spark, path, _records(spark, [(3, "done", 1, "open")]), "two", _check).number == 2
    again = A.validated_append(spark, path, first, "one", _check)
    assert (again.outcome, again.number) == ("repeated", 1)

    bad = _records(spark, [(2, "x", None, None), (4, "x", 9, "open"), (5, "x", 1, "open"), (6, "x", 2, "other"), (None, "x", None, None), (7, "x", 7, "x")])
    bad = bad.unionByName(_records(spark, [(8, "x", None, None)]).withColumn("content_hash", F.lit("0" * 64)))
    got = A.validated_append(spark, path, bad, "three", _check)
    assert got.outcome == "refused" and got.number is None
    assert {(r.check, r.subject) for r in got.issues.collect()} == {("DUPLICATE_ID", "2"), ("PRIOR", "4"), ("BRANCH", "1"), ("PRIOR", "6"), ("MISSING_ID", None), ("PRIOR", "7"), ("HASH", "8")}

    # the job ends between staging and commit: readers stay where they were, and a second try commits
    with monkeypatch.context() as m:
        m.setattr(A, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            A.validated_append(spark, path, _records(spark, [(9, "open", None, None)]), "four", _check)
    assert sorted(r.record_id for r in A.read_log(spark, path).collect()) == [1, 2, 3]
    assert len(A.swept(spark, path)) == 2  # the refused one and the lost one
    assert A.validated_append(spark, path, _records(spark, [(9, "open", None, None)]), "four", _check).number == 3
    assert {(r.record_id, r.commit_number) for r in A.read_log(spark, path).collect()} == {(1, 1), (2, 1), (3, 2), (9, 3)}
    assert sorted(r.record_id for r in A.read_log(spark, path, upto=1).collect()) == [1, 2]


def test_append_that_comes_second_is_checked_anew(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    real, calls = A._commit, []

    def late(session, at, number, line):
        """Another writer takes the number with the same record."""
        if not calls:
            calls.append(number)
            monkeypatch.setattr(A, "_commit", real)
            assert A.validated_append(spark, path, _records(spark, [(1, "open", None, None)]), "other", _check).number == 1
        return real(session, at, number, line)

    monkeypatch.setattr(A, "_commit", late)
    got = A.validated_append(spark, path, _records(spark, [(1, "open", None, None)]), "mine", _check)
    assert got.outcome == "refused" and [r.check for r in got.issues.collect()] == ["DUPLICATE_ID"]
    assert A.read_log(spark, path).count() == 1


def test_empty_append(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert A.validated_append(spark, path, _records(spark, []), "none", _check).outcome == "committed"
    assert A.read_log(spark, path).count() == 0


def _log(spark):
    """Chains of 6 entries of 12 subjects, each broken in its own way or whole."""
    rows = [(f"s{s}", p, f"d{s}-{p}", p, f"d{s}-{p - 1}" if p > 1 else None) for s in range(12) for p in range(1, 7)]
    log = spark.createDataFrame(rows, "subject string, position long, decision_id string, ordinal long, prior_id string")
    log = log.withColumn("content_hash", F.sha2("decision_id", 256)).withColumn("prior_hash", F.lag("content_hash").over(Window.partitionBy("subject").orderBy("position")))
    at = lambda s, p: (F.col("subject") == f"s{s}") & (F.col("position") == p)
    return log.withColumns({
        "content_hash": F.when(at(1, 3), "short").when(at(2, 6), None).otherwise(F.col("content_hash")),
        "ordinal": F.when(at(3, 2), 9).when(at(4, 6), None).otherwise(F.col("ordinal")),
        "prior_id": F.when(at(5, 4), "other").when(at(6, 1), "x").otherwise(F.col("prior_id")),
        "prior_hash": F.when(at(7, 5), "other").when(at(8, 2), None).otherwise(F.col("prior_hash")),
    })


def _run(spark, source, out, state, schema, wait_ms=600_000):
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = C.audit_chain(files, wait_ms).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and not q.isActive


@pytest.fixture
def rocksdb(spark):
    # with processing-time timers a run over what is available would go on with batches without data
    own = {"spark.sql.streaming.stateStore.providerClass": C.ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_chain_issues_in_any_batches(spark, tmp_path, rocksdb):
    log = _log(spark).cache()
    want = {tuple(r) for r in D.validate_audit_chain(log).select("subject", "position", "issue").collect()}
    assert len(want) == 9
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    deal = F.pmod(F.xxhash64("subject", "position"), F.lit(5))  # later entries may come first
    for part in (0, 1, 2):
        log.filter(deal == part).coalesce(1).write.mode("append").parquet(source)
    _run(spark, source, out, state, log.schema)
    for part in (3, 4):  # after a restart from the checkpoint
        log.filter(deal == part).coalesce(1).write.mode("append").parquet(source)
    _run(spark, source, out, state, log.schema)
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_chain_waits_no_longer_than_told(spark, tmp_path, rocksdb):
    log = _log(spark)
    whole = log.filter("subject = 's0' and position <> 2")
    want = {tuple(r) for r in D.validate_audit_chain(whole).select("subject", "position", "issue").collect()}
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    whole.coalesce(1).write.mode("append").parquet(source)
    _run(spark, source, out, state, log.schema, 1)
    log.filter("subject = 's9' and position = 1").coalesce(1).write.mode("append").parquet(source)
    _run(spark, source, out, state, log.schema, 1)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want and want
