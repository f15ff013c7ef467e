"""Files are written to a fresh folder; streams are held against small known results."""

from pyspark.sql import functions as F

from evidentia.sources import packages as P
from evidentia.streaming import streams as K


def test_package_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'x,"y\n,z"\n\n1\n')
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    got = {r.name: (r.size_bytes, r.family) for r in P.dispatch_format(P.scan_package(spark, str(tmp_path))).collect()}
    assert got == {"a.csv": (12, "delimited"), "b.bin": (2, "unsupported")}
    cells = P.read_ragged_csv(spark, str(tmp_path / "a.csv")).orderBy("row", "column").collect()
    assert [(r.row, r.column, r.value, r.width) for r in cells] == [(0, 0, "x", 2), (0, 1, "y\n,z", 2), (1, 0, "", 1), (2, 0, "1", 1)]
    lines = {(r.line, r.readable) for r in P.read_text_lines(spark, str(tmp_path / "b.bin")).collect()}
    assert lines == {(0, False)}


def test_ragged_cells_edges(spark):
    df = spark.createDataFrame([(1, 'a,"b ""c"""'), (2, 'a,"open'), (3, ""), (4, None), (5, "a,,")], "file int, text string")
    got = sorted((r.file, r.column, r.value) for r in P.ragged_cells(df).collect())
    assert got == [(1, 0, "a"), (1, 1, 'b "c"'), (5, 0, "a"), (5, 1, ""), (5, 2, "")]


def test_json_and_audit(spark):
    df = spark.createDataFrame([(1, '[{"a": 1}, {"b": null}]'), (2, "no"), (3, None)], "file int, text string")
    assert sorted((r.file, r.row, r.field, r.value) for r in P.json_cells(df).collect()) == [(1, 0, "a", "1"), (1, 1, "b", None)]
    log = spark.createDataFrame([(1, '{"a": 1}\n\nx\n{"a"'), (2, '{"a": 1}\n{"a"\n')], "file int, text string")
    got = sorted((r.file, r.line, r.issue or "") for r in P.audit_records(log).collect())
    assert got == [(1, 1, ""), (1, 2, "blank"), (1, 3, "malformed"), (1, 4, "torn"), (2, 1, ""), (2, 2, "malformed")]


def test_store_and_export(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("x",), ("y",)], "t string").select(F.sha2("t", 256).alias("sha256"), F.col("t").cast("binary").alias("content"))
    df = df.unionByName(df.limit(1).select(F.lit("0").alias("sha256"), "content"))
    store = str(tmp_path / "store")
    assert sorted(r.outcome for r in P.content_store_write(df, store).collect()) == ["mismatch", "stored", "stored"]
    assert sorted(r.outcome for r in P.content_store_write(df, store).collect()) == ["mismatch", "present", "present"]
    assert spark.read.parquet(store).count() == 2
    assert P.verified_export(df, str(tmp_path / "out")).count() == 4


def test_replay_stream(spark, tmp_path):
    rows = [("a", 1, None, "h1", "draft"), ("b", 1, None, "k1", "draft"), ("a", 2, "h1", "h2", "approved"), ("b", 2, "zz", "k2", "approved")]
    for n in (0, 2):
        spark.createDataFrame(rows[n : n + 2], "subject string, position long, prior_hash string, content_hash string, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("subject string, position long, prior_hash string, content_hash string, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = K.replay(stream).writeStream.outputMode("update").format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.subject, r.position, r.status, r.broken) for r in spark.table("replayed").collect()}
    assert got == {("a", 1, "draft", False), ("b", 1, "draft", False), ("a", 2, "approved", False), ("b", 2, None, True)}


def test_intake_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("1.txt", "me@x.org"), ("2.txt", "me@x.org"), ("3.txt", "plain")):
        (tmp_path / "in" / name).write_text(text)
    q = K.intake(spark, str(tmp_path / "in")).writeStream.foreachBatch(K.screened(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_snapshot_differences(spark, tmp_path):
    schema = "path string, sha256 string"
    step = K.diffs(spark.createDataFrame([], schema), str(tmp_path))
    first, second = spark.createDataFrame([("a", "1"), ("b", "1")], schema), spark.createDataFrame([("b", "2"), ("c", "1")], schema)
    for number, batch in ((0, first), (1, second), (1, second)):
        step(batch, number)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "diff=1")).collect()} == {("a", "removed"), ("b", "changed"), ("c", "added")}
