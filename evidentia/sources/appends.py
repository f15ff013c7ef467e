"""An append-only log of records whose readers see whole, checked appends only.

A log is a folder. ``batches/<id>`` holds the Parquet files of one append, ``commits/<number>.json`` names the batch that commit
``number`` made live. Commits are numbered from 1 without gaps and a commit file comes into being by one rename that fails if
the number is taken: an append that ends before it leaves files that nothing names. ``swept`` lists such leftovers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packages import table_digest

#: Fixed value: how often an append checks itself anew after another one took its number.
TRIES = 20


@dataclass
class Appended:
    """What became of an append: ``committed`` with its commit number, ``repeated`` with the number it had before, or
    ``refused`` with its issues(check, subject)."""

    outcome: str
    number: int | None
    issues: DataFrame | None = None


def record_issues(records: DataFrame, hashed: tuple[str, ...]) -> DataFrame:
    """records(record_id, prior_id, prior_hash, content_hash, ...) -> issues(check, subject) of the whole set: an id that is
    null (MISSING_ID) or not alone (DUPLICATE_ID), a hash that is not ``record_hash`` of the ``hashed`` columns (HASH), a prior
    id without a record or with another hash than the one named (PRIOR), a prior hash without a prior id (PRIOR), a record
    with more than one successor (BRANCH). A record that succeeds itself is a PRIOR too."""
    r = records.withColumn("subject", F.col("record_id").cast("string"))
    tell = lambda df, check: df.select(F.lit(check).alias("check"), "subject")
    ids = r.groupBy("record_id", "subject").agg(F.count("*").alias("n"))
    heads = r.groupBy(F.col("record_id").alias("prior_id")).agg(F.min("content_hash").alias("_found"))
    linked = r.filter("prior_id is not null").join(heads, "prior_id", "left")
    loose = ~F.col("_found").eqNullSafe(F.col("prior_hash")) | F.col("_found").isNull() | F.col("prior_id").eqNullSafe(F.col("record_id"))
    parts = [
        tell(r.filter("record_id is null"), "MISSING_ID"),
        tell(ids.filter("record_id is not null and n > 1"), "DUPLICATE_ID"),
        tell(r.filter(~F.col("content_hash").eqNullSafe(record_hash(*hashed))), "HASH"),
        tell(linked.filter(loose), "PRIOR"),
        tell(r.filter("prior_id is null and prior_hash is not null"), "PRIOR"),
        r.filter("prior_id is not null").groupBy("prior_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("BRANCH").alias("check"), F.col("prior_id").cast("string").alias("subject")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def record_hash(*columns: str):
    """sha-256 of the columns as a JSON object with nulls written."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _files(spark: SparkSession, path: str):
    """(file system, Path class, list of finished commits) by whatever file system the path names."""
    jvm = spark._jvm
    of = jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, of


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(number, batch, key, rows) of every commit, empty where the log is new. One short line an append, read by Spark."""
    fs, of = _files(spark, path)
    schema = "number long, batch string, key string, rows long"
    if not fs.exists(of(f"{path}/commits")):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").option("mode", "FAILFAST").json(f"{path}/commits")


def read_log(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The records of all commits, or of those up to a number, with ``commit_number``; null where there are none. A batch
    that no commit names isn't read."""
    live = commits(spark, path).filter(F.lit(True) if upto is None else F.col("number") <= upto)
    names = [r.batch for r in live.select("batch").collect()]
    if not names:
        return None
    rows = spark.read.option("basePath", f"{path}/batches").parquet(*(f"{path}/batches/batch={n}" for n in names))
    return rows.join(F.broadcast(live.select("batch", F.col("number").alias("commit_number"))), "batch").drop("batch")


def swept(spark: SparkSession, path: str) -> list[str]:
    """Batches that no commit names: of appends that failed, or of such as are still under way."""
    fs, of = _files(spark, path)
    if not fs.exists(of(f"{path}/batches")):
        return []
    named = {r.batch for r in commits(spark, path).select("batch").collect()}
    found = [s.getPath().getName() for s in fs.listStatus(of(f"{path}/batches"))]
    return sorted(f for f in found if f.startswith("batch=") and f.removeprefix("batch=") not in named)


def _commit(spark: SparkSession, path: str, number: int, line: dict) -> bool:
    """Makes the commit file by a rename that fails where the number is taken."""
    fs, of = _files(spark, path)
    jvm = spark._jvm
    fs.mkdirs(of(f"{path}/commits"))
    temp, target = of(f"{path}/commits/.{uuid.uuid4().hex}"), of(f"{path}/commits/{number:010d}.json")
    out = fs.create(temp, False)
    out.write(bytearray((json.dumps(line) + "\n").encode()))
    out.close()
    # FileContext, unlike FileSystem, has a rename that never replaces
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(temp, target, none)
        return True
    except Py4JJavaError as e:
        fs.delete(temp, False)
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
            raise
        return False


def validated_append(spark: SparkSession, path: str, new: DataFrame, key: str, check: Callable[[DataFrame], DataFrame]) -> Appended:
    """Appends ``new`` to the log at ``path`` if ``check`` has no issue with old and new records together.

    ``key`` names the append: one that is committed already is not done again, so a job may repeat a call whose end it did
    not see. The new records are staged, read back and held against what was given, then checked as read, together with the
    log at its last commit; then one rename commits them. If another append commits first, the check is done again over the
    longer log. Empty appends commit an empty batch. ``new`` must not have a column ``batch`` or ``commit_number``.
    """
    batch, staged = uuid.uuid4().hex, None
    for _ in range(TRIES):
        done = commits(spark, path)
        again = done.filter(F.col("key") == key).first()
        if again:
            return Appended("repeated", again.number)
        last = done.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        if staged is None:
            at = f"{path}/batches/batch={batch}"
            new.write.mode("errorifexists").parquet(at)
            staged = spark.read.schema(new.schema).parquet(at)
            given, found = table_digest(new).first(), table_digest(staged).first()
            if given != found:
                raise ValueError(f"{at} does not read back as given")
        old = read_log(spark, path, last)
        whole = staged if old is None else old.drop("commit_number").unionByName(staged, allowMissingColumns=True)
        issues = check(whole)
        if not issues.isEmpty():
            return Appended("refused", None, issues)
        if _commit(spark, path, last + 1, {"number": last + 1, "batch": batch, "key": key, "rows": found.rows}):
            return Appended("committed", last + 1)
    raise RuntimeError(f"{path}: another append was first {TRIES} times")
