"""Structured Streaming forms of intake, replay, audit and activity.

Windowed and deduplicating functions take a streaming or a batch DataFrame alike, so their batch result is their test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import screen_sensitive, snapshot_diff


def activity(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """events(ts, action) -> (start, action, n) by tumbling or, with ``slide``, sliding windows; later events than the
    watermark are dropped from a stream."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """events(ts, key) -> (key, start, end, n): runs of events of one key less than ``gap`` apart; end is the last event
    plus the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def intake(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as they land: (path, sha256, size_bytes, text), each content once. The state grows with the
    number of distinct contents."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.col("content").cast("string").alias("text")).dropDuplicates(["sha256"])


def screened(sink: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the screening of an intake's batch to ``sink``; a repeated batch replaces its own."""

    def run(batch: DataFrame, number: int) -> None:
        screen_sensitive(batch.select(F.col("sha256").alias("artifact_id"), "text")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return run


def diffs(first: DataFrame, store: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch with (path, sha256) of a whole snapshot a batch: writes its difference to the snapshot before it.
    ``first`` stands before batch 0. A repeated batch gives the same files."""

    def run(batch: DataFrame, number: int) -> None:
        now = batch.select("path", "sha256")
        now.write.mode("overwrite").parquet(f"{store}/snapshot={number}")
        prior = batch.sparkSession.read.parquet(f"{store}/snapshot={number - 1}") if number else first
        snapshot_diff(prior, now).write.mode("overwrite").parquet(f"{store}/diff={number}")

    return run


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    position, content, broken = state.get if state.exists else (0, None, False)
    rows = pd.concat(list(frames)).sort_values("position")
    status = None
    for r in rows.itertuples(index=False):
        prior = None if pd.isna(r.prior_hash) else r.prior_hash
        broken = broken or r.position != position + 1 or prior != content
        position, content, status = int(r.position), r.content_hash, r.status
    state.update((position, content, bool(broken)))
    yield pd.DataFrame({"subject": [key[0]], "position": [position], "status": [None if broken else status], "broken": [bool(broken)]})


def replay(decisions: DataFrame) -> DataFrame:
    """decisions(subject, position, prior_hash, content_hash, status) -> per batch and subject its last position and
    status, and whether its chain broke: a position left out or repeated, or a prior hash that is not the last content's.
    A broken chain stays broken and has no status. One row of state a subject."""
    return decisions.groupBy("subject").applyInPandasWithState(
        _follow, "subject string, position long, status string, broken boolean", "position long, content string, broken boolean", "update", "NoTimeout"
    )
