"""Append-only decision logs: replay, chain checks, effective entries, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import semver_key

#: Fixed values: (family, status before or "", action, status after). "review" serves classification, relationship,
#: population and proposal logs alike.
_REVIEW = [("", "approve", "approved"), ("", "reject", "rejected"), ("approved", "revoke", "revoked"), ("approved", "supersede", "superseded"), ("rejected", "supersede", "superseded"), ("revoked", "supersede", "superseded")]
TRANSITIONS = {
    "review": _REVIEW,
    "policy": [("", "approve", "approved"), ("approved", "revoke", "revoked"), ("approved", "supersede", "superseded")],
    "quarantine": [
        ("", "release", "released"), ("", "final-quarantine", "final-quarantine"), ("", "reject", "rejected"),
        ("released", "revoke", "revoked"), ("released", "inherit-release", "released"), ("released", "supersede", "superseded"),
        ("final-quarantine", "continue-quarantine", "final-quarantine"), ("final-quarantine", "release", "released"), ("final-quarantine", "supersede", "superseded"),
        ("rejected", "supersede", "superseded"), ("revoked", "supersede", "superseded"), ("superseded", "supersede", "superseded"),
    ],
    "eligibility": [
        ("", "approve", "eligible"), ("", "inherit-approval", "eligible"), ("", "block", "blocked"), ("eligible", "revoke", "revoked"),
        ("eligible", "supersede", "superseded"), ("blocked", "supersede", "superseded"), ("revoked", "supersede", "superseded"),
    ],
    "unresolved": [
        ("", "resolve", "resolved"), ("", "accept-risk", "accepted-risk"), ("resolved", "reopen", "reopened"), ("accepted-risk", "reopen", "reopened"),
        ("reopened", "resolve", "resolved"), ("reopened", "accept-risk", "accepted-risk"), ("reopened", "supersede", "superseded"),
    ],
    "resolution": [("", "accept", "resolved"), ("", "reject", "resolved"), ("", "supersede", "superseded"), ("", "branch", "superseded")],
}


def log_hash(subject, decision_id, prior_id, action, status):
    parts = [F.coalesce(c.cast("string"), F.lit("-")) for c in (subject, decision_id, prior_id, action, status)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def replay_decisions(log: DataFrame, family: str) -> DataFrame:
    """log(subject, position, actor, decision_id, ordinal, prior_id, prior_hash, content_hash, action, status) ->
    (subject, status, effective_id, entries, error): the last status of a subject whose whole chain holds, else its
    first error. Within an entry the checks go actor, duplicate id, ordinal, link, hash, transition. The stored
    position orders a log; it is never sorted by ordinal."""
    by = Window.partitionBy("subject").orderBy("position")
    seen = Window.partitionBy("subject", "decision_id").orderBy("position")
    rows = [F.struct(F.lit(a).alias("b"), F.lit(x).alias("x"), F.lit(s).alias("s")) for a, x, s in TRANSITIONS[family]]
    before = F.coalesce(F.lag("status").over(by), F.lit(""))
    legal = F.exists(F.array(*rows), lambda t: (t["b"] == F.col("_before")) & (t["x"] == F.col("action")) & (t["s"] == F.col("status")))
    d = log.withColumns({"_before": before, "_pid": F.lag("decision_id").over(by), "_ph": F.lag("content_hash").over(by), "_n": F.row_number().over(by), "_copy": F.row_number().over(seen)})
    own = log_hash(F.col("subject"), F.col("decision_id"), F.col("prior_id"), F.col("action"), F.col("status"))
    error = (
        F.when(F.coalesce(F.trim("actor"), F.lit("")) == "", "ACTOR")
        .when(F.col("_copy") > 1, "DUPLICATE_ID")
        .when(~F.col("ordinal").eqNullSafe(F.col("_n")), "ORDINAL")
        .when(~F.col("prior_id").eqNullSafe(F.col("_pid")) | ~F.col("prior_hash").eqNullSafe(F.col("_ph")), "LINK")
        .when(~F.col("content_hash").eqNullSafe(own), "HASH")
        .when(~F.coalesce(legal, F.lit(False)), "TRANSITION")
    )
    d = d.withColumn("error", error)
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("position")))
    out = d.groupBy("subject").agg(F.max_by("status", "position").alias("s"), F.max_by("decision_id", "position").alias("e"), F.count("*").alias("entries"), first.alias("error"))
    return out.select("subject", F.when(F.col("error").isNull(), F.col("s")).alias("status"), F.when(F.col("error").isNull(), F.col("e")).alias("effective_id"), "entries", "error")


def validate_audit_chain(log: DataFrame) -> DataFrame:
    """Every issue of every entry: (subject, position, issue)."""
    by = Window.partitionBy("subject").orderBy("position")
    d = log.withColumns({"_n": F.row_number().over(by), "_ph": F.lag("content_hash").over(by), "_pid": F.lag("decision_id").over(by)})
    issues = F.array(
        F.when(~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "HASH_FORMAT"),
        F.when(~F.col("ordinal").eqNullSafe(F.col("_n")), "ORDINAL_GAP"),
        F.when(~F.col("prior_id").eqNullSafe(F.col("_pid")), "BROKEN_LINK"),
        F.when(~F.col("prior_hash").eqNullSafe(F.col("_ph")), "STALE_HASH"),
    )
    return d.select("subject", "position", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def effective_decision(log: DataFrame) -> DataFrame:
    return log.groupBy("subject").agg(F.max_by("action", "position").alias("action"), F.max("position").alias("position"))


def latest_version(versions: DataFrame) -> DataFrame:
    """versions(rule_id, version) -> the highest semantic version of each rule."""
    return versions.groupBy("rule_id").agg(F.max_by("version", semver_key(F.col("version"))).alias("version"))


def latest_approval(approvals: DataFrame) -> DataFrame:
    """approvals(subject, approved_at, approver) -> newest one, its approver, and how many."""
    return approvals.groupBy("subject").agg(F.max("approved_at").alias("approved_at"), F.max_by("approver", F.struct("approved_at", "approver")).alias("approver"), F.count("*").alias("approvals"))


def audit_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("action").agg(F.count("*").alias("events"), F.count_distinct("actor").alias("actors"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def audit_events_by(events: DataFrame, start, end) -> DataFrame:
    """Inclusive at both ends."""
    return events.filter(F.col("at").between(start, end))


def production_gate(artifacts: DataFrame, approvals: DataFrame) -> DataFrame:
    """artifacts(artifact_id), approvals(artifact_id, quality, toxic) -> (artifact_id, ok, reason)."""
    j = artifacts.join(approvals, "artifact_id", "left")
    reason = F.when(F.col("quality").isNull(), "unreviewed").when(F.col("quality") != 1, "not-approved").when(F.col("toxic") == 1, "blocked").otherwise("released")
    return j.select("artifact_id", (reason == "released").alias("ok"), reason.alias("reason"))


def plan_resume(attempts: DataFrame) -> DataFrame:
    """attempts(subject, position, snapshot, outcome): resume after an interruption with an unchanged snapshot, else a
    linked attempt; the first is new."""
    by = Window.partitionBy("subject").orderBy("position")
    plan = F.when(F.lag("snapshot").over(by).isNull(), "new").when((F.lag("snapshot").over(by) == F.col("snapshot")) & (F.lag("outcome").over(by) == "interrupted"), "resume").otherwise("linked")
    return attempts.select("subject", "position", plan.alias("plan"))
