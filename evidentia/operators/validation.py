"""Validation reports: issue rows of rule versions, approvals, authority order and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_authority_order(rules: DataFrame, citations: DataFrame) -> DataFrame:
    """rules(rule_id, rank), citations(rule_id, source_id, rank), rank 1 highest -> rules to author anew: (rule_id,
    source_id), their highest source where it outranks the rule, of equal ones the smallest source_id. Citations
    reduce to one a rule before the join."""
    best = citations.filter("rank is not null").groupBy("rule_id").agg(F.min(F.struct(F.col("rank").alias("r"), "source_id")).alias("best"))
    return rules.join(best, "rule_id").filter(F.col("best.r") < F.col("rank")).select("rule_id", F.col("best.source_id").alias("source_id"))


def validate_versions(versions: DataFrame) -> DataFrame:
    """versions(version_id, rule_id, version, author, approver) -> (version_id, issue): a missing version, one that comes
    again for its rule, a lone one that is not 1.0.0, and an author who approves."""
    rule, same = Window.partitionBy("rule_id"), Window.partitionBy("rule_id", "version")
    v = versions.withColumns({"_n": F.count("*").over(rule), "_same": F.count("*").over(same)})
    have = F.col("version").isNotNull()
    issues = F.array(
        F.when(~have, "MISSING_VERSION"),
        F.when(have & (F.col("_same") > 1), "DUPLICATE_VERSION"),
        F.when(have & (F.col("_n") == 1) & (F.col("version") != "1.0.0"), "LONE_VERSION"),
        F.when(F.col("author") == F.col("approver"), "SELF_APPROVED"),
    )
    return v.select("version_id", F.explode(F.array_compact(issues)).alias("issue"))


def approval_completeness(versions: DataFrame, approvals: DataFrame) -> DataFrame:
    """versions(version_id, rule_id), approvals(version_id) -> per rule its versions and how many no approval names."""
    named = approvals.select("version_id").distinct().withColumn("named", F.lit(1))
    return versions.join(named, "version_id", "left").groupBy("rule_id").agg(F.count("*").alias("versions"), F.count_if(F.col("named").isNull()).alias("unapproved"))


def production_id_collisions(cases: DataFrame) -> DataFrame:
    """cases(case_id, authoritative_id, mode) -> authoritative ids with more than one production case, and how many."""
    return cases.filter("mode = 'production' and authoritative_id is not null").groupBy("authoritative_id").agg(F.countDistinct("case_id").alias("cases")).filter("cases > 1")


def containment_parent(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """artifacts(artifact_id, extracted), edges(artifact_id, parent_hash) -> (artifact_id, parents, issue): an extracted
    member needs exactly one distinct parent, any other artifact has one at most. Null parents count as none; edges
    reduce to one row an artifact before the join."""
    ends = edges.groupBy("artifact_id").agg(F.countDistinct("parent_hash").alias("n"))
    n = F.coalesce("n", F.lit(0))
    issue = F.when(F.col("extracted") & (n == 0), "NO_PARENT").when(n > 1, "SEVERAL_PARENTS")
    return artifacts.join(ends, "artifact_id", "left").select("artifact_id", n.alias("parents"), issue.alias("issue")).filter("issue is not null")


def dedupe_citations(citations: DataFrame) -> DataFrame:
    """Distinct (source_hash, locator, description) of each rule; equal nulls are one."""
    return citations.select("rule_id", "source_hash", "locator", "description").distinct()


def distinct_rule_rows(formulas: DataFrame) -> DataFrame:
    """formulas(rule_id, position, conditions array) -> per rule its first occurrence, conditions joined by "; "."""
    first = formulas.groupBy("rule_id").agg(F.min_by(F.struct("position", "conditions"), "position").alias("f"))
    return first.select("rule_id", F.col("f.position").alias("position"), F.array_join("f.conditions", "; ").alias("conditions"))
