"""Evidence and case operators: catalog sections, gates, approvals, inventories, stages, populations, profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import detect_signature
from ..functions.scalars import signal_tokens

#: States that keep an artifact from inspection.
GATED = ("quarantine", "safety-block", "rescreen")
#: Field names that a de-identified export never holds.
PROHIBITED = ("name", "firstname", "middlename", "lastname", "fullname", "ssn", "socialsecuritynumber", "address", "streetaddress", "email", "phone", "telephone", "employeeid", "participantid")
#: Stages of a case in order.
STAGES = ("evidence", "plan-rules", "population-profile", "v1-architecture", "build-spec", "compiled-formulas", "workbook", "validation-reconciliation", "section-436")
#: Fixed values: (artifact type, artifact type it leads to, relationship).
LINEAGE = [
    ("evidence-manifest", "plan-rule-record", "supports-rule-authoring"),
    ("plan-rule-record", "v1-architecture", "drives-architecture"),
    ("population-profile", "v1-architecture", "drives-architecture"),
    ("v1-architecture", "build-spec", "builds-specification"),
    ("build-spec", "compiled-formula-artifact", "compiles-formulas"),
    ("compiled-formula-artifact", "v1-workbook", "builds-workbook"),
    ("v1-workbook", "validation-result", "validates-workbook"),
    ("validation-result", "reconciliation-result", "reconciles-results"),
    ("plan-rule-record", "section-436-evaluation", "supports-section-436"),
]


def _rows(spark, names: str, rows: list[tuple]) -> DataFrame:
    """A table of fixed values, made in the plan."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names.split(), r, strict=True))) for r in rows))))


def screening_gate(results: DataFrame) -> DataFrame:
    """results(artifact_id, state) -> those that go on to inspection; an artifact without a state does not."""
    return results.filter(F.coalesce(~F.col("state").isin(*GATED), F.lit(False)))


def disallowed_fields(records: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """records(record_id, fields map) -> (record_id, field, reason): prohibited names, and any outside ``allowed``. Names
    are compared by their letters and digits in lower case."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    f = records.select("record_id", F.explode(F.map_keys("fields")).alias("field"))
    reason = F.when(plain(F.col("field")).isin(*PROHIBITED), "prohibited").when(~F.col("field").isin(*allowed), "not-allowed")
    return f.select("record_id", "field", reason.alias("reason")).filter("reason is not null")


def approved_source_role(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposals(proposal_id, artifact_id, role), decisions(proposal_id, position, status) -> (artifact_id, role, issue):
    the one role whose last decision approves it; none or several are an issue and no role."""
    last = decisions.groupBy("proposal_id").agg(F.max_by("status", "position").alias("status"))
    p = proposals.join(last, "proposal_id", "left").withColumn("role", F.when(F.col("status") == "approved", F.col("role")))
    n = p.groupBy("artifact_id").agg(F.count_distinct("role").alias("n"), F.min("role").alias("r"))
    return n.select("artifact_id", F.when(F.col("n") == 1, F.col("r")).alias("role"), F.when(F.col("n") == 0, "NO_APPROVED_ROLE").when(F.col("n") > 1, "SEVERAL_APPROVED_ROLES").alias("issue"))


def reuse_approval(sources: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Both (id, sha256, dimension, value): a duplicate may take the approval of a source of the same content, dimension
    and value; of several the smallest id."""
    s = sources.groupBy("sha256", "dimension", "value").agg(F.min("id").alias("source_id"))
    return duplicates.join(s, ["sha256", "dimension", "value"]).select("id", "source_id")


def catalog_sections(outcomes: DataFrame) -> DataFrame:
    """outcomes(artifact_id, receipt_id, screened, decision, position, role, parents, extracted) -> per artifact its canonical
    receipt (the smallest), its section and its issue.

    The decision in force is the one of the highest position. Without a screening outcome there is the issue UNSCREENED, without
    a decision or with any but those named here UNDECIDED. A final quarantine, a rejection and a revocation make it
    excludedQuarantined, whatever else it lacks. Released and eligible ones need a role (NO_ROLE), the same one in each outcome
    (ROLE_CONFLICT), and, if extracted, exactly one parent (CONTAINMENT); training and other sources are referenceOnly, all
    else caseEvidence. What has an issue has no section."""
    a = outcomes.groupBy("artifact_id").agg(
        F.min("receipt_id").alias("receipt_id"), *(F.max(c).alias(c) for c in ("screened", "role", "parents", "extracted")), F.min("role").alias("role2"),
        F.max_by("decision", F.when(F.col("decision").isNotNull(), F.struct("position", "decision"))).alias("decision"),
    )
    d = F.coalesce("decision", F.lit(""))
    out = d.isin("final-quarantine", "rejected", "revoked")
    issue = (
        F.when(F.col("screened").isNull(), "UNSCREENED").when(out, None).when(~d.isin("released", "eligible"), "UNDECIDED").when(F.col("role").isNull(), "NO_ROLE")
        .when(F.col("role") != F.col("role2"), "ROLE_CONFLICT").when(F.col("extracted") & (F.coalesce("parents", F.lit(0)) != 1), "CONTAINMENT")
    )
    section = F.when(out, "excludedQuarantined").when(F.col("role").isin("training-reference", "other"), "referenceOnly").otherwise("caseEvidence")
    return a.select("artifact_id", "receipt_id", F.when(issue.isNull(), section).alias("section"), issue.alias("issue"))


def cross_section_repeats(catalog: DataFrame) -> DataFrame:
    """catalog(artifact_id, section) -> artifacts in more than one section."""
    return catalog.groupBy("artifact_id").agg(F.count_distinct("section").alias("sections")).filter("sections > 1")


def select_dates(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates(candidate_id, artifact_id, normalized), decisions(decision_id, candidate_id, artifact_id, actor_type) ->
    (decision_id, normalized, issue): a decision is a person's and names exactly one valid candidate of its artifact."""
    valid = candidates.filter("normalized is not null").groupBy("candidate_id", "artifact_id").agg(F.count("*").alias("n"), F.min("normalized").alias("normalized"))
    j = decisions.join(valid, ["candidate_id", "artifact_id"], "left")
    issue = F.when(~F.coalesce(F.col("actor_type") == "human", F.lit(False)), "ACTOR").when(F.col("n").isNull(), "NO_CANDIDATE").when(F.col("n") > 1, "AMBIGUOUS")
    return j.select("decision_id", F.when(issue.isNull(), F.col("normalized")).alias("normalized"), issue.alias("issue"))


def inventory_projection(artifacts: DataFrame) -> DataFrame:
    """artifacts(case_id, processing, eligibility) -> counts of each case and its required actions."""
    n = lambda c, v, name: F.count_if(F.coalesce(F.col(c) == v, F.lit(False))).alias(name)
    g = artifacts.groupBy("case_id").agg(F.count("*").alias("artifacts"), n("processing", "preserved", "preserved"), n("processing", "completed", "completed"), n("processing", "failed", "failed"), n("eligibility", "blocked", "blocked"), n("eligibility", "pending-human-decision", "pending"))
    say = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    return g.withColumn("actions", F.concat_ws("; ", say("pending", " artifact(s) awaiting human review"), say("failed", " artifact(s) failed processing")))


def status_groups(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("case_id", "processing").agg(F.count("*").alias("artifacts"))


def profile_workbook(cells: DataFrame) -> DataFrame:
    """cells(file, sheet, row, col, value, hidden), row 1 the headers -> per sheet its header fields, records (distinct
    rows less one) and whether it is hidden."""
    head = F.when((F.col("row") == 1) & (F.coalesce("value", F.lit("")) != ""), F.col("col"))
    g = cells.groupBy("file", "sheet").agg(F.count(head).alias("fields"), F.count_distinct("row").alias("r"), F.bool_or("hidden").alias("hidden"))
    return g.select("file", "sheet", "fields", F.greatest(F.lit(0), F.col("r") - 1).cast("long").alias("records"), "hidden")


def profile_cells(cells: DataFrame) -> DataFrame:
    """cells(file, sheet, address, formula) -> per sheet its cells and those with a formula; no formula is evaluated."""
    return cells.groupBy("file", "sheet").agg(F.count("*").alias("cells"), F.count("formula").alias("formulas"))


def population_dimensions(evidence: DataFrame) -> DataFrame:
    """evidence(subject, dimension, value) -> the one value of each dimension, or null and a conflict."""
    g = evidence.filter("value is not null").groupBy("subject", "dimension").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    same = F.col("lo") == F.col("hi")
    return g.select("subject", "dimension", F.when(same, F.col("lo")).alias("value"), (~same).alias("conflict"))


def stage_rollup(artifacts: DataFrame, unresolved: DataFrame, required: tuple[str, ...] = STAGES) -> DataFrame:
    """artifacts(case_id, stage), unresolved(case_id, stage, item_id) -> a row for each case and stage: ordinal, required,
    status (blocked by a missing required artifact or open items, else ready, or absent where not required) and the
    number of blockers."""
    spark = artifacts.sparkSession
    dim = _rows(spark, "ordinal stage required", [(k, s, s in required) for k, s in enumerate(STAGES)])
    have = artifacts.groupBy("case_id", "stage").agg(F.count("*").alias("have"))
    open_ = unresolved.groupBy("case_id", "stage").agg(F.count("*").alias("open"))
    cases = artifacts.select("case_id").union(unresolved.select("case_id")).distinct()
    each = cases.withColumn("stage", F.explode(F.array(*(F.lit(s) for s in STAGES))))
    j = each.join(dim, "stage").join(have, ["case_id", "stage"], "left").join(open_, ["case_id", "stage"], "left")
    none, n = F.col("have").isNull(), F.coalesce("open", F.lit(0))
    status = F.when((F.col("required") & none) | (n > 0), "blocked").when(none, "absent").otherwise("ready")
    return j.select("case_id", "ordinal", "stage", "required", status.alias("status"), (n + (F.col("required") & none).cast("int")).cast("long").alias("blockers"))


def package_status(stages: DataFrame) -> DataFrame:
    """stages(case_id, required, status) -> blocked where a required stage is."""
    bad = F.bool_or(F.col("required") & (F.col("status") == "blocked"))
    return stages.groupBy("case_id").agg(F.when(bad, "blocked").otherwise("complete").alias("status"))


def stage_lineage_edges(artifacts: DataFrame) -> DataFrame:
    """artifacts(case_id, type, sha256) -> the edges of the fixed template whose both ends are there; of several
    artifacts of a type the largest hash stands for it."""
    one = artifacts.groupBy("case_id", "type").agg(F.max("sha256").alias("sha256"))
    template = _rows(artifacts.sparkSession, "from_type to_type relationship", LINEAGE)
    a = one.select("case_id", F.col("type").alias("from_type"), F.col("sha256").alias("from_sha256"))
    b = one.select("case_id", F.col("type").alias("to_type"), F.col("sha256").alias("to_sha256"))
    return a.join(template, "from_type").join(b, ["case_id", "to_type"]).select("case_id", "from_sha256", "to_sha256", "relationship")


def signal_profile(docs: DataFrame, most: int = 500) -> DataFrame:
    """docs(doc_id, text) -> how many distinct signal tokens a text has, and the first ``most`` of them in order."""
    s = F.array_sort(signal_tokens(F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", F.size(s).cast("long").alias("tokens"), F.slice(s, 1, most).alias("first"))


def package_outcome(events: DataFrame) -> DataFrame:
    """events(package_id, artifact_id, stage) -> interrupted without an end, partial where any failed, else completed."""
    g = events.groupBy("package_id").agg(F.count_if(F.col("stage") == "failed").alias("failed"), F.bool_or(F.col("stage") == "finished").alias("ended"))
    return g.select("package_id", "failed", F.when(~F.coalesce("ended", F.lit(False)), "interrupted").when(F.col("failed") > 0, "partial").otherwise("completed").alias("outcome"))


def screen_binary(files: DataFrame) -> DataFrame:
    """files(artifact_id, name, content, declared) -> findings (artifact_id, check, severity): executable signatures,
    extensions of scripts, and a declared media type that the signature contradicts."""
    f = files.withColumn("media", detect_signature(F.col("content")))
    checks = F.array(
        F.when(F.col("media").isin("application/x-dosexec", "application/x-elf"), F.struct(F.lit("executable-signature").alias("check"), F.lit("critical").alias("severity"))),
        F.when(F.lower("name").rlike(r"\.(?:bat|cmd|js|mjs|ps1|sh|vbs)$"), F.struct(F.lit("script-capable-extension").alias("check"), F.lit("critical").alias("severity"))),
        F.when((F.coalesce("declared", F.lit("")) != "") & (F.col("declared") != "application/octet-stream") & (F.col("declared") != F.col("media")), F.struct(F.lit("media-signature-mismatch").alias("check"), F.lit("error").alias("severity"))),
    )
    return f.select("artifact_id", F.inline(F.array_compact(checks)))


def run_checks(docs: DataFrame, checks: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """docs(artifact_id, ...) through each check, which gives (artifact_id, outcome) -> (artifact_id, check_id, outcome). An
    artifact on which a check says nothing, or null, has an error finding: silence never passes."""
    out = None
    for name, check in checks.items():
        said = docs.select("artifact_id").distinct().join(check(docs).select("artifact_id", "outcome"), "artifact_id", "left")
        one = said.select("artifact_id", F.lit(name).alias("check_id"), F.coalesce("outcome", F.lit("error")).alias("outcome"))
        out = one if out is None else out.unionByName(one)
    return out


def hidden_by_rank(sheets: DataFrame, last: int) -> DataFrame:
    """sheets(file, sheet, position), a row per appearance -> the ``last`` sheets of a file by first appearance are hidden."""
    first = sheets.groupBy("file", "sheet").agg(F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("position"), F.desc("sheet")))
    return first.select("file", "sheet", (rank <= last).alias("hidden"))


def project_latest_items(revisions: DataFrame) -> DataFrame:
    """revisions(item_id, position, ordinal, prior_hash, hash, content, status, history array) -> (item_id, ordinal, status,
    broken): an item's last revision, and how many do not extend the one before by one event of the same content; the
    first opens the item with an empty history."""
    by = Window.partitionBy("item_id").orderBy("position")
    before = lambda c: F.lag(c).over(by)
    first = F.row_number().over(by) == 1
    opens = (F.col("ordinal") == 1) & F.col("prior_hash").isNull() & (F.col("status") == "open") & (F.size("history") == 0)
    extends = (F.col("ordinal") == before("ordinal") + 1) & F.col("prior_hash").eqNullSafe(before("hash")) & F.col("content").eqNullSafe(before("content"))
    extends = extends & (F.size("history") == F.size(before("history")) + 1) & (F.slice("history", F.lit(1), F.greatest(F.lit(0), F.size("history") - 1)) == before("history"))
    d = revisions.withColumn("ok", F.coalesce(F.when(first, opens).otherwise(extends), F.lit(False)))
    return d.groupBy("item_id").agg(F.max_by("ordinal", "position").alias("ordinal"), F.max_by("status", "position").alias("status"), F.count_if(~F.col("ok")).alias("broken"))


def canonical_order(df: DataFrame, *keys: str) -> DataFrame:
    """A total order by the UTF-8 bytes of the keys, then by a hash of the whole row: no order of the input shows."""
    return df.orderBy(*keys, F.xxhash64(*df.columns))


def newest_first(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """All versions, approvals or events of each key, numbered from the newest."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))))


def manifest_report(entries: DataFrame, group: str) -> DataFrame:
    """entries(group, kind, status) -> one line per group: its entries and how many of each are verified, failed or open,
    as columns and as a text that no order of rows changes."""
    n = lambda s: F.count_if(F.coalesce(F.col("status") == s, F.lit(False))).alias(s)
    g = entries.groupBy(group).agg(F.count("*").alias("entries"), n("verified"), n("failed"), n("open"))
    line = F.concat(F.col(group).cast("string"), F.lit(": "), F.col("entries").cast("string"), F.lit(" entries, "), F.col("verified").cast("string"), F.lit(" verified, "), F.col("failed").cast("string"), F.lit(" failed"))
    return g.withColumn("line", line)


