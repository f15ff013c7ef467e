"""Registered queries of the evidence and case operators, over tables derived from the given ones in both engines alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import casework as W
from ..operators import decisions as D
from ..operators import graphs as G
from ..operators import rules as R
from ..operators import tables as T
from .catalog import query


def _pick(column, *values):
    """The value whose number is the column's remainder."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(column) % len(values) + 1).cast("int"))


@query("SELECT o_orderkey AS artifact_id, (['passed', 'quarantine', 'released', 'safety-block', 'rescreen', NULL])[(o_orderkey % 6 + 1)::INT] AS state FROM orders WHERE o_orderkey % 6 IN (0, 2)")
def screening_gate(t):
    return W.screening_gate(t("orders").select(F.col("o_orderkey").alias("artifact_id"), _pick("o_orderkey", "passed", "quarantine", "released", "safety-block", "rescreen", None).alias("state")))


@query("""WITH f AS (SELECT c_custkey AS record_id, unnest(['Employee-ID', 'segment', 'balance' || (c_custkey % 3), 'First Name']) AS field FROM customer)
SELECT record_id, field, CASE WHEN regexp_replace(lower(field), '[^a-z0-9]', '', 'g') IN ('employeeid', 'firstname') THEN 'prohibited' ELSE 'not-allowed' END AS reason FROM f WHERE field NOT IN ('segment', 'balance0', 'balance1')""")
def disallowed_fields(t):
    key = F.concat(F.lit("balance"), (F.col("c_custkey") % 3).cast("string"))
    fields = F.create_map(F.lit("Employee-ID"), F.lit("x"), F.lit("segment"), "c_mktsegment", key, F.lit("1"), F.lit("First Name"), F.lit("y"))
    return W.disallowed_fields(t("customer").select(F.col("c_custkey").alias("record_id"), fields.alias("fields")), ("segment", "balance0", "balance1"))


@query("""WITH p AS (SELECT o_custkey AS a, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN 'role' || o_orderkey % 4 END AS r FROM orders), g AS (SELECT a AS artifact_id, count(DISTINCT r) AS n, min(r) AS r FROM p GROUP BY 1)
SELECT artifact_id, CASE WHEN n = 1 THEN r END AS role, CASE WHEN n = 0 THEN 'NO_APPROVED_ROLE' WHEN n > 1 THEN 'SEVERAL_APPROVED_ROLES' END AS issue FROM g""")
def approved_source_role(t):
    k = F.col("o_orderkey")
    p = t("orders").select(k.alias("proposal_id"), F.col("o_custkey").alias("artifact_id"), F.concat(F.lit("role"), (k % 4).cast("string")).alias("role"))
    d = t("orders").filter(k % 3 != 0).select(k.alias("proposal_id"), F.explode(F.array(F.struct(F.lit(1).alias("position"), F.lit("approved").alias("status")), F.struct(F.lit(2).alias("position"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("revoked").alias("status")))).alias("d"))
    return W.approved_source_role(p, d.select("proposal_id", "d.*"))


@query("""WITH p AS (SELECT p_partkey AS id, p_brand, split_part(p_type, ' ', 1) AS d, p_size % 5 AS v FROM part), s AS (SELECT p_brand, d, v, min(id) AS source_id FROM p WHERE id % 2 = 0 GROUP BY ALL)
SELECT id, source_id FROM p JOIN s USING (p_brand, d, v) WHERE id % 2 = 1""")
def reuse_approval(t):
    p = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("sha256"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("dimension"), (F.col("p_size") % 5).alias("value"))
    return W.reuse_approval(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"))


_OUT = """r AS (SELECT l_orderkey AS a, l_suppkey AS receipt, l_linenumber AS n, CASE WHEN l_orderkey % 11 <> 0 THEN CASE WHEN l_returnflag = 'R' THEN 'safety-block' ELSE 'pass' END END AS screened,
CASE WHEN l_orderkey % 13 <> 0 THEN CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 'released' WHEN 1 THEN 'rejected' WHEN 2 THEN 'eligible' WHEN 3 THEN 'revoked' WHEN 4 THEN 'final-quarantine' WHEN 5 THEN 'pending' END END AS decision,
CASE l_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'other' WHEN 2 THEN 'training-reference' WHEN 3 THEN 'role' || l_linenumber ELSE 'amendment' END AS role FROM lineitem),
o AS (SELECT a, min(receipt) AS receipt_id, max(screened) AS screened, arg_max(decision, n) FILTER (decision IS NOT NULL) AS d, min(role) AS role, count(DISTINCT role) AS roles, max(n) AS parents, a % 3 = 0 AS extracted FROM r GROUP BY a)"""


@query(f"""WITH {_OUT}, i AS (SELECT *, coalesce(d IN ('rejected', 'revoked', 'final-quarantine'), false) AS gone FROM o), j AS (SELECT *, CASE WHEN screened IS NULL THEN 'UNSCREENED' WHEN gone THEN NULL WHEN d IS NULL OR d = 'pending' THEN 'UNDECIDED' WHEN role IS NULL THEN 'NO_ROLE' WHEN roles > 1 THEN 'ROLE_CONFLICT' WHEN extracted AND parents <> 1 THEN 'CONTAINMENT' END AS issue FROM i)
SELECT a AS artifact_id, receipt_id, CASE WHEN issue IS NOT NULL THEN NULL WHEN gone THEN 'excludedQuarantined' WHEN role IN ('training-reference', 'other') THEN 'referenceOnly' ELSE 'caseEvidence' END AS section, issue FROM j""")
def catalog_sections(t):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    d = F.element_at(F.array(*(F.lit(x) for x in ("released", "rejected", "eligible", "revoked", "final-quarantine", "pending", None))), ((k + n) % 7 + 1).cast("int"))
    role = F.when(k % 7 == 0, None).when(k % 7 == 1, "other").when(k % 7 == 2, "training-reference").when(k % 7 == 3, F.concat(F.lit("role"), n.cast("string"))).otherwise("amendment")
    return W.catalog_sections(t("lineitem").select(
        k.alias("artifact_id"), F.col("l_suppkey").alias("receipt_id"), F.when(k % 11 != 0, F.when(F.col("l_returnflag") == "R", "safety-block").otherwise("pass")).alias("screened"),
        F.when(k % 13 != 0, d).alias("decision"), n.alias("position"), role.alias("role"), n.alias("parents"), (k % 3 == 0).alias("extracted"),
    ))


@query("SELECT o_custkey AS artifact_id, count(DISTINCT o_orderstatus) AS sections FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def cross_section_repeats(t):
    return W.cross_section_repeats(t("orders").select(F.col("o_custkey").alias("artifact_id"), F.col("o_orderstatus").alias("section")))


@query("""WITH c AS (SELECT l_partkey AS c, l_suppkey AS a, count(*) AS n, min(l_shipdate::DATE) AS d FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL), d AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS c, l_suppkey AS a, l_orderkey % 4 = 0 AS machine FROM lineitem),
j AS (SELECT id, d, CASE WHEN machine THEN 'ACTOR' WHEN n IS NULL THEN 'NO_CANDIDATE' WHEN n > 1 THEN 'AMBIGUOUS' END AS issue FROM d LEFT JOIN c USING (c, a)) SELECT id AS decision_id, CASE WHEN issue IS NULL THEN d::VARCHAR END AS normalized, issue FROM j""")
def select_dates(t):
    l = t("lineitem").select(F.col("l_partkey").alias("candidate_id"), F.col("l_suppkey").alias("artifact_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("decision_id"), F.when(F.col("l_linenumber") != 3, F.to_date("l_shipdate")).alias("normalized"), F.when(F.col("l_orderkey") % 4 != 0, "human").alias("actor_type"))  # noqa: E741
    return W.select_dates(l, l.drop("normalized")).withColumn("normalized", F.col("normalized").cast("string"))


_ARTIFACTS = "a AS (SELECT o_custkey AS case_id, (['preserved', 'completed', 'failed'])[(o_orderkey % 3 + 1)::INT] AS processing, (['eligible', 'blocked', 'pending-human-decision', NULL])[(o_orderkey % 4 + 1)::INT] AS eligibility FROM orders)"


def _artifacts(t):
    return t("orders").select(F.col("o_custkey").alias("case_id"), _pick("o_orderkey", "preserved", "completed", "failed").alias("processing"), _pick("o_orderkey", "eligible", "blocked", "pending-human-decision", None).alias("eligibility"))


@query(f"""WITH {_ARTIFACTS}, g AS (SELECT case_id, count(*) AS artifacts, count(*) FILTER (processing = 'preserved') AS preserved, count(*) FILTER (processing = 'completed') AS completed, count(*) FILTER (processing = 'failed') AS failed,
count(*) FILTER (eligibility = 'blocked') AS blocked, count(*) FILTER (eligibility = 'pending-human-decision') AS pending FROM a GROUP BY 1)
SELECT *, concat_ws('; ', CASE WHEN pending > 0 THEN pending || ' artifact(s) awaiting human review' END, CASE WHEN failed > 0 THEN failed || ' artifact(s) failed processing' END) AS actions FROM g""")
def inventory_projection(t):
    return W.inventory_projection(_artifacts(t))


@query(f"WITH {_ARTIFACTS} SELECT case_id, processing, count(*) AS artifacts FROM a GROUP BY ALL")
def status_groups(t):
    return W.status_groups(_artifacts(t))


@query("""WITH c AS (SELECT l_returnflag AS file, 's' || l_suppkey % 7 AS sheet, l_linenumber AS row, l_suppkey AS col, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE l_linestatus END AS value, l_suppkey % 7 = 3 AS hidden FROM lineitem)
SELECT file, sheet, count(*) FILTER (row = 1 AND value <> '') AS fields, greatest(0, count(DISTINCT row) - 1) AS records, bool_or(hidden) AS hidden FROM c GROUP BY ALL""")
def profile_workbook(t):
    value = F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.col("l_linestatus"))
    return W.profile_workbook(t("lineitem").select(F.col("l_returnflag").alias("file"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("sheet"), F.col("l_linenumber").alias("row"), F.col("l_suppkey").alias("col"), value.alias("value"), (F.col("l_suppkey") % 7 == 3).alias("hidden")))


@query("SELECT p_brand AS file, p_type AS sheet, count(*) AS cells, count(*) FILTER (p_size % 3 = 0) AS formulas FROM part GROUP BY ALL")
def profile_cells(t):
    return W.profile_cells(t("part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("sheet"), F.col("p_partkey").alias("address"), F.when(F.col("p_size") % 3 == 0, F.lit("=A1")).alias("formula")))


@query("""SELECT o_custkey AS subject, o_orderstatus AS dimension, CASE WHEN min(o_orderpriority) = max(o_orderpriority) THEN min(o_orderpriority) END AS value, min(o_orderpriority) <> max(o_orderpriority) AS conflict FROM orders WHERE o_orderpriority <> '2-HIGH' GROUP BY ALL""")
def population_dimensions(t):
    value = F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderpriority"))
    return W.population_dimensions(t("orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("dimension"), value.alias("value")))


_STAGED = f"""dim AS (SELECT unnest(range({len(W.STAGES)})) AS ordinal, unnest({list(W.STAGES)}) AS stage), h AS (SELECT o_custkey AS case_id, {list(W.STAGES)}[(o_orderkey % 9 + 1)::INT] AS stage, count(*) AS have FROM orders GROUP BY ALL),
u AS (SELECT o_custkey AS case_id, {list(W.STAGES)}[(o_orderkey % 9 + 1)::INT] AS stage, count(*) AS open FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
s AS (SELECT case_id, ordinal, stage, stage <> 'section-436' AS required, have, coalesce(open, 0) AS n FROM (SELECT DISTINCT o_custkey AS case_id FROM orders) CROSS JOIN dim LEFT JOIN h USING (case_id, stage) LEFT JOIN u USING (case_id, stage)),
r AS (SELECT case_id, ordinal, stage, required, CASE WHEN (required AND have IS NULL) OR n > 0 THEN 'blocked' WHEN have IS NULL THEN 'absent' ELSE 'ready' END AS status, n + (required AND have IS NULL)::INT AS blockers FROM s)"""


def _staged(t):
    o = t("orders").select(F.col("o_custkey").alias("case_id"), _pick("o_orderkey", *W.STAGES).alias("stage"), F.col("o_orderkey").alias("item_id"), "o_orderpriority")
    return W.stage_rollup(o, o.filter("o_orderpriority = '1-URGENT'"), W.STAGES[:-1])


@query(f"WITH {_STAGED} SELECT case_id, ordinal::INT AS ordinal, stage, required, status, blockers::BIGINT AS blockers FROM r")
def stage_rollup(t):
    return _staged(t)


@query(f"WITH {_STAGED} SELECT case_id, CASE WHEN bool_or(required AND status = 'blocked') THEN 'blocked' ELSE 'complete' END AS status FROM r GROUP BY 1")
def package_status(t):
    return W.package_status(_staged(t))


_TYPES = ["evidence-manifest", "plan-rule-record", "population-profile", "v1-architecture", "build-spec", "compiled-formula-artifact", "v1-workbook", "validation-result", "reconciliation-result", "section-436-evaluation"]


@query(f"""WITH a AS (SELECT o_custkey AS case_id, {_TYPES}[(o_orderkey % 10 + 1)::INT] AS type, max(sha256(o_orderkey::VARCHAR)) AS h FROM orders GROUP BY ALL), e AS (SELECT unnest({[list(x) for x in W.LINEAGE]}) AS e)
SELECT x.case_id, x.h AS from_sha256, y.h AS to_sha256, e[3] AS relationship FROM e JOIN a x ON x.type = e[1] JOIN a y ON y.type = e[2] AND y.case_id = x.case_id""")
def stage_lineage_edges(t):
    return W.stage_lineage_edges(t("orders").select(F.col("o_custkey").alias("case_id"), _pick("o_orderkey", *_TYPES).alias("type"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256")))


@query(r"""WITH d AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+'), lambda x: length(x) BETWEEN 2 AND 40 AND NOT regexp_full_match(x, '[0-9]+')))) AS s FROM documents)
SELECT doc_id, len(s) AS tokens, s[1:500] AS first FROM d""")
def signal_profile(t):
    return W.signal_profile(t("documents"))


@query("""SELECT user_id AS package_id, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN NOT bool_or(event_type = 'purchase') THEN 'interrupted' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'partial' ELSE 'completed' END AS outcome FROM events GROUP BY 1""")
def package_outcome(t):
    stage = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "finished").otherwise(F.col("event_type"))
    return W.package_outcome(t("events").select(F.col("user_id").alias("package_id"), F.col("event_id").alias("artifact_id"), stage.alias("stage")))


@query("""WITH f AS (SELECT p_partkey AS id, p_partkey % 5 AS k, (['application/pdf', 'application/octet-stream', NULL])[(p_partkey % 3 + 1)::INT] AS declared, (['application/x-dosexec', 'application/x-elf', 'application/zip', 'application/pdf', NULL])[(p_partkey % 5 + 1)::INT] AS media FROM part)
SELECT id AS artifact_id, 'executable-signature' AS "check", 'critical' AS severity FROM f WHERE k < 2 UNION ALL SELECT id, 'script-capable-extension', 'critical' FROM f WHERE id % 7 = 0 UNION ALL SELECT id, 'media-signature-mismatch', 'error' FROM f WHERE declared = 'application/pdf' AND declared <> media""")
def screen_binary(t):
    k = F.col("p_partkey")
    magic = F.element_at(F.array(*(F.unhex(F.lit(x)) for x in ("4D5A90", "7F454C46", "504B0304", "25504446", "504B0506"))), (k % 5 + 1).cast("int"))
    name = F.concat("p_name", F.when(k % 7 == 0, ".PS1").otherwise(".txt"))
    return W.screen_binary(t("part").select(k.alias("artifact_id"), name.alias("name"), magic.alias("content"), _pick("p_partkey", "application/pdf", "application/octet-stream", None).alias("declared")))


@query("""SELECT doc_id AS artifact_id, 'length' AS check_id, CASE WHEN text IS NULL THEN 'error' WHEN length(text) > 2000 THEN 'blocked' ELSE 'pass' END AS outcome FROM documents
UNION ALL SELECT doc_id, 'language', CASE WHEN lang = 'en' THEN 'pass' ELSE 'error' END FROM documents""")
def run_checks(t):
    d = t("documents").withColumnRenamed("doc_id", "artifact_id")
    length = lambda x: x.select("artifact_id", F.when(F.length("text") > 2000, "blocked").when(F.length("text") <= 2000, "pass").alias("outcome"))
    return W.run_checks(d, {"length": length, "language": lambda x: x.filter("lang = 'en'").select("artifact_id", F.lit("pass").alias("outcome"))})


@query("""WITH f AS (SELECT o_custkey AS file, o_orderpriority AS sheet, min(o_orderkey) AS p FROM orders GROUP BY ALL) SELECT file, sheet, row_number() OVER (PARTITION BY file ORDER BY p DESC, sheet DESC) <= 2 AS hidden FROM f""")
def hidden_by_rank(t):
    return W.hidden_by_rank(t("orders").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("sheet"), F.col("o_orderkey").alias("position")), 2)


@query("""WITH o AS (SELECT l_orderkey AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem), r AS (SELECT i, n, n AS p, i % 5 = 0 AND n = 2 AS a, i % 7 = 0 AND n = 3 AS b, i % 3 = 0 AS c FROM o),
k AS (SELECT *, lag(a) OVER w AS pa, CASE WHEN n = 1 THEN NOT c ELSE NOT b AND NOT a AND NOT coalesce(lag(a) OVER w, false) END AS ok FROM r WINDOW w AS (PARTITION BY i ORDER BY p))
SELECT i AS item_id, arg_max(n + a::INT, p) AS ordinal, arg_max(CASE WHEN n = 1 AND NOT c THEN 'open' ELSE 'resolved' END, p) AS status, count(*) FILTER (NOT ok) AS broken FROM k GROUP BY 1""")
def project_latest_items(t):
    from pyspark.sql import Window

    by = Window.partitionBy("item_id").orderBy("position")
    k = F.col("item_id")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    d = t("lineitem").select(F.col("l_orderkey").alias("item_id"), place.alias("position"))
    d = d.withColumn("n", F.col("position")).withColumn("hash", F.concat_ws("-", "item_id", "position"))
    d = d.withColumn("prior_hash", F.when((k % 7 == 0) & (F.col("position") == 3), "wrong").otherwise(F.lag("hash").over(by)))
    d = d.withColumn("ordinal", (F.col("n") + ((k % 5 == 0) & (F.col("position") == 2)).cast("int")).cast("long"))
    status = F.when((F.col("n") == 1) & (k % 3 != 0), "open").otherwise("resolved")
    history = F.when(F.col("n") == 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("n").cast("int"))))
    return W.project_latest_items(d.select("item_id", "position", "ordinal", "prior_hash", "hash", k.alias("content"), status.alias("status"), history.alias("history")))


@query("SELECT n_name AS name, n_regionkey AS region FROM nation")
def canonical_order(t):
    return W.canonical_order(t("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), "region", "name")


@query("SELECT o_custkey AS rule_id, o_orderkey AS version_id, o_orderdate::DATE::VARCHAR AS at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) AS rank FROM orders")
def newest_first(t):
    v = t("orders").select(F.col("o_custkey").alias("rule_id"), F.col("o_orderkey").alias("version_id"), F.to_date("o_orderdate").cast("string").alias("at"))
    return W.newest_first(v, "rule_id", "at", "version_id")


@query("""WITH g AS (SELECT o_custkey AS case_id, count(*) AS entries, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1)
SELECT *, case_id || ': ' || entries || ' entries, ' || verified || ' verified, ' || failed || ' failed' AS line FROM g""")
def manifest_report(t):
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "P", "failed").otherwise("open")
    return W.manifest_report(t("orders").select(F.col("o_custkey").alias("case_id"), status.alias("status")), "case_id")


# operators of the other modules that had no query
@query("""WITH l AS (SELECT o_custkey AS c, row_number() OVER w AS n, o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE lag(o_orderkey) OVER w END AS pred, o_orderdate::DATE AS d, lag(o_orderkey) OVER w AS pid, lag(o_orderdate::DATE) OVER w AS pd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey)),
e AS (SELECT c, CASE WHEN n = 1 THEN pred IS NOT NULL ELSE pred IS DISTINCT FROM pid OR d <= pd END AS bad FROM l) SELECT c AS chain_id, count(*) FILTER (bad) AS errors FROM e GROUP BY 1 HAVING count(*) FILTER (bad) > 0""")
def supersession_chain_errors(t):
    from pyspark.sql import Window

    by = Window.partitionBy("chain_id").orderBy("effective_date", "rule_id")
    d = t("orders").select(F.col("o_custkey").alias("chain_id"), F.col("o_orderkey").alias("rule_id"), F.to_date("o_orderdate").alias("effective_date"))
    d = d.withColumn("ordinal", F.row_number().over(by)).withColumn("predecessor_id", F.when(F.col("rule_id") % 13 == 0, -1).otherwise(F.lag("rule_id").over(by)))
    return R.supersession_chain_errors(d)


@query("""WITH a AS (SELECT user_id AS subject, row_number() OVER w AS position, event_id % 3 AS snapshot, CASE WHEN event_type = 'error' THEN 'interrupted' ELSE 'done' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT subject, position, CASE WHEN lag(snapshot) OVER w IS NULL THEN 'new' WHEN lag(snapshot) OVER w = snapshot AND lag(outcome) OVER w = 'interrupted' THEN 'resume' ELSE 'linked' END AS plan FROM a WINDOW w AS (PARTITION BY subject ORDER BY position)""")
def plan_resume(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return D.plan_resume(t("events").select(F.col("user_id").alias("subject"), n.alias("position"), (F.col("event_id") % 3).alias("snapshot"), F.when(F.col("event_type") == "error", "interrupted").otherwise("done").alias("outcome")))


@query("""SELECT 'size' AS code, p_brand AS message, CASE WHEN bool_or(p_size > 48) THEN 'error' ELSE 'warning' END AS severity FROM part WHERE p_size > 40 GROUP BY 2 UNION ALL SELECT DISTINCT 'type', p_brand, 'warning' FROM part WHERE p_type LIKE '%STEEL%'""")
def merge_findings(t):
    p = t("part").select(F.col("p_brand").alias("message"), "p_size", "p_type")
    one = lambda df, code, s: df.select(F.lit(code).alias("code"), "message", F.lit(s).alias("severity"))
    return T.merge_findings(one(p.filter("p_size > 40"), "size", "warning"), one(p.filter("p_type like '%STEEL%'"), "type", "warning"), one(p.filter("p_size > 48"), "size", "error"))


@query("""SELECT DISTINCT 'big' AS "check", 'error' AS severity, p_brand AS subject FROM part WHERE p_size > 40 UNION SELECT 'steel', 'warning', p_brand FROM part WHERE p_type LIKE '%STEEL%'""")
def union_issues(t):
    p = t("part")
    one = lambda df, c, s: df.select(F.lit(c).alias("check"), F.lit(s).alias("severity"), F.col("p_brand").alias("subject"))
    return T.union_issues(one(p.filter("p_size > 40"), "big", "error"), one(p.filter("p_type like '%STEEL%'"), "steel", "warning"))


@query("""WITH i AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'stale' ELSE c_mktsegment END AS a FROM customer WHERE c_custkey % 7 <> 0), r AS (SELECT c_custkey AS id, c_mktsegment AS b FROM customer WHERE c_custkey % 11 <> 0)
SELECT coalesce(i.id, r.id) AS id, CASE WHEN i.id IS NULL THEN 'not-indexed' WHEN r.id IS NULL THEN 'no-record' ELSE 'different' END AS issue FROM i FULL JOIN r ON i.id = r.id WHERE i.id IS NULL OR r.id IS NULL OR a <> b""")
def index_consistency(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    return T.index_consistency(c.filter("id % 7 <> 0").withColumn("value", F.when(F.col("id") % 5 == 0, "stale").otherwise(F.col("value"))), c.filter("id % 11 <> 0"), "id", "value")


@query("""WITH g AS (SELECT unnest([['STEEL', 'metal'], ['ECONOMY ANODIZED STEEL', 'cheap steel'], ['BRASS', 'metal'], ['PROMO', 'offer']]) AS g), j AS (SELECT p_partkey AS id, g[2] AS x, lower(p_type) = lower(g[1]) AS e FROM part LEFT JOIN g ON contains(lower(p_type), lower(g[1]))),
a AS (SELECT id, count(DISTINCT x) FILTER (e) AS ne, min(x) FILTER (e) AS xe, count(DISTINCT x) AS n, min(x) AS x FROM j GROUP BY 1) SELECT id AS desc_id, CASE WHEN ne > 0 THEN CASE WHEN ne = 1 THEN xe END WHEN n = 1 THEN x END AS generic FROM a""")
def map_generic_field(t):
    rows = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(g).alias("generic")) for p, g in (("STEEL", "metal"), ("ECONOMY ANODIZED STEEL", "cheap steel"), ("BRASS", "metal"), ("PROMO", "offer"))))
    p = t("part").select(F.col("p_partkey").alias("desc_id"), F.col("p_type").alias("text"))
    return T.map_generic_field(p, p.sparkSession.range(1).select(F.inline(rows)))


@query("""WITH r AS (SELECT s_suppkey AS id, 'Brand#' || (s_suppkey % 5 + 1) || (s_suppkey % 3 + 1) AS sheet, s_suppkey % 20 AS c1, s_suppkey % 20 + 25 AS c2, s_suppkey % 50 AS r1, s_suppkey % 50 + 120 AS r2 FROM supplier)
SELECT id AS range_id, count(*) AS cells FROM r JOIN part ON upper(p_brand) = upper(sheet) AND p_size BETWEEN c1 AND c2 AND p_partkey % 200 BETWEEN r1 AND r2 GROUP BY 1""")
def cells_in_range(t):
    k = F.col("s_suppkey")
    sheet = F.concat(F.lit("BRAND#"), (k % 5 + 1).cast("string"), (k % 3 + 1).cast("string"))
    r = t("supplier").select(k.alias("range_id"), sheet.alias("sheet"), (k % 20).alias("c1"), (k % 20 + 25).alias("c2"), (k % 50).alias("r1"), (k % 50 + 120).alias("r2"))
    return T.cells_in_range(r, t("part").select(F.col("p_brand").alias("sheet"), F.col("p_size").alias("col"), (F.col("p_partkey") % 200).alias("row")))


@query("""WITH RECURSIVE e AS (SELECT p_partkey // 2 AS a, p_partkey AS b FROM part WHERE p_partkey > 1 AND p_partkey % 9 <> 5), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT 12::BIGINT AS id UNION SELECT u.b FROM w JOIN u ON u.a = w.id) SELECT id FROM w""")
def trace_lineage(t):
    p = t("part").filter("p_partkey > 1 and p_partkey % 9 <> 5")
    e = p.select(F.floor(F.col("p_partkey") / 2).alias("src"), F.col("p_partkey").alias("dst"))
    return G.trace_lineage(e, e.sparkSession.range(12, 13)).select("id")
