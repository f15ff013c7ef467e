"""Registered queries of names, references, facts, provisions, population and package checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as Y
from .casework import _pick
from .catalog import query


@query(r"""WITH p AS (SELECT p_partkey AS id, '  ' || p_type || '   of ' || p_brand || ' ' AS t FROM part), n AS (SELECT id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS s, t FROM p)
SELECT id, lower(s) AS identity, CASE WHEN length(s) BETWEEN 1 AND 35 THEN upper(s) END AS label, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS key FROM n""")
def normalized_names(t):
    x = F.concat(F.lit("  "), "p_type", F.lit("   of "), "p_brand", F.lit(" "))
    return t("part").select(F.col("p_partkey").alias("id"), Y.normalize_identity(x).alias("identity"), Y.normalize_label(x, 35).alias("label"), Y.normalize_key(x).alias("key"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 26 + 1 AS c, p_size AS r, p_partkey % 5 AS k FROM part)
SELECT id, CASE WHEN k <> 4 THEN CASE WHEN k = 0 THEN c ELSE least(c, 28) END END::INT AS c1, CASE WHEN k <> 4 THEN CASE WHEN k = 0 THEN r ELSE least(r, 20) END END::INT AS r1, CASE WHEN k <> 4 THEN CASE WHEN k = 0 THEN c ELSE 28 END END::INT AS c2, CASE WHEN k <> 4 THEN CASE WHEN k = 0 THEN r ELSE greatest(r, 20) END END::INT AS r2 FROM p""")
def cell_ranges(t):
    k = F.col("p_partkey")
    one = F.concat(F.lit("$"), F.char((k % 26 + 65).cast("long")), F.lit("$"), F.col("p_size").cast("string"))
    text = F.when(k % 5 == 0, one).when(k % 5 == 4, F.concat(one, F.lit(":XFE1"))).otherwise(F.concat(F.lit("ab20:"), one))
    return t("part").select(k.alias("id"), Y.cell_range(text).alias("r")).select("id", "r.*")


@query("SELECT event_id, user_id AS actor, event_type AS action, ts AS at, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE user_id = 7 AND event_type = 'click'")
def events_of(t):
    e = t("events").select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.col("ts").alias("at"))
    return Y.events_of(e, actor=7, action="click")


@query("SELECT o_custkey AS subject, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def approval_status(t):
    return Y.approval_status(t("orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("status")))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS c, (['a', 'b', 'c', 'd'])[(o_orderkey % 4 + 1)::INT] AS f, (['a', 'b', 'c', 'd'])[((o_orderkey + 1) % 4 + 1)::INT] AS g FROM orders), n AS (SELECT DISTINCT c, p[1] AS f, p[2] AS g FROM e, (SELECT unnest([['a', 'b'], ['b', 'c'], ['c', 'd']]) AS p))
SELECT c AS case_id, f AS from_type, g AS to_type FROM n ANTI JOIN e USING (c, f, g)""")
def missing_paths(t):
    o = t("orders").select(F.col("o_custkey").alias("case_id"), _pick("o_orderkey", "a", "b", "c", "d").alias("from_type"), _pick("o_orderkey", "b", "c", "d", "a").alias("to_type"))
    return Y.missing_paths(o, ("a", "b", "c", "d"))


@query("""WITH c AS (SELECT l_suppkey AS summary_id, l_returnflag AS tab, l_linestatus AS run, l_partkey AS field, (['I', 'O', 'B', 'N', 'C', NULL, 'X'])[(l_orderkey % 7 + 1)::INT] AS k, l_linenumber > 4 AS f FROM lineitem)
SELECT summary_id, count(DISTINCT tab) AS tabs, count(DISTINCT run) AS runs, count(DISTINCT field) AS fields, count(*) AS cells, count(*) FILTER (f) AS formulas, count(*) FILTER (k = 'I') AS class_i, count(*) FILTER (k = 'O') AS class_o, count(*) FILTER (k = 'B') AS class_b,
count(*) FILTER (k = 'N') AS class_n, count(*) FILTER (k = 'C') AS class_c, count(*) FILTER (k IS NULL OR k = 'X') AS class_other FROM c GROUP BY 1""")
def reference_index(t):
    return Y.reference_index(t("lineitem").select(F.col("l_suppkey").alias("summary_id"), F.col("l_returnflag").alias("tab"), F.col("l_linestatus").alias("run"), F.col("l_partkey").alias("field"), _pick("l_orderkey", "I", "O", "B", "N", "C", None, "X").alias("class"), F.when(F.col("l_linenumber") > 4, "=A1").alias("formula")))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS d, unnest(['field', 'run', 'tab']) AS kind, unnest([o_orderpriority, o_orderstatus, strftime(o_orderdate::DATE, '%Y')]) AS item FROM orders WHERE o_orderkey % 3 = 0), r AS (SELECT DISTINCT c_custkey % 12 AS ref_id, unnest(['field', 'run', 'tab']) AS kind, unnest([o_orderpriority, o_orderstatus, strftime(o_orderdate::DATE, '%Y')]) AS item FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 31 < 2),
n AS (SELECT d, count(*) FILTER (kind = 'field') AS f, count(*) FILTER (kind = 'run') AS r, count(*) FILTER (kind = 'tab') AS t FROM p GROUP BY 1), ps AS (SELECT o_custkey AS d, count(*) AS pc, count(*) FILTER (o_orderstatus = 'F') AS pf FROM orders GROUP BY 1), rs AS (SELECT o_custkey % 12 AS ref_id, count(*) // 12 AS c, count(*) FILTER (o_orderstatus = 'F') // 12 AS g FROM orders GROUP BY 1),
m AS (SELECT d, ref_id, count(*) FILTER (kind = 'field') AS mf, count(*) FILTER (kind = 'run') AS mr, count(*) FILTER (kind = 'tab') AS mt FROM p JOIN r USING (kind, item) GROUP BY ALL),
e AS (SELECT d, ref_id, pc, pf, c, g, coalesce(f, 0) AS f, coalesce(n.r, 0) AS r, coalesce(t, 0) AS t, coalesce(mf, 0) AS mf, coalesce(mr, 0) AS mr, coalesce(mt, 0) AS mt FROM ps CROSS JOIN rs LEFT JOIN n USING (d) LEFT JOIN m USING (d, ref_id)),
s AS (SELECT *, least(10000, CASE WHEN f > 0 THEN floor(mf / f * 6500.0 + 0.5) ELSE 0 END + CASE WHEN r > 0 THEN floor(mr / r * 1500.0 + 0.5) ELSE 0 END + CASE WHEN t > 0 THEN floor(mt / t * 1000.0 + 0.5) ELSE 0 END
+ CASE WHEN greatest(pc, c) > 0 THEN floor(greatest(0.0::DOUBLE, 1 - abs(pc - c) / greatest(pc, c)) * 700.0::DOUBLE + 0.5) ELSE 0 END + CASE WHEN greatest(pf, g) > 0 THEN floor(greatest(0.0::DOUBLE, 1 - abs(pf - g) / greatest(pf, g)) * 300.0::DOUBLE + 0.5) ELSE 0 END)::BIGINT AS score FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, mf DESC, mr DESC, mt DESC, c, 'ref' || ref_id % 5, ref_id) AS rank FROM s) SELECT d AS doc_id, rank, ref_id, score FROM k WHERE rank <= 5""")
def weighted_matches(t):
    o = t("orders")
    items = F.create_map(F.lit("field"), "o_orderpriority", F.lit("run"), "o_orderstatus", F.lit("tab"), F.date_format("o_orderdate", "yyyy"))
    ref = (F.col("o_custkey") % 12).alias("ref_id")
    known = o.join(t("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    size = lambda key, n: o.groupBy(key).agg(F.floor(F.count("*") / n).alias("cells"), F.floor(F.count_if(F.col("o_orderstatus") == "F") / n).alias("formulas"))
    doc = F.col("o_custkey").alias("doc_id")
    return Y.weighted_matches(o.filter("o_orderkey % 3 = 0").select(doc, F.explode(items).alias("kind", "item")), known.filter("o_orderkey % 31 < 2").select(ref, F.explode(items).alias("kind", "item")), size(doc, 1), size(ref, 12).withColumn("file_name", F.concat(F.lit("ref"), (F.col("ref_id") % 5).cast("string"))))


@query("""WITH f AS (SELECT p_partkey AS id, p_partkey % 60 AS prop, p_partkey % 9 AS pos, p_partkey % 4 = 3 AS badp, p_partkey % 5 = 0 AS none, p_partkey % 6 AS c, p_partkey % 170 AS target FROM part), s AS (SELECT target, count(*) AS n FROM f GROUP BY 1)
SELECT id AS fact_id, unnest(list_filter([CASE WHEN prop % 3 = 0 OR prop > 50 THEN 'NOT_APPROVED' END, CASE WHEN badp THEN 'POINTER' END, CASE WHEN none THEN 'NO_CITATION' END, CASE WHEN NOT none AND c = 5 THEN 'UNKNOWN_CITATION' END, CASE WHEN n > 1 THEN 'TARGET' END], lambda x: x IS NOT NULL)) AS issue FROM f JOIN s USING (target)""")
def promoted_fact_issues(t):
    k = F.col("p_partkey")
    cites = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("h1"), F.concat(F.lit("h"), (k % 6).cast("string"))))
    f = t("part").select(k.alias("fact_id"), (k % 60).alias("proposal_id"), (k % 9).alias("position"), F.concat(F.lit("/facts/"), F.when(k % 4 == 3, k % 9 + 1).otherwise(k % 9).cast("string")).alias("pointer"), (k % 170).alias("target"), cites.alias("citations"))
    q = (k % 60).alias("proposal_id")
    d = t("part").filter(k % 60 <= 50).select(q, F.lit(1).alias("position"), F.lit("approved").alias("status")).union(t("part").filter((k % 60) % 3 == 0).select(q, F.lit(2), F.lit("revoked"))).distinct()
    e = t("part").filter(k % 6 != 5).select(F.concat(F.lit("h"), (k % 6).cast("string")).alias("sha256"))
    return Y.promoted_fact_issues(f, d, e)


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_orderdate::DATE AS d FROM orders)
SELECT id AS segment_id, CASE WHEN k IN (0, 3) THEN d WHEN k = 2 AND id % 2 = 0 THEN DATE '2001-02-03' END::VARCHAR AS effective, CASE WHEN k IN (0, 3) THEN 'explicit' WHEN k = 1 THEN 'ambiguous' WHEN k = 2 AND id % 2 = 0 THEN 'inferred-from-context' WHEN k = 4 AND id % 2 = 0 THEN 'inferred-from-context' ELSE 'unknown' END AS convention,
CASE WHEN k = 3 THEN d + 9 END::VARCHAR AS adopted FROM o WHERE k <> 4""")
def extract_provisions(t):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    us, iso = (lambda x: F.date_format(x, "M/d/yyyy")), (lambda x: F.date_format(x, "yyyy-MM-dd"))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Effective "), iso(d), F.lit(", and effective as of "), us(d), F.lit(" again.")))
        .when(k % 5 == 1, F.concat(F.lit("effective: "), iso(d), F.lit(" or effective date "), iso(F.date_add(d, 1))))
        .when(k % 5 == 2, F.lit("Effective 2021-02-30, as some say."))
        .otherwise(F.concat(F.lit("Adopted on "), F.date_format(F.date_add(d, 9), "MMMM d, yyyy"), F.lit(". EFFECTIVE "), us(d)))
    )
    s = t("orders").filter(k % 5 != 4).select(k.alias("segment_id"), text.alias("text"), F.when(k % 2 == 0, F.lit("2001-02-03").cast("date")).alias("inferred"))
    return Y.extract_provisions(s).withColumns({c: F.col(c).cast("string") for c in ("effective", "adopted")})


@query("""WITH e AS (SELECT c_custkey AS a, CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END AS key, c_custkey % 7 = 0 AS missing, c_custkey % 8 = 0 AS twice, c_custkey % 9 = 0 AS other, c_custkey % 11 = 0 AS stale FROM customer), n AS (SELECT key, count(*) AS n FROM e GROUP BY 1),
i AS (SELECT key, unnest(list_filter([CASE WHEN n > 1 THEN 'DUPLICATE_KEY' END, CASE WHEN missing OR twice THEN 'NOT_IN_MANIFEST' END, CASE WHEN NOT missing AND NOT twice AND other THEN 'OTHER_HASH' END, CASE WHEN stale THEN 'STALE' END], lambda x: x IS NOT NULL)) AS issue FROM e JOIN n USING (key)) SELECT DISTINCT key, issue FROM i""")
def population_evidence_issues(t):
    k = F.col("c_custkey")
    h = F.sha2("c_name", 256)
    e = t("customer").select(F.when(k % 10 == 1, k - 1).otherwise(k).alias("key"), k.alias("artifact_id"), h.alias("sha256"), F.when(k % 11 == 0, "changed").otherwise(F.col("c_name")).alias("content"))
    listed = t("customer").filter(k % 7 != 0).select(k.alias("artifact_id"), F.when(k % 9 == 0, "x").otherwise(h).alias("sha256"))
    return Y.population_evidence_issues(e, listed.union(listed.filter("artifact_id % 8 = 0")))


@query("""WITH p AS (SELECT o_orderkey AS id, o_custkey AS r, o_orderkey % 9 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) AS bad, o_orderkey % 13 = 0 AS t, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderkey % 4 = 0),
q AS (SELECT l_orderkey AS id, l_orderkey % 4 <> 0 OR l_orderkey NOT IN (SELECT id FROM p) OR l_linenumber = 2 AS bad, l_returnflag <> 'A' AS na FROM lineitem)
SELECT 'p' || id AS subject, unnest(list_filter([CASE WHEN bad THEN 'REQUEST_LINK' END, CASE WHEN t THEN 'TRANSMISSION' END, CASE WHEN n > 1 THEN 'DUPLICATE_REGISTRATION' END], lambda x: x IS NOT NULL)) AS issue FROM p
UNION ALL SELECT 'q' || id, unnest(list_filter([CASE WHEN bad THEN 'PACKAGE_LINK' END, CASE WHEN na THEN 'NOT_APPROVED' END], lambda x: x IS NOT NULL)) FROM q""")
def acquisition_issues(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    r = t("customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") * 3).alias("hash"))
    p = t("orders").filter(k % 4 == 0).select(name("p", k).alias("package_id"), c.alias("request_id"), F.when(k % 9 == 0, -1).otherwise(c * 3).alias("request_hash"), (k * 7).alias("hash"), (k % 13 == 0).alias("transmit"))
    o = F.col("l_orderkey")
    q = t("lineitem").select(name("q", o).alias("proposal_id"), name("p", o).alias("package_id"), F.when(F.col("l_linenumber") == 2, -1).otherwise(o * 7).alias("package_hash"), F.when(F.col("l_returnflag") == "A", "approved").otherwise("open").alias("status"))
    return Y.acquisition_issues(r, p, q)
