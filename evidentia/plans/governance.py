"""Registered queries of rule governance, scenarios, architecture, specifications and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import architecture as A
from .catalog import _rules, query
from .casework import _pick


def _table(df, names: str, rows: list[tuple]):
    return df.sparkSession.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names.split(), r, strict=True))) for r in rows))))


_FACTS = """f AS (SELECT o_orderkey AS case_id, unnest(['priority', 'status', 'price', 'clerk']) AS dimension, unnest([o_orderpriority, o_orderstatus, floor(o_totalprice)::BIGINT::VARCHAR, CASE WHEN o_orderkey % 3 = 0 THEN 'absent' WHEN o_orderkey % 3 = 1 THEN 'Clerk' END]) AS v FROM orders),
ff AS (SELECT * FROM f WHERE v IS NOT NULL), c AS (SELECT unnest(['c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'c8', 'c9', 'c10', 'c11']) AS condition_id, unnest(['priority', 'price', 'status', 'clerk', 'price', 'clerk', 'clerk', 'status', 'priority', 'price', 'status']) AS dimension, unnest(['contains', 'greater-than', 'equals', 'absent', 'less-than', 'present', 'equals', 'equals', 'contains', 'greater-than', 'equals']) AS op,
unnest(['urgent', '150000', 'F', '', '9000', '', 'Clerk', 'O', 'high', '100000', 'P']) AS w, unnest(['s1', 's1', 's1', 's2', 's2', 's3', 's4', 's4', 's5', 's5', 's5']) AS scenario_id, unnest(['rule', 'case', 'case', 'rule', 'case', 'case', 'population', 'case', 'rule', 'rule', 'case']) AS source),
m AS (SELECT DISTINCT case_id, condition_id, scenario_id, source FROM ff JOIN c USING (dimension) WHERE CASE op WHEN 'contains' THEN contains(lower(v), w) WHEN 'greater-than' THEN TRY_CAST(v AS DOUBLE) > TRY_CAST(w AS DOUBLE)
WHEN 'less-than' THEN TRY_CAST(v AS DOUBLE) < TRY_CAST(w AS DOUBLE) WHEN 'equals' THEN v = w WHEN 'absent' THEN v = 'absent' ELSE true END)"""


def _facts(t):
    k = F.col("o_orderkey")
    clerk = F.when(k % 3 == 0, "absent").when(k % 3 == 1, "Clerk")
    f = F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus", F.lit("price"), F.floor("o_totalprice").cast("string"), F.lit("clerk"), clerk)
    return t("orders").select(k.alias("case_id"), F.explode(f).alias("dimension", "value")).filter("value is not null")


def _conditions(t):
    return _table(t("orders"), "condition_id dimension operator value scenario_id source", [("c1", "priority", "contains", "urgent", "s1", "rule"), ("c2", "price", "greater-than", "150000", "s1", "case"), ("c3", "status", "equals", "F", "s1", "case"), ("c4", "clerk", "absent", "", "s2", "rule"), ("c5", "price", "less-than", "9000", "s2", "case"), ("c6", "clerk", "present", "", "s3", "case"), ("c7", "clerk", "equals", "Clerk", "s4", "population"), ("c8", "status", "equals", "O", "s4", "case"), ("c9", "priority", "contains", "high", "s5", "rule"), ("c10", "price", "greater-than", "100000", "s5", "rule"), ("c11", "status", "equals", "P", "s5", "case")]).withColumn("excludes", F.col("condition_id") == "c11")


@query(f"WITH {_FACTS} SELECT case_id, condition_id FROM m")
def matching_conditions(t):
    return A.matching_conditions(_facts(t), _conditions(t))


@query(f"""WITH {_FACTS}, k AS (SELECT case_id, c.* , EXISTS (FROM m WHERE m.case_id = f.case_id AND m.condition_id = c.condition_id) AS hit, EXISTS (FROM ff WHERE ff.case_id = f.case_id AND ff.dimension = c.dimension) AS known, c.condition_id = 'c11' AS bar FROM (SELECT DISTINCT case_id FROM ff) f, c)
SELECT case_id, scenario_id, count(*) FILTER (hit AND NOT bar) AS met, count(*) FILTER (NOT bar) AS conditions, CASE
WHEN bool_or(source = 'population' AND NOT known) THEN 'unresolved'
WHEN bool_or(source = 'rule' AND hit) AND bool_or(source = 'rule' AND NOT hit) THEN 'unresolved'
WHEN bool_or(source = 'case' AND NOT hit AND NOT bar) OR bool_or(source = 'population' AND NOT hit) OR bool_or(source = 'rule' AND NOT hit) THEN 'not-selected'
WHEN bool_or(bar AND hit) THEN 'excluded' ELSE 'selected' END AS status FROM k GROUP BY ALL""")
def select_scenarios(t):
    return A.select_scenarios(_facts(t), _conditions(t))


_R = "r AS (SELECT o_orderkey AS rule_id, o_custkey AS scope, o_orderdate::DATE AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE + (o_orderkey % 400)::INT END AS e, o_orderpriority AS p, o_orderstatus AS st FROM orders)"


@query(f"""WITH {_R}, x AS (SELECT a.scope, a.rule_id AS i, b.rule_id AS j, c.rule_id AS k, greatest(a.s, b.s, c.s) AS s, least(a.e, b.e, c.e) AS e FROM r a JOIN r b USING (scope) JOIN r c USING (scope) WHERE a.p < '3' AND b.p > '2' AND c.rule_id % 2 = 0),
y AS (SELECT scope, s, e, unnest([i, j, k]) AS r FROM x WHERE e IS NULL OR s <= e) SELECT scope AS scenario, s::VARCHAR AS start_date, e::VARCHAR AS end_date, count(DISTINCT r) AS rules FROM y GROUP BY ALL""")
def intersect_condition_ranges(t):
    r = _rules(t).withColumnRenamed("scope", "scenario")
    out = A.intersect_condition_ranges([r.filter("text < '3'"), r.filter("text > '2'"), r.filter("rule_id % 2 = 0")])
    return out.select("scenario", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "rules")


@query("""WITH s AS (SELECT l_partkey AS h, count(*) AS n, min(l_returnflag) AS role, min(CASE WHEN l_linenumber = 1 THEN 'stale' ELSE 'reviewed' END) AS rs, min(CASE WHEN l_suppkey % 3 = 0 THEN l_shipdate::DATE END) AS so FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
j AS (SELECT o_orderkey AS rule_id, role, coalesce(so <= DATE '1996-01-01', false) AS over, n, rs FROM orders LEFT JOIN s ON h = o_custkey)
SELECT rule_id, role, CASE WHEN over THEN 'superseded' ELSE 'current' END AS supersession, CASE WHEN n IS NULL THEN 'NO_SOURCE' WHEN n > 1 THEN 'SEVERAL_SOURCES' WHEN over THEN 'SUPERSEDED' WHEN rs = 'stale' THEN 'STALE' END AS issue FROM j""")
def query_authority(t):
    s = t("lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("sha256"), F.col("l_returnflag").alias("role"), F.lit("stale").alias("review_status"), F.when(F.col("l_suppkey") % 3 == 0, F.to_date("l_shipdate")).alias("superseded_on"))
    return A.query_authority(t("orders").select(F.col("o_orderkey").alias("rule_id"), F.col("o_custkey").alias("sha256")), s, F.lit("1996-01-01").cast("date"))


_O = """o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS p0, o_orderkey % 9 = 8 AS rep, o_custkey AS scope, o_orderkey % 7 AS h FROM orders),
q AS (SELECT id, CASE WHEN id % 13 = 1 THEN -5 WHEN id % 17 = 3 THEN id - 3 ELSE p0 END AS p, rep, scope, h FROM o), n AS (SELECT p, count(*) AS c FROM q WHERE p IS NOT NULL GROUP BY 1),
live AS (SELECT id, scope FROM q WHERE id NOT IN (SELECT p FROM n) AND NOT rep AND (p IS NULL OR (p IN (SELECT id FROM q) AND p NOT IN (SELECT p FROM n WHERE c > 1))) AND h NOT IN (5, 6))"""


def _overrides(t):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    prior = F.when(k % 13 == 1, -5).when(k % 17 == 3, k - 3).when(k % 4 != 0, F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    o = t("orders").select(k.alias("override_id"), prior.alias("prior_id"), F.when(k % 9 == 8, "repeal").otherwise("grant").alias("action"), F.col("o_custkey").alias("scope"), (k % 7).alias("sha256"))
    return A.effective_overrides(o, o.filter("sha256 < 5"))


@query(f"WITH {_O} SELECT id AS override_id, scope FROM live")
def effective_overrides(t):
    return _overrides(t)


@query(f"""WITH {_O}, s AS (SELECT s_suppkey % 8 AS h, count(*) AS n, min(CASE WHEN s_suppkey % 8 < 4 THEN 'regulation' ELSE 'notice' END) AS role FROM supplier WHERE s_suppkey % 8 <> 2 AND s_suppkey <= 8 OR s_suppkey = 11 GROUP BY 1), m AS (SELECT scope, count(*) AS m, min(id) AS id FROM live GROUP BY 1),
j AS (SELECT c_custkey AS rule_id, coalesce(n, 0) AS n, coalesce(role = 'regulation', false) AS need, coalesce(m, 0) AS m, id FROM customer LEFT JOIN s ON h = c_custkey % 8 LEFT JOIN m ON scope = c_custkey),
i AS (SELECT *, CASE WHEN n <> 1 THEN 'CITATION' WHEN need AND m = 0 THEN 'OVERRIDE_REQUIRED' WHEN need AND m > 1 THEN 'OVERRIDE_AMBIGUOUS' WHEN NOT need AND m > 0 THEN 'OVERRIDE_FORBIDDEN' END AS issue FROM j)
SELECT rule_id, CASE WHEN issue IS NULL AND need THEN id END AS override_id, issue FROM i""")
def governing_override(t):
    h = F.col("s_suppkey") % 8
    s = t("supplier").filter("(s_suppkey % 8 <> 2 and s_suppkey <= 8) or s_suppkey = 11").select(h.alias("sha256"), F.when(h < 4, "regulation").otherwise("notice").alias("role"))
    c = t("customer").select(F.col("c_custkey").alias("rule_id"), F.col("c_custkey").alias("scope"), (F.col("c_custkey") % 8).alias("sha256"))
    return A.governing_override(c, s, _overrides(t))


@query("""WITH q AS (SELECT o_orderkey AS id, o_orderkey % 10 AS k, o_orderdate::DATE AS d, lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pd FROM orders), b AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 2 GROUP BY 1)
SELECT q.id AS rule_id, CASE WHEN k = 0 THEN 'CITATION_REQUIRED' WHEN k = 1 THEN 'EFFECTIVE_DATE_REQUIRED' WHEN k = 2 THEN 'DATES' WHEN k IN (3, 4) THEN 'CONFIDENCE' WHEN k = 5 THEN 'APPLICABILITY' WHEN n > 0 THEN 'UNRESOLVED' WHEN k = 6 THEN 'OVERRIDE_REQUIRED' WHEN d <= pd THEN 'SUCCESSOR_DATE' END AS error FROM q LEFT JOIN b ON b.id = q.id""")
def authoring_gate(t):
    from pyspark.sql import Window

    k, d = F.col("o_orderkey") % 10, F.to_date("o_orderdate")
    r = t("orders").select(F.col("o_orderkey").alias("rule_id"), F.when(k != 0, 1).alias("citations"), F.when(k != 1, d).alias("effective_date"), F.when(k == 2, d).alias("end_date"), F.when(k == 3, 1.5).when(k != 4, 0.5).alias("confidence"), F.when(k == 5, " ").otherwise("all").alias("applicability"), F.lag(d).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("predecessor_date"))
    blocked = t("lineitem").filter("l_returnflag = 'R' and l_linenumber > 2").groupBy(F.col("l_orderkey").alias("rule_id")).agg(F.count("*").alias("open_items"))
    g = t("orders").select(F.col("o_orderkey").alias("rule_id"), F.when(k == 6, "OVERRIDE_REQUIRED").alias("issue"))
    return A.authoring_gate(r, blocked, g)


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS scope, o_orderpriority || ', all' AS a, o_orderstatus AS author, o_orderdate::DATE AS s, CASE WHEN o_custkey % 4 = 0 THEN o_orderdate::DATE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE + (o_orderkey % 3)::INT END AS e FROM orders), k AS (SELECT *, e IS NULL OR e > s AS o FROM r)
SELECT scope, 'NO_EFFECTIVE_RULES' AS code, '' AS detail FROM k GROUP BY 1 HAVING NOT bool_or(o)
UNION ALL SELECT scope, 'OVERLAPPING_APPLICABILITY', c FROM (SELECT scope, unnest(string_split(a, ', ')) AS c FROM k WHERE o) GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT scope, 'UNAPPROVED_RULE_AUTHOR', count(*)::VARCHAR FROM k WHERE o AND author <> 'F' GROUP BY 1""")
def validate_rule_set(t):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    end = F.when(F.col("o_custkey") % 4 == 0, d).when(k % 5 != 0, F.date_add(d, (k % 3).cast("int")))
    return A.validate_rule_set(t("orders").select(k.alias("rule_id"), F.col("o_custkey").alias("scope"), F.concat("o_orderpriority", F.lit(", all")).alias("applicability"), F.col("o_orderstatus").alias("author"), d.alias("start_date"), end.alias("end_date")), F.lit("F"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 = 0 THEN -1 ELSE o_custkey END AS scope, CASE WHEN o_orderkey % 23 = 4 THEN lag(o_orderkey, 2) OVER w ELSE lag(o_orderkey) OVER w END AS p, o_orderdate::DATE AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE + 30 END AS e, o_orderkey % 11 = 2 AS bad FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey)),
l AS (SELECT a.id, a.bad, NOT a.bad AND NOT coalesce(a.scope = b.scope AND a.s > b.s AND (b.e IS NULL OR b.e <= a.s), false) AS seq FROM r a JOIN r b ON b.id = a.p)
SELECT id::VARCHAR AS subject, 'UNBOUND' AS issue FROM l WHERE bad UNION ALL SELECT id::VARCHAR, 'SEQUENCE' FROM l WHERE seq UNION ALL SELECT p::VARCHAR, 'BRANCH' FROM r WHERE p IS NOT NULL GROUP BY p HAVING count(*) > 1
UNION ALL SELECT scope::VARCHAR, 'SEVERAL_ROOTS' FROM r WHERE p IS NULL GROUP BY scope HAVING count(*) > 1""")
def supersession_issues(t):
    from pyspark.sql import Window

    by, k, d = Window.partitionBy("o_custkey").orderBy("d", "o_orderkey"), F.col("o_orderkey"), F.to_date("o_orderdate")
    p = F.when(k % 23 == 4, F.lag(k, 2).over(by)).otherwise(F.lag(k).over(by))
    r = t("orders").withColumn("d", d).withColumn("predecessor_id", p)
    r = r.select(k.alias("rule_id"), F.when(k % 19 == 0, -1).otherwise(F.col("o_custkey")).alias("scope"), "predecessor_id", F.when(k % 11 == 2, -9).otherwise(F.col("predecessor_id") * 3).alias("predecessor_hash"), (k * 3).alias("hash"), F.col("d").alias("start_date"), F.when(k % 3 == 0, F.date_add("d", 30)).alias("end_date"))
    return A.supersession_issues(r)


@query("""WITH g AS (SELECT lower(p_name[1:3]) AS name, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) END AS sheet, count(*) AS n, min(p_partkey) AS r FROM part WHERE p_size > 25 GROUP BY ALL)
SELECT p_partkey AS ref_id, CASE WHEN a.n = 1 THEN a.r WHEN a.n IS NULL AND b.n = 1 THEN b.r END AS range_id FROM part LEFT JOIN g a ON a.name = lower(p_name[1:3]) AND a.sheet = lower(p_brand) LEFT JOIN g b ON b.name = lower(p_name[1:3]) AND b.sheet IS NULL""".replace("p_name[1:3]", "p_type[1:5] || p_size"))
def resolve_named_ranges(t):
    name = F.concat(F.substring("p_type", 1, 5), F.col("p_size").cast("string"))
    p = t("part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("sheet"), "p_size")
    ranges = p.filter("p_size > 25").select(F.col("id").alias("range_id"), F.lower("name").alias("name"), F.when(F.col("id") % 2 == 0, F.col("sheet")).alias("sheet"))
    return A.resolve_named_ranges(p.select(F.col("id").alias("ref_id"), F.upper("name").alias("name"), F.upper("sheet").alias("sheet")), ranges)


@query("""WITH c AS (SELECT p_partkey AS id, p_brand AS tab, p_type AS field, CASE WHEN p_partkey % 3 = 0 THEN '=A1' WHEN p_partkey % 3 = 1 THEN ' ' END AS f FROM part), k AS (SELECT id, r_name AS run, (['I', 'O', 'B', ''])[((id + r_regionkey) % 4 + 1)::INT] AS class FROM c, region)
SELECT id AS cell_id, run, class, CASE WHEN class IN ('I', 'B') AND tab < 'Brand#3' THEN field END AS source_field, CASE WHEN class IN ('O', 'B') AND f = '=A1' THEN 'FORMULA-' || hex(run) || '-' || hex(id::VARCHAR) END AS formula_id FROM k JOIN c USING (id) WHERE class <> ''""")
def cell_mappings(t):
    p = t("part")
    k = F.col("p_partkey")
    cells = p.select(k.alias("cell_id"), F.col("p_brand").alias("tab"), F.col("p_type").alias("field"), F.when(k % 3 == 0, "=A1").when(k % 3 == 1, " ").alias("formula"))
    runs = F.array(*(F.struct(F.lit(n).alias("run"), F.lit(i).alias("i")) for i, n in enumerate(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))))
    x = p.select(k.alias("cell_id"), F.explode(runs).alias("r")).select("cell_id", F.col("r.run").alias("run"), F.element_at(F.array(*(F.lit(c) for c in ("I", "O", "B", ""))), ((F.col("cell_id") + F.col("r.i")) % 4 + 1).cast("int")).alias("class"))
    tabs = p.select(F.col("p_brand").alias("tab"), F.when(F.col("p_brand") < "Brand#3", "population").otherwise("support").alias("role"))
    return A.cell_mappings(cells, x, tabs)


_SHEETS = ("Steel Tab", "economy (a*)", "Promo brass", "Notes", "copper", "Tin Tab")


@query(rf"""WITH s AS (SELECT p_partkey AS id, p_partkey // 2 AS g, (list_value({", ".join(f"'{n}'" for n in _SHEETS)}))[g % 6 + 1] || CASE WHEN p_partkey % 4 = 1 THEN '  ' ELSE ' ' END || g AS name, p_size % 10 = 0 AS hidden, CASE WHEN g % 3 = 0 THEN 'same' ELSE p_brand END AS h, CASE WHEN g % 9 = 0 THEN p_brand ELSE 'x' END AS l, 't' || p_size % 3 AS trait FROM part),
k AS (SELECT *, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS n FROM s), v AS (SELECT n, count(DISTINCT h || '|' || l) AS c, min(id) AS first FROM k WHERE NOT hidden GROUP BY 1),
a AS (SELECT k.*, CASE WHEN hidden THEN 'hidden' WHEN c > 1 THEN 'collision' WHEN id <> first THEN 'duplicate' END AS state FROM k LEFT JOIN v USING (n)),
p AS (SELECT unnest([1, 2, 3, 4, 5]) AS pos, unnest(['^steel.*$', '^.*tab.*$', '^economy \(a.*$', 'promo', '^copper.*$']) AS pat, unnest(['metal', 'any', 'cheap', 'offer', 'wire']) AS role, unnest([['A', 'b'], ['a'], ['a'], [], ['zz']]) AS req, unnest([NULL, 'T1', NULL, 't2', NULL]) AS need),
m AS (SELECT id, pos, role, req, need IS NULL OR lower(need) = trait AS fits FROM a JOIN p ON regexp_matches(lower(name), pat) WHERE state IS NULL),
r AS (SELECT id, arg_min(role, pos) FILTER (fits) AS role, arg_min(req, pos) FILTER (fits) AS req, count(*) FILTER (NOT fits) AS unmet FROM m GROUP BY 1),
j AS (SELECT id, name, state, role, coalesce(unmet, 0) AS unmet, coalesce(len(list_filter(coalesce(req, []), lambda x: NOT (lower(x) = 'a' AND id % 2 = 0) AND NOT (x = 'b' AND id % 3 = 0))), 0) AS missing FROM a LEFT JOIN r USING (id))
SELECT id AS sheet_id, CASE WHEN state IS NULL THEN CASE WHEN (role IS NOT NULL AND missing = 0) OR name NOT IN ('Notes 3', 'Notes 9', 'Notes 15', 'copper 4', 'copper 10') THEN role ELSE 'support' END END AS role, missing::BIGINT AS missing, unmet::BIGINT AS unmet,
coalesce(state, CASE WHEN role IS NOT NULL AND missing = 0 THEN 'selected' WHEN name IN ('Notes 3', 'Notes 9', 'Notes 15', 'copper 4', 'copper 10') THEN 'support' WHEN missing > 0 THEN 'incomplete' WHEN unmet > 0 THEN 'requirement' ELSE 'unmatched' END) AS status FROM j""")
def select_tabs(t):
    k = F.col("p_partkey")
    g = F.floor(k / 2)
    name = F.concat(F.element_at(F.array(*(F.lit(n) for n in _SHEETS)), (g % 6 + 1).cast("int")), F.when(k % 4 == 1, "  ").otherwise(" "), g.cast("string"))
    p = t("part").select(k.alias("sheet_id"), name.alias("name"), (F.col("p_size") % 10 == 0).alias("hidden"), F.when(g % 3 == 0, "same").otherwise(F.col("p_brand")).alias("content_hash"), F.when(g % 9 == 0, F.col("p_brand")).otherwise("x").alias("lineage"), F.array(F.concat(F.lit("T"), (F.col("p_size") % 3).cast("string"))).alias("traits"))
    rules = ((1, "Steel*", "metal", "Ab", None), (2, "*tab*", "any", "a", "T1"), (3, "economy (a*", "cheap", "a", None), (4, "promo", "offer", "", "t2"), (5, "copper*", "wire", ("zz",), None))
    rows = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(a).alias("pattern"), F.lit(r).alias("role"), F.array(*(F.lit(x) for x in q)).cast("array<string>").alias("required"), F.lit(n).cast("string").alias("requirement")) for i, a, r, q, n in rules))
    have = F.array_compact(F.array(F.when(k % 2 == 0, "a"), F.when(k % 3 == 0, "b")))
    seen = t("part").select(k.alias("sheet_id"), F.explode(have).alias("field"))
    return A.select_tabs(p, p.sparkSession.range(1).select(F.inline(rows)), seen, ("Notes 3", "Notes 9", "Notes 15", "copper 4", "copper 10"))


@query("""WITH c AS (SELECT p_partkey AS id, upper(p_brand) AS s, 'A' || p_partkey AS a FROM part), r AS (SELECT l_orderkey AS cell_id, CASE WHEN l_linenumber = 3 THEN '[x]' ELSE '' END || (SELECT p_brand FROM part WHERE p_partkey = l_partkey) AS s, CASE WHEN l_linenumber = 2 THEN 0 WHEN l_suppkey % 4 = 0 THEN l_partkey + 1 ELSE l_partkey END AS n, 'A' || n AS a, n BETWEEN 1 AND 1048576 AS fits FROM lineitem)
SELECT DISTINCT cell_id, CASE WHEN NOT contains(r.s, '[') AND r.fits THEN c.id END AS on_cell, CASE WHEN contains(r.s, '[') THEN 'EXTERNAL' WHEN NOT r.fits THEN 'MALFORMED' WHEN c.id IS NULL THEN 'UNKNOWN' END AS issue FROM r LEFT JOIN c ON upper(r.s) = c.s AND r.a = c.a""")
def resolve_dependencies(t):
    p = t("part").select(F.col("p_partkey").alias("cell_id"), F.col("p_brand").alias("sheet"), F.concat(F.lit("$a$"), F.col("p_partkey").cast("string")).alias("address"))
    l = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")  # noqa: E741
    n = F.when(F.col("l_suppkey") % 4 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    address = F.when(F.col("l_linenumber") == 2, "A0").otherwise(F.concat(F.lit("A$"), n.cast("string")))
    sheet = F.concat(F.when(F.col("l_linenumber") == 3, "[x]").otherwise(""), F.lower("p_brand"))
    return A.resolve_dependencies(l.select(F.col("l_orderkey").alias("cell_id"), sheet.alias("sheet"), address.alias("address")), p)


@query("""WITH f AS (SELECT o_orderkey % 700 AS id, repeat('x', (o_orderkey % 1100)::INT) AS t, o_orderkey % 13 AS d FROM orders WHERE o_orderkey % 7 <> 0), m AS (SELECT p_partkey AS id, p_size AS run, p_partkey % 40 AS cell, (['I', 'O', 'B'])[(p_partkey % 3 + 1)::INT] AS class, CASE WHEN p_partkey % 4 < 2 THEN p_type END AS src, CASE WHEN p_partkey % 5 < 3 THEN p_partkey % 150 END AS fid FROM part),
u AS (SELECT fid, count(*) AS n FROM m WHERE fid IS NOT NULL GROUP BY 1), j AS (SELECT f.*, coalesce(n, 0) AS n FROM f LEFT JOIN u ON fid = id)
SELECT id::VARCHAR AS subject, 'DUPLICATE_FORMULA' AS issue FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id::VARCHAR, 'NOT_MAPPED' FROM j WHERE n = 0 UNION ALL SELECT id::VARCHAR, 'MAPPED_AGAIN' FROM j WHERE n > 1 UNION ALL SELECT id::VARCHAR, 'LONG_FORMULA' FROM j WHERE length(t) > 1000 UNION ALL SELECT id::VARCHAR, 'DEEP_FORMULA' FROM j WHERE d > 10
UNION ALL SELECT id::VARCHAR, 'UNKNOWN_FORMULA' FROM m WHERE fid NOT IN (SELECT id FROM f) UNION ALL SELECT id::VARCHAR, 'CLASS_WITHOUT_SOURCE' FROM m WHERE class = 'I' AND src IS NULL UNION ALL SELECT id::VARCHAR, 'CLASS_WITHOUT_FORMULA' FROM m WHERE class = 'O' AND fid IS NULL
UNION ALL SELECT id::VARCHAR, 'INPUT_WITH_FORMULA' FROM m WHERE class = 'I' AND fid IS NOT NULL UNION ALL SELECT id::VARCHAR, 'OUTPUT_WITH_SOURCE' FROM m WHERE class = 'O' AND src IS NOT NULL UNION ALL SELECT run || '/' || cell, 'DUPLICATE_CELL' FROM m GROUP BY run, cell HAVING count(*) > 1""")
def validate_spec(t):
    k, q = F.col("o_orderkey"), F.col("p_partkey")
    f = t("orders").filter(k % 7 != 0).select((k % 700).alias("formula_id"), F.repeat(F.lit("x"), (k % 1100).cast("int")).alias("text"), (k % 13).alias("depth"))
    m = t("part").select(q.alias("mapping_id"), F.col("p_size").alias("run"), (q % 40).alias("cell"), _pick("p_partkey", "I", "O", "B").alias("class"), F.when(q % 4 < 2, F.col("p_type")).alias("source_field"), F.when(q % 5 < 3, q % 150).alias("formula_id"))
    return A.validate_spec(f, m)


_TEXTS = ("=SUM(A1, MAX(B1))", "=now() + \"RAND( \"", "=FOO.BAR (1)", "=WEBSERVICE(\"x\") & INDIRECT(A1)")


@query("""SELECT id AS formula_id, name, issue FROM (SELECT p_partkey AS id, unnest(CASE p_partkey % 5 WHEN 1 THEN [['NOW', 'VOLATILE']] WHEN 2 THEN [['FOO.BAR', 'NOT_ALLOWED']] WHEN 3 THEN [['WEBSERVICE', 'ACTIVE'], ['INDIRECT', 'VOLATILE']] WHEN 4 THEN [[NULL, 'TOO_LONG']] ELSE [] END) AS x FROM part) AS p, (SELECT 1) AS o, LATERAL (SELECT x[1] AS name, x[2] AS issue)""")
def formula_text_audit(t):
    text = F.element_at(F.array(*(F.lit(x) for x in _TEXTS), F.concat(F.lit("=1"), F.repeat(F.lit("+1"), 5000))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return A.formula_text_audit(t("part").select(F.col("p_partkey").alias("formula_id"), text.alias("text")))


_ORA = "o AS (SELECT s_suppkey AS id, s_suppkey % 4 AS k, s_suppkey % 3 AS m FROM supplier)"


def _oracles(t):
    k = F.col("s_suppkey")
    return t("supplier").select(k.alias("oracle_id"), _pick("s_suppkey", "external-execution", "reference-calculation", "guess", "independent-oracle").alias("type"), F.when(k % 3 == 0, "tool").alias("tool"), F.when(k % 3 == 1, "no date").otherwise("2024-01-01T00:00:00Z").alias("executed_at"), F.when(k % 4 == 1, " ").otherwise("1").alias("version"), F.sha2(k.cast("string"), 256).alias("population_hash"), F.when(k % 3 == 2, "short").otherwise(F.sha2(F.lit("x"), 256)).alias("spec_hash"), _pick("s_suppkey", "trusted", "provisional", "unknown").alias("reliability"), F.when(k % 4 < 2, "evidence").alias("evidence"))


def _results(t):
    return t("part").select((F.col("p_partkey") % 7 + 1).alias("oracle_id"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("result_id"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_type")).alias("formula_id"), F.col("p_brand").alias("cell"), _pick("p_partkey", "number", "text", "list").alias("type"), (F.col("p_size") - 3).alias("precision"))


@query(f"""WITH {_ORA} SELECT id::VARCHAR AS subject, 'TYPE' AS issue FROM o WHERE k = 2 UNION ALL SELECT id::VARCHAR, 'TOOL' FROM o WHERE k = 0 AND m <> 0 UNION ALL SELECT id::VARCHAR, 'EXECUTED_AT' FROM o WHERE m = 1 UNION ALL SELECT id::VARCHAR, 'VERSION' FROM o WHERE k = 1 UNION ALL SELECT id::VARCHAR, 'SPEC_HASH' FROM o WHERE m = 2
UNION ALL SELECT 'r' || p_partkey, 'FORMULA_ID' FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT 'r' || p_partkey, 'RESULT_TYPE' FROM part WHERE p_partkey % 3 = 2 UNION ALL SELECT 'r' || p_partkey, 'PRECISION' FROM part WHERE p_size < 3""")
def validate_oracle(t):
    return A.validate_oracle(_oracles(t), _results(t))


@query(f"""WITH {_ORA}, c AS (SELECT id, m = 2 AS u, m = 1 AS p, k = 0 AND m <> 0 AS t, k >= 2 AS e, id NOT IN (SELECT p_partkey % 7 + 1 FROM part) AS n FROM o)
SELECT id AS oracle_id, CASE WHEN u OR t OR n THEN 'low' WHEN p OR e THEN 'medium' ELSE 'high' END AS confidence, (u::INT + p::INT + t::INT + e::INT + n::INT)::BIGINT AS concerns, NOT (u OR t OR n) AS reliable FROM c""")
def oracle_reliability(t):
    return A.oracle_reliability(_oracles(t), _results(t))


@query("""SELECT c_custkey::VARCHAR AS subject, 'ABSOLUTE' AS issue FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey::VARCHAR, 'RELATIVE' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey::VARCHAR, 'ROUNDING' FROM customer WHERE c_custkey % 4 = 3
UNION ALL SELECT s_suppkey || '/' || s_nationkey, 'OVERRIDE' FROM supplier WHERE s_suppkey % 3 = 0""")
def validate_tolerance(t):
    c = t("customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_acctbal").alias("absolute"), F.when(F.col("c_custkey") % 5 != 0, 0.1).alias("relative"), _pick("c_custkey", "banker's", "away-from-zero", "down", "up").alias("rounding"))
    return A.validate_tolerance(c, t("supplier").select(F.col("s_suppkey").alias("profile_id"), F.col("s_nationkey").alias("cell"), F.when(F.col("s_suppkey") % 3 != 0, 1.0).otherwise(-1.0).alias("absolute")))


@query("""SELECT e.event_id AS file, 1 AS line, 'F' || event_id AS formula_id, 'A' || user_id AS cell, event_type AS value FROM events e WHERE event_id % 5 IN (0, 4) UNION ALL SELECT event_id, 1, 'G' || event_id, 'B1', '7' FROM events WHERE event_id % 5 = 4""")
def parse_oracle_results(t):
    k = F.col("event_id")
    one = F.to_json(F.struct(F.concat(F.lit("F"), k.cast("string")).alias("formulaId"), F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("cellAddress"), F.col("event_type").alias("value")))
    both = F.concat(F.lit('{"calculations":['), one, F.lit(',{"formulaId":"G'), k.cast("string"), F.lit('","cellAddress":"B1","value":7},{"formulaId":"x"}]}'))
    text = F.when(k % 5 == 0, one).when(k % 5 == 1, F.lit("# a comment")).when(k % 5 == 2, F.lit("{broken")).when(k % 5 == 3, F.lit('{"formulaId":"x"}')).otherwise(both)
    return A.parse_oracle_results(t("events").select(k.alias("file"), F.lit(1).alias("line"), text.alias("text")))


@query("""WITH p AS (SELECT o_custkey AS g, o_orderkey AS id, CASE WHEN o_orderkey % 31 <> 0 THEN floor(o_totalprice)::BIGINT END AS x, lag(CASE WHEN o_orderkey % 31 <> 0 THEN floor(o_totalprice)::BIGINT END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) SELECT g AS "group", id AS rule_id FROM p WHERE x IS NULL OR x <= b""")
def priority_issues(t):
    return A.priority_issues(t("orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("rule_id"), F.when(F.col("o_orderkey") % 31 != 0, F.floor("o_totalprice")).alias("priority")))
