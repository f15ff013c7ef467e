"""Registered queries of the field inventory, the committed log, mock populations, overrides and provisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import architecture as R
from ..operators import evidence as E
from ..operators import inventory as V
from ..operators.graphs import shared_path
from ..sources import appends as A
from ..sources import populations as P
from .casework import _pick
from .catalog import query

#: A tab for each supplier, every fifth of a name that another has; a header for each column; a cell for each line.
_HEADS = ("Plan Year", "  plan   YEAR ", "Service", "Benefit Amount", "Other", "Tax", "Hours")


@query(rf"""WITH t AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 5 = 0 THEN 'Tab  X' ELSE 'Tab ' || s_suppkey END AS name, s_suppkey % 3 = 0 AS support FROM supplier),
g AS (SELECT unnest(['plan year', 'service', 'benefit', 'amount', 'tax', 'tax', 'truck', 'air']) AS p, unnest([NULL, NULL, NULL, NULL, 'tab 3', 'TAB  6', NULL, NULL]) AS c, unnest(['plan_year', 'service', 'benefit', 'benefit', 'tax3', 'tax6', 'truck', 'air']) AS x),
k AS (SELECT s, 'ABCDEFG'[i] || '1' AS a, 'ABCDEFG'[i] AS col, true AS h, (list_value({", ".join(f"'{h}'" for h in _HEADS)}))[(i + s) % 7 + 1] AS v, s % 11 = i AS f FROM t, unnest([1, 2, 3, 4, 5, 6, 7]) AS u(i)
UNION ALL SELECT l_suppkey, 'ABCDEFG'[l_linenumber::INT] || (l_orderkey + 2), 'ABCDEFG'[l_linenumber::INT], false, CASE WHEN l_linestatus = 'F' THEN CASE l_orderkey % 3 WHEN 0 THEN 'TRUCK' WHEN 1 THEN 'AIR REG' ELSE 'MAIL' END END, l_orderkey % 4 = 0 FROM lineitem WHERE l_suppkey IN (SELECT s FROM t)),
n AS (SELECT *, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS tab FROM t), one AS (SELECT * FROM n WHERE tab IN (SELECT tab FROM n GROUP BY 1 HAVING count(*) = 1)),
d AS (SELECT k.s, a, h, f, tab, support, CASE WHEN f THEN coalesce((SELECT v FROM k x WHERE x.h AND x.s = k.s AND x.col = k.col), '') ELSE coalesce(v, '') END AS description FROM k JOIN one ON one.s = k.s),
e AS (SELECT *, lower(trim(regexp_replace(description, '\s+', ' ', 'g'))) AS txt FROM d), u AS (SELECT DISTINCT tab, txt FROM e),
hits AS (SELECT tab, txt, x, p = txt AS exact, c IS NOT NULL AS ctx FROM u JOIN g ON txt <> '' AND contains(txt, p) AND (c IS NULL OR lower(regexp_replace(c, '\s+', ' ', 'g')) = tab)),
best AS (SELECT tab, txt, CASE WHEN count(DISTINCT x) = 1 THEN min(x) END AS x FROM (SELECT *, rank() OVER (PARTITION BY tab, txt ORDER BY ctx DESC, exact DESC) AS r FROM hits) WHERE r = 1 GROUP BY ALL),
q AS (SELECT e.*, x, h AND txt IN ('plan year', 'other', CASE WHEN s % 2 = 0 THEN 'hours' END) AS seen, f OR x IS NOT NULL OR (a LIKE 'B%' AND s % 6 = 0) AS relevant FROM e LEFT JOIN best USING (tab, txt)),
r AS (SELECT *, CASE WHEN f THEN 'formula' WHEN support AND relevant THEN 'support' WHEN seen THEN 'header' END AS source FROM q)
SELECT s AS sheet_id, a AS address, description, coalesce(x, CASE WHEN f THEN description END) AS generic_field, source, CASE WHEN x IS NOT NULL THEN 'mapped' WHEN f THEN 'own-name' ELSE 'unmapped' END AS status FROM r WHERE source IS NOT NULL
UNION ALL SELECT min(s), NULL, tab, NULL, NULL, 'collision' FROM n GROUP BY tab HAVING count(*) > 1""")
def field_inventory(t):
    s = F.col("s_suppkey")
    sup = t("supplier")
    tabs = sup.select(s.alias("sheet_id"), F.when(s % 5 == 0, "Tab  X").otherwise(F.concat(F.lit("Tab "), s.cast("string"))).alias("name"), F.when(s % 3 == 0, "support").otherwise("population").alias("role"))
    letter = lambda c: F.substring(F.lit("ABCDEFG"), c.cast("int"), F.lit(1))
    i = F.col("i")
    head = F.element_at(F.array(*(F.lit(h) for h in _HEADS)), ((i + s) % 7 + 1).cast("int"))
    heads = sup.select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("i")).select(s.alias("sheet_id"), F.concat(letter(i), F.lit("1")).alias("address"), head.alias("value"), F.when(s % 11 == i, "=A1").alias("formula"))
    k = F.col("l_orderkey")
    lines = t("lineitem").select(F.col("l_suppkey").alias("sheet_id"), F.concat(letter(F.col("l_linenumber")), (k + 2).cast("string")).alias("address"), F.when(F.col("l_linestatus") == "F", _pick("l_orderkey", "TRUCK", "AIR REG", "MAIL")).alias("value"), F.when(k % 4 == 0, "=A1").alias("formula"))
    cells = heads.unionByName(lines)
    named = cells.filter((F.substring("address", 1, 1) == "B") & (F.col("sheet_id") % 6 == 0)).select("sheet_id", "address")
    seen = sup.select(s.alias("sheet_id"), F.explode(F.array_compact(F.array(F.lit("PLAN year"), F.lit("Other"), F.when(s % 2 == 0, "hours")))).alias("field"))
    rows = (("plan year", None, "plan_year"), ("service", None, "service"), ("benefit", None, "benefit"), ("amount", None, "benefit"), ("tax", "tab 3", "tax3"), ("tax", "TAB  6", "tax6"), ("truck", None, "truck"), ("air", None, "air"))
    words = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(c).cast("string").alias("context"), F.lit(g).alias("generic")) for p, c, g in rows))
    return V.field_inventory(tabs, cells, named, seen, sup.sparkSession.range(1).select(F.inline(words)))


@query("""SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey - 1 IN (SELECT o_orderkey FROM orders) THEN o_orderkey - 1 END AS prior_id, o_orderstatus AS status, 1 + o_orderkey % 2 AS commit_number FROM orders""")
def committed_log(t):
    """Four appends: records, their successors, the same again (repeated), and one that is refused."""
    k = F.col("o_orderkey")
    base = t("orders").select(k.alias("record_id"), F.col("o_orderstatus").alias("status"))
    head = lambda df: df.withColumn("content_hash", A.record_hash("record_id", "status"))
    spark = base.sparkSession
    first = head(base.filter("record_id % 2 = 0"))
    before = first.select((F.col("record_id") + 1).alias("record_id"), F.col("record_id").alias("prior_id"), F.col("content_hash").alias("prior_hash"))
    second = head(base.filter("record_id % 2 = 1")).join(before, "record_id", "left")
    first = first.withColumns({"prior_id": F.lit(None).cast("long"), "prior_hash": F.lit(None).cast("string")})
    path = shared_path(spark, "log")
    check = lambda df: A.record_issues(df, ("record_id", "status"))
    got = [A.validated_append(spark, path, df.select(*first.columns), key, check).outcome for df, key in ((first, "a"), (second, "b"), (second, "b"), (first, "c"))]
    if got != ["committed", "committed", "repeated", "refused"]:
        raise ValueError(f"the appends ended as {got}")
    return A.read_log(spark, path).select("record_id", "prior_id", "status", "commit_number")


def _state(column: int, fields: int, seed: int, bits: int = 43) -> str:
    """The generator's state in DuckDB's 128-bit integers."""
    step, s, a, c = f"(o_orderkey * {fields} + {column + 1})", f"{seed}::HUGEINT", 1_664_525, 1_013_904_223
    for i in range(bits):
        s = f"({s} * CASE WHEN ({step} >> {i}) & 1 = 1 THEN {a} ELSE 1 END + CASE WHEN ({step} >> {i}) & 1 = 1 THEN {c} ELSE 0 END) % 4294967296"
        a, c = a * a % (1 << 32), (a * c + c) % (1 << 32)
    return s


@query(f"""SELECT o_orderkey AS "row", 'MOCK-' || CASE WHEN o_orderkey < 999999 THEN lpad((o_orderkey + 1)::VARCHAR, 6, '0') ELSE (o_orderkey + 1)::VARCHAR END AS order_key, '19' || (40 + (o_orderkey + 1) % 50) || '-01-01' AS hire_date,
floor(({_state(2, 4, 7)})::DOUBLE / 4294967296 * 10000) / 100 AS service_hours, 'synthetic-4-' || floor(({_state(3, 4, 7)})::DOUBLE / 4294967296 * 1000000)::BIGINT AS status FROM orders""")
def mock_population(t):
    return P.mock_population(t("orders").select(F.col("o_orderkey").alias("row")), ["order_key", "hire_date", "service_hours", "status"], 7)


@query("""WITH c AS (SELECT p_partkey AS id, 'The benefit of a ' || p_type || ' participant, under section ' || p_size || ' of the plan, is due at the date of termination for all years of service' AS t FROM part),
d AS (SELECT t, min(id) AS id, list_filter(string_split(lower(regexp_replace(t, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM c GROUP BY 1), s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM d),
j AS (SELECT a.id AS from_id, b.id AS to_id, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n FROM s a JOIN s b ON a.id < b.id) SELECT from_id, to_id, round(i / (n - i), 6) AS similarity FROM j WHERE round(i / (n - i), 6) >= 0.72""")
def near_duplicate_provisions(t):
    text = F.concat(F.lit("The benefit of a "), "p_type", F.lit(" participant, under section "), F.col("p_size").cast("string"), F.lit(" of the plan, is due at the date of termination for all years of service"))
    return E.near_duplicate_provisions(t("part").select(F.col("p_partkey").alias("candidate_id"), text.alias("restatement")))


@query("""WITH o AS (SELECT o_orderkey - o_orderkey % 50 // 49 AS id, o_custkey % 3 AS c, o_orderkey // 4 % 7 AS scope, o_orderkey % 40 AS h, CASE WHEN o_orderkey % 8 = 1 THEN 'notice' ELSE 'regulation' END AS role, o_orderkey % 4 AS age, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey - CASE WHEN o_orderkey % 12 = 6 THEN 2 WHEN o_orderkey % 36 = 1 THEN 0 ELSE 1 END END AS prior, o_orderkey % 11 = 5 AS stale, o_orderkey % 13 = 4 AS forged FROM orders),
k AS (SELECT x AS c, y AS h, count(*) AS n FROM unnest([0, 1, 2]) AS a(x), unnest(range(0, 38)) AS b(y), unnest(range(0, 2)) AS r(z) WHERE z = 0 OR y = 7 GROUP BY ALL),
heads AS (SELECT id, arg_max(struct_pack(c := c, scope := scope, age := age, forged := forged), [age::BIGINT, (CASE WHEN forged THEN 0 ELSE 1 END)::BIGINT]) AS p, count(*) AS n FROM o GROUP BY 1),
j AS (SELECT o.*, k.n AS found, p FROM o LEFT JOIN k USING (c, h) LEFT JOIN heads ON heads.id = prior)
SELECT id AS override_id, 'HASH' AS issue FROM o WHERE forged UNION ALL SELECT id, 'ARTIFACT' FROM j WHERE found IS NULL OR found <> 1 OR role <> 'regulation' OR h = 9
UNION ALL SELECT id, 'LINK' FROM j WHERE prior IS NOT NULL AND NOT coalesce(NOT stale AND NOT p.forged AND p.c = c AND p.scope = scope AND age > p.age, false)
UNION ALL SELECT id, 'DUPLICATE_ID' FROM heads WHERE n > 1 UNION ALL SELECT prior, 'BRANCH' FROM o WHERE prior IS NOT NULL GROUP BY prior HAVING count(*) > 1""")
def override_issues(t):
    k = F.col("o_orderkey")
    prior = F.when(k % 4 > 0, k - F.when(k % 12 == 6, 2).when(k % 36 == 1, 0).otherwise(1))
    o = t("orders").select(
        (k - F.floor(k % 50 / 49)).alias("override_id"), (F.col("o_custkey") % 3).alias("case_id"), (F.floor(k / 4) % 7).alias("scope"), (k % 40).alias("sha256"), F.when(k % 8 == 1, "notice").otherwise("regulation").alias("role"), (k % 4).alias("issued_at"),
        prior.alias("prior_id"), (k % 11 == 5).alias("stale"), (k % 13 == 4).alias("forged"),
    )
    own = lambda i, c, s, a: F.sha2(F.to_json(F.struct(i.cast("long").alias("override_id"), c.cast("long").alias("case_id"), s.cast("long").alias("scope"), a.cast("long").alias("issued_at"))), 256)
    o = o.withColumns({n: F.col(n).cast("long") for n in ("override_id", "case_id", "scope", "issued_at", "prior_id")})
    o = o.withColumn("content_hash", F.when(F.col("forged"), "0").otherwise(own(*(F.col(n) for n in ("override_id", "case_id", "scope", "issued_at")))))
    # what the successor thinks its prior is: the newest of that id, whole
    held = o.groupBy(F.col("override_id").alias("prior_id")).agg(F.max_by(F.struct("case_id", "scope", "issued_at", F.col("override_id").alias("id")), F.struct("issued_at", "content_hash")).alias("h"))
    o = R.beside(o, held, "prior_id", "override_id").withColumn("prior_hash", F.when(F.col("stale"), "1").otherwise(own(F.col("prior_id"), F.col("h.case_id"), F.col("h.scope"), F.col("h.issued_at")))).drop("h")
    spark = o.sparkSession
    held = spark.range(3).select(F.col("id").alias("case_id"), F.explode(F.concat(F.sequence(F.lit(0), F.lit(37)), F.array(F.lit(7)))).alias("sha256"))
    held = held.withColumns({"role": F.lit("regulation"), "review_status": F.when(F.col("sha256") == 9, "held").otherwise("released")})
    return R.override_issues(o, held, ("override_id", "case_id", "scope", "issued_at"))
