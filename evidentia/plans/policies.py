"""Registered queries of policy files. Every customer is a glossary and every supplier a policy of classes, with faults by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import policies as P
from .catalog import query


def _texts(rows, key: str, text: str):
    return rows.select(F.col(key).alias("file"), F.expr(text).alias("text"))


@query("""WITH f AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS g, CASE c_custkey % 9 WHEN 1 THEN 'root' WHEN 2 THEN 'version' WHEN 3 THEN 'governance' WHEN 4 THEN 'entries[1]' WHEN 5 THEN 'entries' WHEN 6 THEN 'root' WHEN 7 THEN 'entries[0]' END AS place FROM customer),
r AS (SELECT k, place, n, g, '{"description":"' || g || '","genericField":"name","tabContext":null,"workbookPattern":"' || n || '"}' AS a, '{"description":"' || g || '","genericField":"part","tabContext":' || CASE WHEN k % 2 = 0 THEN '"' || g || '"' ELSE 'null' END || ',"workbookPattern":"*' || n || '"}' AS b FROM f)
SELECT k AS file, '1.0.' || k AS version, i AS position, CASE WHEN i = 0 THEN n ELSE '*' || n END AS pattern, CASE WHEN i = 0 THEN 'name' ELSE 'part' END AS generic, g AS description, CASE WHEN i = 1 AND k % 2 = 0 THEN g END AS context,
sha256('[' || a || ',' || b || ']') AS policy_sha256, CAST(NULL AS VARCHAR) AS issue, CAST(NULL AS VARCHAR) AS place FROM r, unnest([0, 1]) AS u(i) WHERE place IS NULL
UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN k % 9 = 1 THEN 'PARSE' ELSE 'VALIDATION' END, place FROM r WHERE place IS NOT NULL""")
def glossary_policies(t):
    k = "c_custkey % 9"
    first = f"""'{{"workbookPattern": "' || c_name || '", "genericField": ' || if({k} = 7, '" "', '"name"') || ', "description": "' || c_mktsegment || '"}}'"""
    second = f"""'{{"description": ' || if({k} = 4, '7', '"' || c_mktsegment || '"') || ', "workbookPattern": "*' || c_name || '", "tabContext": ' || if(c_custkey % 2 = 0, '"' || c_mktsegment || '"', 'null') || ', "genericField": "part"}}'"""
    entries = f"if({k} = 5, '[]', '[' || {first} || ',' || {second} || ']')"
    text = f"""'{{"version": ' || if({k} = 2, '"1.0"', '"1.0.' || c_custkey || '"') || ', "governance": {{"reviewStatus": "' || if({k} = 3, 'approved', 'provisional') || '"}}, "entries": ' || {entries} || if({k} = 6, ', "owner": "x"', '') || if({k} = 1, '', '}}')"""
    loaded = P.policies(_texts(t("customer"), "c_custkey", text), "field-name-glossary")
    rules = P.policy_rules(loaded).select("file", "version", "position", F.col("workbookPattern").alias("pattern"), F.col("genericField").alias("generic"), "description", F.col("tabContext").alias("context"), "policy_sha256", *(F.lit(None).cast("string").alias(c) for c in ("issue", "place")))
    return rules.unionByName(loaded.filter("issue is not null").select("file", "issue", "place"), allowMissingColumns=True)


@query("""WITH f AS (SELECT s_suppkey AS k, s_name AS n, s_suppkey % 5 AS m FROM supplier),
r AS (SELECT *, '{"fieldPattern":"' || n || '","iob":"' || substr('IOBNP', (k % 5 + 1)::INT, 1) || '","justification":"by key","priority":' || (k - 50) || ',"runPattern":"*"}' AS a FROM f)
SELECT k AS file, n AS field_pattern, substr('IOBNP', (k % 5 + 1)::INT, 1) AS iob, (k - 50)::BIGINT AS priority, sha256('[' || a || ']') AS policy_sha256, CAST(NULL AS VARCHAR) AS place FROM r WHERE k % 7 NOT IN (1, 2, 3)
UNION ALL SELECT k, NULL, NULL, NULL, NULL, 'rules[0]' FROM r WHERE k % 7 IN (1, 2, 3)""")
def class_policies(t):
    k = "s_suppkey % 7"
    text = f"""'{{"governance":{{"reviewStatus":"provisional"}},"version":"2.10.0","rules":[{{"runPattern":"*","priority":' || if({k} = 1, '"9"', if({k} = 2, '1.5', cast(s_suppkey - 50 as string))) || ',"iob":"' || if({k} = 3, '', substr('IOBNP', cast(s_suppkey % 5 + 1 as int), 1)) || '","fieldPattern":"' || s_name || '","justification":"by key"}}]}}'"""
    loaded = P.policies(_texts(t("supplier"), "s_suppkey", text), "iob-classification")
    rules = P.policy_rules(loaded).select("file", F.col("fieldPattern").alias("field_pattern"), "iob", "priority", "policy_sha256", F.lit(None).cast("string").alias("place"))
    return rules.unionByName(loaded.filter("issue is not null").select("file", "place"), allowMissingColumns=True)
