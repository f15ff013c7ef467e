"""Registered query of the architecture's referential checks: every document stands for one part of an architecture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import architecture_checks as A
from .catalog import query

#: The parts, in words that Spark and DuckDB share; m is the number of eights in k, the document's number.
_PARTS = {
    "tabs": ("k % 8 = 0", "k AS idx, CASE k % 3 WHEN 0 THEN 'Summary' WHEN 1 THEN source || '-' || lang ELSE 'T' || k END AS tab, CASE k % 16 WHEN 0 THEN 'population' ELSE 'support' END AS role, 'p' || (k % 9) AS profile, CASE WHEN k % 16 = 0 OR k % 40 = 8 THEN 'c' || (k % 10) END AS candidate, CASE WHEN k % 16 = 0 THEN 'a' || (k % 3) END AS artifact"),
    "runs": ("k % 8 = 1", "k AS idx, 'r' || (k % 40) AS run_id"),
    "run_tabs": ("k % 8 = 1", "k AS run_idx, CASE k % 3 WHEN 0 THEN 'Summary' WHEN 1 THEN source || '-' || lang END AS tab"),
    "control_refs": ("k % 8 = 1", "k AS run_idx, 0 AS idx, 'case-control' AS source, 'k' || (k % 14) AS ref_id, 'h' || (k % 7) AS ref_hash"),
    "population_refs": ("k % 8 = 1", "k AS run_idx, 1 AS idx, 'population' AS source, 'c' || (k % 10) AS ref_id, 'a' || (k % 3) AS ref_hash"),
    "cells": ("k % 8 IN (2, 3, 4)", "k, CASE WHEN k % 7 = 0 THEN 'x/~' || k ELSE tab || '::' || address END AS key, CASE WHEN k % 17 <> 0 THEN tab || '::' || address END AS cell_key, tab, address, k % 3 = 0 AS has_formula, CASE WHEN k % 15 = 0 THEN ' ' WHEN k % 3 = 0 THEN '=A1' WHEN k % 9 = 1 THEN '=B1' END AS formula, CASE k % 6 WHEN 0 THEN 'CALC_INDICATOR' WHEN 1 THEN 'CALCULATION' ELSE 'X' END AS field"),
    "dependencies": ("k % 8 = 5", "k AS idx, 'Summary::B' || k AS dependent, 'Summary::B' || (k - 1) AS dependency, CASE WHEN k % 21 = 0 THEN 'r8' WHEN k % 3 = 0 THEN 'r1' ELSE 'r9' END AS run_id, CASE m % 5 WHEN 1 THEN 'named-range' WHEN 2 THEN 'external' WHEN 4 THEN 'odd' ELSE 'cell' END AS type"),
    "ranges": ("k % 8 = 6", "k AS idx, CASE m % 2 WHEN 0 THEN 'workbook' ELSE 'sheet' END AS scope, tab, CASE WHEN k % 9 = 0 THEN '$B$1' ELSE 'B' || (k - 1) END AS address, CASE WHEN k % 5 = 1 THEN 'n' ELSE 'N' END || (m % 10) AS name"),
    "policies": ("k % 8 = 7 AND m % 4 = 0", "CASE k % 5 WHEN 0 THEN 'scenario-selection' WHEN 1 THEN 'tab-selection' WHEN 2 THEN 'iob-classification' WHEN 3 THEN 'field-name-glossary' ELSE 'other' END AS kind, 'd' || (k % 50) AS approval_id, 'h' || (k % 3) AS hash"),
    "population": ("k % 8 = 7 AND m % 4 = 1", "'c' || (k % 10) AS candidate, 'a' || (k % 3) AS artifact, 'p' || (k % 9) AS profile, CASE WHEN k % 7 = 0 THEN ' d' ELSE 'd' || (k % 50) END AS approval_id, 'h' || (k % 4) AS hash"),
    "controls": ("k % 8 = 7 AND m % 4 = 2", "'k' || (k % 14) AS control_id, 'h' || (k % 7) AS hash"),
    "overrides": ("k % 8 = 7 AND m % 4 = 3", "CASE WHEN k % 3 > 0 THEN 'o' || k END AS override_id, 'h' AS hash"),
}
_CLASSES = "key, run AS run_key, CASE WHEN k % 29 = 0 THEN 'other' ELSE run END AS run_id, CASE WHEN k % 31 = 0 THEN 'I' WHEN field = 'CALC_INDICATOR' THEN 'B' ELSE 'N' END AS iob"
_BASE = "doc_id AS k, source, lang, CASE WHEN doc_id % 5 = 0 THEN 'Gone' ELSE 'Summary' END AS tab, CASE WHEN doc_id % 11 = 0 THEN 'b' || doc_id WHEN doc_id % 13 = 0 THEN 'XFE' || (doc_id + 1) ELSE 'B' || (doc_id + 1) END AS address"
_RUNS = ("r1", "r9", "r17", "r25", "r33")

_WITH = f"""d AS (SELECT {_BASE}, doc_id // 8 AS m FROM documents), {", ".join(f"{name} AS (SELECT {cols} FROM d WHERE {where})" for name, (where, cols) in _PARTS.items())},
classes AS (SELECT {_CLASSES} FROM (SELECT *, unnest(CASE WHEN k % 19 = 0 THEN {list(_RUNS[:4])} WHEN k % 23 = 0 THEN {[*_RUNS, "r7"]} ELSE {list(_RUNS)} END) AS run FROM cells)),
escaped AS (SELECT *, '/cells/' || replace(replace(key, '~', '~0'), '/', '~1') AS pl FROM cells), of_class AS (SELECT *, '/cells/' || replace(replace(key, '~', '~0'), '/', '~1') || '/perRunClassification' AS pl FROM classes),
refs AS (FROM control_refs UNION ALL FROM population_refs)"""


@query(rf"""WITH {_WITH} SELECT DISTINCT 'ARCHITECTURE_' || code AS code, path FROM (
SELECT 'POLICY_LINEAGE_INVALID' AS code, '/lineage/policies' AS path FROM policies HAVING count(*) <> 4 OR count(DISTINCT kind) FILTER (kind <> 'other') <> 4
UNION ALL SELECT 'SOURCE_TAB_DUPLICATE', '/sourceTabs' FROM tabs GROUP BY tab HAVING count(*) > 1
UNION ALL SELECT 'RUN_DUPLICATE', '/runs' FROM runs GROUP BY run_id HAVING count(*) > 1
UNION ALL SELECT 'SOURCE_TAB_LINEAGE_MISSING', '/sourceTabs/' || idx FROM tabs WHERE profile NOT IN (SELECT profile FROM population)
UNION ALL SELECT 'SOURCE_TAB_ROLE_INVALID', '/sourceTabs/' || idx FROM tabs WHERE (role = 'population' AND (candidate, artifact) NOT IN (SELECT (candidate, artifact) FROM population)) OR (role = 'support' AND (candidate IS NOT NULL OR artifact IS NOT NULL OR tab NOT IN ('Summary', 'Tables', 'UD Table')))
UNION ALL SELECT 'RUN_TAB_MISSING', '/runs/' || run_idx || '/applicableTabs' FROM run_tabs WHERE coalesce(tab, '?') NOT IN (SELECT tab FROM tabs)
UNION ALL SELECT 'RUN_APPROVAL_REFERENCE_INVALID', '/runs/' || run_idx || '/justifications/' || idx FROM refs WHERE (source = 'case-control' AND (ref_id, ref_hash) NOT IN (SELECT (control_id, hash) FROM controls)) OR (source = 'population' AND (ref_id, ref_hash) NOT IN (SELECT (candidate, artifact) FROM population))
UNION ALL SELECT 'CELL_IDENTITY_INVALID', pl FROM escaped WHERE key <> tab || '::' || address OR cell_key IS NULL OR cell_key <> tab || '::' || address
UNION ALL SELECT 'CELL_TAB_MISSING', pl || '/sourceTab' FROM escaped WHERE tab NOT IN (SELECT tab FROM tabs)
UNION ALL SELECT 'CELL_ADDRESS_INVALID', pl || '/cellAddress' FROM escaped WHERE address NOT LIKE 'B%' OR regexp_extract(address, '[0-9]+')::BIGINT > 1048576
UNION ALL SELECT 'FORMULA_FLAG_INVALID', pl FROM escaped WHERE has_formula <> (coalesce(trim(formula), '') <> '')
UNION ALL SELECT 'CLASSIFICATION_COVERAGE_INVALID', e.pl || '/perRunClassification' FROM escaped e JOIN classes c USING (key) GROUP BY e.pl HAVING list_sort(list(DISTINCT run_key)) <> (SELECT list_sort(list(DISTINCT run_id)) FROM runs)
UNION ALL SELECT 'CLASSIFICATION_IDENTITY_INVALID', pl || '/' || run_key FROM of_class WHERE run_key <> run_id
UNION ALL SELECT 'CLASSIFICATION_SEMANTICS_INVALID', pl || '/' || run_key || '/iob' FROM of_class JOIN cells USING (key) WHERE (field = 'CALC_INDICATOR' AND iob <> 'B') OR (field = 'CALCULATION' AND iob <> 'N')
UNION ALL SELECT 'DEPENDENCY_REFERENCE_INVALID', '/formulaDependencies/' || idx FROM dependencies WHERE dependent NOT IN (SELECT key FROM cells) OR dependency NOT IN (SELECT key FROM cells) OR run_id NOT IN (SELECT run_id FROM runs) OR type = 'odd'
UNION ALL SELECT 'NAMED_RANGE_TARGET_INVALID', '/namedRanges/' || idx FROM ranges WHERE tab NOT IN (SELECT tab FROM tabs) OR address LIKE '$%' OR tab || '::' || address NOT IN (SELECT key FROM cells) OR regexp_extract(address, '[0-9]+')::BIGINT > 1048576
UNION ALL SELECT 'NAMED_RANGE_DUPLICATE', '/namedRanges/' || idx FROM ranges QUALIFY row_number() OVER (PARTITION BY scope, CASE WHEN scope = 'sheet' THEN upper(tab) ELSE '' END, upper(name) ORDER BY idx) > 1
UNION ALL SELECT 'LINEAGE_IDENTITY_DUPLICATE', '/lineage/' || p FROM (SELECT 'policies' AS p, approval_id AS i FROM policies UNION ALL SELECT 'population', approval_id FROM population UNION ALL SELECT 'caseControls', control_id FROM controls UNION ALL SELECT 'authorityOverrides', override_id FROM overrides) WHERE i IS NOT NULL GROUP BY p, i HAVING count(*) > 1
UNION ALL SELECT 'LINEAGE_IDENTITY_INVALID', '/lineage/population' FROM population WHERE approval_id = ' d' UNION ALL SELECT 'LINEAGE_IDENTITY_INVALID', '/lineage/authorityOverrides' FROM overrides WHERE override_id IS NULL
UNION ALL SELECT 'APPROVAL_BINDING_CONFLICT', '/lineage/' || max(p) FROM (SELECT 'policies' AS p, approval_id AS i, hash FROM policies UNION ALL SELECT 'population', approval_id, hash FROM population) GROUP BY i HAVING count(DISTINCT hash) > 1
UNION ALL SELECT 'POPULATION_LINEAGE_DUPLICATE', '/lineage/population' FROM population GROUP BY candidate, artifact HAVING count(*) > 1)""")
def validate_architecture(t):
    d = t("documents").selectExpr(*_split(_BASE), "doc_id div 8 AS m")
    parts = {name: d.filter(where).selectExpr(*_split(cols)) for name, (where, cols) in _PARTS.items()}
    k = F.col("k")
    runs = lambda *x: F.array(*map(F.lit, x))
    run = F.explode(F.when(k % 19 == 0, runs(*_RUNS[:4])).when(k % 23 == 0, runs(*_RUNS, "r7")).otherwise(runs(*_RUNS)))
    parts["classes"] = parts["cells"].withColumn("run", run).selectExpr(*_split(_CLASSES))
    parts["justifications"] = parts.pop("control_refs").unionByName(parts.pop("population_refs"))
    return A.validate_architecture(parts)


def _split(columns: str) -> list[str]:
    """At commas outside parentheses."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
