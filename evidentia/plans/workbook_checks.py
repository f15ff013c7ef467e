"""Registered query of the workbook's structural checks: every document stands for one or more parts of a workbook."""

from __future__ import annotations

from ..operators import workbook_checks as W
from .architecture_checks import _split
from .catalog import query

#: The parts, in words that Spark and DuckDB share. Chains of seven formulas; one chain of ten is closed to a ring.
_PARTS = {
    "sheets": ("true", "CASE k % 3 WHEN 0 THEN 'Summary' WHEN 1 THEN 'Tables' ELSE source END AS name"),
    "ranges": ("k % 5 = 0", "k AS idx, CASE WHEN k % 3 = 0 THEN 'n' ELSE 'N' END || (k % 200) AS name, CASE WHEN k % 2 = 0 THEN 'workbook' ELSE 'sheet' END AS scope, CASE WHEN k % 25 = 0 THEN 'Nope' ELSE 'Summary' END AS tab, CASE WHEN k % 35 = 0 THEN '??' || k ELSE 'A' || (k + 1) END AS address"),
    "formulas": ("k % 2 = 0", "k AS idx, 'f' || k AS formula_id, CASE WHEN k % 26 = 0 THEN 'B-' || k WHEN k % 34 = 0 THEN 'B1' ELSE 'B' || (k + 1) END AS address"),
    "chain": ("k % 2 = 0 AND k % 14 <> 12", "'f' || k AS formula_id, 'f' || (k + 2) AS on_id"),
    "ring": ("k % 140 = 12", "'f' || k AS formula_id, 'f' || (k - 12) AS on_id"),
    "unknown": ("k % 22 = 0", "'f' || k AS formula_id, 'f' || (k + 1) AS on_id"),
    "mappings": ("k % 2 = 1", "CASE k % 6 WHEN 1 THEN 'B' || k ELSE 'C' || k END AS cell, CASE k % 8 WHEN 1 THEN 'I' WHEN 3 THEN 'B' WHEN 5 THEN 'O' ELSE 'B' END AS class, k % 3 > 0 AS has_source, CASE WHEN k % 15 = 1 THEN '' ELSE 'T' || (k % 4) END AS source_tab, CASE WHEN k % 45 <> 2 THEN 'x' END AS source_field, CASE WHEN k % 28 = 1 OR k % 10 = 3 THEN 'f' || (k - 1) END AS formula_id"),
    "cells": ("true", "k AS idx, CASE WHEN k % 50 = 7 THEN 'C' || (k - 2) ELSE 'C' || k END AS address, CASE k % 3 WHEN 0 THEN 'input' WHEN 1 THEN 'label' ELSE 'formula' END AS kind"),
}


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id AS k, source FROM documents), {", ".join(f"{name} AS (SELECT {cols} FROM d WHERE {where})" for name, (where, cols) in _PARTS.items())},
deps AS (FROM chain UNION ALL FROM ring UNION ALL FROM unknown), own AS (SELECT * FROM deps WHERE formula_id IN (SELECT formula_id FROM formulas) AND on_id IN (SELECT formula_id FROM formulas)),
met AS (SELECT formula_id FROM mappings WHERE formula_id IN (SELECT formula_id FROM formulas) UNION SELECT on_id FROM met JOIN own USING (formula_id)),
walk AS (SELECT formula_id AS a, on_id AS b FROM own UNION SELECT a, on_id FROM walk JOIN own ON b = formula_id), rings AS (SELECT x.a AS formula_id, min(x.b) AS cycle FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a GROUP BY 1),
f AS (SELECT *, regexp_matches(address, '^B[0-9]+$') AS good FROM formulas), g AS (SELECT *, address NOT LIKE '?%' AS good FROM ranges), kinds AS (SELECT address AS cell, arg_max(kind, idx) AS kind FROM cells GROUP BY 1), m AS (SELECT * FROM mappings LEFT JOIN kinds USING (cell))
SELECT 'MISSING_SUPPORT_SHEET' AS code, NULL::VARCHAR AS cell, name FROM (SELECT unnest(['Summary', 'Tables', 'UD Table']) AS name) WHERE name NOT IN (SELECT name FROM sheets)
UNION ALL SELECT 'INVALID_NAMED_RANGE_TARGET', address, name FROM g WHERE NOT good
UNION ALL (SELECT 'DUPLICATE_NAMED_RANGE', address, name FROM g WHERE good QUALIFY row_number() OVER (PARTITION BY CASE WHEN scope = 'sheet' THEN upper(tab) END, scope, upper(name) ORDER BY idx) > 1)
UNION ALL SELECT 'INVALID_NAMED_RANGE_SCOPE', address, name FROM g WHERE good AND scope = 'sheet' AND tab NOT IN (SELECT name FROM sheets)
UNION ALL SELECT 'INVALID_FORMULA_TARGET', address, NULL FROM f WHERE NOT good
UNION ALL (SELECT 'DUPLICATE_FORMULA_CELL', address, NULL FROM f WHERE good QUALIFY row_number() OVER (PARTITION BY address ORDER BY idx) > 1)
UNION ALL SELECT 'UNSATISFIED_FORMULA_DEPENDENCY', address, on_id FROM f JOIN deps USING (formula_id) WHERE good AND on_id NOT IN (SELECT formula_id FROM formulas)
UNION ALL SELECT 'CIRCULAR_DEPENDENCY', address, cycle FROM f JOIN rings USING (formula_id)
UNION ALL SELECT 'UNREACHABLE_FORMULA_CELL', address, NULL FROM f WHERE address NOT IN (SELECT cell FROM mappings) AND address NOT IN (SELECT address FROM formulas JOIN met USING (formula_id))
UNION ALL SELECT 'MISSING_POPULATION_SOURCE', cell, NULL FROM m WHERE class IN ('I', 'B') AND NOT has_source
UNION ALL SELECT 'INCOMPLETE_POPULATION_SOURCE', cell, NULL FROM m WHERE class IN ('I', 'B') AND has_source AND (source_tab = '' OR source_field IS NULL)
UNION ALL SELECT DISTINCT 'INVALID_SOURCE_KEY', NULL, source_tab || ':' || coalesce(source_field, '') FROM mappings WHERE has_source AND (source_tab = '' OR source_field IS NULL)
UNION ALL SELECT 'CELL_CLASSIFICATION_MISMATCH', cell, kind FROM m WHERE has_source AND class = 'I' AND kind <> 'input'
UNION ALL SELECT 'INVALID_BIFEED_CELL', cell, kind FROM m WHERE has_source AND class = 'B' AND kind = 'label'
UNION ALL SELECT 'UNMAPPED_INPUT_CELL', cell, NULL FROM m WHERE class = 'I' AND NOT has_source
UNION ALL SELECT 'UNMAPPED_BIFEED_CELL', cell, NULL FROM m WHERE class = 'B' AND NOT has_source AND formula_id IS NULL""")
def validate_workbook(t):
    d = t("documents").selectExpr("doc_id AS k", "source")
    parts = {name: d.filter(where).selectExpr(*_split(cols)) for name, (where, cols) in _PARTS.items()}
    parts["dependencies"] = parts.pop("chain").unionByName(parts.pop("ring")).unionByName(parts.pop("unknown"))
    return W.validate_workbook(parts)
