"""Issue streams of architectures and workbooks on empty and small literal tables."""

from evidentia.operators import architecture_checks as A
from evidentia.operators import workbook_checks as W

ARCHITECTURE = {
    "tabs": "idx int, tab string, role string, profile string, candidate string, artifact string", "runs": "idx int, run_id string", "run_tabs": "run_idx int, tab string",
    "justifications": "run_idx int, idx int, source string, ref_id string, ref_hash string", "cells": "key string, cell_key string, tab string, address string, has_formula boolean, formula string, field string",
    "classes": "key string, run_key string, run_id string, iob string", "dependencies": "idx int, dependent string, dependency string, run_id string, type string", "ranges": "idx int, scope string, tab string, address string, name string",
    "policies": "kind string, approval_id string, hash string", "population": "candidate string, artifact string, profile string, approval_id string, hash string", "controls": "control_id string, hash string", "overrides": "override_id string, hash string",
}
WORKBOOK = {
    "sheets": "name string", "ranges": "idx int, name string, scope string, tab string, address string", "formulas": "idx int, formula_id string, address string", "dependencies": "formula_id string, on_id string",
    "mappings": "cell string, class string, has_source boolean, source_tab string, source_field string, formula_id string", "cells": "idx int, address string, kind string",
}


def tables(spark, schemas, **rows):
    return {k: spark.createDataFrame(rows.get(k, []), v) for k, v in schemas.items()}


def test_empty_and_sound_tables(spark):
    lacks = [("ARCHITECTURE_POLICY_LINEAGE_INVALID", "/lineage/policies")]
    assert [tuple(r) for r in A.validate_architecture(tables(spark, ARCHITECTURE)).collect()] == lacks
    sound = tables(
        spark, ARCHITECTURE, tabs=[(0, "Pop", "population", "p", "c", "a"), (1, "Summary", "support", "p", None, None)], runs=[(0, "r")], run_tabs=[(0, "Pop")], justifications=[(0, 0, "population", "c", "a"), (0, 1, "case-control", "k", "h"), (0, 2, "rule", None, None)],
        cells=[("Pop::A1", "Pop::A1", "Pop", "A1", False, None, "X")], classes=[("Pop::A1", "r", "r", "I")], dependencies=[(0, "Pop::A1", "Pop::A1", "r", "cell")], ranges=[(0, "sheet", "Pop", "A1", "n")], policies=[(k, f"d{k}", "h") for k in A.POLICIES], population=[("c", "a", "p", "d", "h")], controls=[("k", "h")],
    )
    assert A.validate_architecture(sound).collect() == []
    broken = sound | {"dependencies": spark.createDataFrame([(0, None, "Pop::A1", "r", "cell"), (1, "Pop::A1", "Pop::A1", "r", None)], ARCHITECTURE["dependencies"])}
    assert sorted(r.path for r in A.validate_architecture(broken).collect()) == ["/formulaDependencies/0", "/formulaDependencies/1"]
    empty = W.validate_workbook(tables(spark, WORKBOOK))
    assert sorted((r.code, r.name) for r in empty.collect()) == [*(("MISSING_SUPPORT_SHEET", x) for x in sorted(A.SUPPORT_TABS)), ("NO_FORMULA_CELLS", None)]
    assert tuple(W.workbook_status(empty).first()) == ("invalid", 3, 1)


def test_workbook_findings(spark):
    w = tables(
        spark, WORKBOOK, sheets=[(x,) for x in A.SUPPORT_TABS], formulas=[(0, "a", "A1"), (1, "b", "A2"), (2, "c", "A3"), (3, "d", "A4"), (4, "e", None)], dependencies=[("a", "b"), ("c", "d"), ("d", "c")], mappings=[("A1", "O", False, None, None, "a"), ("C1", "I", True, "T", "x", None)], cells=[(0, "C1", "label"), (1, "C1", "input")],
    )
    got = sorted((r.code, r.cell or "", r.name or "") for r in W.validate_workbook(w).collect())
    assert got == [("CIRCULAR_DEPENDENCY", "A3", "c"), ("CIRCULAR_DEPENDENCY", "A4", "c"), ("INVALID_FORMULA_TARGET", "", ""), ("UNREACHABLE_FORMULA_CELL", "", ""), ("UNREACHABLE_FORMULA_CELL", "A3", ""), ("UNREACHABLE_FORMULA_CELL", "A4", "")]
