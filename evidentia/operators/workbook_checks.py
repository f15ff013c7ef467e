"""Structural checks of a built workbook as one stream of issues: support sheets, named ranges, formula cells, their
dependencies, and the cells that take population data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cell_coords
from .architecture_checks import SUPPORT_TABS
from .graphs import cycle_members, reachable


def _rows(df: DataFrame, code: str, cell: str | None = None, name: str | None = None, when: Column | None = None) -> DataFrame:
    df = df if when is None else df.filter(F.coalesce(when, F.lit(False)))
    col = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    return df.select(F.lit(code).alias("code"), col(cell).alias("cell"), col(name).alias("name"))


def _later(df: DataFrame, *key: str) -> DataFrame:
    """Rows whose key a row of smaller idx has; the first of each key is found by an aggregate, so that no key meets in one
    task."""
    first = df.groupBy(*key).agg(F.min("idx").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return df.join(first, list(key)).filter("idx > first")


def validate_workbook(w: dict[str, DataFrame]) -> DataFrame:
    """-> (code, cell, name), one row for each finding; the code NO_FORMULA_CELLS is a warning, all others are errors.

    ``w`` holds sheets(name), ranges(idx, name, scope, tab, address), formulas(idx, formula_id, address),
    dependencies(formula_id, on_id), mappings(cell, class, has_source, source_tab, source_field, formula_id),
    cells(idx, address, kind).

    Of repeated ranges and formula cells all but the first by idx are findings. Each formula on a cycle is a row, named by
    the cycle's smallest formula_id. A formula cell is reachable if it is mapped or a mapped formula depends on it, at
    any distance. A cell that is told several times has the kind of its largest idx. Null addresses are invalid.
    """
    spark = w["sheets"].sparkSession
    canonical = lambda c: cell_coords(F.col(c)).isNotNull()
    support = spark.createDataFrame([(x,) for x in SUPPORT_TABS], "name string")
    sheets = w["sheets"].select("name").distinct()
    out = [_rows(support.join(sheets, "name", "left_anti"), "MISSING_SUPPORT_SHEET", name="name")]

    ranges = w["ranges"].withColumn("good", canonical("address"))
    good = ranges.filter("good").withColumns({"space": F.when(F.col("scope") == "sheet", F.concat(F.lit("sheet:"), F.upper("tab"))).otherwise("workbook"), "key": F.upper("name")})
    out += [
        _rows(ranges, "INVALID_NAMED_RANGE_TARGET", "address", "name", ~F.col("good")),
        _rows(_later(good, "space", "key"), "DUPLICATE_NAMED_RANGE", "address", "name"),
        _rows(good.filter("scope = 'sheet'").join(sheets.select(F.col("name").alias("tab")), "tab", "left_anti"), "INVALID_NAMED_RANGE_SCOPE", "address", "name"),
    ]

    formulas = w["formulas"].withColumn("good", canonical("address"))
    good = formulas.filter("good")
    known = formulas.select("formula_id").distinct()
    on = good.join(w["dependencies"], "formula_id")
    edges = w["dependencies"].select(F.col("formula_id").alias("src"), F.col("on_id").alias("dst"))
    own = edges.join(known.select(F.col("formula_id").alias("src")), "src", "left_semi").join(known.select(F.col("formula_id").alias("dst")), "dst", "left_semi")
    rings = cycle_members(own).select(F.col("id").alias("formula_id"), "cycle")
    mapped = w["mappings"].select("formula_id").filter("formula_id is not null").distinct().join(known, "formula_id", "left_semi")
    met = reachable(own, mapped.select(F.col("formula_id").alias("id"))).select(F.col("id").alias("formula_id"))
    reached = formulas.join(met, "formula_id").select("address").union(w["mappings"].select(F.col("cell").alias("address"))).distinct()
    out += [
        _rows(formulas, "INVALID_FORMULA_TARGET", "address", when=~F.col("good")),
        _rows(_later(good, "address"), "DUPLICATE_FORMULA_CELL", "address"),
        _rows(on.join(known.select(F.col("formula_id").alias("on_id")), "on_id", "left_anti"), "UNSATISFIED_FORMULA_DEPENDENCY", "address", "on_id"),
        _rows(formulas.join(rings, "formula_id"), "CIRCULAR_DEPENDENCY", "address", "cycle"),
        _rows(formulas.join(reached, "address", "left_anti"), "UNREACHABLE_FORMULA_CELL", "address"),
    ]

    kinds = w["cells"].groupBy(F.col("address").alias("cell")).agg(F.max_by("kind", "idx").alias("kind"))
    m = w["mappings"].join(kinds, "cell", "left")
    cls, has = F.col("class"), F.coalesce("has_source", F.lit(False))
    blank = (F.coalesce("source_tab", F.lit("")) == "") | (F.coalesce("source_field", F.lit("")) == "")
    keys = w["mappings"].filter(has).select("source_tab", "source_field").distinct().withColumn("source", F.concat(F.coalesce("source_tab", F.lit("")), F.lit(":"), F.coalesce("source_field", F.lit(""))))
    out += [
        _rows(m, "MISSING_POPULATION_SOURCE", "cell", when=cls.isin("I", "B") & ~has),
        _rows(m, "INCOMPLETE_POPULATION_SOURCE", "cell", when=cls.isin("I", "B") & has & blank),
        _rows(keys, "INVALID_SOURCE_KEY", name="source", when=blank),
        _rows(m, "CELL_CLASSIFICATION_MISMATCH", "cell", "kind", has & (cls == "I") & (F.col("kind") != "input")),
        _rows(m, "INVALID_BIFEED_CELL", "cell", "kind", has & (cls == "B") & (F.col("kind") == "label")),
        _rows(m, "UNMAPPED_INPUT_CELL", "cell", when=(cls == "I") & ~has),
        _rows(m, "UNMAPPED_BIFEED_CELL", "cell", when=(cls == "B") & ~has & (F.coalesce("formula_id", F.lit("")) == "")),
        _rows(formulas.agg(F.count("*").alias("n")), "NO_FORMULA_CELLS", when=F.col("n") == 0),
    ]
    return reduce(DataFrame.unionByName, out)


def workbook_status(issues: DataFrame) -> DataFrame:
    """The findings of :func:`validate_workbook` -> one row (status, errors, warnings): invalid, warnings or valid."""
    warning = F.col("code") == "NO_FORMULA_CELLS"
    n = issues.agg(F.count_if(~warning).alias("errors"), F.count_if(warning).alias("warnings"))
    return n.select(F.when(F.col("errors") > 0, "invalid").when(F.col("warnings") > 0, "warnings").otherwise("valid").alias("status"), "errors", "warnings")
