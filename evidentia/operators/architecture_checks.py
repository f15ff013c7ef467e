"""Referential checks of an architecture: tabs, runs, cells, classifications, dependencies, ranges and lineage.

All references, whatever they refer to, are rows (space, key, code, path) of one table, all that can be referred to rows
(space, key) of another: one anti-join answers every referential check, and one aggregate finds what is defined twice.
Spark splits a hot key of the references, such as the tab of most cells; the targets are distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cell_coords

#: Governed policies, tabs that may stand without a population, kinds of references, and fields whose class is fixed.
POLICIES = ("scenario-selection", "tab-selection", "iob-classification", "field-name-glossary")
SUPPORT_TABS = ("Summary", "Tables", "UD Table")
REFERENCE_TYPES = ("cell", "named-range", "external")
FIXED_CLASSES = {"CALC_INDICATOR": "B", "CALCULATION": "N"}
#: The codes of issues, and where in the document those of a whole category are reported.
CODES = {
    "policies": "ARCHITECTURE_POLICY_LINEAGE_INVALID",
    "tab_twice": "ARCHITECTURE_SOURCE_TAB_DUPLICATE",
    "run_twice": "ARCHITECTURE_RUN_DUPLICATE",
    "tab_lineage": "ARCHITECTURE_SOURCE_TAB_LINEAGE_MISSING",
    "tab_role": "ARCHITECTURE_SOURCE_TAB_ROLE_INVALID",
    "run_tab": "ARCHITECTURE_RUN_TAB_MISSING",
    "run_reference": "ARCHITECTURE_RUN_APPROVAL_REFERENCE_INVALID",
    "cell_identity": "ARCHITECTURE_CELL_IDENTITY_INVALID",
    "cell_tab": "ARCHITECTURE_CELL_TAB_MISSING",
    "cell_address": "ARCHITECTURE_CELL_ADDRESS_INVALID",
    "formula_flag": "ARCHITECTURE_FORMULA_FLAG_INVALID",
    "coverage": "ARCHITECTURE_CLASSIFICATION_COVERAGE_INVALID",
    "class_identity": "ARCHITECTURE_CLASSIFICATION_IDENTITY_INVALID",
    "class_value": "ARCHITECTURE_CLASSIFICATION_SEMANTICS_INVALID",
    "dependency": "ARCHITECTURE_DEPENDENCY_REFERENCE_INVALID",
    "range_target": "ARCHITECTURE_NAMED_RANGE_TARGET_INVALID",
    "range_twice": "ARCHITECTURE_NAMED_RANGE_DUPLICATE",
    "lineage_twice": "ARCHITECTURE_LINEAGE_IDENTITY_DUPLICATE",
    "lineage_identity": "ARCHITECTURE_LINEAGE_IDENTITY_INVALID",
    "approval": "ARCHITECTURE_APPROVAL_BINDING_CONFLICT",
    "population_twice": "ARCHITECTURE_POPULATION_LINEAGE_DUPLICATE",
}
WHERE = {"tab": "/sourceTabs", "run": "/runs", "policies": "/lineage/policies", "population": "/lineage/population", "controls": "/lineage/caseControls", "overrides": "/lineage/authorityOverrides"}


def _path(*parts) -> Column:
    """A path of literal steps and columns, whose values are escaped as in JSON pointers."""
    out = [F.lit(p) if isinstance(p, str) and p.startswith("/") else F.replace(F.replace(F.col(p).cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")) for p in parts]
    return F.concat(*(F.coalesce(x, F.lit("")) for x in out))


def _pair(a: str, b: str) -> Column:
    """One key of two columns; null if either is."""
    return F.concat(F.col(a).cast("string"), F.lit("\0"), F.col(b).cast("string"))


def _issues(df: DataFrame, code: str, path: Column, when: Column) -> DataFrame:
    return df.filter(F.coalesce(when, F.lit(False))).select(F.lit(CODES[code]).alias("code"), path.alias("path"))


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def _references(a: dict[str, DataFrame]) -> DataFrame:
    def of(df: DataFrame, space: str, key, code: str, path: Column, when: Column | None = None) -> DataFrame:
        df = df if when is None else df.filter(when)
        return df.select(F.lit(space).alias("space"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), F.lit(CODES[code]).alias("code"), path.alias("path"))

    tab, cell, dep, rng, just = _path("/sourceTabs/", "idx"), _path("/cells/", "key"), _path("/formulaDependencies/", "idx"), _path("/namedRanges/", "idx"), _path("/runs/", "run_idx", "/justifications/", "idx")
    return _union([
        of(a["tabs"], "profile", "profile", "tab_lineage", tab),
        of(a["tabs"], "population", _pair("candidate", "artifact"), "tab_role", tab, F.col("role") == "population"),
        of(a["run_tabs"], "tab", "tab", "run_tab", _path("/runs/", "run_idx", "/applicableTabs")),
        of(a["justifications"], "control", _pair("ref_id", "ref_hash"), "run_reference", just, F.col("source") == "case-control"),
        of(a["justifications"], "population", _pair("ref_id", "ref_hash"), "run_reference", just, F.col("source") == "population"),
        of(a["cells"], "tab", "tab", "cell_tab", F.concat(cell, F.lit("/sourceTab"))),
        of(a["classes"], "run", "run_key", "coverage", F.concat(cell, F.lit("/perRunClassification"))),
        of(a["dependencies"], "cell", "dependent", "dependency", dep),
        of(a["dependencies"], "cell", "dependency", "dependency", dep),
        of(a["dependencies"], "run", "run_id", "dependency", dep),
        of(a["ranges"], "tab", "tab", "range_target", rng),
        of(a["ranges"], "cell", F.concat("tab", F.lit("::"), "address"), "range_target", rng),
    ])


def _targets(a: dict[str, DataFrame]) -> DataFrame:
    def of(df: DataFrame, space: str, key, twice: str | None = None, at: str | None = None) -> DataFrame:
        return df.select(F.lit(space).alias("space"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), F.lit(CODES[twice] if twice else None).cast("string").alias("code"), F.lit(at).cast("string").alias("path"))

    lineage = [of(a[k], f"id of {k}", i, "lineage_twice", WHERE[k]) for k, i in (("policies", "approval_id"), ("population", "approval_id"), ("controls", "control_id"), ("overrides", "override_id"))]
    return _union([
        *lineage,
        of(a["tabs"], "tab", "tab", "tab_twice", WHERE["tab"]),
        of(a["runs"], "run", "run_id", "run_twice", WHERE["run"]),
        of(a["cells"], "cell", "key"),
        of(a["population"], "population", _pair("candidate", "artifact"), "population_twice", WHERE["population"]),
        of(a["population"], "profile", "profile"),
        of(a["controls"], "control", _pair("control_id", "hash")),
    ])


def validate_architecture(a: dict[str, DataFrame]) -> DataFrame:
    """-> (code, path), each once. ``a`` holds

    tabs(idx, tab, role, profile, candidate, artifact), runs(idx, run_id), run_tabs(run_idx, tab),
    justifications(run_idx, idx, source, ref_id, ref_hash), cells(key, cell_key, tab, address, has_formula, formula, field),
    classes(key, run_key, run_id, iob), dependencies(idx, dependent, dependency, run_id, type),
    ranges(idx, scope, tab, address, name), policies(kind, approval_id, hash), population(candidate, artifact, profile,
    approval_id, hash), controls(control_id, hash), overrides(override_id, hash).

    A reference that is null refers to nothing, so it is an issue; null keys of targets are no targets. Of ranges of one
    identity the first by idx is none's repetition. An architecture without rows lacks its policies only.
    """
    refs, targets = _references(a), _targets(a).filter("key is not null")
    known = targets.groupBy("space", "key").agg(F.count("*").alias("n"), F.first("code").alias("code"), F.first("path").alias("path"))
    missing = refs.join(known.select("space", "key"), ["space", "key"], "left_anti").select("code", "path")
    twice = known.filter("n > 1 and code is not null").select("code", "path")

    cells, classes, ranges = a["cells"], a["classes"], a["ranges"]
    cell, cls = _path("/cells/", "key"), _path("/cells/", "key", "/perRunClassification/", "run_key")
    same = F.concat("tab", F.lit("::"), "address")
    canonical = lambda c: F.coalesce(F.col(c).rlike("^[A-Z]+[1-9][0-9]*$") & cell_coords(F.col(c)).isNotNull(), F.lit(False))
    support = F.col("candidate").isNotNull() | F.col("artifact").isNotNull() | ~F.coalesce(F.col("tab").isin(*SUPPORT_TABS), F.lit(False))
    fixed = reduce(lambda x, kv: x | ((F.col("field") == kv[0]) & ~F.col("iob").eqNullSafe(kv[1])), FIXED_CLASSES.items(), F.lit(False))
    own = [
        _issues(a["tabs"], "tab_role", _path("/sourceTabs/", "idx"), (F.col("role") == "support") & support),
        _issues(cells, "cell_identity", cell, ~(F.col("key").eqNullSafe(same) & F.col("cell_key").eqNullSafe(same))),
        _issues(cells, "cell_address", F.concat(cell, F.lit("/cellAddress")), ~canonical("address")),
        _issues(cells, "formula_flag", cell, ~F.col("has_formula").eqNullSafe(F.coalesce(F.trim("formula") != "", F.lit(False)))),
        _issues(classes, "class_identity", cls, ~F.col("run_key").eqNullSafe(F.col("run_id"))),
        _issues(classes.join(cells.filter(F.col("field").isin(*FIXED_CLASSES)).select("key", "field"), "key"), "class_value", F.concat(cls, F.lit("/iob")), fixed),
        _issues(a["dependencies"], "dependency", _path("/formulaDependencies/", "idx"), ~F.coalesce(F.col("type").isin(*REFERENCE_TYPES), F.lit(False))),
        _issues(ranges, "range_target", _path("/namedRanges/", "idx"), ~canonical("address")),
    ]
    # every run has a class in every cell: those of unknown runs are references above
    runs = a["runs"].agg(F.countDistinct("run_id").alias("runs"))  # one row
    per = classes.groupBy("key").agg(F.countDistinct("run_key").alias("n"))
    short = cells.select("key").join(per, "key", "left").crossJoin(F.broadcast(runs))
    own.append(_issues(short, "coverage", F.concat(cell, F.lit("/perRunClassification")), F.coalesce("n", F.lit(0)) < F.col("runs")))
    # ranges: all but the first of an identity
    identity = [F.col("scope"), F.when(F.col("scope") == "sheet", F.upper("tab")).otherwise("").alias("sheet"), F.upper("name").alias("name")]
    named = ranges.select("idx", *identity)
    first = named.groupBy("scope", "sheet", "name").agg(F.min("idx").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = named.join(first, (named.scope.eqNullSafe(first.scope)) & (named.sheet.eqNullSafe(first.sheet)) & (named.name.eqNullSafe(first.name))).select("idx", "first")
    own.append(_issues(again, "range_twice", _path("/namedRanges/", "idx"), F.col("idx") > F.col("first")))
    # lineage
    by = (("policies", "approval_id"), ("population", "approval_id"), ("controls", "control_id"), ("overrides", "override_id"))
    own += [_issues(a[k], "lineage_identity", F.lit(WHERE[k]), F.coalesce((F.col(i) == "") | (F.col(i) != F.trim(F.col(i))), F.lit(True))) for k, i in by]
    bound = _union([a[k].select(F.col("approval_id").alias("id"), "hash", F.lit(WHERE[k]).alias("path")) for k in ("policies", "population")]).filter("id is not null")
    clash = bound.groupBy("id").agg(F.countDistinct(F.coalesce("hash", F.lit("\0"))).alias("n"), F.max("path").alias("path")).filter("n > 1")
    own.append(_issues(clash, "approval", F.col("path"), F.lit(True)))
    kinds = a["policies"].agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("kind").isin(*POLICIES), F.col("kind"))).alias("k"))
    own.append(_issues(kinds, "policies", F.lit(WHERE["policies"]), (F.col("n") != len(POLICIES)) | (F.col("k") != len(POLICIES))))
    return _union([missing, twice, *own]).distinct()
