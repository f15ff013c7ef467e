"""Referential checks, set operations, reconciliation and profiles over any tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import classify_raw_value, within_tolerance


def policy(table: DataFrame, most: int = 10_000) -> DataFrame:
    """A policy table, to be broadcast if it has no more than ``most`` rows. A larger one comes back as it is: its join gives
    the same rows by whatever plan Spark takes for its size."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def resolve_exactly_once(refs: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """refs(ref_id, key): missing without a target, ok with one, ambiguous with more."""
    n = targets.groupBy(key).agg(F.count("*").alias("targets"))
    n_ = F.coalesce("targets", F.lit(0))
    return refs.join(n, key, "left").select("ref_id", key, F.when(n_ == 0, "missing").when(n_ == 1, "ok").otherwise("ambiguous").alias("resolution"))


def ledger_balance(expected: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Ids that are not exactly once in the ledger, or in it without being expected: (key, expected, found)."""
    e = expected.groupBy(key).agg(F.count("*").alias("expected"))
    f = ledger.groupBy(key).agg(F.count("*").alias("found"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return e.join(f, key, "full").select(key, zero("expected"), zero("found")).filter("expected <> found or expected <> 1")


def missing_required(required: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    return required.select(key).distinct().join(observed.select(key), key, "left_anti")


def set_equals(a: DataFrame, b: DataFrame, group: str, value: str) -> DataFrame:
    """Per group whether both sides hold the same set of values; null is a value, and a null group equals no other. Each
    value is marked by the sides that hold it, so that no set is collected."""
    side = lambda df, k: df.select(group, value, F.lit(k == 0).alias("_a"), F.lit(k == 1).alias("_b"), F.when(F.col(group).isNull(), k).alias("_s"))
    marked = side(a, 0).unionByName(side(b, 1)).groupBy(group, "_s", value).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return marked.groupBy(group, "_s").agg(F.bool_and(F.col("_a") & F.col("_b")).alias("equal")).select(group, "equal")


def order_id_audit(order: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids of a supplied order that are unknown or repeated, and known ids that it lacks."""
    o, k = order.groupBy("id").agg(F.count("*").alias("n")), ids.select("id").distinct().withColumn("known", F.lit(True))
    issue = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return o.join(k, "id", "full").select("id", issue.alias("issue")).filter("issue is not null")


def union_issues(*issues: DataFrame) -> DataFrame:
    """Issue rows (check, severity, subject, message) of several checks, once each."""
    out = issues[0]
    for i in issues[1:]:
        out = out.unionByName(i)
    return out.distinct()


def merge_findings(*validations: DataFrame) -> DataFrame:
    """(code, message, severity): of equal code and message the one of the last validation counts."""
    out = None
    for k, v in enumerate(validations):
        v = v.withColumn("_k", F.lit(k))
        out = v if out is None else out.unionByName(v)
    return out.groupBy("code", "message").agg(F.max_by("severity", "_k").alias("severity"))


def index_consistency(index: DataFrame, records: DataFrame, key: str, value: str) -> DataFrame:
    """Index entries that differ from what their record gives, or miss one side."""
    i, r = index.select(key, F.col(value).alias("a"), F.lit(1).alias("_i")), records.select(key, F.col(value).alias("b"), F.lit(1).alias("_r"))
    issue = F.when(F.col("_i").isNull(), "not-indexed").when(F.col("_r").isNull(), "no-record").when(~F.col("a").eqNullSafe(F.col("b")), "different")
    return i.join(r, key, "full").select(key, issue.alias("issue")).filter("issue is not null")


def reconcile(expected: DataFrame, actual: DataFrame, overrides: DataFrame, absolute: float, relative: float) -> DataFrame:
    """expected(formula_id, class, expected), actual(formula_id, actual), overrides(class, absolute): one row per
    expected value; a value the expectation omits is not reported. ``overrides`` is a policy table."""
    j = expected.join(actual, "formula_id", "left").join(overrides.withColumnRenamed("absolute", "_abs"), "class", "left")
    ok = within_tolerance(F.col("expected"), F.col("actual"), F.coalesce("_abs", F.lit(absolute)), F.lit(relative))
    return j.select("formula_id", F.when(F.col("actual").isNull(), "error").when(ok, "match").otherwise("mismatch").alias("status"))


def reconciliation_summary(rows: DataFrame) -> DataFrame:
    a = rows.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("match", "matches"), ("mismatch", "mismatches"), ("error", "errors"))))
    status = F.when(F.col("matches") + F.col("mismatches") + F.col("errors") == 0, "unavailable").when(F.col("errors") > 0, "oracle-error").when(F.col("mismatches") > 0, "mismatches").otherwise("complete")
    return a.withColumn("status", status)


def summary_lines(findings: DataFrame, group: str, order: str, first: int = 10) -> DataFrame:
    """The first ``first`` of each group in order, and how many more there are. Ranks come from a partial sort."""
    by = Window.partitionBy(group)
    r = findings.withColumn("rank", F.row_number().over(by.orderBy(order)))
    n = findings.groupBy(group).agg(F.count("*").alias("n"))
    return r.filter(F.col("rank") <= first).join(n, group).select(group, order, "rank", F.greatest(F.lit(0), F.col("n") - first).cast("long").alias("more"))


def to_cells(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Wide rows as (row, field, value): one pass over the table, no join."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.col(key).alias("row"), F.inline(pairs))


def profile_fields(cells: DataFrame) -> DataFrame:
    """cells(row, field, value) -> per field the cells, exact distinct values other than null, and how many of each kind
    of missingness."""
    k = classify_raw_value(F.col("value"), F.lit(True))
    kinds = ("null", "blank", "formula-text", "leading-zero-text", "malformed", "literal-zero", "text")
    return cells.withColumn("kind", k).groupBy("field").agg(F.count("*").alias("cells"), F.count_distinct("value").alias("distinct_values"), *(F.count_if(F.col("kind") == x).alias(x.replace("-", "_") + "_cells") for x in kinds))


def profile_table(cells: DataFrame) -> DataFrame:
    """cells(row, field, value) -> per field the cells and how many of each kind of missingness; ``profile_fields`` has
    the distinct values, ``table_structure`` the checks of headers and widths."""
    return profile_fields(cells).drop("distinct_values")


def table_structure(cells: DataFrame) -> DataFrame:
    """cells(file, row, col, value) from 0, row 0 the headers -> per file its headers, records, row widths, whether it is
    sound (headers there and unique, all rows as wide) and the confidence that it is a population."""
    rows = cells.groupBy("file", "row").agg((F.max("col") + 1).alias("width"))
    w = rows.groupBy("file").agg(F.count_if(F.col("row") > 0).alias("records"), F.min("width").alias("min_width"), F.max("width").alias("max_width"))
    h = cells.filter("row = 0").groupBy("file").agg(F.count("*").alias("headers"), F.count_distinct(F.coalesce("value", F.lit(""))).alias("_d"))
    headers = F.coalesce("headers", F.lit(0))
    j = w.join(h, "file", "left").withColumn("structurally_valid", F.coalesce((F.col("_d") == F.col("headers")) & (F.col("min_width") == F.col("headers")) & (F.col("max_width") == F.col("headers")), F.lit(False)))
    confidence = F.when(headers < 2, 0.0).when(F.col("structurally_valid"), 0.8).otherwise(0.5)
    return j.select("file", headers.alias("headers"), "records", "min_width", "max_width", "structurally_valid", confidence.alias("confidence"))


def population_registry(cells: DataFrame) -> DataFrame:
    """cells(tab, field, row_idx, value) -> per tab its fields and record count, the longest column."""
    f = cells.groupBy("tab", "field").agg((F.max("row_idx") + 1).alias("records"))
    return f.groupBy("tab").agg(F.count("*").alias("fields"), F.max("records").alias("records"))


def populate_cells(mappings: DataFrame, data: DataFrame) -> DataFrame:
    """mappings(mapping_id, field, position), data(field, row_idx, value): the n-th mapping of a field takes its n-th
    value, null past the end."""
    n = F.row_number().over(Window.partitionBy("field").orderBy("position")) - 1
    return mappings.withColumn("row_idx", n.cast("long")).join(data, ["field", "row_idx"], "left").select("mapping_id", "field", "value")


def merge_sheet_cells(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer by address; the left side counts, unless blank."""
    x, y = a.select(*keys, F.col(value).alias("x")), b.select(*keys, F.col(value).alias("y"))
    return x.join(y, keys, "full").select(*keys, F.coalesce(F.when(F.trim("x") != "", F.col("x")), F.col("y"), F.col("x")).alias(value))


def expand_containers(members: DataFrame, max_members: int, max_bytes: int) -> DataFrame:
    """members(parent, seq, path, size) in ledger order: kept before the first breach of a limit, partial after it."""
    run = Window.partitionBy("parent").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    breach = (F.count("*").over(run) > max_members) | (F.sum("size").over(run) > max_bytes)
    same = F.count("*").over(Window.partitionBy("parent", "path"))
    return members.withColumns({"_b": breach, "_n": same}).select("parent", "seq", F.when(F.col("_b"), "dropped").when(F.col("_n") > 1, "collision").otherwise("kept").alias("status"))


def contract_check(df: DataFrame, key: str, contract: dict[str, Column]) -> DataFrame:
    """contract: column predicates that must hold; null counts as broken. One issue row per broken one."""
    issues = F.array(*(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in contract.items()))
    return df.select(F.col(key).alias("subject"), F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def match_references_topk(tokens: DataFrame, refs: DataFrame, k: int = 5, weight: float = 100.0) -> DataFrame:
    """tokens(doc_id, token), refs(ref_id, token): the ``k`` references that share the most distinct tokens, scored by
    the share of the reference's; ties by smaller ref_id."""
    r = refs.distinct()
    size = r.groupBy("ref_id").agg(F.count("*").alias("n"))
    # tokens that no reference has go before the shuffle; a document's rest is dealt once, by the document, which serves
    # the distinct tokens, the counts and the ranks, so that the rows of documents and references are never shuffled.
    # They are many more than the tokens, so that partitions fit for the tokens' bytes would be too large
    parts = 8 * int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = tokens.join(r.select("token").distinct(), "token", "left_semi").select("doc_id", "token").repartition(parts, "doc_id").distinct()
    m = t.join(r, "token").groupBy("doc_id", "ref_id").agg(F.count("*").alias("shared")).join(size, "ref_id")
    m = m.withColumn("score", F.floor(F.col("shared") / F.col("n") * weight + 0.5).cast("long"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("shared"), "ref_id"))
    return m.withColumn("rank", rank).filter(F.col("rank") <= k).select("doc_id", "rank", "ref_id", "score")


def classify_fields(cells: DataFrame, runs: DataFrame, rules: DataFrame) -> DataFrame:
    """cells(cell_id, field), runs(run), rules(field_pattern, run_pattern, class, priority) -> the class of each cell and
    run by the first matching rule, empty where none. ``runs`` and ``rules`` are policy tables."""
    hit = F.contains(F.lower("field"), F.lower("field_pattern")) & ((F.col("run_pattern") == "*") | (F.col("run_pattern") == F.col("run")))
    m = cells.join(policy(runs)).join(policy(rules), hit, "left")
    return m.groupBy("cell_id", "run").agg(F.coalesce(F.min_by("class", F.when(F.col("priority").isNotNull(), F.struct(-F.col("priority"), "field_pattern"))), F.lit("")).alias("class"))


def map_generic_field(descs: DataFrame, glossary: DataFrame) -> DataFrame:
    """descs(desc_id, text), glossary(pattern, generic): exact beats contained; one distinct target or null."""
    j = descs.join(policy(glossary), F.contains(F.lower("text"), F.lower("pattern")), "left")
    j = j.withColumn("exact", F.lower("text") == F.lower("pattern"))
    a = j.groupBy("desc_id").agg(*(f(F.when(c, F.col("generic"))).alias(n) for n, c, f in (("e", F.col("exact"), F.min), ("e2", F.col("exact"), F.max), ("c", F.lit(True), F.min), ("c2", F.lit(True), F.max))))
    return a.select("desc_id", F.when(F.col("e").isNotNull(), F.when(F.col("e") == F.col("e2"), F.col("e"))).otherwise(F.when(F.col("c") == F.col("c2"), F.col("c"))).alias("generic"))


def cells_in_range(ranges: DataFrame, cells: DataFrame) -> DataFrame:
    """ranges(range_id, sheet, c1, r1, c2, r2), cells(sheet, col, row): an equi-join on the sheet with bounds."""
    j = ranges.withColumn("s", F.upper("sheet")).drop("sheet").join(cells.withColumn("s", F.upper("sheet")).drop("sheet"), "s")
    return j.filter(F.col("col").between(F.col("c1"), F.col("c2")) & F.col("row").between(F.col("r1"), F.col("r2"))).groupBy("range_id").agg(F.count("*").alias("cells"))
