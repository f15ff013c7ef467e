"""Rule governance, scenario intervals, architecture and specification checks, reconciliation oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import requires_override, tab_matches
from ..functions.scalars import cell_coords
from .registry import normalize_identity
from .rules import match_condition
from .tables import policy as policy_table

#: Functions a formula may use, those that change by themselves, and those that reach outside.
FUNCTIONS = ("ABS", "AND", "DATE", "DAY", "DAYS", "IF", "INT", "ISBLANK", "ISLOGICAL", "ISNUMBER", "ISTEXT", "MAX", "MIN", "MOD", "MONTH", "NOT", "OR", "PRODUCT", "ROUND", "ROUNDDOWN", "ROUNDUP", "SIGN", "SUM", "TRUNC", "YEAR")
VOLATILE = ("CELL", "INDIRECT", "INFO", "NOW", "OFFSET", "RAND", "RANDARRAY", "RANDBETWEEN", "TODAY")
ACTIVE = ("FILTERXML", "HYPERLINK", "RTD", "WEBSERVICE")
LONGEST_FORMULA = 8192
#: Kinds of oracles, of their results, of their reliability, and of rounding.
ORACLES = ("external-execution", "reference-calculation", "prior-validated-run", "independent-oracle")
RESULT_TYPES = ("number", "text", "date", "boolean", "error")
RELIABILITY = ("trusted", "provisional", "unknown")
ROUNDING = ("banker's", "away-from-zero", "down")


def _issues(df: DataFrame, subject: str, **checks: Column) -> DataFrame:
    """(subject, issue) for every check that is true of a row."""
    found = F.array_compact(F.array(*(F.when(c, name.upper()) for name, c in checks.items())))
    return df.select(F.col(subject).cast("string").alias("subject"), F.explode(found).alias("issue"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Fixed value: rows of a table that one task of its joins with itself takes.
TASK_ROWS = 200_000


def _tasks(df: DataFrame) -> int:
    """How many tasks the joins of ``df`` with itself are dealt to. A session's fixed number would make tasks as large as the
    input grows, and rows in memory are many times what they are in a shuffle, by which Spark joins partitions up."""
    return max(1, -(-df.count() // TASK_ROWS))


def beside(df: DataFrame, other: DataFrame, key: str, by: str) -> DataFrame:
    """``df`` left joined by ``key`` with ``other``(key, ...). Rows without a key match nothing; they are dealt by
    ``by``, where a join by the key alone would send all of them to one task."""
    spot = F.xxhash64(F.col(key))
    return df.withColumn("_spot", F.when(F.col(key).isNotNull(), spot).otherwise(F.xxhash64(by))).join(other.withColumn("_spot", spot), [key, "_spot"], "left").drop("_spot")


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def matching_conditions(facts: DataFrame, conditions: DataFrame) -> DataFrame:
    """facts(case_id, dimension, value), conditions(condition_id, dimension, operator, value) -> (case_id, condition_id)
    where a fact of the condition's dimension meets it. A dimension that a case leaves out meets nothing: absence is a
    value of its own."""
    c = conditions.select("condition_id", "dimension", "operator", F.col("value").alias("wanted"))
    hit = match_condition(F.col("value"), F.col("operator"), F.col("wanted"))
    return facts.join(c, "dimension").filter(hit).select("case_id", "condition_id").distinct()


def select_scenarios(facts: DataFrame, conditions: DataFrame) -> DataFrame:
    """facts as above, conditions(condition_id, scenario_id, source, excludes, dimension, operator, value), source being
    rule, case or population -> (case_id, scenario_id, met, conditions, status) for every case that has a fact and every
    scenario; met and conditions count those that do not exclude.

    unresolved: the case has no fact of a population condition's dimension, or meets some of the scenario's rule
    conditions, but not all; else not-selected: a case or population condition is not met, or there are rule conditions
    and none is; else excluded: an excluding condition is met; else selected. Scenarios are a policy table, so that the
    result, each case with each of them, is what is asked for and no join by chance."""
    c = conditions.select("condition_id", "scenario_id", "source", F.coalesce("excludes", F.lit(False)).alias("excludes"), "dimension", "operator", F.col("value").alias("wanted"))
    of = lambda source: ~F.col("excludes") & (F.col("source") == source)
    size = c.groupBy("scenario_id").agg(F.count_if(~F.col("excludes")).alias("conditions"), *(F.count_if(of(s)).alias(s) for s in ("rule", "case", "population")))
    hit = F.coalesce(match_condition(F.col("value"), F.col("operator"), F.col("wanted")), F.lit(False))
    # all steps go by case: facts are dealt once, before conditions multiply them
    facts = facts.repartition("case_id")
    told = facts.filter("value is not null").join(c, "dimension").groupBy("case_id", "scenario_id", "condition_id", "source", "excludes").agg(F.max(hit).alias("hit"))
    count = lambda when, name: F.count_if(when).alias(name)
    per = told.groupBy("case_id", "scenario_id").agg(count(~F.col("excludes") & F.col("hit"), "met"), count(of("population"), "known"), *(count(of(s) & F.col("hit"), f"met_{s}") for s in ("rule", "case", "population")), count(F.col("excludes") & F.col("hit"), "barred"))
    every = facts.select("case_id").distinct().crossJoin(policy_table(size)).join(per, ["case_id", "scenario_id"], "left").fillna(0)
    n = {x: F.col(x) for x in every.columns}
    status = (
        F.when((n["known"] < n["population"]) | ((n["met_rule"] > 0) & (n["met_rule"] < n["rule"])), "unresolved")
        .when((n["met_case"] < n["case"]) | (n["met_population"] < n["population"]) | ((n["rule"] > 0) & (n["met_rule"] == 0)), "not-selected")
        .when(n["barred"] > 0, "excluded")
        .otherwise("selected")
    )
    return every.select("case_id", "scenario_id", "met", "conditions", status.alias("status"))


def intersect_condition_ranges(matches: list[DataFrame]) -> DataFrame:
    """One DataFrame (scenario, rule_id, start_date, end_date) of matching rules for each condition -> (scenario,
    start_date, end_date, rules): every interval that one rule of each condition shares, and how many different rules
    contribute to it. Conditions are folded one by one: intervals that are empty go at each step, and equal intervals
    become one, so that the product of all conditions never exists at once."""

    def meet(spans: DataFrame, m: DataFrame, *more: str) -> DataFrame:
        n = m.select("scenario", F.col("start_date").alias("s"), F.col("end_date").alias("e"), *more)
        start, end = F.greatest("start_date", "s"), F.least("end_date", "e")
        return spans.join(n, "scenario").filter(end.isNull() | (start <= end)).select("scenario", start.alias("start_date"), end.alias("end_date"), *more)

    # all steps go by scenario: rules are dealt once, and no step deals them anew. Equal intervals become one before that, as
    # each step beside the joins takes memory of the same task
    n = _tasks(_union([m.select("scenario") for m in matches]))
    spans = [m.select("scenario", "start_date", "end_date").distinct().repartition(n, "scenario") for m in matches]
    parts = []
    for k, m in enumerate(matches):
        # what all other conditions share, met by each rule of this one
        rest, own = spans[:k] + spans[k + 1 :], m.select("scenario", "start_date", "end_date", "rule_id").repartition(n, "scenario")
        parts.append(meet(reduce(lambda a, b: meet(a, b).distinct(), rest), own, "rule_id") if rest else own)
    return _union(parts).groupBy("scenario", "start_date", "end_date").agg(F.count_distinct("rule_id").alias("rules"))


def query_authority(rules: DataFrame, sources: DataFrame, day: Column) -> DataFrame:
    """rules(rule_id, sha256), sources(sha256, role, review_status, superseded_on) -> per rule its source's role,
    supersession status on ``day`` and issue: no source, several, superseded or stale."""
    s = sources.groupBy("sha256").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("role", "review_status", "superseded_on")))
    j = rules.join(s, "sha256", "left")
    over = F.coalesce(F.col("superseded_on") <= day, F.lit(False))
    issue = F.when(F.col("n").isNull(), "NO_SOURCE").when(F.col("n") > 1, "SEVERAL_SOURCES").when(over, "SUPERSEDED").when(F.col("review_status") == "stale", "STALE")
    return j.select("rule_id", "role", F.when(over, "superseded").otherwise("current").alias("supersession"), issue.alias("issue"))


def override_issues(overrides: DataFrame, catalog: DataFrame, hashed: tuple[str, ...]) -> DataFrame:
    """overrides(override_id, case_id, scope, sha256, role, issued_at, prior_id, prior_hash, content_hash), catalog(case_id, sha256,
    role, review_status) of evidence and references -> issues(override_id, issue) of the set, any of which makes it unfit:
    an id that is not alone (DUPLICATE_ID), a hash that is not that of the ``hashed`` columns (HASH), an artifact that the
    case's catalog does not hold exactly once, released and in the role (ARTIFACT), a prior that is not there or of another
    hash, case or scope, or not older (LINK), and a prior with several successors (BRANCH, once, under the prior's id).
    A null prior_id has no prior. Null ids are one id."""
    o = overrides.withColumn("_own", F.sha2(F.to_json(F.struct(*hashed), {"ignoreNullFields": "false"}), 256))
    c = catalog.groupBy("case_id", "sha256").agg(F.count("*").alias("_n"), F.min("role").alias("_role"), F.min("review_status").alias("_status"))
    # of repeated ids the newest stands for the prior; the repeat itself is an issue anyway
    heads = F.max_by(F.struct("content_hash", "case_id", "scope", "issued_at"), F.struct("issued_at", "content_hash"))
    prior = overrides.filter("override_id is not null").groupBy(F.col("override_id").alias("prior_id")).agg(heads.alias("_prior"))
    j = beside(o.join(c, ["case_id", "sha256"], "left"), prior, "prior_id", "override_id")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    bound = same("_prior.content_hash", "prior_hash") & same("_prior.case_id", "case_id") & same("_prior.scope", "scope") & F.coalesce(F.col("issued_at") > F.col("_prior.issued_at"), F.lit(False))
    issues = F.array_compact(F.array(
        F.when(~F.col("content_hash").eqNullSafe(F.col("_own")), "HASH"),
        F.when(~(F.coalesce(F.col("_n") == 1, F.lit(False)) & same("_role", "role") & F.coalesce(F.col("_status") == "released", F.lit(False))), "ARTIFACT"),
        F.when(F.col("prior_id").isNotNull() & ~bound, "LINK"),
    ))
    several = lambda key, issue: overrides.groupBy(F.col(key).alias("override_id")).agg(F.count("*").alias("n")).filter("n > 1").select("override_id", F.lit(issue).alias("issue"))
    return j.select("override_id", F.explode(issues).alias("issue")).unionByName(several("override_id", "DUPLICATE_ID")).unionByName(several("prior_id", "BRANCH").filter("override_id is not null"))


def effective_overrides(overrides: DataFrame, released: DataFrame) -> DataFrame:
    """overrides(override_id, prior_id, action, scope, sha256), released(sha256) -> those in force: ends of chains that do
    not branch, not repealed, and bound to a released artifact. A prior that is not there breaks a chain."""
    succ = overrides.filter("prior_id is not null").groupBy(F.col("prior_id").alias("override_id")).agg(F.count("*").alias("next"))
    known = overrides.select(F.col("override_id").alias("prior_id"), F.lit(True).alias("known")).distinct()
    free = released.select("sha256").distinct()
    o = beside(overrides.join(succ, "override_id", "left"), known, "prior_id", "override_id")
    branches = succ.filter("next > 1").select(F.col("override_id").alias("prior_id"), F.lit(True).alias("branches"))
    o = beside(o, branches, "prior_id", "override_id").filter("branches is null and next is null and action <> 'repeal' and (prior_id is null or known)")
    return o.join(free, "sha256", "left_semi").select("override_id", "scope")


def governing_override(rules: DataFrame, sources: DataFrame, overrides: DataFrame) -> DataFrame:
    """rules(rule_id, scope, sha256), sources(sha256, role) of released artifacts, overrides(override_id, scope) in force ->
    (rule_id, override_id, issue): a citation names one released artifact; regulation, training and other sources need
    exactly one override of the rule's scope, the rest none."""
    s = sources.groupBy("sha256").agg(F.count("*").alias("n"), F.min("role").alias("role"))
    o = overrides.groupBy("scope").agg(F.count("*").alias("m"), F.min("override_id").alias("override_id"))
    j = rules.join(s, "sha256", "left").join(o, "scope", "left")
    need, m = requires_override(F.col("role")), F.coalesce("m", F.lit(0))
    issue = F.when(F.coalesce("n", F.lit(0)) != 1, "CITATION").when(need & (m == 0), "OVERRIDE_REQUIRED").when(need & (m > 1), "OVERRIDE_AMBIGUOUS").when(~need & (m > 0), "OVERRIDE_FORBIDDEN")
    return j.select("rule_id", F.when(issue.isNull() & need, F.col("override_id")).alias("override_id"), issue.alias("issue"))


def authoring_gate(requests: DataFrame, blocked: DataFrame, governance: DataFrame) -> DataFrame:
    """requests(rule_id, citations, effective_date, end_date, confidence, applicability, predecessor_date), blocked(rule_id,
    open_items), governance(rule_id, issue) -> (rule_id, error): the first broken check, null where a rule may be
    authored."""
    g = governance.filter("issue is not null").groupBy("rule_id").agg(F.min("issue").alias("g"))
    j = requests.join(blocked.groupBy("rule_id").agg(F.sum("open_items").alias("open")), "rule_id", "left").join(g, "rule_id", "left")
    error = (
        F.when(F.coalesce("citations", F.lit(0)) < 1, "CITATION_REQUIRED")
        .when(F.col("effective_date").isNull(), "EFFECTIVE_DATE_REQUIRED")
        .when(F.col("end_date") <= F.col("effective_date"), "DATES")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "CONFIDENCE")
        .when(_blank("applicability"), "APPLICABILITY")
        .when(F.coalesce("open", F.lit(0)) > 0, "UNRESOLVED")
        .when(F.col("g").isNotNull(), F.col("g"))
        .when(F.col("effective_date") <= F.col("predecessor_date"), "SUCCESSOR_DATE")
    )
    return j.select("rule_id", error.alias("error"))


def validate_rule_set(rules: DataFrame, approver: Column) -> DataFrame:
    """rules(rule_id, scope, applicability, author, start_date, end_date) -> (scope, code, detail): scopes none of whose
    rules is ever effective, classes that several effective rules name, and rules by others than the approver."""
    on = F.col("end_date").isNull() | (F.col("end_date") > F.col("start_date"))
    r = rules.withColumn("on", on)
    none = r.groupBy("scope").agg(F.bool_or("on").alias("any")).filter("not any").select("scope", F.lit("NO_EFFECTIVE_RULES").alias("code"), F.lit("").alias("detail"))
    c = r.filter("on").select("scope", F.explode(F.split("applicability", ",")).alias("c")).select("scope", F.trim("c").alias("detail"))
    over = c.groupBy("scope", "detail").agg(F.count("*").alias("n")).filter("n > 1").select("scope", F.lit("OVERLAPPING_APPLICABILITY").alias("code"), "detail")
    other = r.filter(F.col("on") & (F.col("author") != approver)).groupBy("scope").agg(F.count("*").alias("n")).select("scope", F.lit("UNAPPROVED_RULE_AUTHOR").alias("code"), F.col("n").cast("string").alias("detail"))
    return _union([none, over, other])


def supersession_issues(rules: DataFrame) -> DataFrame:
    """rules(rule_id, scope, predecessor_id, predecessor_hash, hash, start_date, end_date) -> (subject, issue): ids that come
    again, links that do not bind to their predecessor, predecessors with several successors, scopes with several roots,
    and successors of another scope or of dates that do not follow. Cycles are ``graphs.cycle_members`` of the links."""
    again = rules.groupBy("rule_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rule_id").cast("string").alias("subject"), F.lit("DUPLICATE_ID").alias("issue"))
    p = rules.select(F.col("rule_id").alias("predecessor_id"), F.col("hash").alias("h"), F.col("scope").alias("ps"), F.col("start_date").alias("pstart"), F.col("end_date").alias("pend"), F.lit(1).alias("there"))
    n = _tasks(rules)
    linked = rules.filter("predecessor_id is not null").repartition(n, "predecessor_id").join(p.repartition(n, "predecessor_id"), "predecessor_id", "left")
    bound = F.col("there").isNotNull() & F.col("predecessor_hash").eqNullSafe(F.col("h"))
    follows = (F.col("scope") == F.col("ps")) & (F.col("start_date") > F.col("pstart")) & (F.col("pend").isNull() | (F.col("pend") <= F.col("start_date")))
    links = _issues(linked, "rule_id", unbound=~bound, sequence=bound & ~F.coalesce(follows, F.lit(False)))
    branch = rules.filter("predecessor_id is not null").groupBy("predecessor_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("predecessor_id").cast("string").alias("subject"), F.lit("BRANCH").alias("issue"))
    roots = rules.filter("predecessor_id is null").groupBy("scope").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("scope").cast("string").alias("subject"), F.lit("SEVERAL_ROOTS").alias("issue"))
    return _union([again, links, branch, roots])


def resolve_named_ranges(refs: DataFrame, ranges: DataFrame) -> DataFrame:
    """refs(ref_id, sheet, name), ranges(range_id, sheet, name), a null sheet being the whole workbook -> (ref_id, range_id):
    names ignore case, a range of the sheet beats one of the workbook, and the winner must be the only one."""
    low = lambda c: F.lower(c)
    g = ranges.groupBy(low("name").alias("name"), low("sheet").alias("sheet")).agg(F.count("*").alias("n"), F.min("range_id").alias("r"))
    own = g.filter("sheet is not null").select("name", "sheet", F.col("n").alias("n1"), F.col("r").alias("r1"))
    all_ = g.filter("sheet is null").select("name", F.col("n").alias("n2"), F.col("r").alias("r2"))
    j = refs.select("ref_id", low("name").alias("name"), low("sheet").alias("sheet")).join(own, ["name", "sheet"], "left").join(all_, "name", "left")
    found = F.when(F.col("n1") == 1, F.col("r1")).when(F.col("n1").isNull() & (F.col("n2") == 1), F.col("r2"))
    return j.select("ref_id", found.alias("range_id"))


def cell_mappings(cells: DataFrame, classes: DataFrame, tabs: DataFrame) -> DataFrame:
    """cells(cell_id, tab, field, formula), classes(cell_id, run, class) without empty classes, tabs(tab, role) -> a mapping
    per classified cell and run: inputs of population tabs take their field, outputs with a formula their formula's id."""
    role = tabs.groupBy("tab").agg(F.min("role").alias("role"))
    j = classes.filter("class <> ''").join(cells, "cell_id").join(role, "tab", "left")
    takes = F.col("class").isin("I", "B") & (F.col("role") == "population")
    gives = F.col("class").isin("O", "B") & ~_blank("formula")
    return j.select("cell_id", "run", "class", F.when(takes, F.col("field")).alias("source_field"), F.when(gives, F.concat(F.lit("FORMULA-"), F.hex(F.encode(F.col("run").cast("string"), "UTF-8")), F.lit("-"), F.hex(F.encode(F.col("cell_id").cast("string"), "UTF-8")))).alias("formula_id"))


def select_tabs(sheets: DataFrame, policy: DataFrame, observed: DataFrame, support: tuple[str, ...] = ()) -> DataFrame:
    """sheets(sheet_id, name, hidden, content_hash, lineage, traits array), policy(position, pattern, role, required array,
    requirement), observed(sheet_id, field) -> (sheet_id, role, missing, unmet, status).

    Hidden sheets are out before names are compared. Sheets of one name (without regard to case and runs of spaces) must have
    one content and lineage: then the smallest sheet_id is admitted and the others are duplicates, else all are in collision.
    An admitted sheet takes the first rule by position whose pattern its name matches and whose requirement, if any, is among
    its traits; ``unmet`` counts matching rules whose requirement is not, ``missing`` the rule's fields that the sheet lacks.
    A sheet that no rule selects is a support tab if its exact name is in ``support``. A null hidden counts as visible.
    ``policy`` is a policy table: each pattern is tried on each admitted name."""
    out = F.coalesce("hidden", F.lit(False))
    s = sheets.withColumn("key", normalize_identity(F.coalesce("name", F.lit(""))))
    seen = s.filter(~out).groupBy("key").agg(F.count_distinct(F.struct("content_hash", "lineage")).alias("contents"), F.min("sheet_id").alias("first"))
    s = s.join(seen, "key", "left")
    state = F.when(out, "hidden").when(F.col("contents") > 1, "collision").when(F.col("sheet_id") != F.col("first"), "duplicate")
    s = s.withColumn("state", state)
    m = s.filter("state is null").join(policy_table(policy), tab_matches(F.col("name"), F.col("pattern")), "left")
    fits = F.col("requirement").isNull() | F.array_contains(F.transform(F.coalesce("traits", F.array()), normalize_identity), normalize_identity(F.col("requirement")))
    hit, fits = F.col("pattern").isNotNull(), F.coalesce(fits, F.lit(False))
    m = m.groupBy("sheet_id").agg(F.min_by(F.struct("role", "required"), F.when(hit & fits, F.struct("position", "pattern"))).alias("rule"), F.count_if(hit & ~fits).alias("unmet"))
    need = m.select("sheet_id", F.explode("rule.required").alias("f")).select("sheet_id", normalize_identity(F.col("f")).alias("f"))
    lacks = need.join(observed.select("sheet_id", normalize_identity(F.col("field")).alias("f")).distinct(), ["sheet_id", "f"], "left_anti").groupBy("sheet_id").agg(F.count("*").alias("missing"))
    j = s.select("sheet_id", "name", "state").join(m, "sheet_id", "left").join(lacks, "sheet_id", "left").fillna(0, ["missing", "unmet"])
    picked = F.col("rule").isNotNull() & (F.col("missing") == 0)
    kept = F.coalesce(F.col("name").isin(*support), F.lit(False)) if support else F.lit(False)
    status = F.coalesce("state", F.when(picked, "selected").when(kept, "support").when(F.col("missing") > 0, "incomplete").when(F.col("unmet") > 0, "requirement").otherwise("unmatched"))
    role = F.when(F.col("state").isNull(), F.when(picked | ~kept, F.col("rule.role")).otherwise("support"))
    return j.select("sheet_id", role.alias("role"), "missing", "unmet", status.alias("status"))


def resolve_dependencies(refs: DataFrame, cells: DataFrame) -> DataFrame:
    """refs(cell_id, sheet, address), cells(cell_id, sheet, address) -> (cell_id, on_cell, issue), each once: the cell that a
    reference names by sheet and address without dollar signs, in any case; external, malformed and unknown ones are
    issues. Ranges go through ``tables.cells_in_range``, names through ``resolve_named_ranges``."""
    at = lambda c: F.upper(F.replace(F.col(c), F.lit("$"), F.lit("")))
    known = cells.select(F.col("cell_id").alias("on_cell"), F.upper("sheet").alias("s"), at("address").alias("a"))
    j = refs.withColumns({"s": F.upper("sheet"), "a": at("address")}).join(known, ["s", "a"], "left")
    issue = F.when(F.contains("sheet", F.lit("[")), "EXTERNAL").when(cell_coords(F.col("address")).isNull(), "MALFORMED").when(F.col("on_cell").isNull(), "UNKNOWN")
    return j.select("cell_id", F.when(issue.isNull(), F.col("on_cell")).alias("on_cell"), issue.alias("issue")).distinct()


def validate_spec(formulas: DataFrame, mappings: DataFrame) -> DataFrame:
    """formulas(formula_id, text, depth), mappings(mapping_id, run, cell, class, source_field, formula_id) -> (subject,
    issue): repeated formula ids, formulas not mapped exactly once, mappings of an unknown formula, of a class that
    contradicts its source or formula, repeated cells of a run, and warnings on long and deep formulas."""
    again = formulas.groupBy("formula_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("formula_id").cast("string").alias("subject"), F.lit("DUPLICATE_FORMULA").alias("issue"))
    used = mappings.filter("formula_id is not null").groupBy("formula_id").agg(F.count("*").alias("uses"))
    f = formulas.join(used, "formula_id", "left")
    uses = F.coalesce("uses", F.lit(0))
    of = _issues(f, "formula_id", not_mapped=uses == 0, mapped_again=uses > 1, long_formula=F.length("text") > 1000, deep_formula=F.col("depth") > 10)
    known = formulas.select("formula_id", F.lit(True).alias("known")).distinct()
    m = mappings.join(known, "formula_id", "left")
    has, src = F.col("formula_id").isNotNull(), F.col("source_field").isNotNull()
    mm = _issues(m, "mapping_id", unknown_formula=has & F.col("known").isNull(), class_without_source=(F.col("class") == "I") & ~src, class_without_formula=(F.col("class") == "O") & ~has, input_with_formula=(F.col("class") == "I") & has, output_with_source=(F.col("class") == "O") & src)
    twice = mappings.groupBy("run", "cell").agg(F.count("*").alias("n")).filter("n > 1").select(F.concat_ws("/", "run", "cell").alias("subject"), F.lit("DUPLICATE_CELL").alias("issue"))
    return _union([again, of, mm, twice])


def formula_text_audit(formulas: DataFrame) -> DataFrame:
    """formulas(formula_id, text) -> (formula_id, name, issue): functions that may not be used, change by themselves or
    reach outside, and texts over the longest length (name null). Texts in quotes are no functions."""
    plain = F.regexp_replace("text", '"[^"]*"', '""')
    names = F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"([A-Za-z][A-Za-z0-9.]*)\s*\("), F.lit(1)), F.upper))
    d = formulas.select("formula_id", "text", F.explode_outer(names).alias("name"))
    issue = F.when(F.col("name").isin(*ACTIVE), "ACTIVE").when(F.col("name").isin(*VOLATILE), "VOLATILE").when(~F.col("name").isin(*FUNCTIONS), "NOT_ALLOWED")
    long = formulas.filter(F.length("text") > LONGEST_FORMULA).select("formula_id", F.lit(None).cast("string").alias("name"), F.lit("TOO_LONG").alias("issue"))
    return d.select("formula_id", "name", issue.alias("issue")).filter("issue is not null").unionByName(long)


def validate_oracle(oracles: DataFrame, results: DataFrame) -> DataFrame:
    """oracles(oracle_id, type, tool, executed_at, version, population_hash, spec_hash, reliability), results(oracle_id,
    result_id, formula_id, cell, type, precision) -> (subject, issue)."""
    sha = lambda c: ~F.coalesce(F.length(c) == 64, F.lit(False))
    among = lambda c, v: ~F.coalesce(F.col(c).isin(*v), F.lit(False))
    o = _issues(oracles, "oracle_id", oracle_id=_blank("oracle_id"), type=among("type", ORACLES), tool=(F.col("type") == "external-execution") & F.col("tool").isNull(), executed_at=F.try_to_timestamp("executed_at").isNull(), version=_blank("version"), population_hash=sha("population_hash"), spec_hash=sha("spec_hash"), reliability=among("reliability", RELIABILITY))
    return o.unionByName(_issues(results, "result_id", formula_id=_blank("formula_id"), cell=_blank("cell"), result_type=among("type", RESULT_TYPES), precision=F.coalesce(F.col("precision") < 0, F.lit(False))))


def validate_tolerance(profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """profiles(profile_id, absolute, relative, rounding), overrides(profile_id, cell, absolute) -> (subject, issue)."""
    p = _issues(profiles, "profile_id", absolute=~F.coalesce(F.col("absolute") >= 0, F.lit(False)), relative=~F.coalesce(F.col("relative") >= 0, F.lit(False)), rounding=~F.coalesce(F.col("rounding").isin(*ROUNDING), F.lit(False)))
    return p.unionByName(_issues(overrides.withColumn("at", F.concat_ws("/", "profile_id", "cell")), "at", override=~F.coalesce(F.col("absolute") >= 0, F.lit(False))))


def oracle_reliability(oracles: DataFrame, results: DataFrame) -> DataFrame:
    """oracles(oracle_id, type, tool, reliability, evidence), results(oracle_id) -> (oracle_id, confidence, concerns,
    reliable)."""
    n = results.groupBy("oracle_id").agg(F.count("*").alias("n"))
    unknown, provisional = F.col("reliability") == "unknown", F.col("reliability") == "provisional"
    no_tool, no_evidence, empty = (F.col("type") == "external-execution") & F.col("tool").isNull(), F.col("evidence").isNull(), F.col("n").isNull()
    low, medium = unknown | no_tool | empty, provisional | no_evidence
    concerns = sum((F.coalesce(c, F.lit(False)).cast("long") for c in (unknown, provisional, no_tool, no_evidence, empty)), F.lit(0).cast("long"))
    confidence = F.when(low, "low").when(medium, "medium").otherwise("high")
    return oracles.join(n, "oracle_id", "left").select("oracle_id", confidence.alias("confidence"), concerns.alias("concerns"), (confidence != "low").alias("reliable"))


def parse_oracle_results(lines: DataFrame) -> DataFrame:
    """lines(file, line, text) -> (file, line, formula_id, cell, value): JSON objects one a line, or one object with a list
    ``calculations``. Comment lines, what is no JSON, and results without both ids are left out."""
    v = lines.filter(~F.startswith(F.trim("text"), F.lit("#"))).withColumn("v", F.try_parse_json("text")).filter("v is not null")
    one = v.select("file", "line", F.expr("coalesce(try_variant_get(v, '$.calculations', 'array<variant>'), array(v))").alias("r"))
    get = lambda k: F.try_variant_get("x", f"$.{k}", "string")
    out = one.select("file", "line", F.explode("r").alias("x")).select("file", "line", get("formulaId").alias("formula_id"), get("cellAddress").alias("cell"), get("value").alias("value"))
    return out.filter("formula_id <> '' and cell <> ''")


def priority_issues(rules: DataFrame) -> DataFrame:
    """rules(group, position, rule_id, priority) -> rules whose priority is not above that of the rule before."""
    before = F.lag("priority").over(Window.partitionBy("group").orderBy("position"))
    return rules.withColumn("b", before).filter("priority is null or priority <= b").select("group", "rule_id")
