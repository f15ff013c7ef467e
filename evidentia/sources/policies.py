"""Policy files as typed rules. A policy is one document, so all its checks happen within its row: nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONDITION = "struct<dimension: string, operator: string, source: string, value: variant>"
#: For each kind of policy the name of its list and the form of its rules, fields in order of their names.
KINDS = {
    "scenario-selection": (
        "scenarios",
        f"struct<defaultEffectiveDateRange: struct<endDate: string, startDate: string>, exclusionConditions: array<{_CONDITION}>, id: string, label: string, triggerConditions: array<{_CONDITION}>>",
    ),
    "tab-selection": ("rules", "struct<description: string, populationRequirement: string, requiredFields: array<string>, tabPattern: string>"),
    "iob-classification": ("rules", "struct<fieldPattern: string, iob: string, justification: string, priority: bigint, runPattern: string>"),
    "field-name-glossary": ("entries", "struct<description: string, genericField: string, tabContext: string, workbookPattern: string>"),
}
#: What conditions and classes may hold.
OPERATORS = ("equals", "contains", "greater-than", "less-than", "present", "absent")
SOURCES = ("plan-rule", "population", "case-control")
CLASSES = ("I", "O", "B", "N", "P")
SAFE = (1 << 53) - 1  # the largest whole number that a double holds together with all below it


def _get(v: Column, path: str, form: str) -> Column:
    return F.try_variant_get(v, path, form)


def _fields(v: Column) -> Column:
    """The fields of an object; null for all else."""
    return _get(v, "$", "map<string, variant>")


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _filled(v: Column) -> Column:
    """A text that is more than space."""
    return (_type(v) == "STRING") & F.coalesce(_get(v, "$", "string").rlike(r"[^\s\p{Z}\x{FEFF}]"), F.lit(False))


def _text(m: Column, *names: str) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & _filled(m[n])
    return ok


def _maybe_text(v: Column) -> Column:
    return _filled(v) | (_type(v) == "VOID")


def _one_of(m: Column, name: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(_get(m[name], "$", "string").isin(*values), F.lit(False)) & _text(m, name)


def _keys(m: Column, needed: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """Exactly these fields: none missing, no other."""
    names = F.map_keys(m)
    lit = lambda x: F.array(*(F.lit(n) for n in x))
    return F.coalesce((F.size(F.array_except(names, lit(needed + optional))) == 0) & (F.size(F.array_except(lit(needed), names)) == 0), F.lit(False))


def _each(v: Column, ok: Callable[[Column], Column]) -> Column:
    """Whether ``v`` is an array whose every member is ``ok``."""
    return F.coalesce(F.forall(_get(v, "$", "array<variant>"), ok), F.lit(False))


def _day(v: Column) -> Column:
    s = _get(v, "$", "string")
    return _filled(v) & F.coalesce(s.rlike(r"^\d{4}-\d{2}-\d{2}\z") & s.try_cast("date").isNotNull(), F.lit(False))


def _condition(v: Column) -> Column:
    m = _fields(v)
    plain = _type(m["value"]).rlike("^(STRING|BOOLEAN|BIGINT|DOUBLE|DECIMAL.*)$")
    return _keys(m, ("dimension", "operator", "value", "source")) & _text(m, "dimension") & _one_of(m, "operator", OPERATORS) & _one_of(m, "source", SOURCES) & plain


def _scenario(v: Column) -> Column:
    m = _fields(v)
    span, triggers = _fields(m["defaultEffectiveDateRange"]), m["triggerConditions"]
    some = F.coalesce(F.size(_get(triggers, "$", "array<variant>")) > 0, F.lit(False))
    days = _keys(span, ("startDate", "endDate")) & _day(span["startDate"]) & ((_type(span["endDate"]) == "VOID") | _day(span["endDate"]))
    keys = _keys(m, ("id", "label", "triggerConditions", "exclusionConditions", "defaultEffectiveDateRange"))
    return keys & _text(m, "id", "label") & days & some & _each(triggers, _condition) & _each(m["exclusionConditions"], _condition)


def _tab(v: Column) -> Column:
    m = _fields(v)
    keys = _keys(m, ("tabPattern", "requiredFields", "populationRequirement", "description"))
    return keys & _text(m, "tabPattern", "description") & _maybe_text(m["populationRequirement"]) & _each(m["requiredFields"], _filled)


def _iob(v: Column) -> Column:
    m = _fields(v)
    whole = (_type(m["priority"]) == "BIGINT") & F.coalesce(_get(m["priority"], "$", "bigint").between(-SAFE, SAFE), F.lit(False))
    return _keys(m, ("fieldPattern", "runPattern", "iob", "priority", "justification")) & _text(m, "fieldPattern", "runPattern", "justification") & _one_of(m, "iob", CLASSES) & whole


def _entry(v: Column) -> Column:
    m = _fields(v)
    keys = _keys(m, ("workbookPattern", "genericField", "description"), ("tabContext",))
    return keys & _text(m, "workbookPattern", "genericField", "description") & (~F.map_contains_key(m, "tabContext") | _maybe_text(m["tabContext"]))


_RULE = {"scenario-selection": _scenario, "tab-selection": _tab, "iob-classification": _iob, "field-name-glossary": _entry}


def policies(texts: DataFrame, kind: str) -> DataFrame:
    """texts(file, text), JSON documents -> one row a file: (file, version, review_status, rules, policy_sha256,
    source_sha256, issue, place).

    The first fault ends a policy: it has no rules then, but an ``issue``, PARSE for what is no JSON (a key twice, null
    and empty texts included) or VALIDATION, and the ``place`` of it: root, version, the list, governance, or the first
    bad rule by its place from 0. A file may only say that it is provisional; approval is a decision kept elsewhere.
    ``policy_sha256`` hashes the list of rules as compact JSON with fields in order of name, so that neither space nor
    order of fields nor an optional field left out changes it. A whole number written with a point is refused as a
    priority.
    """
    name, form = KINDS[kind]
    v = F.col("v")
    root, listed = _fields(v), _get(v, f"$.{name}", "array<variant>")
    ruled = _fields(_get(v, "$.governance", "variant"))
    bad = F.array_position(F.transform(listed, lambda x: F.coalesce(_RULE[kind](x), F.lit(False))), F.lit(False))
    version, status = _get(v, "$.version", "string"), _get(v, "$.governance.reviewStatus", "string")
    fine = F.coalesce(_text(root, "version") & version.rlike(r"^\d+\.\d+\.\d+\z"), F.lit(False))
    place = (
        F.when(v.isNull() | ~_keys(root, ("version", "governance", name)), "root").when(~fine, "version").when(listed.isNull() | (F.size(listed) == 0), name)
        .when(~_keys(ruled, ("reviewStatus",)) | ~F.coalesce(status == "provisional", F.lit(False)), "governance").when(bad > 0, F.concat(F.lit(f"{name}["), (bad - 1).cast("string"), F.lit("]")))
    )
    told = texts.select("file", F.coalesce("text", F.lit("")).alias("text"), F.try_parse_json("text").alias("v"))
    told = told.select("file", version.alias("version"), status.alias("review_status"), _get(v, f"$.{name}", f"array<{form}>").alias("rules"), F.sha2("text", 256).alias("source_sha256"), place.alias("place"), v.isNull().alias("broken"))
    good = F.col("place").isNull()
    digest = F.sha2(F.to_json("rules", {"ignoreNullFields": "false"}), 256)
    issue = F.when(F.col("broken"), "PARSE").when(~good, "VALIDATION")
    return told.select("file", *(F.when(good, F.col(c)).alias(c) for c in ("version", "review_status", "rules")), F.when(good, digest).alias("policy_sha256"), "source_sha256", issue.alias("issue"), "place")


def policy_rules(loaded: DataFrame) -> DataFrame:
    """One row a rule: (file, version, policy_sha256, position from 0, and the fields of the rule). Files with an issue have none."""
    rows = loaded.filter("issue is null").select("file", "version", "policy_sha256", F.posexplode("rules").alias("position", "rule"))
    return rows.select("file", "version", "policy_sha256", "position", "rule.*")


def load_policy_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The policies of a folder, ``<kind>.json`` each (or a folder of that name with many), by kind, as :func:`policies` gives
    them. A kind without a file is one row with the issue NOT_FOUND."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    out = {}
    for kind in KINDS:
        own = policies(files.filter(F.col("file").rlike(rf"/{kind}(\.json|/[^/]*)\z")), kind)
        none = own.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(kind).alias("file"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in own.schema.fields[1:-2]), F.lit("NOT_FOUND").alias("issue"), F.lit(None).cast("string").alias("place"))
        out[kind] = own.unionByName(none)
    return out
