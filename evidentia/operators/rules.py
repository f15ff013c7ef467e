"""Effective-dated rules: as-of queries, overlaps, chains, thresholds, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_ascii_text, token_shingles
from .tables import policy


def rules_effective_on(rules: DataFrame, day: Column) -> DataFrame:
    """Half-open periods [start_date, end_date); null end is open."""
    return rules.filter((F.col("start_date") <= day) & (F.col("end_date").isNull() | (F.col("end_date") > day)))


def rules_applicable_to(rules: DataFrame, wanted: str) -> DataFrame:
    a = F.lower("applicability")
    return rules.filter(F.contains(a, F.lit(wanted.lower())) | F.contains(F.lit(wanted.lower()), a))


def query_rules(rules: DataFrame, day: Column | None = None, wanted: str | None = None, status: str | None = None) -> DataFrame:
    out = rules if day is None else rules_effective_on(rules, day)
    out = out if wanted is None else rules_applicable_to(out, wanted)
    if status == "superseded":
        out = out.filter("end_date is not null")
    elif status == "current":
        out = out.filter("end_date is null")
    return out


def chained_periods(rules: DataFrame) -> DataFrame:
    """Ends each rule where the next of its scope starts: end = min(own end, next start)."""
    by = Window.partitionBy("scope").orderBy("start_date", "rule_id")
    return rules.withColumn("end_date", F.least("end_date", F.lead("start_date").over(by)))


def effective_rule_asof(rules: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(query_id, scope, day) -> (query_id, rule_id), null where no rule of the scope holds that day. Periods end
    where the next rule starts, so the last rule to start until a day is the only one that can hold: rules and queries
    lie in one order of scope and day, and each query looks back once."""
    r = rules.filter("start_date is not null").select("scope", F.col("start_date").alias("day"), F.struct("rule_id", "end_date").alias("rule"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.lit(0).alias("asks"))
    q = queries.select("scope", "day", F.lit(None).cast(r.schema["rule"].dataType).alias("rule"), "query_id", F.lit(1).alias("asks"))
    by = Window.partitionBy("scope").orderBy("day", "asks", "rule.rule_id").rowsBetween(Window.unboundedPreceding, 0)
    last = r.unionByName(q).withColumn("last", F.last("rule", ignorenulls=True).over(by)).filter("asks = 1")
    holds = F.col("last.end_date").isNull() | (F.col("day") < F.col("last.end_date"))
    return last.groupBy("query_id").agg(F.max(F.when(holds & F.col("scope").isNotNull() & F.col("day").isNotNull(), F.col("last.rule_id"))).alias("rule_id"))


def latest_rule_at(rules: DataFrame, day: Column) -> DataFrame:
    return rules_effective_on(rules, day).groupBy("scope").agg(F.max_by("rule_id", F.struct("start_date", "rule_id")).alias("rule_id"))


def conflicting_rules(rules: DataFrame) -> DataFrame:
    """Pairs of one scope with different text whose closed periods overlap."""
    a = rules.select(*(F.col(c).alias(f"{c}_a") for c in ("scope", "rule_id", "start_date", "end_date", "text")))
    b = rules.select(*(F.col(c).alias(f"{c}_b") for c in ("scope", "rule_id", "start_date", "end_date", "text")))
    on = (F.col("scope_a") == F.col("scope_b")) & (F.col("rule_id_a") < F.col("rule_id_b")) & (F.col("text_a") != F.col("text_b"))
    on = on & (F.col("end_date_a").isNull() | (F.col("start_date_b") <= F.col("end_date_a"))) & (F.col("end_date_b").isNull() | (F.col("start_date_a") <= F.col("end_date_b")))
    return a.join(b, on).select(F.col("scope_a").alias("scope"), "rule_id_a", "rule_id_b")


def chain_overlaps(rules: DataFrame) -> DataFrame:
    """Rules whose own end lies after the start of the next rule of the scope, or is open before one."""
    nxt = F.lead("start_date").over(Window.partitionBy("scope").orderBy("start_date", "rule_id"))
    return rules.withColumn("next_start", nxt).filter("next_start is not null and (end_date is null or end_date > next_start)").select("scope", "rule_id")


def derive_date_range(rules: DataFrame) -> DataFrame:
    """Per scenario the latest start and earliest end; null where they do not meet."""
    r = rules.groupBy("scenario").agg(F.max("start_date").alias("s"), F.min("end_date").alias("e"))
    ok = F.col("e").isNull() | (F.col("s") <= F.col("e"))
    return r.select("scenario", F.when(ok, F.col("s")).alias("start_date"), F.when(ok, F.col("e")).alias("end_date"))


def overlapping_applicability(rules: DataFrame) -> DataFrame:
    return rules.select("rule_id", F.explode(F.split("applicability", ",")).alias("c")).select("rule_id", F.trim("c").alias("class")).filter("class <> ''").groupBy("class").agg(F.count("*").alias("rules")).filter("rules > 1")


def supersession_chain_errors(links: DataFrame) -> DataFrame:
    """links(chain_id, ordinal, predecessor_id, rule_id, effective_date) -> (chain_id, errors): first link without
    predecessor, later ones naming the link before, dates strictly rising."""
    by = Window.partitionBy("chain_id").orderBy("ordinal")
    bad = F.when(F.row_number().over(by) == 1, F.col("predecessor_id").isNotNull()).otherwise(~F.col("predecessor_id").eqNullSafe(F.lag("rule_id").over(by)) | (F.col("effective_date") <= F.lag("effective_date").over(by)))
    return links.withColumn("bad", F.coalesce(bad, F.lit(True))).groupBy("chain_id").agg(F.count_if("bad").alias("errors")).filter("errors > 0")


def match_condition(actual: Column, operator: Column, value: Column) -> Column:
    n, v = actual.try_cast("double"), value.try_cast("double")
    return F.coalesce(
        F.when(operator == "equals", actual == value)
        .when(operator == "contains", F.contains(F.lower(actual), F.lower(value)))
        .when(operator == "greater-than", n > v)
        .when(operator == "less-than", n < v)
        .when(operator == "present", actual.isNotNull())
        .when(operator == "absent", actual == "absent"),
        F.lit(False),
    )


def threshold_evaluation(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """facts(case_id, percentage), rules(rule_id, operator, threshold, conclusion, priority) -> per case its governing
    rule (lowest priority number, then id), all matches, and the conclusion; blocked without a percentage.
    ``rules`` is a policy table, whose size is checked."""
    p, t = F.col("percentage"), F.col("threshold")
    hit = F.when(F.col("operator") == "less-than", p < t).when(F.col("operator") == "at-most", p <= t).when(F.col("operator") == "at-least", p >= t).otherwise(p == t)
    m = facts.join(policy(rules), hit, "left")
    order = F.struct("priority", "rule_id")
    out = m.groupBy("case_id").agg(F.min_by("conclusion", F.when(F.col("rule_id").isNotNull(), order)).alias("c"), F.count("rule_id").alias("matches"), F.max("percentage").alias("p"))
    return out.select("case_id", "matches", F.when(F.col("p").isNull(), "blocked").when(F.col("matches") == 0, "inconclusive").otherwise(F.col("c")).alias("conclusion"))


def adjacent_amendments(candidates: DataFrame, wording: str) -> DataFrame:
    """candidates(provision, position, candidate_id, text): each candidate with the wording, linked to the one row
    before it only. ``detect_supersession`` is the whole job."""
    by = Window.partitionBy("provision").orderBy("position")
    c = candidates.withColumn("prior", F.lag("candidate_id").over(by))
    return c.filter(F.col("prior").isNotNull() & F.lower("text").rlike(wording)).select("provision", F.col("prior").alias("from_id"), F.col("candidate_id").alias("to_id"), F.lit("amendment").alias("kind"))


#: Wording of an amendment, and the part of it that supersedes; ASCII word boundaries.
SUPERSEDING = "replac(?:e|es|ed|ement)|supersed(?:e|es|ed|ing)"
AMENDING = f"amend(?:ed|ment)?|restat(?:ed|ement)|{SUPERSEDING}"
#: Fixed value: candidates of one provision that meet in one block; more are split into blocks that meet in pairs.
BLOCK = 256


def detect_supersession(candidates: DataFrame, least: float = 0.72, wording: str = AMENDING) -> DataFrame:
    """candidates(provision, position, candidate_id, text) -> (provision, from_id, to_id, kind, similarity, confidence):
    every strictly earlier candidate of the provision, where the later text has amendment wording or the two are
    similar by ``least`` (Jaccard of ASCII word shingles, 6 places; without a word, equal). Null positions and null
    provisions link nothing. The candidates of a provision meet in pairs of blocks, so that no task takes all of a hot one.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    says = lambda words: low.rlike(f"(?<![a-z0-9_])(?:{words})(?![a-z0-9_])")
    plain = normalize_ascii_text(low)
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    shingles = F.when(F.size(words) < 3, F.array_distinct(words)).otherwise(token_shingles(plain))
    c = candidates.filter("provision is not null and position is not null")
    blocks = c.groupBy("provision").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    c = c.select("provision", "position", "candidate_id", shingles.alias("s"), says(wording).alias("amends"), says(SUPERSEDING).alias("supersedes"))
    c = c.join(blocks, "provision").withColumn("b", F.pmod(F.xxhash64("candidate_id"), "blocks"))
    # an ordered pair of blocks (i, j) holds the earlier candidate in i and the later one in j
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    p = c.select("provision", F.col("b").alias("i"), F.explode(every).alias("j"), F.col("position").alias("_from"), F.col("candidate_id").alias("from_id"), F.col("s").alias("x"))
    s = c.select("provision", F.explode(every).alias("i"), F.col("b").alias("j"), F.col("position").alias("_to"), F.col("candidate_id").alias("to_id"), F.col("s").alias("y"), "amends", "supersedes")
    both = F.size(F.array_intersect("x", "y"))
    similarity = F.when((F.size("x") == 0) & (F.size("y") == 0), 1.0).otherwise(F.round(both / (F.size("x") + F.size("y") - both), 6))
    m = p.join(s, ["provision", "i", "j"]).filter("_from < _to").withColumn("similarity", similarity).filter(F.col("amends") | (F.col("similarity") >= least))
    confidence = F.round(F.least(F.lit(0.99), F.col("similarity") * 0.7 + F.when(F.col("amends"), 0.25).otherwise(0.0)), 6)
    return m.select("provision", "from_id", "to_id", F.when(F.col("supersedes"), "supersession").otherwise("amendment").alias("kind"), "similarity", confidence.alias("confidence"))


def blocked_by_unresolved(rules: DataFrame, items: DataFrame) -> DataFrame:
    """rules(rule_id, scope), items(item_id, scope): open items whose scope is the rule's, an ancestor or a descendant.
    Scopes are exploded to their ancestors, so that both directions are equi-joins."""
    parts = lambda c: F.split(c, "/")
    up = lambda df, i: df.select(i, "scope", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts(F.col("scope")))), lambda n: F.array_join(F.slice(parts(F.col("scope")), 1, n), "/"))).alias("at"))
    a = up(rules, "rule_id").join(items.select("item_id", F.col("scope").alias("at")), "at").select("rule_id", "item_id")
    b = up(items, "item_id").join(rules.select("rule_id", F.col("scope").alias("at")), "at").select("rule_id", "item_id")
    return a.union(b).distinct().groupBy("rule_id").agg(F.count("*").alias("open_items"))
