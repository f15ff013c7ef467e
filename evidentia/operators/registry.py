"""Names and ranges, reference indexes and weighted matches, promoted facts, provisions, population and package checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cell_coords, coverage_score, numeric_similarity, parse_evidence_date
from .tables import policy

#: What shared fields, runs and tabs, and like numbers of cells and formulas weigh, and the highest score.
WEIGHTS, CELLS, FORMULAS, HIGHEST = {"field": 6500.0, "run": 1500.0, "tab": 1000.0}, 700.0, 300.0, 10_000
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}"


def normalize_identity(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normalize_label(text: Column, most: int = 80) -> Column:
    """Upper case with single spaces; null where it is empty or longer than ``most`` (80 of a label, 40 of a run)."""
    up = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(F.length(up).between(1, most), up)


def normalize_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def cell_range(text: Column) -> Column:
    """struct(c1, r1, c2, r2) of an A1 range or a single cell, its corners in order; null where one is no cell."""
    ends = F.split(text, ":")
    a, b = cell_coords(ends[0]), cell_coords(F.coalesce(F.get(ends, 1), ends[0]))
    ok = (F.size(ends) <= 2) & a.isNotNull() & b.isNotNull()
    return F.when(ok, F.struct(F.least(a["col"], b["col"]).alias("c1"), F.least(a["row"], b["row"]).alias("r1"), F.greatest(a["col"], b["col"]).alias("c2"), F.greatest(a["row"], b["row"]).alias("r2")))


def events_of(events: DataFrame, **wanted) -> DataFrame:
    """Events whose columns equal the wanted values, numbered from the newest; ties by event_id."""
    out = events
    for name, value in wanted.items():
        out = out.filter(F.col(name) == value)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*wanted).orderBy(F.desc("at"), F.desc("event_id"))))


def approval_status(approvals: DataFrame) -> DataFrame:
    """approvals(subject, position, status) -> the status of the first entry of each subject, as stored."""
    return approvals.groupBy("subject").agg(F.min_by("status", "position").alias("status"))


def missing_paths(edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """edges(case_id, from_type, to_type) -> the consecutive pairs of ``types`` that no edge of a case connects."""
    pairs = F.array(*(F.struct(F.lit(a).alias("from_type"), F.lit(b).alias("to_type")) for a, b in zip(types, types[1:], strict=False)))
    need = edges.select("case_id").distinct().select("case_id", F.inline(pairs))
    return need.join(edges, ["case_id", "from_type", "to_type"], "left_anti")


def reference_index(cells: DataFrame) -> DataFrame:
    """cells(summary_id, tab, run, field, class, formula) -> per summary its distinct tabs, runs and fields, its cells and
    formulas, and its cells by class."""
    n = lambda c: F.count_if(F.coalesce(F.col("class") == c, F.lit(False))).alias(f"class_{c.lower()}")
    other = F.count_if(~F.coalesce(F.col("class").isin("I", "O", "B", "N", "C"), F.lit(False))).alias("class_other")
    g = cells.groupBy("summary_id").agg(*(F.count_distinct(c).alias(f"{c}s") for c in ("tab", "run", "field")), F.count("*").alias("cells"), F.count("formula").alias("formulas"), *(n(c) for c in "IOBNC"), other)
    return g


def weighted_matches(profile: DataFrame, refs: DataFrame, profile_sizes: DataFrame, ref_sizes: DataFrame, k: int = 5) -> DataFrame:
    """profile(doc_id, kind, item), refs(ref_id, kind, item), sizes (id, cells, formulas), those of references with a
    file_name -> the ``k`` best references of each document of ``profile_sizes``, also such as share nothing with it: the share
    of its fields, runs and tabs that a reference has, weighted, and how near the numbers of cells and formulas are. Ties by
    more shared fields, runs, tabs, then fewer cells, the file name, the id. A null number is near to none.

    References that share an item come by a join on items. Of those that share none only the ``k`` nearest in size can be
    among the best, since a sharing one is never behind another of the same nearness: they are found once for each distinct
    pair of sizes, ``ref_sizes`` being a policy table."""
    p, r = profile.distinct(), refs.distinct()
    shared = [f"m_{x}" for x in WEIGHTS]
    total = p.groupBy("doc_id").agg(*(F.count_if(F.col("kind") == x).alias(f"n_{x}") for x in WEIGHTS))
    m = p.join(r, ["kind", "item"]).groupBy("doc_id", "ref_id").agg(*(F.count_if(F.col("kind") == x).alias(f"m_{x}") for x in WEIGHTS))
    docs = profile_sizes.select("doc_id", F.col("cells").alias("pc"), F.col("formulas").alias("pf"))
    none = F.lit(0).cast("long")
    near = F.coalesce(numeric_similarity(F.col("pc"), F.col("cells"), CELLS), none) + F.coalesce(numeric_similarity(F.col("pf"), F.col("formulas"), FORMULAS), none)
    last = ["cells", "file_name", "ref_id"]
    sized = docs.select("pc", "pf").distinct().crossJoin(policy(ref_sizes)).withColumn("near", near)
    sized = sized.withColumn("r", F.row_number().over(Window.partitionBy("pc", "pf").orderBy(F.desc("near"), *last))).filter(F.col("r") <= k)
    sized = sized.select(F.col("pc").alias("qc"), F.col("pf").alias("qf"), "ref_id")
    alike = docs.join(sized, F.col("pc").eqNullSafe(F.col("qc")) & F.col("pf").eqNullSafe(F.col("qf"))).select("doc_id", "ref_id", *(none.alias(c) for c in shared))
    m = m.unionByName(alike).groupBy("doc_id", "ref_id").agg(*(F.max(c).alias(c) for c in shared))
    m = m.join(docs, "doc_id").join(ref_sizes, "ref_id").join(total, "doc_id", "left")
    parts = [coverage_score(F.col(f"m_{x}"), F.coalesce(f"n_{x}", none), w) for x, w in WEIGHTS.items()]
    score = F.least(F.lit(HIGHEST).cast("long"), sum(parts, near))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), *(F.desc(c) for c in shared), *last))
    return m.withColumn("score", score).withColumn("rank", rank).filter(F.col("rank") <= k).select("doc_id", "rank", "ref_id", "score")


def promoted_fact_issues(facts: DataFrame, decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """facts(fact_id, proposal_id, position, pointer, target, citations array), decisions(proposal_id, position, status),
    evidence(sha256) -> (fact_id, issue): facts of proposals that are not approved, whose pointer is not their place, that
    cite nothing or what is not there, or whose target another fact has too."""
    last = decisions.groupBy("proposal_id").agg(F.max_by("status", "position").alias("status"))
    known = evidence.select("sha256").distinct()
    cited = facts.select("fact_id", F.explode("citations").alias("sha256")).join(known, "sha256", "left_anti").groupBy("fact_id").agg(F.count("*").alias("unknown"))
    same = facts.groupBy("target").agg(F.count("*").alias("same"))
    j = facts.join(last, "proposal_id", "left").join(cited, "fact_id", "left").join(same, "target", "left")
    issues = F.array(
        F.when(~F.coalesce(F.col("status") == "approved", F.lit(False)), "NOT_APPROVED"),
        F.when(~F.col("pointer").eqNullSafe(F.concat(F.lit("/facts/"), F.col("position").cast("string"))), "POINTER"),
        F.when(F.coalesce(F.size("citations"), F.lit(0)) < 1, "NO_CITATION"),
        F.when(F.col("unknown") > 0, "UNKNOWN_CITATION"),
        F.when(F.col("same") > 1, "TARGET"),
    )
    return j.select("fact_id", F.explode(F.array_compact(issues)).alias("issue"))


def extract_provisions(segments: DataFrame) -> DataFrame:
    """segments(segment_id, text, inferred) -> (segment_id, effective, convention, adopted): the date after "effective" and
    after "adopted" where there is exactly one possible one; several make it ambiguous (no date), none takes the date
    inferred from elsewhere."""
    def dates(label: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(rf"(?i)\b{label}\w*(?: date)?(?: on| as of|:)? ({_DATE})"), F.lit(1))
        return F.array_distinct(F.array_compact(F.transform(found, parse_evidence_date)))

    s = segments.withColumns({"_e": dates("effective"), "_a": dates("adopted")})
    one = lambda c: F.when(F.size(c) == 1, F.get(F.col(c), 0))
    convention = F.when(F.size("_e") == 1, "explicit").when(F.size("_e") > 1, "ambiguous").when(F.col("inferred").isNotNull(), "inferred-from-context").otherwise("unknown")
    return s.select("segment_id", F.when(F.size("_e") == 0, F.col("inferred")).otherwise(one("_e")).alias("effective"), convention.alias("convention"), one("_a").alias("adopted"))


def population_evidence_issues(evidence: DataFrame, manifest: DataFrame) -> DataFrame:
    """evidence(key, artifact_id, sha256, content), manifest(artifact_id, sha256) -> (key, issue): keys that come again,
    artifacts that the manifest has not exactly once, hashes that differ from its, and contents that no longer hash so."""
    m = manifest.groupBy("artifact_id").agg(F.count("*").alias("n"), F.min("sha256").alias("listed"))
    again = evidence.groupBy("key").agg(F.count("*").alias("times"))
    j = evidence.join(m, "artifact_id", "left").join(again, "key", "left")
    issues = F.array(
        F.when(F.col("times") > 1, "DUPLICATE_KEY"),
        F.when(F.coalesce("n", F.lit(0)) != 1, "NOT_IN_MANIFEST"),
        F.when((F.col("n") == 1) & (F.col("listed") != F.col("sha256")), "OTHER_HASH"),
        F.when(F.sha2("content", 256) != F.col("sha256"), "STALE"),
    )
    return j.select("key", F.explode(F.array_compact(issues)).alias("issue")).distinct()


def acquisition_issues(requests: DataFrame, packages: DataFrame, proposals: DataFrame) -> DataFrame:
    """requests(request_id, hash), packages(package_id, request_id, request_hash, hash, transmit), proposals(proposal_id,
    package_id, package_hash, status) -> (subject, issue): links that do not bind by hash, packages to be transmitted, a
    request with several packages, and proposals that are not approved."""
    r = requests.select("request_id", F.col("hash").alias("rh"))
    p = packages.join(r, "request_id", "left").join(packages.groupBy("request_id").agg(F.count("*").alias("n")), "request_id", "left")
    a = F.array(F.when(~F.col("request_hash").eqNullSafe(F.col("rh")) | F.col("rh").isNull(), "REQUEST_LINK"), F.when(F.coalesce("transmit", F.lit(True)), "TRANSMISSION"), F.when(F.col("n") > 1, "DUPLICATE_REGISTRATION"))
    out = p.select(F.col("package_id").alias("subject"), F.explode(F.array_compact(a)).alias("issue"))
    q = proposals.join(packages.select("package_id", F.col("hash").alias("ph")), "package_id", "left")
    b = F.array(F.when(~F.col("package_hash").eqNullSafe(F.col("ph")) | F.col("ph").isNull(), "PACKAGE_LINK"), F.when(~F.coalesce(F.col("status") == "approved", F.lit(False)), "NOT_APPROVED"))
    return out.unionByName(q.select(F.col("proposal_id").alias("subject"), F.explode(F.array_compact(b)).alias("issue")))
