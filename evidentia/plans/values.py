"""Registered queries of column functions, over values derived from the given tables in both engines alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import scalars as S
from .catalog import query

_RAW = """CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' WHEN 3 THEN '-' || o_orderkey WHEN 4 THEN '0' || o_orderkey WHEN 5 THEN '#n/a' WHEN 6 THEN 'Invalid' WHEN 7 THEN '0' WHEN 8 THEN '#NAME?' ELSE o_orderpriority END"""


def _raw():
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    out = F.col("o_orderpriority")
    for n, v in {1: F.lit(""), 2: F.lit(" "), 3: F.concat(F.lit("-"), text), 4: F.concat(F.lit("0"), text), 5: F.lit("#n/a"), 6: F.lit("Invalid"), 7: F.lit("0"), 8: F.lit("#NAME?")}.items():
        out = F.when(k % 10 == n, v).otherwise(out)
    return F.when(k % 10 != 0, out)


@query(rf"""WITH r AS (SELECT o_orderkey AS id, {_RAW} AS v FROM orders)
SELECT id, CASE WHEN id % 11 = 0 THEN 'missing' WHEN v IS NULL THEN 'null' WHEN v = '' THEN 'blank' WHEN regexp_matches(v, '^[=+@-]') THEN 'formula-text' WHEN regexp_matches(v, '^0[0-9]+$') THEN 'leading-zero-text'
WHEN lower(v) IN ('#n/a', '#value!', '#ref!', '#div/0!', 'invalid') THEN 'malformed' WHEN v = '0' THEN 'literal-zero' ELSE 'text' END AS kind, coalesce(v, '') AS shown FROM r""")
def raw_value_kinds(t):
    v = _raw()
    return t("orders").select(F.col("o_orderkey").alias("id"), C.raw_value_kind(v, F.col("o_orderkey") % 11 != 0).alias("kind"), S.primitive_display(v).alias("shown"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM conversations),
s AS (SELECT conv_id, turn, list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w)
SELECT conv_id, turn, len(s) AS n, list_min(s) AS lo, list_max(s) AS hi FROM s""")
def rule_shingles(t):
    s = C.rule_shingles(F.coalesce("text", F.lit("")))
    return t("conversations").select("conv_id", "turn", F.size(s).cast("long").alias("n"), F.array_min(s).alias("lo"), F.array_max(s).alias("hi"))


@query(r"""WITH p AS (SELECT unnest(['promo*', '*BRUSHED*', 'steel', 'a long economy anodized steel tab', 'st.*l']) AS p), v AS (SELECT p_partkey AS id, lower(p_type) AS v, lower(p) AS p FROM part, p)
SELECT id, p AS pattern, CASE WHEN contains(p, '*') THEN regexp_matches(v, '^' || replace(p, '*', '.*') || '$') ELSE contains(v, p) END AS tab,
CASE WHEN contains(p, '*') THEN regexp_matches(v, '^' || replace(replace(p, '.', '\.'), '*', '.*') || '$') ELSE contains(v, p) OR contains(p, v) END AS class FROM v""")
def wildcard_matches(t):
    names = F.array(*(F.lit(x) for x in ("promo*", "*brushed*", "steel", "a long economy anodized steel tab", "st.*l")))
    d = t("part").select(F.col("p_partkey").alias("id"), "p_type", F.explode(names).alias("pattern"))
    return d.select("id", "pattern", C.tab_matches(F.col("p_type"), F.col("pattern")).alias("tab"), C.class_matches(F.col("p_type"), F.col("pattern")).alias("class"))


_ROLES = ["executed-plan-document", "amendment", "collective-bargaining-agreement", "formal-determination", "approved-plan-summary", "certified-case-report", "supporting-administrative-report", "actuarial-report", "notice", "approved-historical-calculation-artifact", "inference", "regulation", "training-reference", "other", "none"]
_RANKS = "[0, 0, 0, 1, 2, 3, 4, 4, 4, 5, 6, 7, 7, 7, NULL]"


@query(f"""WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 15 + 1)::INT AS a, (o_custkey % 15 + 1)::INT AS b FROM orders), r AS (SELECT *, {_RANKS}[a] AS ra, {_RANKS}[b] AS rb FROM o)
SELECT id, {_ROLES}[a] AS role, ra AS rank, coalesce(ra, 14) < coalesce(rb, 14) AS outranks, a IN (12, 13, 14) AS needs_override FROM r""")
def authority_ranks(t):
    role = lambda c: F.element_at(F.array(*(F.lit(x) for x in _ROLES)), (F.col(c) % 15 + 1).cast("int"))
    a, b = role("o_orderkey"), role("o_custkey")
    return t("orders").select(F.col("o_orderkey").alias("id"), a.alias("role"), C.authority_rank(a).alias("rank"), C.outranks(a, b).alias("outranks"), C.requires_override(a).alias("needs_override"))


@query("""WITH v AS (SELECT p_partkey AS id, p_size % 4 AS a, p_size % 13 AS b, p_partkey % 11 AS c FROM part)
SELECT id, c <> 3 AS valid, CASE WHEN c <> 3 THEN (a + 1) || '.0.0' END AS major, CASE WHEN c <> 3 THEN a || '.' || (b + 1) || '.0' END AS minor, CASE WHEN c <> 3 THEN a || '.' || b || '.' || (c + 1) END AS patch FROM v""")
def next_versions(t):
    part = lambda c, n: (F.col(c) % n).cast("string")
    v = F.when(F.col("p_partkey") % 11 == 3, F.concat_ws(".", part("p_size", 4), part("p_size", 13))).otherwise(F.concat_ws(".", part("p_size", 4), part("p_size", 13), part("p_partkey", 11)))
    return t("part").select(F.col("p_partkey").alias("id"), C.valid_version(v).alias("valid"), *(C.next_version(v, k).alias(k) for k in ("major", "minor", "patch")))


@query("""WITH i AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || c_mktsegment WHEN 2 THEN c_mktsegment || '-' || c_name WHEN 3 THEN 'x' || c_nationkey || 'abc' ELSE 'C' || (c_custkey * 1000) END AS v FROM customer)
SELECT id, CASE WHEN v = '' THEN 'EMPTY' WHEN v <> trim(v) THEN 'PADDED' WHEN length(v) NOT BETWEEN 4 AND 12 THEN 'LENGTH' WHEN NOT regexp_matches(upper(v), '^[A-Z][0-9]+$') THEN 'SYNTAX' END AS error FROM i""")
def identifier_errors(t):
    k, s = F.col("c_custkey"), lambda c: F.col(c).cast("string")
    v = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit(" "), "c_mktsegment")).when(k % 5 == 2, F.concat_ws("-", "c_mktsegment", "c_name")).when(k % 5 == 3, F.concat(F.lit("x"), s("c_nationkey"), F.lit("abc"))).otherwise(F.concat(F.lit("C"), (k * 1000).cast("string")))
    return t("customer").select(k.alias("id"), C.identifier_error(v, 4, 12, "^[A-Z][0-9]+$").alias("error"))


@query(r"""WITH d AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations),
k AS (SELECT *, CASE WHEN regexp_matches(t, '\b(example|illustration|for instance)\b') THEN 'example' WHEN regexp_matches(t, '\bformula\b|=|\bmultiplied by\b|\btimes\b') THEN 'formula' ELSE 'provision' END AS kind,
turn % 2 = 0 AS named, CASE turn % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'unknown' ELSE 'inferred-from-context' END AS e, CASE WHEN conv_id % 2 = 0 THEN 'explicit' ELSE 'unknown' END AS a FROM d),
i AS (SELECT *, regexp_matches(t, '\bmay\b|\bat the discretion of\b')::INT + regexp_matches(t, '\bundefined term\b|\bnot defined\b')::INT + (kind = 'example')::INT AS issues FROM k)
SELECT conv_id, turn, kind, issues::BIGINT AS issues, greatest(0.0, least(1.0, round(0.6::DOUBLE + named::INT * 0.1::DOUBLE + (e = 'explicit')::INT * 0.1::DOUBLE + (a = 'explicit')::INT * 0.05::DOUBLE - (kind = 'example')::INT * 0.2::DOUBLE - issues * 0.1::DOUBLE, 2)))::DOUBLE AS confidence,
CASE WHEN e = 'inferred-from-context' THEN e WHEN e = 'explicit' OR a = 'explicit' THEN 'explicit' ELSE 'unknown' END AS convention FROM i""")
def provision_signs(t):
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    e = F.when(turn % 3 == 0, "explicit").when(turn % 3 == 1, "unknown").otherwise("inferred-from-context")
    a = F.when(F.col("conv_id") % 2 == 0, "explicit").otherwise("unknown")
    kind, n = C.provision_kind(text), F.size(C.provision_issues(text)).cast("long")
    return t("conversations").select("conv_id", "turn", kind.alias("kind"), n.alias("issues"), C.provision_confidence(kind, turn % 2 == 0, e, a, n).alias("confidence"), C.combined_convention(e, a).alias("convention"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'application/x-dosexec' WHEN 1 THEN 'application/x-elf' WHEN 2 THEN 'application/zip' WHEN 3 THEN 'application/pdf' END AS media FROM part""")
def signatures(t):
    k = F.col("p_partkey") % 5
    magic = F.when(k == 0, F.unhex(F.lit("4D5A90"))).when(k == 1, F.unhex(F.lit("7F454C46"))).when(k == 2, F.unhex(F.lit("504B0304"))).when(k == 3, F.unhex(F.lit("25504446"))).otherwise(F.unhex(F.lit("504B0506")))
    return t("part").select(F.col("p_partkey").alias("id"), C.detect_signature(F.concat(magic, F.encode("p_name", "UTF-8"))).alias("media"))


@query(r"""WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END || md5(o_orderkey::VARCHAR) AS h, CASE o_orderkey % 4 WHEN 0 THEN '01.5' WHEN 1 THEN '-12.25' WHEN 2 THEN '1.50' ELSE '0' END AS d FROM orders)
SELECT id, length(h) = 32 AS sha, d IN ('-12.25', '0') AS decimal, regexp_matches(u, '^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}$') AS uuid FROM (SELECT *, '01234567-89ab-5def-a123-456789abcdef' AS u FROM v)""")
def identity_checks(t):
    k = F.col("o_orderkey")
    h = F.concat(F.when(k % 3 == 0, "x").otherwise(""), F.repeat(F.md5(k.cast("string")), 2))
    d = F.when(k % 4 == 0, "01.5").when(k % 4 == 1, "-12.25").when(k % 4 == 2, "1.50").otherwise("0")
    return t("orders").select(k.alias("id"), S.is_sha256(h).alias("sha"), S.is_canonical_decimal(d).alias("decimal"), S.is_uuid(S.deterministic_uuid("order", k)).alias("uuid"))


@query("""WITH s AS (SELECT p_partkey AS id, lower(replace(p_brand || ':' || p_type, ' ', '-')) AS a, CASE p_partkey % 3 WHEN 0 THEN '*' WHEN 1 THEN lower(replace(p_brand, ' ', '-')) ELSE 'brand#11/x' END AS b FROM part), n AS (SELECT id, replace(a, ':', '/') AS a, b FROM s)
SELECT id, a AS scope, b = '*' OR a = b OR starts_with(a, b || '/') OR starts_with(b, a || '/') AS meets FROM n""")
def scopes_meet(t):
    p, k = t("part"), F.col("p_partkey")
    a = S.normalize_scope(F.concat(F.lit(" "), "p_brand", F.lit(":"), "p_type"))
    b = F.when(k % 3 == 0, "*").when(k % 3 == 1, S.normalize_scope(F.col("p_brand"))).otherwise("brand#11/x")
    return p.select(k.alias("id"), a.alias("scope"), S.scopes_intersect(a, b).alias("meets"))


@query(f"""WITH r AS (SELECT o_orderkey AS id, {_RAW} AS v FROM orders) SELECT id, CASE WHEN v IS NULL THEN 'text' WHEN v IN ('0') OR regexp_matches(v, '^-?[0-9]+$') THEN 'number' WHEN starts_with(v, '#') THEN 'error' ELSE 'text' END AS type FROM r""")
def oracle_value_types(t):
    return t("orders").select(F.col("o_orderkey").alias("id"), S.oracle_value_type(_raw()).alias("type"))


@query("""WITH p AS (SELECT p_partkey AS id, lower(p_type) AS a, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN split_part(lower(p_type), ' ', 2) WHEN 2 THEN lower(p_type) || ' or other' ELSE split_part(lower(p_type), ' ', 3) || 'x' END AS w, p_size AS n FROM part)
SELECT id, CASE WHEN w = a THEN 100 WHEN contains(a, w) THEN 80 WHEN contains(w, a) THEN 60 WHEN len(list_filter(string_split(a, ' '), lambda x: contains(w, x))) > 0 THEN 40 ELSE 20 END AS score,
floor(least(n, 20)::DOUBLE / n * 6500 + 0.5)::BIGINT AS coverage, floor(greatest(0.0, 1 - abs(n - 20)::DOUBLE / greatest(n, 20)) * 700 + 0.5)::BIGINT AS similarity FROM p""")
def match_scores(t):
    k, a = F.col("p_partkey"), F.lower("p_type")
    word = lambda n: F.split_part(a, F.lit(" "), F.lit(n))
    w = F.when(k % 4 == 0, a).when(k % 4 == 1, word(2)).when(k % 4 == 2, F.concat(a, F.lit(" or other"))).otherwise(F.concat(word(3), F.lit("x")))
    n = F.col("p_size")
    return t("part").select(k.alias("id"), S.match_score(w, a).alias("score"), S.coverage_score(F.least(n, F.lit(20)), n, 6500.0).alias("coverage"), S.numeric_similarity(n, F.lit(20), 700.0).alias("similarity"))


@query("SELECT doc_id, nfc_normalize(coalesce(text, '')) = coalesce(text, '') AS composed, sha256(nfc_normalize(coalesce(text, '') || 'e' || chr(769))) AS digest FROM documents")
def composed_texts(t):
    text = F.coalesce("text", F.lit(""))
    return t("documents").select("doc_id", (C.nfc(text) == text).alias("composed"), F.sha2(C.nfc(F.concat(text, F.lit("é"))), 256).alias("digest"))
