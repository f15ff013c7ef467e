"""Column functions: text normalisation, typed values, dates, addresses, versions, tolerance, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell texts that stand for a malformed value.
ERROR_TOKENS = ("#N/A", "#VALUE!", "#REF!", "#DIV/0!", "#NUM!", "#NAME?", "#NULL!", "INVALID")
#: Rank of a source role; the lower one governs.
AUTHORITY_RANK = {"statute": 0, "regulation": 1, "plan-document": 2, "amendment": 2, "resolution": 3, "procedure": 4, "summary": 5, "training": 6, "other": 7}


def classify_raw_value(value: Column, present: Column) -> Column:
    """The kind of a raw text cell: missing, null, blank, formula-text, leading-zero-text, malformed, literal-zero or
    text. Text such as ``-5`` is formula-text: it begins as a formula would."""
    return (
        F.when(~present, "missing")
        .when(value.isNull(), "null")
        .when(F.trim(value) == "", "blank")
        .when(value.rlike(r"^[=+\-@]"), "formula-text")
        .when(value.rlike("^0[0-9]+$"), "leading-zero-text")
        .when(value.isin(*ERROR_TOKENS), "malformed")
        .when(value == "0", "literal-zero")
        .otherwise("text")
    )


def primitive_display(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def normalize_comparable_text(text: Column) -> Column:
    """Lower case; every run of characters that are neither letters nor digits is one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normalize_ascii_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalize_restatement(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def normalize_field(name: Column) -> Column:
    """Upper-case identifier of 2 to 40 characters, else null."""
    up = F.regexp_replace(F.upper(F.trim(name)), "[^A-Z0-9]+", "_")
    return F.when(up.rlike("^[A-Z][A-Z0-9_]{1,39}$"), up)


def token_shingles(normalized: Column, width: int = 3) -> Column:
    """Distinct sorted ``width``-word shingles; fewer words make one shingle, none make an empty array."""
    t = F.filter(F.split(normalized, " "), lambda x: x != "")

    def grams(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < width, F.array(F.array_join(w, " "))).otherwise(F.array_sort(F.array_distinct(runs)))

    # the words are bound to a lambda's variable, else every shingle would split the text again
    return F.transform(F.array(t), grams)[0]


def hashed_shingles(normalized: Column, width: int = 3) -> Column:
    """The distinct shingles of ``token_shingles`` as 64-bit hashes, in no order and without a string for each."""

    def grams(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < width, F.array(F.xxhash64(w))).otherwise(F.array_distinct(runs))

    return F.transform(F.array(F.filter(F.split(normalized, " "), lambda x: x != "")), grams)[0]


def signal_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters, marks, digits and underscores, 2 to 40 characters, not digits alone."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda x: F.length(x).between(2, 40) & ~x.rlike("^[0-9]+$")))


def parse_evidence_date(text: Column) -> Column:
    """ISO, M/D/YYYY or "Month D, YYYY"; an impossible date is null and never rolls over."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "M/d/yyyy"), F.try_to_date(text, "MMMM d, yyyy"))


def infer_date_kind(left: Column) -> Column:
    """From the words before a date."""
    low = F.lower(left)
    return F.when(low.rlike("effective"), "effective").when(low.rlike("adopt"), "adopted").when(low.rlike("execut|sign"), "executed").when(low.rlike("issue"), "issued").otherwise("unknown")


def column_number(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)


def cell_coords(address: Column) -> Column:
    """struct(col, row) of an A1 address within 16,384 x 1,048,576 cells, else null."""
    plain = F.upper(F.replace(address, F.lit("$"), F.lit("")))
    col = column_number(F.regexp_extract(plain, "^([A-Z]{1,3})", 1))
    row = F.regexp_extract(plain, "^[A-Z]{1,3}([0-9]{1,7})$", 1).try_cast("int")
    return F.when(plain.rlike("^[A-Z]{1,3}[1-9][0-9]{0,6}$") & (col <= 16384) & (row <= 1048576), F.struct(col.alias("col"), row.alias("row")))


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def is_canonical_decimal(text: Column) -> Column:
    """No leading or trailing zeros, no plus, no minus zero, no exponent."""
    return text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]*[1-9])?$") & (text != "-0")


def content_hash(**fields: Column) -> Column:
    """SHA-256 over the named fields in name order; null and empty differ, types are the caller's string casts."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("null"))) for k, v in sorted(fields.items())]
    return F.sha2(F.concat_ws(";", *parts), 256)


def deterministic_uuid(kind: str, key: Column) -> Column:
    """A UUID of version 5 shape from a hash of kind and key."""
    h = F.sha2(F.concat(F.lit(kind + ":"), key.cast("string")), 256)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def normalize_scope(scope: Column) -> Column:
    return F.lower(F.replace(F.replace(F.trim(scope), F.lit(":"), F.lit("/")), F.lit(" "), F.lit("-")))


def scopes_intersect(a: Column, b: Column) -> Column:
    return (a == "*") | (b == "*") | (a == b) | F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))


def semver_key(version: Column) -> Column:
    """struct of three ints that orders versions; null parts where there are fewer."""
    p = F.split(version, r"\.")
    return F.struct(*(F.get(p, k).try_cast("int").alias(n) for k, n in enumerate(("major", "minor", "patch"))))


def round_value(x: Column, mode: str, scale: int = 0) -> Column:
    """mode: ``bankers`` (half to even), ``away`` from zero, or ``down``."""
    k = 10.0**scale
    return {"bankers": F.bround(x, scale), "away": F.when(x >= 0, F.ceil(x * k)).otherwise(F.floor(x * k)) / k, "down": F.floor(x * k) / k}[mode]


def within_tolerance(expected: Column, actual: Column, absolute: Column, relative: Column) -> Column:
    diff = F.abs(expected - actual)
    rel = F.when(expected == 0, diff).otherwise(diff / F.abs(expected))
    return (diff <= absolute) | (rel <= relative)


def oracle_value_type(text: Column) -> Column:
    return (
        F.when(text.isNull(), "text")
        .when(text.try_cast("double").isNotNull(), "number")
        .when(F.lower(text).isin("true", "false"), "boolean")
        .when((F.lower(text) == "error") | F.startswith(text, F.lit("#")), "error")
        .when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date")
        .otherwise("text")
    )


def safe_path(path: Column) -> Column:
    """The path with forward slashes; null where it is empty, absolute, has a drive, control characters, or a part that
    is empty, ``.`` or ``..``."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when((p != "") & ~p.rlike(r"^/|^[A-Za-z]:|[\x00-\x1F\x7F]|(^|/)\.{0,2}(/|$)"), p)


def match_score(wanted: Column, applicability: Column) -> Column:
    w, a = F.lower(wanted), F.lower(applicability)
    return F.when(w == a, 100).when(F.contains(a, w), 80).when(F.contains(w, a), 60).when(F.exists(F.split(a, " "), lambda x: F.contains(w, x)), 40).otherwise(20)


def coverage_score(matched: Column, total: Column, weight: float) -> Column:
    return F.when(total > 0, F.floor(matched / total * weight + 0.5)).otherwise(0).cast("long")


def numeric_similarity(a: Column, b: Column, weight: float) -> Column:
    most = F.greatest(a, b)
    return F.when(most > 0, F.floor(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / most) * weight + 0.5)).otherwise(0).cast("long")


def segment_kind(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("example|for instance"), "example").when(low.rlike(r"formula|[=×*/] *[0-9]"), "formula").otherwise("provision")
