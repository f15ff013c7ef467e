"""Column functions: raw value kinds, roles, versions, patterns, identifiers, signatures, provisions, Unicode forms."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import normalize_ascii_text, semver_key, token_shingles

#: Source roles and the rank of their authority; the lower one governs.
ROLE_RANK = {
    "executed-plan-document": 0, "amendment": 0, "collective-bargaining-agreement": 0, "formal-determination": 1, "approved-plan-summary": 2, "certified-case-report": 3,
    "supporting-administrative-report": 4, "actuarial-report": 4, "notice": 4, "approved-historical-calculation-artifact": 5, "inference": 6, "regulation": 7, "training-reference": 7, "other": 7,
}
#: Roles that govern only by an override.
OVERRIDE_ROLES = ("regulation", "training-reference", "other")
#: First bytes in hexadecimal, and what they say.
SIGNATURES = {"4D5A": "application/x-dosexec", "7F454C46": "application/x-elf", "504B0304": "application/zip", "25504446": "application/pdf"}


def nfc(text: Column) -> Column:
    """The composed Unicode form. Only what can change leaves the JVM: the text from one character before the first that is
    not ASCII. ASCII is composed already, and joins nothing before it. Rows go over in small batches, so that no
    worker holds thousands of long texts at once."""

    @F.udf("string", useArrow=False)
    def composed(x: str | None) -> str | None:
        return None if x is None else unicodedata.normalize("NFC", x)

    first = F.regexp_instr(text, F.lit(r"[^\x00-\x7F]"))
    start = F.greatest(first - 1, F.lit(1))
    tail = F.when(first > 0, F.substring(text, start, F.length(text)))
    return F.when(first > 0, F.concat(F.substring(text, F.lit(1), start - 1), composed(tail))).otherwise(text)


def raw_value_kind(value: Column, present: Column) -> Column:
    """missing, null, blank (the empty text only), formula-text, leading-zero-text, malformed (any case), literal-zero or
    text, as the text of a cell says."""
    return (
        F.when(~present, "missing")
        .when(value.isNull(), "null")
        .when(value == "", "blank")
        .when(value.rlike(r"^[=+\-@]"), "formula-text")
        .when(value.rlike("^0[0-9]+$"), "leading-zero-text")
        .when(value.rlike("^(?i)(?:#(?:N/A|VALUE!|REF!|DIV/0!)|INVALID)$"), "malformed")
        .when(value == "0", "literal-zero")
        .otherwise("text")
    )


def rule_shingles(text: Column) -> Column:
    """Distinct three-word shingles of ASCII words; with fewer than three words, the words."""
    plain = normalize_ascii_text(F.lower(text))
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    return F.when(F.size(words) < 3, F.array_sort(F.array_distinct(words))).otherwise(token_shingles(plain))


def tab_matches(value: Column, pattern: Column) -> Column:
    """A pattern with an asterisk matches the whole value, any other is contained in it; case is ignored. Every sign but the
    asterisk stands for itself."""
    v, p = F.lower(value), F.lower(pattern)
    quoted = F.concat(F.lit(r"^\Q"), F.replace(F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E$"))
    return F.when(F.contains(p, F.lit("*")), F.call_function("rlike", v, quoted)).otherwise(F.contains(v, p))


def class_matches(value: Column, pattern: Column) -> Column:
    """As ``tab_matches``, but every other sign of a pattern stands for itself, and containment counts either way."""
    v, p = F.lower(value), F.lower(pattern)
    literal = F.replace(F.regexp_replace(p, r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*"))
    return F.when(F.contains(p, F.lit("*")), F.call_function("rlike", v, F.concat(F.lit("^"), literal, F.lit("$")))).otherwise(F.contains(v, p) | F.contains(p, v))


def authority_rank(role: Column) -> Column:
    """Null for what is no role."""
    return F.create_map(*(F.lit(x) for kv in ROLE_RANK.items() for x in kv))[role]


def outranks(candidate: Column, current: Column) -> Column:
    last = F.lit(len(ROLE_RANK))
    return F.coalesce(authority_rank(candidate), last) < F.coalesce(authority_rank(current), last)


def requires_override(role: Column) -> Column:
    return F.coalesce(role.isin(*OVERRIDE_ROLES), F.lit(False))


def valid_version(version: Column) -> Column:
    return F.coalesce(version.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), F.lit(False))


def next_version(version: Column, part: str) -> Column:
    """``part`` is major, minor or patch; null where the version has not three numbers."""
    v = semver_key(version)
    up = {"major": (v["major"] + 1, F.lit(0), F.lit(0)), "minor": (v["major"], v["minor"] + 1, F.lit(0)), "patch": (v["major"], v["minor"], v["patch"] + 1)}[part]
    return F.when(valid_version(version), F.concat_ws(".", *(x.cast("string") for x in up)))


def detect_signature(content: Column) -> Column:
    """Media type that the first bytes tell, else null."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for magic, media in reversed(SIGNATURES.items()):
        out = F.when(F.startswith(head, F.lit(magic)), media).otherwise(out)
    return out


def identifier_error(value: Column, least: int, most: int, syntax: str, upper: bool = True) -> Column:
    """First broken rule of an identifier, else null; length and syntax look at the case-folded form."""
    v = F.upper(value) if upper else value
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "EMPTY")
        .when(value != F.trim(value), "PADDED")
        .when(~F.length(v).between(least, most), "LENGTH")
        .when(~v.rlike(syntax), "SYNTAX")
    )


#: Where a word of ASCII letters, digits and underscores begins and ends; ``\\b`` depends on the Java release.
ASCII_START, ASCII_END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _words(*texts: str) -> str:
    return f"{ASCII_START}(?:{'|'.join(texts)}){ASCII_END}"


#: The words of this function and of the two below it, with their weights.
def provision_kind(text: Column) -> Column:
    """example, formula or provision; null for a null text. Word bounds are looked at only where a word is."""
    low = F.lower(text)

    def has(*words: str) -> Column:
        return reduce(or_, [low.contains(w) for w in words]) & low.rlike(_words(*words))

    return F.when(has("example", "illustration", "for instance"), "example").when(low.contains("=") | has("formula", "multiplied by", "times"), "formula").when(text.isNotNull(), "provision")


def provision_issues(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(
        F.when(low.rlike(_words("may", "at the discretion of")), "ambiguous-text"),
        F.when(low.rlike(_words("undefined term", "not defined")), "undefined-term"),
        F.when(provision_kind(text) == "example", "other"),
    ))


def provision_confidence(kind: Column, named: Column, effective: Column, adopted: Column, issues: Column) -> Column:
    """0.6, more for a name and explicit dates, less for an example and each issue; within 0 and 1, two places."""
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    score = F.lit(0.6) + plus(named, 0.1) + plus(effective == "explicit", 0.1) + plus(adopted == "explicit", 0.05) - plus(kind == "example", 0.2) - issues * F.lit(0.1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 2)))


def combined_convention(left: Column, right: Column) -> Column:
    """Inferred beats explicit beats unknown."""
    either = lambda x: (left == x) | (right == x)
    return F.when(either("inferred-from-context"), "inferred-from-context").when(either("explicit"), "explicit").otherwise("unknown")
