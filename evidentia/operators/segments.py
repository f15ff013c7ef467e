"""Evidence segments: pieces of text with the place they come from, of lines, JSON leaves, table cells, workbook cells and
page spans, all as (artifact_id, source, locator, provision_id, text, kind)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import ASCII_END, ASCII_START, provision_kind

#: A line with its end. The last match is empty.
_LINE = r"[^\r\n]*(?:\r\n|\r|\n|$)"
#: What begins a worked example, and what shows that the text before it is a formula.
EXAMPLE = rf"(?i){ASCII_START}(?:example|illustration)\s*:"
FORMULA = rf"(?i){ASCII_START}(?:formula|multiplied by|times){ASCII_END}|="


def running_offsets(lengths: Column, block: int = 256) -> Column:
    """The sum of all lengths before each, within the row: blocks of lengths are summed first, so that the work stays near
    linear for long arrays."""

    def sums(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    n = F.transform(lengths, lambda x: x.cast("long"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(n) / block).cast("int") - 1)), lambda b: F.slice(n, b * block + 1, F.lit(block)))
    begin = F.slice(sums(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0).cast("long")), 1, F.size(parts))
    return F.flatten(F.zip_with(parts, begin, lambda p, first: F.slice(sums(p, first), 1, F.size(p))))


def json_leaves(docs: DataFrame, levels: int = 12) -> DataFrame:
    """docs(artifact_id, json string) -> (artifact_id, pointer, text, unread): every string leaf that is not empty with its
    RFC 6901 pointer ('' for a document that is one string). One generator a level, and one pass for all levels.

    Null and malformed documents, and objects that repeat a key, have no leaves. What lies below ``levels`` levels is not
    dropped unsaid: its container is a row with a null text and unread = true."""
    tvf = docs.sparkSession.tvf
    now = docs.select("artifact_id", F.lit("").alias("pointer"), F.try_parse_json("json").alias("v")).filter("v is not null")
    for _ in range(levels):
        step = F.coalesce(F.replace(F.replace(F.col("key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
        below = F.col("pos").isNotNull()
        now = now.lateralJoin(tvf.variant_explode_outer(F.col("v").outer())).select("artifact_id", F.when(below, F.concat("pointer", F.lit("/"), step)).otherwise(F.col("pointer")).alias("pointer"), F.when(below, F.col("value")).otherwise(F.col("v")).alias("v"))
    kind = F.schema_of_variant("v")
    unread = kind.rlike("^(OBJECT<.+>|ARRAY<.+>)$") & (kind != "ARRAY<VOID>")
    told = now.select("artifact_id", "pointer", F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).alias("text"), unread.alias("unread"))
    return told.filter("text <> '' or unread")


def _segments(df: DataFrame, source: str, locator: Column, provision: Column, text: Column, kind: Column | None = None) -> DataFrame:
    kind = provision_kind(text) if kind is None else kind
    return df.select(F.col("artifact_id").cast("string").alias("artifact_id"), F.lit(source).alias("source"), locator.alias("locator"), provision.alias("provision_id"), text.alias("text"), kind.alias("kind"))


def line_rows(docs: DataFrame) -> DataFrame:
    """docs(artifact_id, text) -> (artifact_id, line from 1, offset, value), blank lines too; lines end with CR, LF or both."""
    raw = docs.select("artifact_id", F.regexp_extract_all("text", F.lit(_LINE), F.lit(0)).alias("raw"))
    raw = raw.select("artifact_id", "raw", F.transform("raw", F.length).alias("n"))
    at = raw.select("artifact_id", F.posexplode(F.arrays_zip("raw", "n", running_offsets(F.col("n")).alias("at"))).alias("pos", "x"))
    end = F.when(F.endswith("x.raw", F.lit("\r\n")), 2).when(F.endswith("x.raw", F.lit("\n")) | F.endswith("x.raw", F.lit("\r")), 1).otherwise(0)
    return at.select("artifact_id", (F.col("pos") + 1).alias("line"), F.col("x.at").alias("offset"), F.substring("x.raw", F.lit(1), F.col("x.n") - end).alias("value"))


def text_segments(docs: DataFrame, prefix: str = "text") -> DataFrame:
    """docs(artifact_id, text): the lines that are not blank."""
    rows = line_rows(docs).filter(F.col("value").rlike(r"[^ \t\x0B\f]"))
    line = F.col("line").cast("string")
    return _segments(rows, "lines", F.concat(F.lit(f"{prefix}:line="), line, F.lit(":offset="), F.col("offset").cast("string")), F.concat(F.lit(f"{prefix}-line-"), line), F.col("value"))


def json_segments(docs: DataFrame, levels: int = 12) -> DataFrame:
    """docs(artifact_id, json): its leaves; an unread container is a row with a null text and kind."""
    at = F.when(F.col("pointer") == "", "/").otherwise(F.col("pointer"))
    return _segments(json_leaves(docs, levels), "json", at, at, F.col("text"))


def delimited_segments(cells: DataFrame) -> DataFrame:
    """cells(artifact_id, row, col, value), rows and columns from 0: the cells that are not empty."""
    r, c = ((F.col(x) + 1).cast("string") for x in ("row", "col"))
    return _segments(cells.filter("value <> ''"), "delimited", F.concat(F.lit("row="), r, F.lit(":column="), c), F.concat(F.lit("row-"), r, F.lit("-column-"), c), F.col("value"))


def uri_component(text: Column) -> Column:
    """Percent encoding of all but ASCII letters, digits and - _ . ! ~ * ' ( )."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def workbook_segments(cells: DataFrame) -> DataFrame:
    """cells(artifact_id, sheet, address, formula, stored): a formula text and a stored value are a segment each; the
    value beside a formula is an example of it."""
    of = lambda c, k, kind: F.when(F.col(c) != "", F.struct(F.lit(k).alias("what"), F.col(c).alias("text"), kind.alias("kind")))
    stored = F.when(F.col("formula").isNotNull(), "example").otherwise(provision_kind(F.col("stored")))
    both = cells.select("artifact_id", "sheet", "address", F.explode(F.array_compact(F.array(of("formula", "formula", F.lit("formula")), of("stored", "stored-value", stored)))).alias("x"))
    at = F.concat(F.lit("sheet="), uri_component(F.col("sheet")), F.lit(":cell="), F.col("address"), F.lit(":"), F.col("x.what"))
    return _segments(both, "workbook", at, F.concat("sheet", F.lit("!"), "address", F.lit("-"), "x.what"), F.col("x.text"), F.col("x.kind"))


def page_segments(spans: DataFrame) -> DataFrame:
    """spans(artifact_id, page, start, end, text): the spans whose numbers fit their text."""
    good = spans.filter((F.col("page") >= 1) & (F.col("start") >= 0) & (F.col("text") != "") & (F.col("end") == F.col("start") + F.length("text")))
    p, a, b = (F.col(c).cast("string") for c in ("page", "start", "end"))
    return _segments(good, "page", F.concat(F.lit("pdf:page="), p, F.lit(":offset="), a, F.lit(":endOffset="), b), F.concat(F.lit("pdf-page-"), p, F.lit("-offset-"), a), F.col("text"))


def split_examples(segments: DataFrame) -> DataFrame:
    """A segment whose text is a formula followed by an example becomes two, each with its offset."""
    low, at = F.lower("text"), F.col("at")
    # the pattern is tried where its words are, which is seldom
    found = F.when(low.contains("example") | low.contains("illustration"), F.regexp_instr("text", F.lit(EXAMPLE)) - 1).otherwise(-1)
    before = F.substring(F.col("text"), F.lit(1), at)
    part = lambda what, text, offset: F.struct(
        F.concat("locator", F.lit(f":{what}-offset="), offset.cast("string")).alias("locator"), F.concat("provision_id", F.lit(f"-{what}")).alias("provision_id"), text.alias("text"), F.lit(what).alias("kind")
    )
    two = F.array(part("formula", before, F.lit(0)), part("example", F.substring(F.col("text"), at + 1, F.length("text")), at))
    one = F.array(F.struct("locator", "provision_id", "text", "kind"))
    return segments.withColumn("at", found).select("artifact_id", "source", F.explode(F.when((at > 0) & before.rlike(FORMULA), two).otherwise(one)).alias("x")).select("artifact_id", "source", "x.*")


def segment_evidence(lines: DataFrame | None = None, json: DataFrame | None = None, delimited: DataFrame | None = None, workbook: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """All segments of the given sources, formulas and examples apart. No source needs a shuffle. Null texts and rows
    whose locator is not complete have no segments; repeated rows come out as often as they go in."""
    given = ((lines, text_segments), (json, json_segments), (delimited, delimited_segments), (workbook, workbook_segments), (pages, page_segments))
    return split_examples(reduce(DataFrame.unionByName, [f(df) for df, f in given if df is not None]))
