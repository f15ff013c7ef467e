"""Mock populations by field names, and question-and-answer summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplier and increment of the generator, whose state has 32 bits.
MULTIPLIER, INCREMENT, MASK = 1_664_525, 1_013_904_223, 0xFFFFFFFF

#: A summary: its document and its items, each with its references. Identifiers and pages are read as text.
SUMMARY = (
    "document struct<doc_id: string, file_name: string, source_type: string>, items array<struct<item_id: string, item_text: string, status: string, answer: string, "
    "citation_note: string, references: array<struct<section: string, page_pdf: string, page_printed: string, excerpt: string>>>>, _corrupt string"
)


def drawn(seed: int, step: Column, bits: int) -> Column:
    """The state of the generator after ``step`` steps, for steps below 2**bits: step 1 is the first number. The map of 2**i
    steps is known for each i, so any step is at most ``bits`` maps away from the seed, whatever task it falls to."""
    maps, a, c = [], MULTIPLIER, INCREMENT
    for i in range(bits):
        maps.append(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in (("bit", 1 << i), ("high", a >> 16), ("low", a & 0xFFFF), ("plus", c)))))
        a, c = a * a & MASK, (a * c + c) & MASK

    def jump(state: Column, m: Column) -> Column:
        # high and low half of the factor apart: no product leaves 64 bits
        there = (F.shiftleft((state * m["high"]).bitwiseAND(0xFFFF), 16) + state * m["low"] + m["plus"]).bitwiseAND(MASK)
        return F.when(step.bitwiseAND(m["bit"]) != 0, there).otherwise(state)

    state = F.aggregate(F.array(*maps), F.lit(seed & MASK).cast("long"), jump)
    return state


def mock_population(rows: DataFrame, fields: list[str], seed: int, most: int = 1 << 40) -> DataFrame:
    """rows(row), numbers from 0 -> a record of each: one column a field, made by what its name holds. Keys and ids are counted,
    dates are a first of January from 1940 to 1989, amounts, services and hours are numbers below 100 of two digits, all else is
    a synthetic word. Numbers are drawn row by row and field by field from one congruential stream, reached by jumps, so rows may
    lie in any partitions. ``most`` bounds the rows; names must be unique, not empty and without space at their ends."""
    if not fields or len(set(fields)) < len(fields) or any(not f or f != f.strip() for f in fields):
        raise ValueError("fields must be unique names, not empty")
    row, bits = F.col("row").cast("long"), (most * len(fields)).bit_length()

    def value(field: str, column: int) -> Column:
        name = field.lower()
        text = (row + 1).cast("string")
        if "key" in name or "id" in name:
            return F.concat(F.lit("MOCK-"), F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text))
        if "date" in name:
            return F.concat(F.lit("19"), (40 + (row + column) % 50).cast("string"), F.lit("-01-01"))
        share = drawn(seed, row * len(fields) + column + 1, bits) / float(1 << 32)
        if any(w in name for w in ("amount", "service", "hours")):
            return F.floor(share * 10_000) / 100
        return F.concat(F.lit(f"synthetic-{column + 1}-"), F.floor(share * 1_000_000).cast("string"))

    return rows.select("row", *(value(f, i).alias(f) for i, f in enumerate(fields)))


def read_qa_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries, one JSON object a file -> items(file, doc_id, position, item_id, item_text, status, answer, citation_note),
    references(file, doc_id, item_id, item_position, position, section, page_pdf, page_printed, excerpt), issues(file, position,
    issue).

    Positions count from 0. A file that is no such object has the issue MALFORMED and no rows, one without items NO_ITEMS; an
    item that is null or has no id is NO_ID and stays among the items, an id twice in a file is DUPLICATE_ID. An item
    without references has none of them; other fields of a summary are not read."""
    raw = spark.read.schema(SUMMARY).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.select(F.col("_metadata.file_name").alias("file"), "document", "items", F.col("_corrupt").isNotNull().alias("bad"))
    good = raw.filter(~F.col("bad"))
    items = good.select("file", F.col("document.doc_id").alias("doc_id"), F.posexplode("items").alias("position", "i"))
    flat = items.select("file", "doc_id", "position", *(F.col(f"i.{c}").alias(c) for c in ("item_id", "item_text", "status", "answer", "citation_note")))
    refs = items.select("file", "doc_id", F.col("i.item_id").alias("item_id"), F.col("position").alias("item_position"), F.posexplode("i.references").alias("position", "r"))
    refs = refs.select("file", "doc_id", "item_id", "item_position", "position", *(F.col(f"r.{c}").alias(c) for c in ("section", "page_pdf", "page_printed", "excerpt")))
    none = F.lit(None).cast("int").alias("position")
    twice = flat.filter("item_id is not null").groupBy("file", "item_id").agg(F.count("*").alias("n"), F.max("position").alias("position")).filter("n > 1")
    issues = raw.filter("bad or items is null or size(items) = 0").select("file", none, F.when(F.col("bad"), "MALFORMED").otherwise("NO_ITEMS").alias("issue"))
    issues = issues.unionByName(flat.filter("coalesce(trim(item_id), '') = ''").select("file", "position", F.lit("NO_ID").alias("issue")))
    return flat, refs, issues.unionByName(twice.select("file", "position", F.lit("DUPLICATE_ID").alias("issue")))
