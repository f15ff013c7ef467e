"""Reading submitted files and writing verified outputs. Files are listed and read by Spark's readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_path
from ..operators.graphs import cut

#: Reader families by file extension.
FAMILIES = {"csv": "delimited", "tsv": "delimited", "json": "json", "jsonl": "json", "txt": "text", "md": "text", "xlsx": "workbook", "docx": "document", "pptx": "document", "pdf": "page", "zip": "container", "gz": "container"}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def scan_package(spark: SparkSession, path: str) -> DataFrame:
    """Inventory of a folder: (path, name, size_bytes, sha256, issue). A path that is unsafe or comes twice when its
    case is ignored has an issue; nothing is dropped."""
    name = F.substring_index("path", "/", -1)
    twice = F.count("*").over(Window.partitionBy(F.lower("path"))) > 1
    issue = F.when(safe_path(name).isNull(), "unsafe-path").when(twice, "duplicate-path")
    return _files(spark, path).select("path", name.alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), issue.alias("issue"))


def dispatch_format(files: DataFrame) -> DataFrame:
    """Adds ``family``, the reader of the file's extension, or ``unsupported``."""
    known = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    extension = F.when(F.instr("name", ".") > 0, F.lower(F.substring_index("name", ".", -1))).otherwise("")
    return files.withColumn("family", F.coalesce(F.try_element_at(known, extension), F.lit("unsupported")))


def text_lines(texts: DataFrame) -> DataFrame:
    """texts(file, text) -> (file, line, text), lines from 1, ended by \\n, \\r\\n or \\r; a final end adds none. A null
    text has no lines."""
    body = F.regexp_replace("text", r"(\r\n|\r|\n)\z", "")
    return texts.filter("text <> ''").select("file", F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text, readable): a file with invalid UTF-8 is one row without text that is not readable."""
    raw = _files(spark, path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    fine = F.is_valid_utf8("text")
    bad = raw.filter(~fine).select("file", F.lit(0).alias("line"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("readable"))
    return text_lines(raw.filter(fine)).withColumn("readable", F.lit(True)).unionByName(bad)


def ragged_cells(texts: DataFrame, delimiter: str = ",") -> DataFrame:
    """texts(file, text) -> (file, row, column, value, width): delimited cells with each row's true width.

    Rows and columns count from 0. A quoted cell may hold delimiters, line ends and doubled quotes. A text with an
    open quote is unreadable and has no rows; it is never repaired. A final line end adds no row, an empty line is a
    row of one empty cell.
    """
    d = delimiter.replace("|", r"\|").replace("\t", r"\t")
    even = (F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))) % 2 == 0
    body = F.regexp_replace("text", r"(\r\n|\r|\n)\z", "")
    # ends of rows outside quotes: text is cut at quotes, and only even pieces stand outside
    marked = texts.filter(even & (F.col("text") != "")).withColumn("pieces", F.split(body, '"'))
    outside = F.transform("pieces", lambda p, i: F.when(i % 2 == 0, F.regexp_replace(F.regexp_replace(p, r"\r\n|\r|\n", "\x1e"), d, "\x1f")).otherwise(p))
    rows = marked.select("file", F.array_join(outside, '"').alias("t")).select("file", F.posexplode(F.split("t", "\x1e")).alias("row", "t"))
    cells = rows.select("file", "row", F.split("t", "\x1f").alias("c")).select("file", "row", F.size("c").alias("width"), F.posexplode("c").alias("column", "value"))
    quoted = F.col("value").rlike(r'(?s)^".*"$') & (F.length("value") > 1)
    plain = F.replace(F.expr("substring(value, 2, length(value) - 2)"), F.lit('""'), F.lit('"'))
    return cells.select("file", "row", "column", F.when(quoted, plain).otherwise(F.col("value")).alias("value"), "width")


def read_ragged_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    return ragged_cells(_files(spark, path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text")), delimiter)


def json_cells(texts: DataFrame) -> DataFrame:
    """texts(file, text), each an array of objects -> (file, row, field, value): a key that an object lacks is no row;
    a JSON null has a null value. A text that is no such array has none."""
    parsed = texts.select("file", F.from_json("text", "array<map<string,string>>").alias("rows"))
    return parsed.select("file", F.posexplode("rows").alias("row", "fields")).select("file", "row", F.explode("fields").alias("field", "value"))


def audit_records(texts: DataFrame) -> DataFrame:
    """texts(file, text) of one JSON object a line -> (file, line, record, issue).

    A blank line and bad JSON are issues with their line number; an unfinished last line is ``torn`` and not an error.
    """
    last = F.max("line").over(Window.partitionBy("file"))
    ended = texts.select("file", F.col("text").rlike(r"\n\z").alias("ended"))
    lines = text_lines(texts).withColumn("last", F.col("line") == last).join(ended.distinct(), "file")
    good = F.try_parse_json("text").isNotNull() & F.col("text").rlike(r"^\s*\{")
    issue = F.when(F.trim("text") == "", "blank").when(F.col("last") & ~F.col("ended"), "torn").when(~good, "malformed")
    return lines.select("file", "line", F.when(issue.isNull(), F.col("text")).alias("record"), issue.alias("issue"))


def write_audit_jsonl(records: DataFrame, path: str) -> None:
    """One object a line with its keys in order; nulls are written."""
    records.select(F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest) that neither the order of rows nor of columns changes."""
    h = F.xxhash64(*(F.col(c) for c in sorted(df.columns))).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def verified_export(df: DataFrame, path: str) -> DataFrame:
    """Writes Parquet, reads it back and raises where its digest differs; returns what was read."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if table_digest(df).first() != table_digest(back).first():
        raise ValueError(f"{path} does not read back as written")
    return back


def content_store_write(files: DataFrame, path: str) -> DataFrame:
    """files(sha256, content): appends contents that the store lacks, once each, under a folder per hash prefix.

    Returns (sha256, outcome) of every file given: stored, present before, or mismatch where the content does not
    have the hash it was given with; such a content is not stored.
    """
    spark = files.sparkSession
    try:
        have = spark.read.parquet(path).select("sha256")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        have = spark.createDataFrame([], "sha256 string")
    right = F.sha2("content", 256) == F.col("sha256")
    told = files.join(have.distinct().withColumn("had", F.lit(True)), "sha256", "left")
    outcome = F.when(~right | right.isNull(), "mismatch").when(F.col("had"), "present").otherwise("stored")
    out = cut(told.select("sha256", outcome.alias("outcome")).distinct())  # told before the store grows
    new = files.filter(right).join(have, "sha256", "left_anti").dropDuplicates(["sha256"])
    new.select("sha256", "content", F.substring("sha256", 1, 2).alias("prefix")).write.mode("append").partitionBy("prefix").parquet(path)
    return out
