"""The inventory of fields on selected tabs: which cells are kept, under which name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import normalize_identity
from .tables import policy


def _name(c: str) -> Column:
    return normalize_identity(F.coalesce(F.col(c), F.lit("")))


def mapped_descriptions(descs: DataFrame, glossary: DataFrame) -> DataFrame:
    """descs(tab, text), glossary(pattern, context, generic) -> each distinct (tab, text), both normalized, with its one generic
    name or null. Entries whose context is the tab stand before those without a context, if any of them is contained in the
    text; among them equal patterns stand before contained ones. Several different names are none. ``glossary`` is a policy
    table, and only distinct texts meet it. Empty texts have no name."""
    d = descs.select(_name("tab").alias("tab"), _name("text").alias("text")).distinct()
    g = glossary.filter("generic is not null and pattern is not null").select(_name("pattern").alias("pattern"), normalize_identity(F.col("context")).alias("context"), "generic")
    hit = (F.col("context").isNull() | (F.col("context") == F.col("tab"))) & F.contains("text", "pattern") & (F.col("text") != "")
    m = d.join(policy(g), hit, "left")
    rank = F.when(F.col("generic").isNotNull(), F.when(F.col("context").isNull(), 2).otherwise(0) + F.when(F.col("text") == F.col("pattern"), 0).otherwise(1))
    m = m.withColumn("rank", rank).groupBy("tab", "text").agg(F.min(F.struct("rank", "generic")).alias("a"), F.max(F.struct(-F.col("rank"), "generic")).alias("b"))
    return m.select("tab", "text", F.when(F.col("a.generic") == F.col("b.generic"), F.col("a.generic")).alias("generic"))


def field_inventory(tabs: DataFrame, cells: DataFrame, named: DataFrame, observed: DataFrame, glossary: DataFrame) -> DataFrame:
    """tabs(sheet_id, name, role), cells(sheet_id, address, value, formula), named(sheet_id, address), observed(sheet_id, field),
    glossary(pattern, context, generic) -> (sheet_id, address, description, generic_field, source, status).

    A formula is described by the value in row 1 of its column, any other cell by its own value. Kept are all formulas
    (source formula), on support tabs cells with a name or a mapped description (support), and cells of row 1 whose value is
    an observed field of the sheet (header). Status ``mapped``: under its generic name. A formula without one is kept under its
    description, status ``own-name``; any other is left out, status ``unmapped``. Tabs of one name, without regard to case and
    runs of spaces, give one row of status ``collision`` (its sheet_id is the smallest) and none for their cells. Null values
    and headers that are missing read as empty; of several cells at one address in row 1 the smallest value is the header.

    A header meets the cells of its column by a join on sheet and column, which Spark may split where a column is hot; nothing
    is sorted or gathered by sheet.
    """
    t = tabs.withColumn("tab", _name("name"))
    t = t.join(t.groupBy("tab").agg(F.count("*").alias("n"), F.min("sheet_id").alias("first")), "tab")
    good = t.filter("n = 1").select("sheet_id", "tab", (F.col("role") == "support").alias("support"))
    nul = F.lit(None).cast("string")
    twice = t.filter("n > 1 and sheet_id = first").select("sheet_id", nul.alias("address"), F.col("tab").alias("description"), nul.alias("generic_field"), nul.alias("source"), F.lit("collision").alias("status")).distinct()
    first = F.coalesce(F.col("address").rlike("^[A-Z]+1$"), F.lit(False))
    c = cells.join(good, "sheet_id").select("sheet_id", "tab", "support", "address", F.regexp_extract("address", "^[A-Z]+", 0).alias("column"), first.alias("header"), F.coalesce("value", F.lit("")).alias("value"), F.col("formula").isNotNull().alias("is_formula"))
    heads = c.filter("header").groupBy("sheet_id", "column").agg(F.min("value").alias("head"))
    c = c.join(heads, ["sheet_id", "column"], "left").withColumn("description", F.when(F.col("is_formula"), F.coalesce("head", F.lit(""))).otherwise(F.col("value")))
    c = c.withColumn("text", _name("description"))
    seen = observed.select("sheet_id", _name("field").alias("text"), F.lit(True).alias("seen")).distinct()
    names = named.select("sheet_id", "address", F.lit(True).alias("has_name")).distinct()
    c = c.join(seen, ["sheet_id", "text"], "left").join(names, ["sheet_id", "address"], "left").fillna(False, ["seen", "has_name"])
    c = c.filter(F.col("is_formula") | F.col("support") | (F.col("header") & F.col("seen")))
    c = c.join(mapped_descriptions(c.select("tab", "text"), glossary), ["tab", "text"], "left")
    mapped = F.col("generic").isNotNull()
    source = F.when(F.col("is_formula"), "formula").when(F.col("support") & (F.col("has_name") | mapped), "support").when(F.col("header") & F.col("seen"), "header")
    status = F.when(mapped, "mapped").when(F.col("is_formula"), "own-name").otherwise("unmapped")
    generic = F.when(mapped, F.col("generic")).when(F.col("is_formula"), F.col("description"))
    kept = c.withColumn("source", source).filter("source is not null").select("sheet_id", "address", "description", generic.alias("generic_field"), "source", status.alias("status"))
    return kept.unionByName(twice)
