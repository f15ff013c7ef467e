"""Mixing sources to target weights by fitting each source's budget as a subset sum.

Documents are counted by exact length per source. Of every length a proportional share is taken; what is
left of the budget, less than one document of each length, is filled by bounded-knapsack dynamic
programming over the remaining counts. Which documents of a length are taken is the order of a seeded hash.
Only counts by (source, length) go through the dynamic programme, one source per task; documents are chosen
in small hash buckets, so that a length shared by very many documents spreads over tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"


def fit_budget(counts: dict[int, int], budget: int, exact: int = 1 << 16) -> dict[int, int]:
    """How many items of each length (bounded by ``counts``) to take so that lengths sum to at most
    ``budget``, and as near as possible: proportional shares, then longest first down to ``exact``, then a
    dynamic programme over reachable sums, held as the bits of an integer."""
    total = sum(n * c for n, c in counts.items() if n > 0)
    if budget >= total:
        return {n: c for n, c in counts.items() if n > 0}
    took = {n: c * budget // total for n, c in counts.items() if n > 0}
    rest = budget - sum(n * k for n, k in took.items())
    for n in sorted(took, reverse=True):
        if rest <= exact:
            break
        k = min(counts[n] - took[n], (rest - exact) // n if rest - exact >= n else 0)
        took[n] += k
        rest -= k * n
    mask, sums, chunks = (1 << (rest + 1)) - 1, [1], []
    for n in sorted((n for n in took if n <= rest), reverse=True):
        left = min(counts[n] - took[n], rest // n)
        step = 1
        while left > 0 and not sums[-1] >> rest & 1:
            k = min(step, left)
            chunks.append((n, k))
            sums.append(sums[-1] | sums[-1] << n * k & mask)
            left -= k
            step *= 2
        if sums[-1] >> rest & 1:
            break
    at = sums[-1].bit_length() - 1
    for (n, k), before in zip(reversed(chunks), reversed(sums[:-1]), strict=True):
        if not before >> at & 1:
            took[n] += k
            at -= n * k
    return took


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes(source, source_size) -> with target: ``share`` of all words by weight, sources in code point
    order (null last) weighing ``weights`` in turn, none above ``most`` times its size; what that cuts off is
    shared again by weight. The level L with sum(min(most * size, L * weight)) = total is found in one pass
    over the sources in order of most * size / weight."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level)
    # the first source whose cap is above the level there: it and all later ones get weight * level
    t = t.withColumn("found", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(Window.partitionBy())["level"])
    return t.select("source", "source_size", F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("found"))).alias("target"))


def _quota(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one source's (size, n): how many documents of each size are taken once more than whole copies."""
    target, total = float(pdf.target.iloc[0]), int(pdf.source_size.iloc[0])
    whole = min(int(target // total), 2) if total else 0
    took = fit_budget(dict(zip(pdf["size"].tolist(), pdf.n.tolist(), strict=True)), max(0, min(total, round(target - whole * total))))
    return pdf.assign(copies=whole, extra=[took.get(s, 0) for s in pdf["size"]])[["source", "size", "n", "copies", "extra"]]


def chosen(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: int, bucket: int) -> DataFrame:
    """docs(doc_id, source, size, h, g) -> one row per distinct row of these: how many rows it stands for (m), and how
    many of its documents are taken in all (total), with source_size and target. Equal rows are counted before anything
    is ordered, so that very many of them are one row here. The draw goes by doc_id and h; rows that share both are in
    order of g, in one task (which spills)."""
    if most not in (1, 2):
        raise ValueError("most is 1 or 2")
    d = written(docs.groupBy("doc_id", "source", "size", "h", "g").agg(F.count("*").alias("m")), "sizes")
    hist = written(d.groupBy("source", "size").agg(F.sum("m").alias("n")), "lengths")
    per = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    p = per.select(F.col("source").alias("ps"), "source_size", "target")
    quota = hist.join(p, F.col("source").eqNullSafe(F.col("ps"))).drop("ps")
    quota = written(quota.groupBy("source").applyInPandas(_quota, "source string, size long, n long, copies long, extra long"), "quota")
    q = quota.select(F.col("source").alias("qs"), F.col("size").alias("qz"), "n", "copies", "extra")
    # documents of one source and length are ordered by (hash bucket, hash): whole buckets first, then within one
    placed = d.join(q, F.col("source").eqNullSafe(F.col("qs")) & (F.col("size") == F.col("qz"))).drop("qs", "qz")
    placed = placed.withColumn("r", F.xxhash64("doc_id", "h", F.lit(seed)))
    placed = placed.withColumn("b", F.pmod(F.shiftright("r", 32), F.ceil(F.col("n") / bucket)))
    some = placed.filter("extra > 0 and extra < n")
    counts = some.groupBy("source", "size", "b").agg(F.sum("m").alias("here"))
    before = F.sum("here").over(Window.partitionBy("source", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    cut = counts.withColumn("before", F.coalesce(before, F.lit(0))).select(F.col("source").alias("cs"), F.col("size").alias("cz"), F.col("b").alias("cb"), "before", "here")
    inside = some.join(cut, F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("cz")) & (F.col("b") == F.col("cb"))).drop("cs", "cz", "cb")
    edge = (F.col("before") < F.col("extra")) & (F.col("before") + F.col("here") > F.col("extra"))
    keep = ("doc_id", "source", "size", "h", "g", "m", "copies", "more")
    within = F.coalesce(F.sum("m").over(Window.partitionBy("source", "size", "b").orderBy("r", "doc_id", "h", "g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("extra") - F.col("before") - within
    ranked = inside.filter(edge).withColumn("more", F.greatest(F.lit(0).cast("long"), F.least("m", left))).select(*keep)
    plain = inside.filter(~edge).withColumn("more", F.when(F.col("before") < F.col("extra"), F.col("m")).otherwise(0)).select(*keep)
    rest = placed.filter("extra <= 0 or extra >= n").withColumn("more", F.when(F.col("extra") > 0, F.col("m")).otherwise(0)).select(*keep)
    out = ranked.unionByName(plain).unionByName(rest).join(p, F.col("source").eqNullSafe(F.col("ps"))).drop("ps")
    total = F.when(F.col("size") > 0, F.col("copies") * F.col("m") + F.col("more")).otherwise(0).cast("long")
    return out.select("doc_id", "source", "size", "h", "g", "m", total.alias("total"), "source_size", "target")


def _measured(docs: DataFrame, g: Column, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("h"), g.alias("g"), *more)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 11, bucket: int = 512) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, size, source_size, target, taken, copies), one row per input
    row. size counts runs of non-whitespace (null: 0); a document is taken 0, 1 or 2 times whole, taken is
    that many times its size. Documents without words are never taken. Null is a source of its own; repeated
    rows are documents of their own. Reruns agree. ``most`` is 1 or 2. No documents: no rows."""
    c = chosen(_measured(docs, F.lit(0).cast("long")), weights, share, most, seed, bucket)
    each = c.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = F.floor(F.col("total") / F.col("m")) + (F.col("k") <= F.col("total") % F.col("m")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 11, bucket: int = 512) -> DataFrame:
    """The rows of ``docs``, each 0, 1 or 2 times as :func:`mix` says, null doc_ids and sources too. Rows of one doc_id,
    source and text share what :func:`mix` takes of these; rows that differ in another column are documents of their own,
    and what is taken of equal rows comes as copies of one of them. Columns may have any names; they must be of types that can be
    ordered."""
    row = F.struct(*docs.columns)
    g = F.xxhash64(row)
    c = chosen(_measured(docs, g), weights, share, most, seed, bucket).filter("total > 0")
    took = c.select(*(F.col(x).alias(f"_{x}") for x in ("doc_id", "source", "size", "h", "g", "m", "total")))
    rows = _measured(docs, g, row.alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))
    j = rows.join(took, same).select("doc_id", "source", "h", "g", "row", F.col("_m").alias("m"), F.col("_total").alias("total"))
    again = j.filter("m > 1").groupBy("doc_id", "source", "h", "g", "total").agg(F.min("row").alias("row"))
    out = j.filter("m = 1").select("row", "total").unionByName(again.select("row", "total"))
    return out.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total")))).select("row.*")
