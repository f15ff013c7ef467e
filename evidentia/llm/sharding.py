"""Shards of near-equal bytes by sampled splitters.

The key is the hash of the text, so equal texts lie side by side. A size-weighted sample of keys gives
splitters of many small ranges; the bytes of each range are then counted exactly. An overfull range is
subdivided by a second hash of the key, and what is still overfull then (very many copies of one text) row by
row; consecutive ranges are dealt to shards by their exact cumulated bytes. Sampling thus only decides where
ranges may be cut, never how full a shard gets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written


def _ranges(splitters):
    def run(batches):
        for batch in batches:
            k = np.searchsorted(splitters.value, batch.column("key").to_numpy(), side="right")
            yield batch.append_column("range", pa.array(k.astype(np.int32)))

    return run


def _placed(d: DataFrame, shards: int, ranges_per_shard: int, rows_per_range: int, sample: int, seed: int) -> DataFrame:
    """d(doc_id, size, key, spread, ...), a written table -> with range, sub, fine, shard and base, the slot of the
    first row of its fine range."""
    spark = d.sparkSession
    total = d.agg(F.count("*"), F.sum("size")).first()
    n = min(1 << 16, max(shards * ranges_per_shard, (total[0] or 0) // rows_per_range))
    # a row is drawn with a chance in proportion to its size, by a hash: reruns draw the same rows
    chance = F.col("size") * (sample / (total[1] or 1))
    u = F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit(seed)), 11) / float(1 << 53)
    # about ``sample`` keys, whatever the number of rows
    pdf = d.filter(u < chance).select("key", F.greatest(F.lit(1.0), chance).alias("w")).toPandas().sort_values("key")
    at = np.searchsorted(np.cumsum(pdf.w.to_numpy()), np.linspace(0, pdf.w.sum(), n + 1)[1:-1])
    keys = pdf.key.to_numpy()[np.minimum(at, len(pdf) - 1)] if len(pdf) else []
    splitters = spark.sparkContext.broadcast(np.unique(np.array(keys, np.int64)))
    r = written(d.mapInArrow(_ranges(splitters), T.StructType([*d.schema.fields, T.StructField("range", T.IntegerType())])), "ranges")
    most = 2 * (total[1] or 1) / n

    def cuts(by: list[str], name: str, slack: int) -> DataFrame:
        load = r.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        k = F.greatest(F.ceil(F.col("bytes") / most), F.ceil(F.col("rows") / rows_per_range))
        return load.select(*by, F.when(k > slack, k).otherwise(1).alias(name))

    r = r.join(cuts(["range"], "cuts", 1), "range").withColumn("sub", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("cuts"))).drop("cuts")
    r = r.join(cuts(["range", "sub"], "cuts", 2), ["range", "sub"]).withColumn("fine", F.pmod("spread", "cuts")).drop("cuts")
    fine = r.groupBy("range", "sub", "fine").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # one row per fine range: at most 65,536 ranges, and one more for each ``most`` bytes or ``rows_per_range`` rows
    along = Window.orderBy("range", "sub", "fine")
    before = F.coalesce(F.sum("bytes").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = fine.withColumn("shard", F.least(F.lit(shards - 1), F.floor((before + F.col("bytes") / 2) * shards / F.lit(total[1] or 1)).cast("int")))
    place = Window.partitionBy("shard").orderBy("range", "sub", "fine").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("base", F.coalesce(F.sum("rows").over(place), F.lit(0))).select("range", "sub", "fine", "shard", "base")
    return r.join(written(fine, "fine"), ["range", "sub", "fine"])


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))  # fixed once it is written
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), spread.alias("spread"), *more), "sizes")


def assign(docs: DataFrame, shards: int = 8, ranges_per_shard: int = 256, rows_per_range: int = 100_000, sample: int = 200_000, seed: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    size is the text's UTF-8 bytes (null: none) plus 1; law is ``bytes``: shards are near equal in the sum of
    size. slot numbers a shard's rows from 0 without gaps, in key order (equal rows in any order).
    grown_shard is null: byte-balanced shards move rows anywhere when their number changes. Equal texts get
    one shard unless they alone overfill a range. No documents: no rows.
    """
    out = _placed(_keyed(docs), shards, ranges_per_shard, rows_per_range, sample, seed)
    slot = F.col("base") + F.row_number().over(Window.partitionBy("range", "sub", "fine").orderBy("key", "doc_id")) - 1
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, ranges_per_shard: int = 256, rows_per_range: int = 100_000, sample: int = 200_000, seed: int = 3) -> None:
    """Writes every row of ``docs``, null doc_ids too, under ``path``/shard=N by the same law, in key order within each
    file. Its columns may have any names but ``shard``."""
    r = _placed(_keyed(docs, F.struct(*docs.columns).alias("row")), shards, ranges_per_shard, rows_per_range, sample, seed)
    r = r.repartition("shard", "range", "sub", "fine").sortWithinPartitions("shard", "range", "sub", "fine", "key", "doc_id")
    r.select("row.*", "shard").write.partitionBy("shard").parquet(path)
