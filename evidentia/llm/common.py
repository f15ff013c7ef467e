"""Shared helpers: scratch tables in the cluster's shared folder, and batches of text for numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is not set, a temporary one in local mode; on a cluster, whose
    machines share no such folder, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        found = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by :func:`written` that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def release_memory() -> None:
    """Hands memory that Arrow and the C library keep for later back to the system. Reused Python workers would
    otherwise hold the most that any earlier task needed, beside an executor's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20, max_rows: int = 4096):
    """Cuts a batch into runs of whole texts of about ``max_bytes``; yields (first row, texts as a StringArray).
    Memory of the slices goes back to the system at the end of the batch."""
    texts = batch.column(column)
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    import numpy as np

    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + max_rows, n)
        yield lo, texts.slice(lo, hi - lo)
        lo = hi
    release_memory()
