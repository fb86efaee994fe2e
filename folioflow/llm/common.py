"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as the inside of a regex class.
SPACE = r"\x20\x09-\x0D"
#: A class with more than total/HOT_PARTS rows is hot; so there are fewer than HOT_PARTS hot classes.
HOT_PARTS = 1000
#: For a session in one process only, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/folioflow"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session in one process may leave it unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    What a result still reads goes when the application ends, or by sweep(); the rest by unstash().
    """
    spark = df.sparkSession
    if not _swept:
        atexit.register(_sweep_all)
    _swept.add(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def sweep(spark: SparkSession) -> None:
    """Delete all stashed tables of this application. Results that are not written yet are lost."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{sc.applicationId}")
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


_swept: set[SparkSession] = set()


def _sweep_all() -> None:
    for spark in _swept:
        if spark.sparkContext._jsc is not None:
            sweep(spark)


def unstash(*frames: DataFrame) -> None:
    """Delete stashed tables that no plan needs any more."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows to classes (one row per key; `size` counts the key's rows, `total` all rows).

    Classes with over total/HOT_PARTS rows are fewer than HOT_PARTS, so they are broadcast; the
    others are joined by a shuffle in which no key has more than that share. Keys must not be null.
    """
    bar = total // HOT_PARTS
    hot = classes.filter(F.col(size) > bar)
    cold = classes.filter(F.col(size) <= bar)
    by_hot = rows.join(F.broadcast(hot), keys)
    by_cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return by_hot.unionByName(by_cold)


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    gaps = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACE}]+", "w"), f"[{SPACE}]+", "")
    return F.length(gaps).cast("long")


def release_memory() -> None:
    """Give a worker's freed memory back at the end of a task: workers live on beside the JVM."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
