"""Exact dedup by 128-bit content hash with byte comparison inside each hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_classes, stash

#: Ids are packed below the text length; 2^63 - id lies in [1, 2^64], and 0 stands for a null id.
_STEP = "100000000000000000000"
_TOP = "9223372036854775808"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def _dec(v: Column | str) -> Column:
    return (F.lit(v) if isinstance(v, str) else v).cast("decimal(38,0)")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("points"), normalised(F.col(text_col)).alias("norm"))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: content_hash (128 bit), sha, group_size, keep_id, keep_points.

    The grouping key is the hash and the text itself, so Spark compares bytes inside a hash group
    and a collision stays two groups. Copies collapse on the map side, so a text with a third of
    all rows leaves one row per task. Nulls count as empty text; a null id sorts last.
    """
    rank = _dec(F.col("points")) * _dec(_STEP) + F.coalesce(_dec(_TOP) - _dec(F.col("doc_id")), _dec("0"))
    grouped = (
        _keyed(docs, id_col, text_col)
        .groupBy(F.unhex(F.md5("norm")).alias("content_hash"), "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("best"))
    )
    low = F.col("best") % _dec(_STEP)
    return grouped.select(
        "content_hash",
        F.sha2("norm", 256).alias("sha"),
        "group_size",
        F.when(low > 0, (_dec(_TOP) - low).cast("long")).alias("keep_id"),
        ((F.col("best") - low) / _dec(_STEP)).cast("long").alias("keep_points"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decision per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space. Of equal texts the one with the most
    code points, then the smallest id stays. Repeated rows (same id, same text) all report kept;
    keep_rows() leaves one of them. An empty table gives an empty result. Other columns are ignored.
    """
    classes = stash(text_classes(docs, id_col, text_col), "exact-classes")
    total = classes.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    rows = _keyed(docs, id_col, text_col).select("doc_id", "points", F.unhex(F.md5("norm")).alias("content_hash"), F.sha2("norm", 256).alias("sha"))
    rows = stash(rows, "exact-rows")
    out = join_classes(rows, classes, ["content_hash", "sha"], "group_size", total)
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns; repeated rows leave one."""
    classes = text_classes(docs, id_col, text_col).select(
        F.col("sha").alias("__sha"), F.col("content_hash").alias("__hash"), F.col("keep_points").alias("__points"), F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("__id")
    )
    classes = stash(classes, "exact-keepers")
    norm = normalised(F.col(text_col))
    mine = docs.select(
        "*",
        F.sha2(norm, 256).alias("__sha"),
        F.unhex(F.md5(norm)).alias("__hash"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("__points"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"),
    )
    keys = ["__hash", "__sha", "__points", "__id"]
    # The id is part of the join key, so a large group of copies is spread; only repeats of one row meet.
    return mine.join(classes, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
