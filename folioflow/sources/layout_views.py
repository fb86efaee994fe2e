"""Page geometry derived from `documents.text`, for tables that have no boxes of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, i, t, x0, y0, x1, y1: a box for each non-blank line, top to bottom."""
    kept = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    d = docs.select("doc_id", F.posexplode(kept).alias("i", "t"))
    d = d.withColumn("h", F.when(F.length("t") <= 36, 26).otherwise(16))
    d = d.withColumn("step", F.col("h") + F.when(F.col("i") % 6 == 5, 48).otherwise(6))
    above = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("y0", F.lit(40) + F.coalesce(F.sum("step").over(above), F.lit(0)))
    x0 = F.when(F.col("i") % 9 == 4, 120).otherwise(60)
    x1 = F.least(x0 + 7 * F.length("t"), F.lit(1180))
    return d.select("doc_id", "i", "t", x0.cast("long").alias("x0"), F.col("y0").cast("long").alias("y0"), x1.cast("long").alias("x1"), (F.col("y0") + F.col("h")).cast("long").alias("y1"))


def words(docs: DataFrame) -> DataFrame:
    """doc_id, i, k, label, x0, y0, x1, y1: a box for each word of a line, with a wide gap after every eighth."""
    toks = F.array_remove(F.split("t", r"\s+"), "")
    d = lines(docs).select("doc_id", "i", F.col("x0").alias("lx"), "y0", "y1", F.posexplode(toks).alias("k", "label"))
    left = W.partitionBy("doc_id", "i").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    gap = F.when(F.col("k") % 8 == 7, 40).otherwise(7)
    d = d.withColumn("x0", F.col("lx") + F.coalesce(F.sum(7 * F.length("label") + gap).over(left), F.lit(0)))
    return d.select("doc_id", "i", "k", "label", F.col("x0").cast("long").alias("x0"), "y0", (F.col("x0") + 7 * F.length("label")).cast("long").alias("x1"), "y1")


def zones(docs: DataFrame) -> DataFrame:
    """doc_id, z, x0, y0, x1, y1: two rectangles per document."""
    z = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("z"))
    x0 = F.lit(100) + 350 * F.col("z")
    y0 = F.lit(200) + 37 * F.pmod("doc_id", F.lit(11)) + 400 * F.col("z")
    return z.select("doc_id", "z", x0.cast("long").alias("x0"), y0.cast("long").alias("y0"), (x0 + 300).cast("long").alias("x1"), (y0 + 120).cast("long").alias("y1"))


def styles(docs: DataFrame) -> DataFrame:
    """doc_id, i, font, size, color, bold, italic, serif: styles with ties, by line and document number."""
    d = lines(docs).select("doc_id", "i")
    pick = lambda c, *vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (c + 1).cast("int"))
    return d.select(
        "doc_id",
        "i",
        pick(F.col("i") % 3, "Arial", "Times", "Courier").alias("font"),
        pick(F.pmod(F.col("doc_id") + F.col("i"), F.lit(4)), 10.0, 12.0, 12.5, 18.0).alias("size"),
        pick(F.pmod("doc_id", F.lit(4)), "#222222", "#101010", "#204080", "#f0f0a0").alias("color"),
        (F.col("i") % 5 == 0).alias("bold"),
        (F.col("i") % 7 == 3).alias("italic"),
        (F.col("i") % 3 == 1).alias("serif"),
    )
