"""Dominant styles, style classes, heading levels and page style profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G


def first_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value): the most frequent value per key; on ties the one seen first."""
    g = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__o"))
    return g.groupBy(*keys).agg(F.max_by(value, F.struct("__n", -F.col("__o"))).alias(value))


def normalized_style(df: DataFrame) -> DataFrame:
    """font, size and color with defaults, sizes within 6 to 72 and colours readable on white."""
    font = F.coalesce(F.nullif(F.col("font"), F.lit("")), F.when(F.col("serif"), "Times-New-Roman").otherwise("Arial"))
    size = F.greatest(F.lit(6.0), F.least(F.lit(72.0), F.coalesce(F.col("size"), F.lit(12.0))))
    return df.withColumn("font", font).withColumn("size", size).withColumn("color", G.readable_color(F.coalesce("color", F.lit("#222222"))))


def dominant_style(spans: DataFrame, keys: list[str], order: str, flags: tuple[str, ...] = ("bold", "italic", "serif")) -> DataFrame:
    """Per key: median size, and the mode of font, colour and each flag, the first seen on ties."""
    out = spans.groupBy(*keys).agg(F.median("size").alias("size"))
    for c in ("font", "color", *flags):
        out = out.join(first_mode(spans, keys, c, order), keys)
    return out


def semantic(role: Column, words: Column, bold: Column, upper: Column, size: Column, y0: Column, height: Column) -> Column:
    strong = (words <= 12) & (bold | upper) & (size >= 11.0) & (y0 < height * 0.65)
    return F.when(role.isin("header", "footer"), role).when(role == "figure_caption", "caption").when(role.isin("title", "section_heading") | strong, "heading").otherwise("body")


def style_clusters(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Style classes of a page, by semantic, rounded size, flags and colour bucket, ranked by frequency.

    blocks: keys, order, semantic, font, size, color, bold, italic, serif. Returns per class its rank,
    class_id, occurrences, size, font, color and flags; ties rank by first appearance.
    """
    b = blocks.withColumn("size_bucket", F.bround("size").cast("int")).withColumn("color_bucket", G.color_bucket(F.col("color")))
    flags = [f"is_{c}" for c in ("bold", "italic", "serif")]
    key = [*keys, "semantic", "size_bucket", *flags, "color_bucket"]
    b = b.select("*", *[F.col(c).cast("int").alias(f"is_{c}") for c in ("bold", "italic", "serif")])
    g = b.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences"), F.median("size").alias("size"), F.min(order).alias("first"))
    for c in ("font", "color"):
        g = g.join(first_mode(b, key, c, order), key)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("occurrences"), "first"))
    g = g.withColumn("rank", rank)
    levels = heading_levels(blocks, keys)
    g = g.withColumn("__size", F.bround("size").cast("int")).join(levels.withColumnRenamed("size", "__size"), [*keys, "__size"], "left")
    level = F.when(F.col("semantic") == "heading", F.coalesce("level", F.lit(3)))
    name = F.when(F.col("semantic") == "heading", F.concat(F.lit("Heading"), level)).otherwise(F.initcap("semantic"))
    return g.select(*key, "rank", F.concat(name, F.lit("_"), F.lpad(F.col("rank").cast("string"), 2, "0")).alias("class_id"), level.alias("heading_level"), "occurrences", "size", "font", "color")


def heading_levels(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size, level): the three largest rounded sizes of headings are levels 1 to 3."""
    d = blocks.filter("semantic = 'heading'").select(*keys, F.bround("size").cast("int").alias("size")).distinct()
    d = d.withColumn("level", F.dense_rank().over(W.partitionBy(*keys).orderBy(F.desc("size"))))
    return d.filter("level <= 3")


def palette(blocks: DataFrame, keys: list[str], order: str, top: int = 8) -> DataFrame:
    """(keys, rank, color, n): the most frequent colours, the first seen on ties."""
    g = blocks.groupBy(*keys, "color").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    g = g.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "first")))
    return g.filter(F.col("rank") <= top).select(*keys, "rank", "color", "n")


def typography(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rounded sizes per page, large to small."""
    return blocks.groupBy(*keys).agg(F.sort_array(F.collect_set(F.bround("size").cast("int")), asc=False).alias("sizes"))


def resolved_style(blocks: DataFrame) -> DataFrame:
    """A block's own style, normalised; captions a point smaller but 8 at least, headings bold; and the confidence."""
    d = normalized_style(blocks)
    size = F.when(F.col("semantic") == "caption", F.least("size", F.greatest(F.lit(8.0), F.col("size") - 1))).otherwise(F.col("size"))
    sure = F.when(F.col("font").isin("Arial", "Times-New-Roman") & ~F.col("serif"), 0.8).otherwise(0.9)
    return d.withColumn("size", size).withColumn("bold", F.col("bold") | (F.col("semantic") == "heading")).withColumn("style_confidence", sure)
