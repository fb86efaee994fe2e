"""Page layout: content box, bands, roles, alignment, columns, frames and layout quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

TEXT_ROLES = ("body", "title", "section_heading", "figure_caption")


def content_box(blocks: DataFrame, keys: list[str], width: Column, height: Column) -> DataFrame:
    """One row per page: content box c0..c3 of the valid blocks (else the page), margins and the two bands."""
    ok = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    pick = lambda f, c, d: F.coalesce(f(F.when(ok, F.col(c))), d).cast("int")
    g = blocks.groupBy(*keys).agg(
        F.max(width).cast("int").alias("width"),
        F.max(height).cast("int").alias("height"),
        pick(F.min, "x0", F.lit(0)).alias("c0"),
        pick(F.min, "y0", F.lit(0)).alias("c1"),
        pick(F.max, "x1", F.max(width)).alias("c2"),
        pick(F.max, "y1", F.max(height)).alias("c3"),
    )
    zero = lambda c: F.greatest(F.lit(0), c).cast("int")
    band = F.greatest(F.lit(24), F.floor(F.col("height") * 0.10).cast("int"))
    return g.select(
        "*",
        zero(F.col("c0")).alias("margin_left"),
        zero(F.col("width") - F.col("c2")).alias("margin_right"),
        zero(F.col("c1")).alias("margin_top"),
        zero(F.col("height") - F.col("c3")).alias("margin_bottom"),
        F.least(F.col("height"), band).alias("header_end"),
        F.greatest(F.lit(0), F.col("height") - band).alias("footer_start"),
    )


def role(t: Column, known: Column | None = None) -> Column:
    """Role of a block with its box, and c0, c2, header_end and footer_start of its page, in reach."""
    s = T.norm_text(t)
    y0, y1 = F.col("y0"), F.col("y1")
    mid, wide = (y0 + y1) / 2, F.greatest(F.lit(1.0), F.col("x1") - F.col("x0"))
    short, part = F.length(s) <= 140, wide < (F.col("c2") - F.col("c0")) * 0.8
    known = F.lower(F.coalesce(known, F.lit(""))) if known is not None else F.lit("")
    title = short & (F.size(F.array_remove(F.split(s, " "), "")) <= 12)
    top, bottom = F.col("header_end"), F.col("footer_start")
    return (
        F.when(known == "diagram_text_label", "diagram_text_label")
        .when(T.is_equation_like(s), "equation_inline")
        .when(known.isin("diagram_label", "figure_label"), "diagram_label")
        .when((y1 <= top) & short, "header")
        .when((y0 >= bottom) & short, "footer")
        .when((y1 <= top) & part, "header")
        .when((y0 >= bottom) & part, "footer")
        .when((mid <= top) & short, "header")
        .when((mid >= bottom) & short, "footer")
        .when(s.rlike(r"^\s*(figure|fig\.?)\s*\d+"), "figure_caption")
        .when(s.rlike(r"^\s*(\d+(\.\d+)+)\b"), "section_heading")
        .when(title & part, "title")
        .otherwise("body")
    )


def annotate(blocks: DataFrame, keys: list[str], width: Column, height: Column) -> DataFrame:
    """Blocks with role, alignment and indent_px, and the page's content box."""
    page = content_box(blocks, keys, width, height)
    d = blocks.join(page, keys)
    content = tuple(F.col(f"c{i}") for i in range(4))
    known = F.col("role") if "role" in blocks.columns else None
    return d.withColumn("role", role(F.col("t"), known)).withColumn("alignment", G.alignment(G.rect(), content)).withColumn("indent_px", G.indent(G.rect(), content))


def columns(blocks: DataFrame, keys: list[str], width: Column) -> DataFrame:
    """1 or 2 columns per page from the blocks left of, right of and across the middle."""
    mid = width / 2
    cross = (F.col("x0") < mid) & (F.col("x1") > mid)
    g = blocks.groupBy(*keys).agg(
        F.count_if(cross).alias("crossing"),
        F.count_if(~cross & (F.col("x1") <= mid)).alias("left"),
        F.count_if(~cross & (F.col("x1") > mid) & (F.col("x0") >= mid)).alias("right"),
        F.max(width).alias("__w"),
    )
    two = (F.col("left") >= 3) & (F.col("right") >= 3) & (F.col("crossing") <= F.greatest(F.lit(2), F.floor(0.25 * (F.col("left") + F.col("right")))))
    return g.select(*keys, "left", "right", "crossing", F.when(two, 2).otherwise(1).alias("columns"), F.when(two, F.floor(F.col("__w") * 0.06)).otherwise(0).cast("int").alias("gutter"))


def free_frames(obstacles: DataFrame, keys: list[str], top: Column, bottom: Column, least: int = 14) -> DataFrame:
    """Vertical frames (f0, f1) of `least` or more between the obstacles of a page."""
    w = W.partitionBy(*keys).orderBy("y0", "y1").rowsBetween(W.unboundedPreceding, -1)
    reach = F.greatest(top, F.coalesce(F.max("y1").over(w), top))
    inner = obstacles.select(*keys, reach.alias("f0"), F.least(F.col("y0"), bottom).alias("f1"))
    last = obstacles.groupBy(*keys).agg(F.greatest(top, F.max("y1")).alias("f0")).select(*keys, "f0", bottom.alias("f1"))
    return inner.unionByName(last).filter(F.col("f1") - F.col("f0") >= least)


def slot_rows(slots: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `row`: slots whose top lies within half a slot height (2 at least) of the one before share a row."""
    w = W.partitionBy(*keys).orderBy("y0", "x0")
    far = F.abs(F.col("y0") - F.lag("y0").over(w)) > F.greatest(F.lit(2.0), 0.5 * (F.col("y1") - F.col("y0")))
    d = slots.withColumn("__b", F.coalesce(far, F.lit(False)).cast("int"))
    return d.withColumn("row", F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__b")


def block_gaps(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between a block and the one above, where they don't overlap; and their median per page."""
    w = W.partitionBy(*keys).orderBy("y0", "x0")
    g = blocks.withColumn("gap", F.col("y0") - F.lag("y1").over(w)).filter("gap >= 0")
    return g.groupBy(*keys).agg(F.bround(F.median("gap").cast("decimal(20,6)"), 2).cast("double").alias("block_gap"), F.count(F.lit(1)).alias("gaps"))


def quality_counts(words: int | DataFrame, off: DataFrame, pairs: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Words, words off the page, overlapping pairs and text-image collisions per page and in total."""
    parts = []
    for name, df in (("words", words), ("off_page_words", off), ("word_overlaps", pairs), ("text_image_collisions", hits)):
        parts.append(df.select(*keys, F.lit(name).alias("metric")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.rollup(*keys).agg(*[F.count_if(F.col("metric") == m).alias(m) for m in ("words", "off_page_words", "word_overlaps", "text_image_collisions")])
