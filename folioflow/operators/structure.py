"""Words to lines, blocks and phrases by gaps and islands; native blocks merged in reading order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def _islands(df: DataFrame, keys: list[str], order: list, is_break: Column, name: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__brk", F.coalesce(is_break, F.lit(False)).cast("int")).withColumn(name, F.sum("__brk").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__brk")


def box() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def word_lines(words: DataFrame, keys: list[str], order: str = "word_id") -> DataFrame:
    """Adds `line`: a new line starts where the centre moves by 0.4 of the smaller height or more."""
    by = [(F.col("y0") + F.col("y1")) / 2, F.col(order)]
    w = W.partitionBy(*keys).orderBy(*by)
    mid, h = (F.col("y0") + F.col("y1")) / 2, F.col("y1") - F.col("y0")
    step = F.abs(mid - F.lag(mid).over(w)) >= 0.4 * F.least(h, F.lag(h).over(w))
    return _islands(words, keys, by, step, "line")


def line_boxes(words: DataFrame, keys: list[str], order: str = "word_id") -> DataFrame:
    """One row per line of word_lines: box and text in x order."""
    parts = F.sort_array(F.collect_list(F.struct("x0", F.col(order).alias("o"), "label")))
    g = words.groupBy(*keys, "line").agg(*[c.alias(n) for c, n in zip((F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")), ("bx0", "by0", "bx1", "by1"), strict=True)], parts.alias("p"))
    return g.select(*keys, "line", F.array_join(F.transform("p", lambda x: x["label"]), " ").alias("t"), *[F.col(f"b{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def line_blocks(lines: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Adds `blk`: a block ends at a wide gap, a jump, an indentation or a change of line height."""
    w = W.partitionBy(*keys).orderBy(order)
    prev = {c: F.lag(c).over(w) for c in ("x0", "y0", "y1")}
    h, ph = F.col("y1") - F.col("y0"), prev["y1"] - prev["y0"]
    avg = (h + ph) / 2
    centers = (F.col("y0") + F.col("y1")) / 2 - (prev["y0"] + prev["y1"]) / 2
    brk = (
        (F.col("y0") - prev["y1"] > avg * 2.0)
        | (centers > avg * 3.5)
        | (F.abs(F.col("x0") - prev["x0"]) > avg * 2.5)
        | (F.abs(h - ph) > avg * 0.5)
    )
    return _islands(lines, keys, [order], brk, "blk")


def block_boxes(lines: DataFrame, keys: list[str], order: str = "i", peak: Column | None = None) -> DataFrame:
    """One row per block: n lines, box, median gap, height and peak distance, and the text in order."""
    w = W.partitionBy(*keys, "blk").orderBy(order)
    peak = (F.col("y0") + F.col("y1")) / 2 if peak is None else peak
    d = lines.withColumn("__peak", peak)
    d = d.withColumn("__gap", F.col("y0") - F.lag("y1").over(w)).withColumn("__step", F.col("__peak") - F.lag("__peak").over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "t"))), lambda x: x["t"]), " ")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return d.groupBy(*keys, "blk").agg(
        F.count(F.lit(1)).alias("n"),
        *box(),
        zero(F.median("__gap")).alias("line_spacing"),
        F.median(F.col("y1") - F.col("y0")).alias("avg_line_height"),
        zero(F.median("__step")).alias("peak_spacing"),
        text.alias("t"),
    )


def word_phrases(words: DataFrame, keys: list[str], order: str = "k") -> DataFrame:
    """Adds `phrase` within keys (which name a line): a gap over 1.5 mean heights starts a new one."""
    w = W.partitionBy(*keys).orderBy("x0", order)
    mean = F.avg(F.col("y1") - F.col("y0")).over(W.partitionBy(*keys))
    brk = F.col("x0") - F.lag("x1").over(w) > 1.5 * mean
    return _islands(words, keys, [F.col("x0"), F.col(order)], brk, "phrase")


def phrase_boxes(words: DataFrame, keys: list[str], order: str = "k") -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "label")))
    return words.groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(parts, lambda x: x["label"]), " ").alias("t"), *box())


def line_markers(lines: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Adds line_index, leading_marker, indent_px and hard_break_before to the lines of blocks (keys name a block)."""
    w = W.partitionBy(*keys).orderBy("y0", "x0", order)
    h = F.greatest(F.lit(1), F.first(F.col("y1") - F.col("y0")).over(w))
    left = F.min("x0").over(W.partitionBy(*keys))
    indent = (F.col("x0") - left).cast("double")
    d = lines.withColumn("line_index", F.row_number().over(w) - 1).withColumn("leading_marker", T.leading_marker(F.col("t"))).withColumn("indent_px", indent)
    gap = F.greatest(F.lit(0), F.col("y0") - F.lag("y1").over(w))
    moved = F.abs(F.col("indent_px") - F.lag("indent_px").over(w))
    hard = (gap > F.greatest(F.lit(2.5), h * 0.42)) | (moved > F.greatest(F.lit(8.0), h * 0.45))
    return d.withColumn("hard_break_before", (F.col("line_index") == 0) | F.coalesce(hard, F.lit(False)))


MERGE_ROLES = ("body", "title", "section_heading", "figure_caption")


def merge_native_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `merged`: the number of the block that a native block joins, in reading order per page.

    blocks: keys, block_id, source, role, font, size, color, bold, italic and a box. Each block is held
    against the box that has grown so far, so a page is folded as a group.
    """
    schema = blocks.select(*keys, "block_id").schema.simpleString()[7:-1].replace(":", " ") + ", merged int"

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y0", "x0", "block_id"], kind="stable")
        out, n, cur = [], -1, None
        for r in page.itertuples(index=False):
            joins = False
            if cur is not None and cur["source"] == "native" == r.source and cur["role"] == r.role and r.role in MERGE_ROLES:
                x0, y0, x1, y1 = cur["box"]
                gap = r.y0 - y1
                shared = max(0.0, min(x1, r.x1) - max(x0, r.x0)) / max(1.0, min(x1 - x0, r.x1 - r.x0))
                same = cur["font"] == r.font and cur["color"] == r.color and cur["bold"] == r.bold and cur["italic"] == r.italic
                joins = -2.0 <= gap <= max(22.0, 0.75 * max(y1 - y0, r.y1 - r.y0)) and shared >= 0.55 and same and abs(cur["size"] - round(r.size, 1)) <= 1.2
            if joins:
                cur["box"] = (min(x0, r.x0), min(y0, r.y0), max(x1, r.x1), max(y1, r.y1))
            else:
                n += 1
                cur = {"source": r.source, "role": r.role, "box": (r.x0, r.y0, r.x1, r.y1), "font": r.font, "color": r.color, "bold": r.bold, "italic": r.italic, "size": round(r.size, 1)}
            out.append(n)
        res = page[[*keys, "block_id"]].copy()
        res["merged"] = out
        return res

    return blocks.groupBy(*keys).applyInPandas(fold, schema)
