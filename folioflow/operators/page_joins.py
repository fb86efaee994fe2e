"""Joins of a page's own records: lines with a stored layout, and the zones that text must keep clear of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The least area in pixels of a zone that blocks translated text, and the kind that always does.
BLOCKING_AREA = 4500
BLOCKING_KIND = "diagram_block"


def with_layout(lines: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, block, i, t) with the stored layout's line of the same block and place.

    stored: keys, block, i, index, marker, indent, break_before, break_after, text. Adds line_index,
    marker, indent, break_before, break_after, line_text and block_text, the block's stored lines. Where
    a block has no such line the layout's columns are null and line_text is the line's own.
    """
    s = stored.select(*keys, "block", "i", F.struct("index", "marker", "indent", "break_before", "break_after", "text").alias("s"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("i", F.col("s.text").alias("text")))), lambda x: x["text"])
    whole = s.groupBy(*keys, "block").agg(F.trim(F.array_join(F.filter(texts, lambda x: x != ""), "\n")).alias("block_text"))
    d = lines.join(s, [*keys, "block", "i"], "left").join(whole, [*keys, "block"], "left")
    got = F.col("s").isNotNull()
    return d.withColumns(
        {
            "line_index": F.when(got, F.coalesce("s.index", "i")),
            "marker": F.when(got, F.coalesce("s.marker", F.lit(""))),
            "indent": F.when(got, F.coalesce(F.col("s.indent").cast("double"), F.lit(0.0))),
            "break_before": F.when(got, F.coalesce("s.break_before", F.lit(False))),
            "break_after": F.when(got, F.coalesce("s.break_after", F.lit(True))),
            "line_text": F.coalesce(F.when(F.col("s.text") != "", F.col("s.text")), F.col("t")),
            "block_text": F.when(F.col("block_text") != "", F.col("block_text")),
        }
    ).drop("s")


def forbidden_zones(zones: DataFrame, images: DataFrame, overlays: DataFrame, keys: list[str], translated: bool = False, scale: float = 1.0) -> DataFrame:
    """keys, origin, x0, y0, x1, y1 in points: boxes that text keeps clear of. Boxes with a null side are left out.

    Translated text ignores zones without text, small images, and small overlays (with columns kind and
    reason) that are no diagram.
    """
    box = ["x0", "y0", "x1", "y1"]
    large = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0")) >= BLOCKING_AREA
    if translated:
        named = lambda c: F.when(F.col(c) != "", F.col(c))
        kind = F.lower(F.coalesce(named("kind"), named("reason"), F.lit("")))
        parts = [("image", images.filter(large)), ("overlay", overlays.filter(large | (kind == BLOCKING_KIND)))]
    else:
        parts = [("zone", zones), ("image", images), ("overlay", overlays)]
    out = None
    for origin, d in parts:
        d = d.dropna(subset=box).select(*keys, F.lit(origin).alias("origin"), *[(F.col(c) * scale).alias(c) for c in box])
        out = d if out is None else out.unionByName(d)
    return out
