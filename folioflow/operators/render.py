"""Placing text on pages. The state runs down a page, so a page is a group; results are draw commands.

Text width comes from an injected measure(text, size, font); the default is half an em per character.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

Measure = Callable[[str, float, str], float]
LINE_HEIGHT = 1.22
COMMANDS = "line int, t string, x double, y double, size double"


def half_em(text: str, size: float, font: str) -> float:
    return 0.5 * size * len(text)


def wrap(text: str, width: float, size: float, font: str = "", measure: Measure = half_em, split_long: bool = True) -> list[str]:
    """Lines of whole words within width; a word that is wider alone is cut, or left whole."""
    lines, cur = [], ""
    for word in text.split():
        cand = f"{cur} {word}" if cur else word
        if measure(cand, size, font) <= width:
            cur = cand
            continue
        if cur:
            lines.append(cur)
        cur = word
        while split_long and len(cur) > 1 and measure(cur, size, font) > width:
            n = len(cur) - 1
            while n > 1 and measure(cur[:n], size, font) > width:
                n -= 1
            lines.append(cur[:n])
            cur = cur[n:]
    return lines + [cur] if cur else lines


def fit(text: str, width: float, height: float, size: float, font: str = "", measure: Measure = half_em, smallest: float = 7.0, step: float = 0.25, shrink: float = 3.0) -> tuple[list[str], float, str]:
    """Lines that fit the box, the size used, and the text that is left over at the smallest size."""
    low, s = max(smallest, size - shrink), size
    while True:
        lines = wrap(text, width, s, font, measure)
        room = max(0, int((height + 1e-9) // (s * LINE_HEIGHT)))
        if len(lines) <= room:
            return lines, s, ""
        if s - step < low:
            return lines[:room], s, " ".join(lines[room:])
        s -= step


def _apply(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.groupBy(*keys).applyInPandas(fn, f"{kinds}, {schema}")


def compose(boxes: DataFrame, keys: list[str], measure: Measure = half_em) -> DataFrame:
    """Draw commands and overflow of texts in their own boxes. boxes: keys, block_id, t, size, font, box."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in page.sort_values(["y0", "x0", "block_id"]).itertuples(index=False):
            lines, size, rest = fit(r.t or "", r.x1 - r.x0, r.y1 - r.y0, float(r.size), r.font, measure)
            for i, t in enumerate(lines):
                out.append((r.block_id, i, t, float(r.x0), float(r.y0 + (i + 1) * size * LINE_HEIGHT), size, rest if i + 1 == len(lines) else ""))
            if not lines:
                out.append((r.block_id, 0, "", float(r.x0), float(r.y0), size, rest))
        res = pd.DataFrame(out, columns=["block_id", "line", "t", "x", "y", "size", "overflow"])
        for k in keys:
            res[k] = page[k].iloc[0]
        return res

    return _apply(boxes, keys, run, f"block_id {boxes.schema['block_id'].dataType.simpleString()}, {COMMANDS}, overflow string")


def flow(items: DataFrame, keys: list[str], width: float, height: float, margin: float = 36.0, gap: float = 6.0, measure: Measure = half_em) -> DataFrame:
    """Draw commands of items one below the other, with a new page when a line does not fit. items: keys, ord, t, size, font."""

    def run(doc: pd.DataFrame) -> pd.DataFrame:
        out, page, y = [], 0, margin
        for r in doc.sort_values("ord").itertuples(index=False):
            size = float(r.size)
            for i, t in enumerate(wrap(r.t or "", width - 2 * margin, size, r.font, measure)):
                if y + size * LINE_HEIGHT > height - margin and y > margin:
                    page, y = page + 1, margin
                y += size * LINE_HEIGHT
                out.append((r.ord, page, i, t, margin, y, size))
            y += gap
        res = pd.DataFrame(out, columns=["ord", "page", "line", "t", "x", "y", "size"])
        for k in keys:
            res[k] = doc[k].iloc[0]
        return res

    return _apply(items, keys, run, f"ord {items.schema['ord'].dataType.simpleString()}, page int, {COMMANDS}")


def push_down(blocks: DataFrame, keys: list[str], zones: DataFrame, margin: float = 15.0, pushes: int = 10) -> DataFrame:
    """Blocks top down, each moved below the blocks and zones it meets: (keys, block_id, y0, y1)."""
    z = zones.groupBy(*keys).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("__z"))
    both = blocks.join(z, keys, "left")

    def run(page: pd.DataFrame) -> pd.DataFrame:
        zs = page["__z"].iloc[0]
        zs = [] if zs is None else [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in zs]
        out, placed = [], []
        for r in page.sort_values(["y0", "x0", "block_id"]).itertuples(index=False):
            h, y = r.y1 - r.y0, r.y0
            for a, b, c, d in placed:
                if a < r.x1 and r.x0 < c and b < y + h and y < d:
                    y = max(y, d + margin)
            for _ in range(pushes):
                hit = [d for a, b, c, d in zs if a < r.x1 and r.x0 < c and b < y + h and y < d]
                if not hit:
                    break
                y = max(hit) + margin
            placed.append((r.x0, y, r.x1, y + h))
            out.append((r.block_id, float(y), float(y + h)))
        res = pd.DataFrame(out, columns=["block_id", "y0", "y1"])
        for k in keys:
            res[k] = page[k].iloc[0]
        return res

    return _apply(both, keys, run, f"block_id {blocks.schema['block_id'].dataType.simpleString()}, y0 double, y1 double")


def first_free(box: tuple, taken: list[tuple], height: float, step: float, most: int = 24) -> tuple | None:
    """The box shifted down by whole steps, `most` at most, to the first place that is free and on the page."""
    x0, y0, x1, y1 = box
    for k in range(most + 1):
        b, d = y0 + k * step, y1 + k * step
        if d > height:
            return None
        if not any(a < x1 and x0 < c and e < d and b < f for a, e, c, f in taken):
            return x0, b, x1, d
    return None


def place_spans(spans: DataFrame, width, height) -> DataFrame:
    """Draw commands at the spans' own places: sizes in points, baselines at 0.8 of the height, inside the page."""
    r = G.clamp(G.rect(), F.lit(width), F.lit(height))
    size = G.font_points(F.col("native"), F.col("size"), r[3] - r[1])
    return spans.withColumn("x", r[0].cast("double")).withColumn("y", (r[1] + 0.8 * (r[3] - r[1])).cast("double")).withColumn("size_pt", size)


def distinct_commands(commands: DataFrame, keys: list[str]) -> DataFrame:
    """Draw commands without repeats of the same text at the same rounded place and size; the first stays."""
    from .units import first_distinct

    d = commands.withColumn("__x", F.bround("x", 1)).withColumn("__y", F.bround("y", 1)).withColumn("__s", F.bround("size", 1))
    return first_distinct(d, [*keys, "__x", "__y", "__s", "t"], "line").drop("__x", "__y", "__s")


def strategy(translated, native, sequential) -> "F.Column":
    """How a page is drawn: anchored, strict, sequential or flow."""
    return F.when(translated, "anchored").when(native, "strict").when(sequential, "sequential").otherwise("flow")
