"""Rectangles, colours and page-relative measures as Column expressions.

A rectangle is four columns x0, y0, x1, y1 under an optional prefix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rect = tuple[Column, Column, Column, Column]


def rect(prefix: str = "") -> Rect:
    return tuple(F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1"))


def area(r: Rect) -> Column:
    return F.greatest(F.lit(0), r[2] - r[0]) * F.greatest(F.lit(0), r[3] - r[1])


def center(r: Rect) -> tuple[Column, Column]:
    return (r[0] + r[2]) / 2, (r[1] + r[3]) / 2


def pad(r: Rect, dx, dy=None) -> Rect:
    dy = dx if dy is None else dy
    return r[0] - dx, r[1] - dy, r[2] + dx, r[3] + dy


def intersection(a: Rect, b: Rect) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def overlap(a: Rect, b: Rect) -> Column:
    """Intersection over the smaller area."""
    return F.when(intersection(a, b) > 0, intersection(a, b) / F.greatest(F.lit(1e-9), F.least(area(a), area(b)))).otherwise(F.lit(0.0))


def horizontal_overlap(a: Rect, b: Rect) -> Column:
    inter = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return inter / F.greatest(F.lit(1), F.least(a[2] - a[0], b[2] - b[0]))


def distance2(a: Rect, b: Rect) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def clamp(r: Rect, width: Column, height: Column, margin: float = 0.0) -> Rect:
    """Moved inside the page, and cut where it is larger than the page."""
    lo, w, h = F.lit(margin), F.least(r[2] - r[0], width - 2 * margin), F.least(r[3] - r[1], height - 2 * margin)
    x = F.greatest(lo, F.least(r[0], width - margin - w))
    y = F.greatest(lo, F.least(r[1], height - margin - h))
    return x, y, x + w, y + h


def alignment(r: Rect, content: Rect) -> Column:
    """justify, center, right or left within the content box."""
    cw = F.greatest(F.lit(1.0), content[2] - content[0])
    bw = F.greatest(F.lit(1.0), r[2] - r[0])
    left, right = F.greatest(F.lit(0.0), r[0] - content[0]), F.greatest(F.lit(0.0), content[2] - r[2])
    near, middle = F.greatest(F.lit(8.0), cw * 0.03), F.greatest(F.lit(10.0), cw * 0.06)
    return (
        F.when((bw >= cw * 0.88) & (left <= near) & (right <= near), "justify")
        .when((F.abs(left - right) <= middle) & (bw < cw * 0.88), "center")
        .when((right <= near) & (left > near), "right")
        .otherwise("left")
    )


def indent(r: Rect, content: Rect) -> Column:
    return F.greatest(F.lit(0.0), r[0] - content[0]).cast("double")


def px_to_pt(c: Column, dpi: float = 150.0) -> Column:
    return c * (72.0 / dpi)


def font_points(native: Column, raw_size: Column, height: Column) -> Column:
    """Native sizes are points; others are pixels at 150 dpi, and a missing one is 0.9 of the box height."""
    return F.when(raw_size.isNull() | (raw_size <= 0), height * 0.9).when(native, raw_size).otherwise(raw_size * 0.48)


# Colours


def channel(color: Column, k: int) -> Column:
    """Channel 0 to 2 of #rrggbb or #rgb; null for anything else."""
    c = F.lower(F.regexp_replace(F.trim(color), "^#", ""))
    six = F.when(c.rlike("^[0-9a-f]{6}$"), F.substring(c, 2 * k + 1, 2)).when(c.rlike("^[0-9a-f]{3}$"), F.repeat(F.substring(c, k + 1, 1), 2))
    return F.conv(six, 16, 10).cast("int")


def hex_color(r: Column, g: Column, b: Column) -> Column:
    part = lambda v: F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def int_color(c: Column) -> Column:
    """0xRRGGBB as #rrggbb."""
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(c.bitwiseAND(F.lit(0xFFFFFF)).cast("long")), 6, "0")))


def luminance(r: Column, g: Column, b: Column) -> Column:
    part = lambda v: F.when(v / 255.0 <= 0.03928, v / 255.0 / 12.92).otherwise(F.pow((v / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * part(r) + 0.7152 * part(g) + 0.0722 * part(b)


def contrast_on_white(r: Column, g: Column, b: Column) -> Column:
    return F.lit(1.05) / (luminance(r, g, b) + 0.05)


def readable_color(color: Column, least: float = 4.5) -> Column:
    """The colour, or it darkened to 0.42, or #222222, whichever first has the contrast on white."""
    rgb = [F.coalesce(channel(color, k), F.lit(0)) for k in range(3)]
    dark = [F.floor(v * 0.42).cast("int") for v in rgb]
    return F.when(contrast_on_white(*rgb) >= least, hex_color(*rgb)).when(contrast_on_white(*dark) >= least, hex_color(*dark)).otherwise("#222222")


def color_bucket(color: Column) -> Column:
    """Channels rounded half-even to multiples of 32."""
    return hex_color(*[F.bround(F.coalesce(channel(color, k), F.lit(0)) / 32.0) * 32 for k in range(3)])


def body_color(color: Column, role: Column) -> Column:
    """Body text lighter than 0.82 becomes near black."""
    rgb = [channel(color, k) / 255.0 for k in range(3)]
    light = 0.2126 * rgb[0] + 0.7152 * rgb[1] + 0.0722 * rgb[2]
    return F.when((role == "body") & (light > 0.82), "#101010").otherwise(color)
