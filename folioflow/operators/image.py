"""Pixel operators behind a UDF boundary: pages as binary columns, numpy inside, no image library.

A page is `width`, `height` and `gray` (one byte a pixel, row by row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def otsu(gray: np.ndarray) -> int:
    """The threshold with the largest variance between the two classes."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    rest = w[-1] - w
    ok = (w > 0) & (rest > 0)
    between = np.zeros(256)
    between[ok] = w[ok] * rest[ok] * (s[ok] / w[ok] - (s[-1] - s[ok]) / rest[ok]) ** 2
    return int(between.argmax())


def text_mask(gray: np.ndarray) -> np.ndarray:
    return gray <= otsu(gray)


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x, y, width, height and area of the 8-connected components: runs per row, joined to the row above."""
    root: list[int] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    runs, above = [], []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            i = len(root)
            root.append(i)
            runs.append((a, b, y))
            for c, d, j in above:
                if c <= b and a <= d:
                    root[find(i)] = find(j)
            here.append((a, b, i))
        above = here
    box: dict[int, list[int]] = {}
    for i, (a, b, y) in enumerate(runs):
        c = box.setdefault(find(i), [a, y, b, y + 1, 0])
        c[0], c[2], c[3], c[4] = min(c[0], a), max(c[2], b), max(c[3], y + 1), c[4] + b - a
    return [(x0, y0, x1 - x0, y1 - y0, n) for x0, y0, x1, y1, n in box.values()]


def signatures(gray: np.ndarray) -> dict[str, list]:
    """Component heights, row ink and left edges of a page: inputs of the fidelity operators."""
    mask = text_mask(gray)
    ink = mask.sum(axis=1)
    rows = np.flatnonzero(ink > max(1, int(mask.shape[1] * 0.002)))
    return {
        "heights": [float(h) for _, _, w, h, n in components(mask) if n >= 6 and w >= 2 and h >= 2],
        "ink": ink.astype(int).tolist(),
        "lefts": mask[rows].argmax(axis=1).astype(float).tolist(),
    }


def page_signatures(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, heights, ink and lefts of each page (columns width, height, gray)."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [signatures(np.frombuffer(g, np.uint8).reshape(h, w)) for g, w, h in zip(b.gray, b.width, b.height, strict=True)]
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(found, columns=["heights", "ink", "lefts"])], axis=1)

    return pages.mapInPandas(run, f"{kinds}, heights array<double>, ink array<long>, lefts array<double>")


def fill_boxes(gray: np.ndarray, boxes: list[tuple[int, int, int, int]], pad: int = 2) -> np.ndarray:
    """The page with each padded box filled by the mean of the ring around it."""
    out, (h, w) = gray.copy(), gray.shape
    for x0, y0, x1, y1 in boxes:
        a, b, c, d = max(0, x0 - pad), max(0, y0 - pad), min(w, x1 + pad), min(h, y1 + pad)
        if c <= a or d <= b:
            continue
        ring = gray[max(0, b - 2) : d + 2, max(0, a - 2) : c + 2].astype(float)
        total, n = ring.sum() - gray[b:d, a:c].astype(float).sum(), ring.size - (d - b) * (c - a)
        out[b:d, a:c] = int(round(total / n)) if n else 255
    return out


def changed(before: np.ndarray, after: np.ndarray, limit: float = 22.0) -> bool:
    """Whether a crop changed by more than `limit` grey levels in the mean."""
    return bool(np.abs(before.astype(int) - after.astype(int)).mean() > limit)
