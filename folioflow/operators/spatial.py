"""Joins on rectangles. Every join has the page keys as equi-keys, so it is partitioned by page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T


def _pair(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    a, b = a.alias("a"), b.alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a, b, on


def _rects() -> tuple[G.Rect, G.Rect]:
    return G.rect("a."), G.rect("b.")


def not_covered(words: DataFrame, blocks: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Words of positive area of which no block covers more than `share`."""
    a, b, on = _pair(words.filter(G.area(G.rect()) > 0), blocks, keys)
    ra, rb = _rects()
    return a.join(b, on & (G.intersection(ra, rb) / G.area(ra) > share), "left_anti")


def covered_any(items: DataFrame, zones: DataFrame, keys: list[str], share: float = 0.25, how: str = "left_semi") -> DataFrame:
    """Items of which some zone covers `share` of their area or more (left_semi), or none does (left_anti)."""
    a, b, on = _pair(items, zones, keys)
    ra, rb = _rects()
    return a.join(b, on & (G.area(ra) > 0) & (G.intersection(ra, rb) / F.greatest(F.lit(1e-9), G.area(ra)) >= share), how)


def overlapping_any(items: DataFrame, others: DataFrame, keys: list[str], ratio: float = 0.25, how: str = "left_semi") -> DataFrame:
    """Items that overlap another rectangle by `ratio` of the smaller area or more."""
    a, b, on = _pair(items, others, keys)
    ra, rb = _rects()
    return a.join(b, on & (G.intersection(ra, rb) > 0) & (G.overlap(ra, rb) >= ratio), how)


def unprotected_regions(phrases: DataFrame, zones: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Phrase boxes outside protected zones; on pages without any, the block boxes outside them."""
    cols = [*keys, "x0", "y0", "x1", "y1"]
    mine = covered_any(phrases.filter("x1 > x0 and y1 > y0"), zones, keys, 0.25, "left_anti").select(*cols)
    rest = covered_any(blocks.filter("x1 > x0 and y1 > y0"), zones, keys, 0.25, "left_anti").select(*cols)
    return mine.unionByName(rest.join(mine.select(*keys).distinct(), keys, "left_anti"))


def drop_recognised_duplicates(recognised: DataFrame, native: DataFrame, keys: list[str]) -> DataFrame:
    """Recognised blocks that no native block repeats: by place and text, similar words, or place alone."""
    a, b, on = _pair(recognised, native, keys)
    ra, rb = _rects()
    ov, ta, tb = G.overlap(ra, rb), T.norm_text("a.t"), T.norm_text("b.t")
    both = (ta != "") & (tb != "")
    same = both & ((ta == tb) | F.contains(tb, ta) | F.contains(ta, tb))
    near = both & (T.jaccard(T.tokens("a.t"), T.tokens("b.t")) >= 0.72)
    return a.join(b, on & (ov >= 0.35) & (same | near | (ov >= 0.70)), "left_anti")


def union_native(recognised: DataFrame, native: DataFrame, keys: list[str]) -> DataFrame:
    return native.unionByName(drop_recognised_duplicates(recognised, native, keys), allowMissingColumns=True)


def overlap_pairs(items: DataFrame, keys: list[str], ident: str, ratio: float = 0.25, band: int | None = None) -> DataFrame:
    """Pairs (a, b) of items of a page that overlap by more than `ratio` of the smaller.

    With `band`, items meet only in the bands of that height that both touch, and a pair counts in the
    first of them: the same pairs, without comparing all items of a page.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(band)).cast("long")
    if band:
        items = items.filter("y1 > y0").withColumn("__band", F.explode(F.sequence(at("y0"), at("y1"))))
    a, b, on = _pair(items, items, [*keys, "__band"] if band else keys)
    if band:
        on = on & (F.col("a.__band") == F.greatest(at("a.y0"), at("b.y0")))
    ra, rb = _rects()
    hit = on & (F.col(f"a.{ident}") < F.col(f"b.{ident}")) & (G.intersection(ra, rb) > 0) & (G.overlap(ra, rb) > ratio)
    return a.join(b, hit).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{ident}").alias("a"), F.col(f"b.{ident}").alias("b"), G.overlap(ra, rb).alias("ratio"))


def text_image_collisions(blocks: DataFrame, images: DataFrame, pages: DataFrame, keys: list[str], ratio: float = 0.10, full_page: float = 0.95) -> DataFrame:
    """Text blocks that overlap an image other than those of nearly page size. pages: keys, width, height."""
    small = images.join(pages, keys).filter(G.area(G.rect()) / F.greatest(F.lit(1e-9), F.col("width") * F.col("height")) < full_page).drop("width", "height")
    a, b, on = _pair(blocks, small, keys)
    ra, rb = _rects()
    return a.join(b, on & (G.intersection(ra, rb) > 0) & (G.overlap(ra, rb) > ratio), "left_semi")


def off_page(words: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    return words.join(pages, keys).filter("x0 < 0 or y0 < 0 or x1 > width or y1 > height").select(*words.columns)


def nearest(items: DataFrame, anchors: DataFrame, keys: list[str], item: str, anchor: str, dx: float, dy: float) -> DataFrame:
    """For each item the anchor with the nearest centre among those whose padded box meets it; ties by anchor id."""
    a, b, on = _pair(items, anchors, keys)
    ra, rb = _rects()
    hit = on & (G.intersection(ra, G.pad(rb, dx, dy)) > 0)
    d = a.join(b, hit).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{item}").alias(item), F.col(f"b.{anchor}").alias("__b"), G.distance2(ra, rb).alias("d2"))
    return d.groupBy(*keys, item).agg(F.min_by("__b", F.struct("d2", "__b")).alias(anchor), F.min("d2").alias("d2"))


def inline_equations(blocks: DataFrame, keys: list[str], ident: str = "block_id") -> DataFrame:
    """Small blocks that belong inside a paragraph: (keys, block_id, into), the first paragraph by id."""
    roles = F.col("role").isin("body", "title", "section_heading") & (F.col("source") == "native")
    b = blocks.filter(roles & (G.area(G.rect()) > 0)).withColumn("n", F.length(T.norm_text("t")))
    large, small = b.filter("n >= 80"), b.filter((F.col("n") <= 28) & ~T.is_equation_like("t"))
    s, p, on = _pair(small, large, keys)
    rs, rp = _rects()
    inside = (rs[0] >= rp[0] - 16) & (rs[2] <= rp[2] + 16) & (rs[1] >= rp[1] - 12) & (rs[3] <= rp[3] + 20)
    hit = on & (F.col(f"a.{ident}") != F.col(f"b.{ident}")) & (G.area(rs) / F.greatest(F.lit(1.0), G.area(rp)) <= 0.10) & ((G.intersection(rs, rp) / F.greatest(F.lit(1.0), G.area(rs)) > 0.45) | inside)
    return s.join(p, hit).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{ident}").alias(ident)).agg(F.min(f"b.{ident}").alias("into"))


# Greedy and iterative operators: the state is a page's accepted boxes, so a page is a group.


def _grouped(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(fn, schema)


def _ddl(df: DataFrame, *cols: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*cols).schema)


def _meet(a, b) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


#: Covering candidates per word from which a page is taken word by word, so pairs stay bounded.
CROWDED = 64


def _whole_pages(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], columns: list[str]) -> DataFrame:
    """fn(rows, sizes) over many whole pages at a time, which returns `columns`; sizes are the pages' numbers of rows, in order.

    The window brings a page's rows together, by the partitions and order the rows already have where
    these suffice, and says where a page ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, need = [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            need = need or b.column("__n")[0].as_py()
            if rows < need:  # the first page held is not whole yet
                continue
            t = pa.Table.from_batches(held)
            n, sizes, at = t.column("__n").to_numpy(), [], 0
            while at < rows and at + n[at] <= rows:
                sizes.append(int(n[at]))
                at += sizes[-1]
            yield from fn(t.slice(0, at).drop_columns("__n"), np.array(sizes)).to_batches()
            held, rows = t.slice(at).to_batches(), rows - at
            need = int(n[at]) if rows else 0
        if rows:
            raise ValueError("a page was cut")

    counted = df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return counted.mapInArrow(run, df.select(*columns).schema)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    x = column.to_numpy()
    return x.astype(float) if x.dtype == object else x


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values, nulls last."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    at = pd.factorize(column.to_pandas(), sort=True)[0]
    return np.where(at < 0, len(at), at)


def _spread(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, value): for each position at, the n[at] numbers from low[at]."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n - low, n)


def _centre_hits(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(box, first, n, by): centres by[first:first + n] of the same page and band have an x inside the box.

    Bands have the mean height of a page's boxes, so all boxes together touch at most three per box.
    """
    tall = np.bincount(page, y1 - y0) / np.maximum(1, np.bincount(page))
    low, high, mid = (np.floor(y / tall[page]).astype(np.int64) for y in (y0, y1, (y0 + y1) / 2))
    base, width = low.min(), int(high.max() - low.min()) + 1
    xs, x = np.unique(x0 + x1, return_inverse=True)
    bands, band = np.unique(page * width + (mid - base), return_inverse=True)
    point = band * len(xs) + x
    by = np.argsort(point, kind="stable")
    point = point[by]
    first = np.searchsorted(bands, page * width + (low - base))
    box, band = _spread(first, np.searchsorted(bands, page * width + (high - base), "right") - first)
    left = np.searchsorted(point, band * len(xs) + np.searchsorted(xs, 2 * x0)[box])
    right = np.searchsorted(point, band * len(xs) + np.searchsorted(xs, 2 * x1, "right")[box])
    hit = right > left
    return box[hit], left[hit], (right - left)[hit], by


def _repeated(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, order: np.ndarray, labels: pa.Array, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Words that an accepted one covers, of candidate pairs (one, two): by rounds over the pairs left."""
    size = (x1 - x0) * (y1 - y0)
    ahead = (size[one] > size[two]) | ((size[one] == size[two]) & ((order[one] < order[two]) | ((order[one] == order[two]) & (one < two))))
    one, two = one[ahead], two[ahead]
    wide = np.minimum(x1[one], x1[two]) - np.maximum(x0[one], x0[two])
    tall = np.minimum(y1[one], y1[two]) - np.maximum(y0[one], y0[two])
    covered = (wide > 0) & (tall > 0)
    covered &= wide * tall / size[two] > 0.85
    one, two = one[covered], two[covered]
    a, b = labels.take(pa.array(one)), labels.take(pa.array(two))
    inside = pc.equal(a, b).to_numpy(zero_copy_only=False)
    other = np.flatnonzero(~inside)
    inside[other] = [y.lower() in x.lower() for x, y in zip(a.take(pa.array(other)).to_pylist(), b.take(pa.array(other)).to_pylist(), strict=True)]
    one, two = one[inside], two[inside]
    gone = np.zeros(len(size), dtype=bool)
    while len(one):
        open_ = np.zeros(len(size), dtype=bool)
        open_[two] = True
        gone[two[~open_[one]]] = True
        left = ~gone[one] & ~gone[two]
        one, two = one[left], two[left]
    return gone


def _repeated_one_by_one(x0: list, y0: list, x1: list, y1: list, order: list, labels: list[str]) -> list[int]:
    """The same for one page, word by word with a grid of accepted words."""
    size = [(c - a) * (d - b) for a, b, c, d in zip(x0, y0, x1, y1, strict=True)]
    # Accepted words by the cells they touch, as only those that meet a word can cover it.
    wide, tall = max(1.0, sum(x1) / len(x1) - sum(x0) / len(x0)), max(1.0, sum(y1) / len(y1) - sum(y0) / len(y0))
    grid, gone = {}, []
    for at in sorted(range(len(size)), key=lambda i: (-size[i], order[i])):
        box, label = (x0[at], y0[at], x1[at], y1[at]), labels[at].lower()
        across = range(int(box[0] // wide), int(box[2] // wide) + 1)
        cells = [(x, y) for y in range(int(box[1] // tall), int(box[3] // tall) + 1) for x in across]
        if any(_meet(box, other) / size[at] > 0.85 and label in word for c in cells for other, word in grid.get(c, ())):
            gone.append(at)
        else:
            for c in cells:
                grid.setdefault(c, []).append((box, label))
    return gone


def dedupe_words(words: DataFrame, keys: list[str], order: str = "word_id", columns: list[str] | None = None) -> DataFrame:
    """Words, large to small, that no accepted word covers by over 0.85 with a label containing theirs.

    A word that covers another by over a half holds its centre, so the pairs to judge are found by centres.
    With `columns`, the words' other columns are left out of the result.
    """
    columns = columns or words.columns

    def run(t: pa.Table, sizes: np.ndarray) -> pa.Table:
        x0, y0, x1, y1 = (_numbers(t.column(c)) for c in ("x0", "y0", "x1", "y1"))
        live = np.flatnonzero((x1 > x0) & (y1 > y0))  # others meet nothing
        if not len(live):
            return t.select(columns)
        page = np.repeat(np.arange(len(sizes)), sizes)[live]
        x0, y0, x1, y1 = (c[live] for c in (x0, y0, x1, y1))
        rank = _ranks(t.column(order))[live]
        labels = pc.fill_null(t.column("label"), "").combine_chunks().take(pa.array(live))
        box, first, n, by = _centre_hits(page, x0, y0, x1, y1)
        crowded = np.bincount(page[box], n, len(sizes)) > CROWDED * np.bincount(page, minlength=len(sizes))
        few = ~crowded[page[box]]
        at, point = _spread(first[few], n[few])
        gone = _repeated(x0, y0, x1, y1, rank, labels, box[few][at], by[point])
        for p in np.flatnonzero(crowded):
            on = np.flatnonzero(page == p)
            again = _repeated_one_by_one(*(c[on].tolist() for c in (x0, y0, x1, y1, rank)), labels.take(pa.array(on)).to_pylist())
            gone[on[again]] = True
        keep = np.ones(t.num_rows, dtype=bool)
        keep[live[gone]] = False
        return t.select(columns).filter(pa.array(keep))

    return _whole_pages(words, keys, run, columns)


def dedupe_spans(spans: DataFrame, keys: list[str], order: str, share: float = 0.6) -> DataFrame:
    """Spans in order without those whose text an earlier kept one has at the same place."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(order, kind="stable")
        kept, rows = {}, []
        for at, r in enumerate(page.itertuples(index=False)):
            key, box = " ".join((r.t or "").lower().split()), (r.x0, r.y0, r.x1, r.y1)
            size = (r.x1 - r.x0) * (r.y1 - r.y0)
            if key and any(_meet(box, o) / max(1e-9, min(size, (o[2] - o[0]) * (o[3] - o[1]))) >= share for o in kept.get(key, ())):
                continue
            kept.setdefault(key, []).append(box)
            rows.append(at)
        return page.iloc[rows]

    return _grouped(spans, keys, run, _ddl(spans, *spans.columns))


def dedupe_translated_blocks(blocks: DataFrame, keys: list[str], order: str, share: float = 0.55) -> DataFrame:
    """Blocks in order without those that an earlier kept one overlaps with a text that contains, or is in, theirs."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(order, kind="stable")
        kept, rows = [], []
        for at, r in enumerate(page.itertuples(index=False)):
            t, box = " ".join((r.t or "").split()), (r.x0, r.y0, r.x1, r.y1)
            size = max(1.0, (r.x1 - r.x0) * (r.y1 - r.y0))
            again = False
            for o, k in kept:
                m = _meet(box, o)
                if m > 0 and m / max(1.0, min(size, max(1.0, (o[2] - o[0]) * (o[3] - o[1])))) >= share and t and k and (t in k or k in t):
                    again = True
                    break
            if not again:
                kept.append((box, t))
                rows.append(at)
        return page.iloc[rows]

    return _grouped(blocks, keys, run, _ddl(blocks, *blocks.columns))


def label_groups(labels: DataFrame, keys: list[str], ident: str, pad: float = 14.0, least: int = 3) -> DataFrame:
    """(keys, ident, grp): connected components of padded label boxes; grp is the smallest id.

    Components under `least` members, and pages with fewer labels, leave every label on its own.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        ids = page[ident].tolist()
        boxes = [(a - pad, b - pad, c + pad, d + pad) for a, b, c, d in zip(page.x0, page.y0, page.x1, page.y1, strict=True)]
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        near = []  # from top to bottom, so only boxes that still reach down to the next one are compared
        for i in sorted(range(len(ids)), key=lambda i: boxes[i][1]):
            near = [j for j in near if boxes[j][3] > boxes[i][1]]
            for j in near:
                if _meet(boxes[i], boxes[j]) > 0:
                    root[find(i)] = find(j)
            near.append(i)
        roots = pd.Series([find(i) for i in range(len(ids))])
        low = pd.Series(ids).groupby(roots).transform("min")
        n = pd.Series(ids).groupby(roots).transform("size")
        out = page[[*keys, ident]].reset_index(drop=True)
        out["grp"] = low.where((n >= least) & (len(ids) >= least), pd.Series(ids))
        return out

    kind = labels.schema[ident].dataType.simpleString()
    return _grouped(labels, keys, run, _ddl(labels, *keys, ident) + f", grp {kind}")


def merge_overlapping(labels: DataFrame, keys: list[str], ident: str, ratio: float = 0.22) -> DataFrame:
    """Merged boxes (keys, first id, x0..y1, n): boxes that overlap are joined, in order, until none do."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        items = [[i, (a, b, c, d), 1] for i, a, b, c, d in page.sort_values(["y0", "x0", ident])[[ident, "x0", "y0", "x1", "y1"]].itertuples(index=False)]
        changed = True
        while changed:
            changed, done = False, []
            while items:
                i, box, n = items.pop(0)
                rest = []
                for j, other, m in items:
                    size = max(1.0, min((box[2] - box[0]) * (box[3] - box[1]), (other[2] - other[0]) * (other[3] - other[1])))
                    if _meet(box, other) / size >= ratio:
                        box, n, changed = (min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3])), n + m, True
                    else:
                        rest.append([j, other, m])
                items = rest
                done.append([i, box, n])
            items = sorted(done, key=lambda x: (x[1][1], x[1][0]))
        out = pd.DataFrame([(i, *b, n) for i, b, n in items], columns=[ident, "x0", "y0", "x1", "y1", "n"])
        for k in keys:
            out[k] = page[k].iloc[0]
        return out[[*keys, ident, "x0", "y0", "x1", "y1", "n"]]

    return _grouped(labels, keys, run, _ddl(labels, *keys, ident, "x0", "y0", "x1", "y1") + ", n int")
