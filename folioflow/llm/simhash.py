"""SimHash near-dedup with bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_classes, release_memory, stash, unstash
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: 64 bits in 5 blocks: fingerprints within 3 bits agree on 2 whole blocks at least, so each of the
#: 10 pairs of blocks is a key and every link shares one.
BLOCKS = (13, 13, 13, 13, 12)
#: Members of a bucket that meet in one piece of work; larger buckets are compared chunk by chunk.
CHUNK = 4096
SMALL = 12
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the whole text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, xx = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return xx(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    h = np.array([xx(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    lanes = h.view(np.uint8).reshape(n, 8)
    if n < 200:
        counts = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])
        release_memory()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes (64, words): bit i of plane k is bit k of fingerprint i."""
    n = len(fps)
    wide = np.zeros(-(-n // 64) * 64, dtype="<u8")
    wide[:n] = fps
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _count_over(differs: Iterator[np.ndarray], shape: tuple, radius: int, alive=None) -> np.ndarray:
    """Words whose bits say: more than `radius` (at most 3) planes differ. Carry-save counting."""
    one, two, over = (np.zeros(shape, dtype=np.uint64) for _ in range(3))
    for k, d in enumerate(differs):
        carry = one & d
        one ^= d
        over |= two & carry
        two ^= carry
        if k % 8 == 7:
            beyond = over if radius == 3 else over | (two & one if radius == 2 else two)
            if (beyond == _ONES).all():
                return beyond
    return over if radius == 3 else over | (two & one if radius == 2 else two if radius == 1 else two | one)


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Mask of the positions where a and b differ in at most `radius` bits, block by block of 4096."""
    out = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 4096):
        x = a[at : at + 4096] ^ b[at : at + 4096]
        p = planes(x)
        over = _count_over(iter(p), p.shape[1:], radius)
        out[at : at + len(x)] = ~np.unpackbits(over.view(np.uint8), bitorder="little")[: len(x)].astype(bool)
    return out


def group_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one bucket: (member, root). All pairs are compared, few returned."""
    n, p = len(fps), planes(fps)
    words, label = p.shape[1], np.arange(n)
    varying = [k for k in range(64) if 0 < int(np.bitwise_count(p[k]).sum()) < n]
    step = max(1, 32768 // words)
    for at in range(0, n, step):
        q = fps[at : at + step]
        first = at // 64
        mine = [np.where((q >> np.uint64(k)) & np.uint64(1), _ONES, np.uint64(0))[:, None] for k in varying]
        over = _count_over((p[k][None, first:] ^ m for k, m in zip(varying, mine, strict=True)), (len(q), words - first), radius)
        rows = np.flatnonzero((over != _ONES).any(axis=1))
        for r in rows:
            near = np.flatnonzero(np.unpackbits((~over[r]).view(np.uint8), bitorder="little")) + first * 64
            near = near[(near < n) & (near > at + r)]
            if not len(near):
                continue
            seen = np.unique(np.append(label[near], label[at + r]))
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (band, key, left, right) with column fp; gives links (a, b)."""

    def emit(keys: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        new = np.ones(len(fps), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fps)))
        out = []
        size_of = np.repeat(sizes, sizes)
        small = (size_of > 1) & (size_of <= SMALL)
        k = np.repeat(np.arange(len(starts)), sizes)[small]
        f = fps[small]
        for o in range(1, SMALL):
            if len(f) <= o:
                break
            same = np.flatnonzero(k[o:] == k[:-o])
            if not len(same):
                break
            ok = same[pairs_within(f[same], f[same + o])]
            out.append((f[ok], f[ok + o]))
        for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            g = fps[s : s + m]
            i, j = group_links(g)
            out.append((g[i], g[j]))
        return out

    kept_k, kept_f = np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def pack(found: list) -> Iterator[pa.RecordBatch]:
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        kept_k = np.concatenate([kept_k, np.stack(cols[:4], axis=1).astype(np.int64)])
        kept_f = np.concatenate([kept_f, cols[4].astype(np.int64).view(np.uint64)])
        last = np.flatnonzero((kept_k != kept_k[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        yield from pack(emit(kept_k[:cut], kept_f[:cut]) if cut else [])
        kept_k, kept_f = kept_k[cut:], kept_f[cut:]
    if len(kept_f):
        yield from pack(emit(kept_k, kept_f))


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that span all components at RADIUS.

    Buckets of over `chunk` members are cut into chunks by hash, and each pair of chunks is a piece
    of work of its own; nothing is left out.
    """
    at, spans = 0, []
    for w in BLOCKS:
        spans.append(((1 << w) - 1) << at)
        at += w
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    masks = [signed(a | b) for a, b in combinations(spans, 2)]
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    rows = distinct.select("fp", bands.alias("x")).select("x.band", "x.key", "fp")
    large = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > chunk)
    rows = rows.join(large, ["band", "key"], "left")
    chunks = F.ceil(F.coalesce(F.col("m"), F.lit(1)) / chunk).cast("int")
    rows = rows.withColumn("c", chunks).withColumn("own", F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("c")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    work = rows.select("band", "key", F.least("own", "x").alias("left"), F.greatest("own", "x").alias("right"), "fp")
    keys = ["band", "key", "left", "right"]
    return work.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_bucket_links, "a long, b long").distinct()


def _rooted(fps: DataFrame, *more: Column) -> DataFrame:
    """Per distinct fp: n, the aggregates `more`, and root, which is equal inside a component."""
    distinct = stash(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), *more), "simhash-distinct")
    found = stash(links(distinct), "simhash-links")
    roots = stash(components(found).select(F.col("node").alias("fp"), "root"), "simhash-roots")
    unstash(found)
    return stash(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-classes")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id, component_size.

    component_id is the smallest id reachable over links of RADIUS bits or fewer. Null and empty texts
    have fingerprint zero and link like any other; null ids are never a component_id unless all ids of
    the component are null; repeated rows each get a row; an empty table gives no rows; other columns
    are ignored. Copies collapse to their fingerprint before any comparison.
    """
    fps = stash(fingerprints(docs, id_col, text_col), "simhash-fps")
    total = fps.count()
    classes = _rooted(fps, F.min("doc_id").alias("low"))
    per_root = stash(classes.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_size"), F.count(F.lit(1)).alias("members")), "simhash-components")
    classes = join_classes(classes.select("fp", "n", "root"), per_root, ["root"], "members", total)
    classes = stash(classes.select("fp", "n", "component_id", "component_size"), "simhash-named")
    out = join_classes(fps, classes, ["fp"], "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")
