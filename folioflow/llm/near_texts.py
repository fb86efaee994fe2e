"""Near copies by word shingles: SimHash comparison of candidates, settled by exact set similarity.

Texts of 0.8 similarity differ in about 10 of 64 SimHash bits, more than whole blocks of equal bits
can find. So the candidates come from least hashes of shingles, and the bit-sliced comparison, at a
radius for that similarity, decides which of them are worth an exact comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_classes, release_memory, stash, unstash
from .components import components
from .simhash import SEED, planes

SHINGLE = 5
SIMILARITY = 0.8
#: A key hashes ROWS least hashes, a text has BANDS keys. Two texts of similarity s share no key with
#: chance (1 - s^ROWS)^BANDS: 0.0017 at 0.8, 0.00002 at 0.87.
BANDS, ROWS = 16, 5
#: At similarity 0.8 a bit differs with chance 0.15 to 0.19 (few shingles), so 24 of 64 is 3.9 or
#: more standard deviations above the mean; unrelated texts differ in 32.
RADIUS = 24
#: Shingles of one chunk of a candidate group; larger groups meet chunk by chunk.
CHUNK_SHINGLES = 500_000
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPIN = np.random.default_rng(SEED).integers(1 << 63, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
_SPIN[0] |= np.uint64(1)


def shingle_set(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words are one shingle, no words give none."""
    if not words:
        return np.zeros(0, dtype="<u8")
    line, xx = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xx(line, SEED)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    return np.unique(np.array([xx(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8"))


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS signed keys; texts without words share all of theirs."""
    least = np.full(BANDS * ROWS, _ONES)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096] * _SPIN[0] + _SPIN[1]).min(axis=1), out=least)
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text) to (doc_id, h, k, fp, n, keys); k names the text's words, lower-cased."""
    for b in batches:
        k, fp, n, keys = [], [], [], []
        for t in b.column(2):
            words = _words(t.as_py())
            s = shingle_set(words)
            k.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
            fp.append(set_fingerprint(s))
            n.append(len(s))
            keys.append(band_keys(s))
        cols = [b.column(0), b.column(1), pa.array(k, pa.string()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "k", "fp", "n", "keys"])
    release_memory()


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last column, the text, by its shingle set as bytes."""
    for b in batches:
        sets = pa.array([shingle_set(_words(t.as_py())).tobytes() for t in b.column(b.num_columns - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], sets], names=[*b.schema.names[:-1], "bytes"])
    release_memory()


def _beyond(count: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the columns whose count, held in bit planes, is above radius."""
    above, equal = over.copy(), np.full_like(over, _ONES)
    for i in reversed(range(len(count))):
        if radius >> i & 1:
            equal &= count[i]
        else:
            above |= equal & count[i]
            equal &= ~count[i]
    return above


def far(differs: Iterator[np.ndarray], shape: tuple, radius: int) -> np.ndarray:
    """Words whose bits say: more than `radius` planes differ. Ends once all of the block do."""
    count = [np.zeros(shape, dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(shape, dtype=np.uint64)
    for k, carry in enumerate(differs):
        for c in count:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if k >= radius and k % 8 == 7:
            beyond = _beyond(count, over, radius)
            if (beyond == _ONES).all():
                return beyond
    return _beyond(count, over, radius)


def similar_links(fps: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that span the components of one group of texts; each link is exact, pairs joined already are passed over."""
    n, p = len(fps), planes(fps)
    sizes, label, out = np.array([len(s) for s in sets]), np.arange(n), []
    step = max(1, 32768 // p.shape[1])
    for at in range(0, n, step):
        q, first = fps[at : at + step], at // 64
        mine = [np.where((q >> np.uint64(k)) & np.uint64(1), _ONES, np.uint64(0))[:, None] for k in range(64)]
        over = far((p[k][None, first:] ^ m for k, m in enumerate(mine)), (len(q), p.shape[1] - first), radius)
        for r, row in enumerate(over, at):
            near = np.flatnonzero(np.unpackbits((~row).view(np.uint8), bitorder="little")) + first * 64
            near = near[(near > r) & (near < n)]
            if sizes[r]:
                near = near[np.minimum(sizes[near], sizes[r]) / np.maximum(sizes[near], sizes[r]) >= similarity]
            else:
                near = near[sizes[near] == 0]
            near = near[label[near] != label[r]]
            while len(near):
                j, near = near[0], near[1:]
                shared = len(np.intersect1d(sets[r], sets[j], assume_unique=True))
                if not sizes[r] or shared / (sizes[r] + sizes[j] - shared) >= similarity:
                    out.append((r, int(j)))
                    label[label == label[j]] = label[r]
                    near = near[label[near] != label[r]]
    return out


def _piece_links(piece: pa.Table) -> pa.Table:
    k = piece.column("k").to_pylist()
    fps = piece.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    found = similar_links(fps, [np.frombuffer(b, dtype="<u8") for b in piece.column("bytes").to_pylist()])
    return pa.table({"a": pa.array([k[i] for i, _ in found], pa.string()), "b": pa.array([k[j] for _, j in found], pa.string())})


def _text_hash(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _id_name(c: Column) -> Column:
    return F.coalesce(c.cast("long").cast("string"), F.lit(""))


def _candidate_groups(distinct: DataFrame) -> DataFrame:
    """(k, root): texts that share keys, directly or through others. A key links its texts to its least one."""
    keyed = distinct.select("k", F.explode("keys").alias("key"))
    shared = stash(keyed.groupBy("key").agg(F.min("k").alias("low"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "near-keys")
    total = shared.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    edges = join_classes(keyed, shared, ["key"], "m", total).filter("k != low").select(F.col("k").alias("a"), F.col("low").alias("b")).distinct()
    groups = stash(components(edges).select(F.col("node").alias("k"), "root"), "near-groups")
    unstash(shared)
    return groups


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """One row of docs for each component: the one with the smallest id, nulls last, then the smallest text hash.

    Texts link if the sets of their 5-word shingles (A-Z lower-cased, words as in op6) have a Jaccard
    similarity of 0.8 or more; each link is checked exactly. Pairs that share none of their BANDS keys
    or differ in over RADIUS bits are missed, with the chances given there. Fewer than five words are
    one shingle. Null and empty texts, and texts of white space, are one component; repeated rows and
    texts with equal words always are. An empty table gives no rows; other columns, of any name, are
    kept. A candidate group of over `chunk_shingles` shingles is cut into chunks by hash and each pair
    of chunks is a piece of work of its own; nothing is left out.
    """
    cols = [F.col(id_col).cast("long").alias("doc_id"), _text_hash(text_col).alias("h"), F.col(text_col).cast("string").alias("text")]
    rows = stash(docs.select(*cols).mapInArrow(_sketch, "doc_id long, h string, k string, fp long, n long, keys array<long>"), "near-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    # fp, n and keys follow from k.
    distinct = stash(rows.groupBy("k", "fp", "n", "keys").agg(first), "near-distinct")
    unstash(rows)
    groups = _candidate_groups(distinct)
    chunks = groups.join(distinct.select("k", "n"), "k").groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / chunk_shingles)).cast("int").alias("c"), F.count(F.lit(1)).alias("m"))
    members = join_classes(groups, stash(chunks, "near-chunks"), ["root"], "m", groups.count()).join(distinct.select("k", "fp", "first"), "k")
    keys = ["__id", "__h"]
    members = members.select(_id_name(F.col("first.doc_id")).alias("__id"), F.col("first.h").alias("__h"), "k", "fp", "root", "c")
    texts = docs.select(_id_name(F.col(id_col)).alias("__id"), _text_hash(text_col).alias("__h"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(members, keys).dropDuplicates(["k"]).select("k", "fp", "root", "c", "text")
    found = found.mapInArrow(_with_sets, "k string, fp long, root string, c int, bytes binary")
    found = found.withColumn("own", F.pmod(F.xxhash64("k"), F.col("c")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    # A piece (own, own) is part of every piece (own, other), so it is one of its own only in groups of one chunk.
    found = found.filter((F.col("c") == 1) | (F.col("own") != F.col("x")))
    pieces = found.select("root", F.least("own", "x").alias("left"), F.greatest("own", "x").alias("right"), "k", "fp", "bytes")
    links = stash(pieces.groupBy("root", "left", "right").applyInArrow(_piece_links, "a string, b string"), "near-links")
    named = components(links).select(F.col("node").alias("k"), "root")
    best = distinct.join(named, "k", "left").groupBy(F.coalesce("root", "k").alias("root")).agg(F.min("first").alias("first"))
    best = best.select(_id_name(F.col("first.doc_id")).alias("__id"), F.col("first.h").alias("__h"))
    mine = docs.withColumns({"__id": _id_name(F.col(id_col)), "__h": _text_hash(text_col)})
    return mine.join(best, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
