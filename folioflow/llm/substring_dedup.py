"""Substring dedup over the de Bruijn graph of token k-mers.

A window of `k` words is an edge. Documents are dealt into blocks; each block sends its distinct
edges, sorted and delta-coded, to the bucket of their hash range, and the bucket answers with those
whose hash starts at two places or more. These are candidates: stretches of candidate windows that
share their least 8-word run are sent, as words, to that run's bucket, where windows are compared word
by word and counted over all sources; windows that only share a hash are refuted and stay.

A run of repeated edges in a document is a walk in the graph of repeated edges. Walks are cut where
the edge itself says so (a sampled hash), so equal stretches are cut alike; the pieces and their
successions are compacted into nonbranching paths by Spark joins, and the source coordinates of the
paths' pieces give the words that a document loses.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_classes, stash
from .components import components

WINDOW = 35
BLOCK_BYTES = 12_000_000
#: One repeated edge in CUT ends a piece.
CUT = 128
#: Words of the run whose least hash in a window names the bucket that compares the window's words.
MINI = 8
HASH_BITS = 64
#: Fixed odd multipliers of the rolling hashes (mod 2^64).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Block:
    """The words of a block's texts and their rolling hashes. Word hashes are 64-bit XXH64."""

    def __init__(self, texts: list[str | None], k: int, bits: int = HASH_BITS) -> None:
        self.k, self.mask = k, np.uint64((1 << bits) - 1)
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        n = int(self.ends[-1]) if len(texts) else 0
        self.h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(self.words)), dtype=np.uint64, count=n)
        self.prefix: dict[int, np.ndarray] = {}
        # Starts of windows that stay inside their document.
        left = np.repeat(self.ends, self.sizes) - np.arange(n)
        self.starts = np.flatnonzero(left >= k)

    def rolled(self, base: int, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Hash of the words [at, to) for arrays of positions; equal words give equal hashes anywhere."""
        if base not in self.prefix:
            n = len(self.h)
            p = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.h * _powers(base, n), out=p[1:])
            self.prefix[base] = p
        p = self.prefix[base]
        back = _powers(pow(base, -1, 1 << 64), len(self.h) + 1)
        return (p[to] - p[at]) * back[at]

    def edges(self) -> np.ndarray:
        return self.rolled(BASES[0], self.starts, self.starts + self.k) & self.mask

    def least_runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows that start at `at`: the hash of their least MINI-word run, and where it starts; the first of ties."""
        mini = min(MINI, self.k)
        n, span = len(self.h), self.k - mini + 1
        where = np.arange(n)
        low = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
        fits = where[: max(0, n - mini + 1)]
        low[: len(fits)] = self.rolled(BASES[1], fits, fits + mini) * np.uint64(BASES[0]) & self.mask

        def merged(val: np.ndarray, pos: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
            take = val[shift:] < val[: len(val) - shift]
            return np.where(take, val[shift:], val[: len(val) - shift]), np.where(take, pos[shift:], pos[: len(pos) - shift])

        val, pos, width = low, where, 1
        while 2 * width <= span:
            val, pos = merged(val, pos, width)
            width *= 2
        if width < span:
            val, pos = merged(val, pos, span - width)
        return val[at], pos[at]

    def stretches(self, at: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(doc, key, first word, end word) of maximal stretches of windows `at` that follow each other and share their least run."""
        if not len(at):
            return []
        key, pos = self.least_runs(at)
        first = np.ones(len(at), dtype=bool)
        first[1:] = (np.diff(at) != 1) | (np.diff(doc) != 0) | (np.diff(pos) != 0)
        s = np.flatnonzero(first)
        e = np.append(s[1:], len(at)) - 1
        return list(zip(doc[s].tolist(), key[s].view(np.int64).tolist(), at[s].tolist(), (at[e] + self.k).tolist(), strict=True))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted distinct 64-bit values as byte planes of their differences, without planes of zeros on top."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    wide = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 1
    return bytes([wide]) + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    wide = blob[0]
    flat = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(wide, -1)
    gaps = np.zeros((flat.shape[1], 8), dtype=np.uint8)
    gaps[:, :wide] = flat.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def _send(buckets: int, k: int, bits: int):
    width = -(-(1 << 64) // buckets)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        block = key[0].as_py()
        edges = Block(t.column("text").to_pylist(), k, bits).edges()
        edges.sort()
        new = np.ones(len(edges), dtype=bool)
        new[1:] = edges[1:] != edges[:-1]
        first = np.flatnonzero(new)
        twice = np.diff(np.append(first, len(edges))) > 1
        edges = edges[first]
        at = np.searchsorted(edges, np.array([i * width for i in range(1, buckets)], dtype=np.uint64)) if buckets > 1 else np.array([], dtype=np.int64)
        at = np.concatenate([[0], at, [len(edges)]]).astype(np.int64)
        rows = [(b, edges[s:e], twice[s:e]) for b, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if e > s]
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
                "block": pa.array([block] * len(rows), pa.int32()),
                "edges": pa.array([pack_sorted(v) for _, v, _ in rows], pa.binary()),
                "twice": pa.array([np.packbits(w).tobytes() for _, _, w in rows], pa.binary()),
            }
        )

    return run


def _answer(key: tuple, t: pa.Table) -> pa.Table:
    """Of each block's edges in this bucket, those that start at two places or more."""
    blobs = t.column("edges").to_pylist()
    lists = [unpack_sorted(b) for b in blobs]
    sizes = [len(v) for v in lists]
    every = np.concatenate(lists)
    twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(t.column("twice").to_pylist(), sizes, strict=True)])
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = s[1:] == s[:-1]
    again = twice[order]
    again[1:] |= same
    again[:-1] |= same
    # A value that one block has twice repeats for every block that has it: neighbours are marked by `same`.
    back = np.zeros(len(s), dtype=bool)
    back[order] = again
    out_block, out = [], []
    at = 0
    for block, v, n in zip(t.column("block").to_pylist(), lists, sizes, strict=True):
        hit = v[back[at : at + n]]
        at += n
        if len(hit):
            out_block.append(block)
            out.append(pack_sorted(hit))
    return pa.table({"block": pa.array(out_block, pa.int32()), "repeated": pa.array(out, pa.binary()), "refuted": pa.nulls(len(out), pa.list_(pa.binary()))})


_PIECE = pa.list_(pa.struct([("hi", pa.int64()), ("lo", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


_STRETCH = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64()), ("words", pa.binary())]))


def _cover(k: int, bits: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = key[0].as_py()
        b = Block(docs.column("text").to_pylist(), k, bits)
        n_docs = len(b.words)
        known = [unpack_sorted(x) for x in answers.column("repeated").to_pylist() if x is not None]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, dtype=np.uint64)
        edges = b.edges()
        hit = np.zeros(len(edges), dtype=bool)
        if len(known):
            spot = np.minimum(np.searchsorted(known, edges), len(known) - 1)
            hit = known[spot] == edges
        refuted = {w for ws in answers.column("refuted").to_pylist() if ws for w in ws}
        flat = list(chain.from_iterable(b.words))
        if refuted:
            some = np.flatnonzero(hit)
            lone = [i for i, p in zip(some.tolist(), b.starts[some].tolist(), strict=True) if b" ".join(flat[p : p + k]) in refuted]
            hit[lone] = False
        at = b.starts[hit]
        n = len(b.h)
        change = np.zeros(n + 1, dtype=np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + k, -1)
        gone = np.cumsum(change[:-1]) > 0
        # Pieces: runs of consecutive repeated edges of a document, cut after sampled edges.
        doc = np.searchsorted(b.ends, at, side="right")
        first = np.ones(len(at), dtype=bool)
        if len(at):
            cut = ((edges[hit] >> np.uint64(17)) % np.uint64(CUT)) == 0
            first[1:] = (np.diff(at) != 1) | (np.diff(doc) != 0) | cut[:-1]
        s = np.flatnonzero(first)
        e = np.append(s[1:], len(at)) - 1 if len(s) else s
        from_, to = at[s], at[e] + k
        hi = b.rolled(BASES[0], from_, to).view(np.int64).tolist()
        lo = b.rolled(BASES[1], from_, to).view(np.int64).tolist()
        offset = b.ends - b.sizes
        piece_doc = doc[s]
        # Distinct stretches of the block with their number, on the row that has them first.
        counted: dict[tuple[int, bytes], list[int]] = {}
        for d, run_key, x, y in b.stretches(at, doc):
            counted.setdefault((run_key, b" ".join(flat[x:y])), [d, 0])[1] += 1
        sent: list[list[dict]] = [[] for _ in range(n_docs)]
        for (run_key, words), (d, m) in counted.items():
            sent[d].append({"key": run_key, "n": m, "words": words})
        starts, ends = (from_ - offset[piece_doc]).tolist(), (to - offset[piece_doc]).tolist()
        cuts = np.searchsorted(piece_doc, np.arange(n_docs + 1)).tolist()
        removed, sha, pieces = [], [], []
        for i, w in enumerate(b.words):
            g = gone[offset[i] : offset[i] + len(w)]
            m = int(g.sum())
            removed.append(m)
            kept = w if not m else [x for x, y in zip(w, g.tolist(), strict=True) if not y]
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            pieces.append([{"hi": hi[j], "lo": lo[j], "start": starts[j], "end": ends[j]} for j in range(cuts[i], cuts[i + 1])])
        return pa.table(
            {
                "doc_id": docs.column("doc_id").cast(pa.int64()),
                "block": pa.array([block] * n_docs, pa.int32()),
                "nth": pa.array(range(n_docs), pa.int32()),
                "n_words": pa.array(b.sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()),
                "pieces": pa.array(pieces, _PIECE),
                "stretches": pa.array(sent, _STRETCH),
            }
        )

    return run


_SCHEMA = (
    "doc_id long, block int, nth int, n_words long, n_removed long, kept_sha256 string, pieces array<struct<hi:bigint,lo:bigint,start:bigint,end:bigint>>,"
    " stretches array<struct<key:bigint,n:bigint,words:binary>>"
)


def _refute(k: int):
    """Of distinct stretches in one bucket, the windows that start at one place only, by their words."""

    def windows(words: bytes) -> list[bytes]:
        ends = [i for i, c in enumerate(words) if c == 32] + [len(words)]
        starts = [0, *[e + 1 for e in ends]]
        return [words[starts[i] : ends[i + k - 1]] for i in range(len(ends) - k + 1)]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        texts, counts = t.column("words").to_pylist(), t.column("n").to_pylist()
        # A stretch that occurs twice shows all its windows twice; the windows of the others are counted.
        alone = [x for x, n in zip(texts, counts, strict=True) if n < 2]
        seen = Counter(w for x in alone for w in windows(x))
        short = [(x, [w for w in windows(x) if seen[w] < 2]) for x in alone]
        lacking = {w for _, ws in short for w in ws}
        if lacking:
            for x, n in zip(texts, counts, strict=True):
                if n >= 2:
                    lacking.difference_update(windows(x))
        out = [(x, [w for w in ws if w in lacking]) for x, ws in short]
        out = [(x, ws) for x, ws in out if ws]
        return pa.table({"words": pa.array([x for x, _ in out], pa.binary()), "refuted": pa.array([ws for _, ws in out], pa.list_(pa.binary()))})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, block_bytes: int = BLOCK_BYTES, bits: int = HASH_BITS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, pieces (hash, start, end in words), and
    block and nth, which number the row within this result.

    A word is removed if a window of k words that covers it starts anywhere else too, in the same or
    another row. Null text has no words; texts under k words lose none; repeated rows remove each
    other; an empty table gives no rows; other columns are ignored. Candidates share a hash of `bits`
    bits; their words are compared, so a collision removes nothing.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks)).cast("int"))
    sent = d.groupBy("block").applyInArrow(_send(blocks, k, bits), "bucket int, block int, edges binary, twice binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block int, repeated binary, refuted array<binary>")
    found = stash(d.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_cover(k, bits), _SCHEMA), "substring-found")
    cuts = found.select("block", F.explode("stretches").alias("x")).select("block", "x.key", "x.n", "x.words")
    # One exchange by bucket; equal stretches collapse there before a bucket is read as a whole.
    dealt = cuts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(blocks))).select("bucket", "words", "n").repartition("bucket")
    once = dealt.groupBy("bucket", "words").agg(F.sum("n").alias("n"))
    lone = stash(once.groupBy("bucket").applyInArrow(_refute(k), "words binary, refuted array<binary>"), "substring-refuted")
    found = found.drop("stretches")
    if lone.isEmpty():
        return found
    # Hash collisions: the blocks concerned are covered again without the refuted windows.
    wrong = stash(cuts.join(lone, "words").groupBy("block").agg(F.flatten(F.collect_list("refuted")).alias("refuted")), "substring-wrong")
    redo = d.join(F.broadcast(wrong.select("block")), "block", "left_semi")
    more = answers.join(F.broadcast(wrong.select("block")), "block", "left_semi").select("block", "repeated", "refuted")
    more = more.unionByName(wrong.select("block", F.lit(None).cast("binary").alias("repeated"), "refuted"))
    again = stash(redo.groupBy("block").cogroup(more.groupBy("block")).applyInArrow(_cover(k, bits), _SCHEMA), "substring-again")
    return found.join(F.broadcast(wrong.select("block")), "block", "left_anti").select(*found.columns).unionByName(again.drop("stretches"))


def _path_pieces(found: DataFrame, k: int) -> DataFrame:
    """block, nth, path, start, end, copies, verified of each piece of each row."""
    row = ["block", "nth"]
    seq = found.select(*row, F.explode("pieces").alias("p")).select(*row, F.struct("p.hi", "p.lo").alias("piece"), F.col("p.start").cast("int").alias("start"), F.col("p.end").cast("int").alias("end"))
    n = F.greatest(F.size("pieces") - 1, F.lit(0))
    nxt = found.select(F.explode(F.arrays_zip(F.slice("pieces", 1, n).alias("x"), F.slice("pieces", 2, n).alias("y"))).alias("z"))
    # Neighbours of one run: the next piece's first edge follows the last edge of this one.
    step = nxt.filter(F.col("z.y.start") == F.col("z.x.end") - k + 1).select(F.struct("z.x.hi", "z.x.lo").alias("x"), F.struct("z.y.hi", "z.y.lo").alias("y")).distinct()
    step = stash(step, "paths-steps")
    only_next = step.groupBy("x").agg(F.count(F.lit(1)).alias("out"), F.min("y").alias("y")).filter("out = 1").select("x", "y")
    only_prev = step.groupBy("y").agg(F.count(F.lit(1)).alias("inn"), F.min("x").alias("x")).filter("inn = 1").select("x", "y")
    joined = only_next.join(only_prev, ["x", "y"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components(joined).select(F.col("node").alias("piece"), "root")
    size = F.col("end") - F.col("start")
    sources = seq.groupBy("piece").agg(F.count(F.lit(1)).alias("copies"), F.min(size).alias("short"), F.max(size).alias("long"))
    named = sources.join(roots, "piece", "left").select("piece", F.coalesce("root", "piece").alias("path"), "copies", ((F.col("copies") > 1) & (F.col("short") == F.col("long"))).alias("verified"))
    named = stash(named, "paths-named")
    total = named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    return join_classes(seq, named, ["piece"], "copies", total).select(*row, "path", "start", "end", "copies", "verified")


def paths(found: DataFrame, k: int = WINDOW) -> DataFrame:
    """Nonbranching paths from the result of substring_dedup, verified by source coordinates.

    found must be a written table, as block and nth name its rows. One row per row and path: block, nth,
    path_hi, path_lo, spans, copies, verified. Pieces are nodes; a piece that has one successor whose
    only predecessor it is, over all documents, is joined to it. A path is verified in a document if
    each piece of it there has a second source of the same length and both rolling hashes; the pieces
    at the ends of a run, where another source goes on, are usually alone: their windows are verified
    by words, in stretches.
    """
    row = ["block", "nth"]
    return (
        _path_pieces(found, k)
        .groupBy(*row, "path")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.min("copies").alias("copies"), F.min("verified").alias("verified"))
        .select(*row, F.col("path.hi").alias("path_hi"), F.col("path.lo").alias("path_lo"), "spans", "copies", "verified")
    )


def with_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, block_bytes: int = BLOCK_BYTES, bits: int = HASH_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_paths, n_verified per row of docs.

    n_removed is read off the source coordinates of the row's paths: the words that their pieces cover.
    """
    found = substring_dedup(docs, id_col, text_col, k, block_bytes, bits)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to"))
    spans = F.sort_array(F.collect_list(F.struct("start", "end")))
    held, lone = F.size(F.collect_set("path")), F.size(F.collect_set(F.when(~F.col("verified"), F.col("path"))))
    p = _path_pieces(found, k).groupBy("block", "nth").agg(held.alias("n_paths"), (held - lone).alias("n_verified"), F.aggregate(spans, start, step, lambda a: a["n"]).alias("n_removed"))
    out = found.drop("pieces", "n_removed").join(p, ["block", "nth"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_words", zero("n_removed"), "kept_sha256", zero("n_paths"), zero("n_verified"))
