"""Token-id output: best-fit-decreasing packing with a segment tree over bin capacities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

LENGTH = 2048
PAD = 0
#: Text bytes of one packing group; groups are dealt by id hash, so the result does not depend on files.
GROUP_BYTES = 8_000_000
#: Bytes of a pre-token up to which ids are found by rounds over a matrix; longer ones take the encoder's rank queue.
SHORT = 32


class Capacities:
    """Segment tree over free room: leaf c counts open bins with room c; finds the least room >= need."""

    def __init__(self, length: int) -> None:
        self.size = 1 << max(1, length).bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the bin that fits need most closely, or None."""
        i, count = need + self.size, self.count
        if not count[i]:
            # Up to the first ancestor with a counted right sibling, then down to its least leaf.
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        b = self.bins[room].pop()
        self._add(room, -1)
        return room, b


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins of item numbers, each at most `length` in total; items of 1 to length.

    Items of one size go by number; of bins with equal room the one filled last is taken.
    """
    order = np.argsort(-sizes, kind="stable").tolist()
    free, bins = Capacities(length), []
    for i in order:
        n = int(sizes[i])
        found = free.take(n) if n < length else None
        if found:
            room, b = found
            bins[b].append(i)
        else:
            room, b = length, len(bins)
            bins.append([i])
        if room > n:
            free.put(room - n, b)
    return bins


def pack(ids: list[np.ndarray], length: int = LENGTH, pad: int = PAD) -> dict:
    """Pack documents' ids. Longer documents are split into pieces of `length` and a rest, losing nothing.

    matrix: (rows, length) unsigned 32-bit, padded; per row: cumulative segment lengths, starting at 0;
    position resets (position of each token in its segment's document piece); doc number and offset
    of each segment.
    """
    doc, start, size = [], [], []
    for d, x in enumerate(ids):
        for s in range(0, len(x), length):
            doc.append(d)
            start.append(s)
            size.append(min(length, len(x) - s))
    bins = best_fit_decreasing(np.array(size, dtype=np.int64), length) if size else []
    matrix = np.full((len(bins), length), pad, dtype="<u4")
    positions = np.zeros((len(bins), length), dtype="<u4")
    cumulative, segments = [], []
    for r, items in enumerate(bins):
        at, ends, segs = 0, [0], []
        for i in items:
            n = size[i]
            matrix[r, at : at + n] = ids[doc[i]][start[i] : start[i] + n]
            positions[r, at : at + n] = np.arange(n)
            at += n
            ends.append(at)
            segs.append((doc[i], start[i], n))
        cumulative.append(ends)
        segments.append(segs)
    return {"matrix": matrix, "positions": positions, "cumulative": cumulative, "segments": segments}


_SEGMENT = pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))
_SCHEMA = "pack_group int, pack_row int, n_tokens long, ids binary, positions binary, cu_seqlens array<int>, segments array<struct<doc_id:bigint,offset:bigint,length:bigint>>"


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    pad: int = PAD,
    path: str | None = None,
    pattern: str | None = None,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Rows of `length` token ids: pack_group, pack_row, n_tokens, ids and positions (little-endian
    unsigned 32-bit), cu_seqlens (0 and the end of each segment) and segments (doc_id, offset, length).

    Documents are dealt into groups by id hash and packed within a group in id order, so memory is bounded and reruns agree. Null and
    empty texts have no tokens and no segment; a null id is carried as null; repeated rows are packed
    each; an empty table gives no rows; other columns are ignored.
    """
    voc = bpe.vocabulary(docs.sparkSession, path, pattern)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_bytes))
    d = d.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", F.lit("pack")), F.lit(groups)).cast("int"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        c = bpe.codec(*voc.value)
        ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        p = pack([np.frombuffer(e, dtype="<u4") for e in c.encode_all((texts[i] or "" for i in order), short=SHORT)], length, pad)
        n = len(p["cumulative"])
        return pa.table(
            {
                "pack_group": pa.array([key[0].as_py()] * n, pa.int32()),
                "pack_row": pa.array(range(n), pa.int32()),
                "n_tokens": pa.array([x[-1] for x in p["cumulative"]], pa.int64()),
                "ids": pa.array([x.tobytes() for x in p["matrix"]], pa.binary()),
                "positions": pa.array([x.tobytes() for x in p["positions"]], pa.binary()),
                "cu_seqlens": pa.array(p["cumulative"], pa.list_(pa.int32())),
                "segments": pa.array([[{"doc_id": ids[order[i]], "offset": s, "length": m} for i, s, m in x] for x in p["segments"]], _SEGMENT),
            }
        )

    return d.groupBy("pack_group").applyInArrow(run, _SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    """Packed rows with the SHA-256 in hex of their ids and positions instead of these."""
    return packed.withColumns({c: F.sha2(c, 256) for c in ("ids", "positions")})


def save(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: each row's ids and positions are raw little-endian unsigned 32-bit blocks."""
    packed.repartitionByRange("pack_group").sortWithinPartitions("pack_group", "pack_row").write.parquet(path)


def matrix(rows: list, column: str = "ids") -> np.ndarray:
    """(rows, length) unsigned 32-bit from collected or streamed packed rows, for a loader."""
    return np.stack([np.frombuffer(r[column], dtype="<u4") for r in rows]) if rows else np.zeros((0, 0), dtype="<u4")


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, offset, ids) of each segment: what was packed, to rebuild documents."""
    s = packed.select("ids", F.posexplode("segments").alias("at", "seg"), "cu_seqlens")
    start = F.get("cu_seqlens", F.col("at"))
    return s.select("seg.doc_id", "seg.offset", F.substring(F.col("ids"), 4 * start + 1, (4 * F.col("seg.length")).cast("int")).alias("ids"))
