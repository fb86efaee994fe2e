"""Byte-level BPE with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_memory

#: Fixed value: the pattern that _SAME restates.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker remembers; then it starts afresh, so memory stays bounded.
CACHE = 500_000
#: Characters of text whose new pre-tokens go through one queue.
GROUP_CHARS = 8_000_000
#: Bytes of results that a worker holds before they leave it.
BATCH_BYTES = 4_000_000
_SPACES = "\t-\r \x85\xa0  -     　"


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in blob.splitlines() if line)}


class RankQueue:
    """Buckets of positions per merge rank under a two-level bitmap; find-first-set gives the next rank."""

    __slots__ = ("buckets", "leaves", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.leaves: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        g = rank >> 8
        self.leaves[g] = self.leaves.get(g, 0) | 1 << (rank & 255)
        self.top |= 1 << g

    def first(self) -> int:
        g = (self.top & -self.top).bit_length() - 1
        leaf = self.leaves[g]
        return g << 8 | (leaf & -leaf).bit_length() - 1

    def pop(self) -> tuple[int, list[int]]:
        rank = self.first()
        g = rank >> 8
        leaf = self.leaves[g] ^ 1 << (rank & 255)
        self.leaves[g] = leaf
        if not leaf:
            self.top ^= 1 << g
        return rank, self.buckets.pop(rank)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest rank first, the leftmost of equal ranks first.

    Time is near-linear in the length: linked list of parts, stale queue entries are skipped.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    pair = [-1] * n  # rank of the pair that starts at a part; -1: none, or the part is gone
    q = RankQueue()
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            pair[i] = r
            q.push(r, i)
    while q.top:
        rank, bucket = q.pop()
        if len(bucket) > 1:
            bucket.sort()
        for at, i in enumerate(bucket):
            if pair[i] != rank:
                continue
            j = after[i]
            end = after[j]
            after[i] = end
            pair[j] = -1
            r = None
            if end < n:
                before[end] = i
                r = get(piece[i : after[end]])
            pair[i] = -1 if r is None else r
            if r is not None:
                q.push(r, i)
            p = before[i]
            if p >= 0:
                r = get(piece[p:end])
                pair[p] = -1 if r is None else r
                if r is not None:
                    q.push(r, p)
            if q.top and at + 1 < len(bucket) and q.first() < rank:
                for k in bucket[at + 1 :]:
                    q.push(rank, k)
                break
    ids, i = [], 0
    while i < n:
        j = after[i]
        ids.append(ranks[piece[i:j]])
        i = j
    return ids


class _Odd(dict):
    """Whether re's classes differ from the pattern's for a character: numbers that are no digits, and unassigned ones."""

    def __missing__(self, c: str) -> bool:
        self[c] = odd = unicodedata.category(c) in ("Nl", "No", "Cn", "Cs")
        return odd


_ODD = _Odd()
_REST = rf"'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\w{_SPACES}]|_)+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
#: The pattern in re's classes, for texts without odd characters.
_SAME = re.compile(rf" ?[^\W\d_]+|{_REST}")
#: Spaces, letters and numbers below U+0100: plain ranges are faster than classes.
_S, _L, _N = "\t-\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Codec:
    """Encoder and decoder for one vocabulary; one per worker."""

    def __init__(self, blob: bytes, pattern: str) -> None:
        self.ranks = read_ranks(blob)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.exact = regex.compile(pattern)
        self.fast = _SAME if pattern == PATTERN else self.exact
        self.known: dict[str, bytes] = {}
        # Every pair of tokens that joins to a token, as sorted keys left * step + right.
        get, self.step = self.ranks.get, len(self.tokens) + 1
        pairs = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                left, right = get(t[:i]), get(t[i:])
                if left is not None and right is not None:
                    pairs[left * self.step + right] = r
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.joins = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.bytes = np.array([get(bytes([i]), -1) for i in range(256)], dtype=np.int64)
        # Rank of each pair of bytes.
        self.byte_pairs = self.joined(np.repeat(self.bytes, 256), np.tile(self.bytes, 256)).reshape(256, 256)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 if they don't join."""
        if not len(self.keys):
            return np.full(len(right), -1, dtype=np.int64)
        key = left * self.step + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joins[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, as little-endian unsigned 32-bit, with one rank queue over all of them.

        Pre-tokens don't touch, so taking a rank in all of them at once changes nothing, except where a
        merge makes a pair of lower rank than its own; such a pre-token is done again by itself.
        """
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        none = self.step - 1  # a token that joins nothing, at the place n
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        tok = np.append(self.bytes[raw], none)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends - sizes] = n
        alive = np.ones(n, dtype=bool)
        pair = np.full(n + 1, -1, dtype=np.int64)
        pair[: n - 1] = self.byte_pairs[raw[:-1], raw[1:]]
        pair[ends - 1] = -1
        buckets: dict[int, list[np.ndarray]] = {}
        leaves: dict[int, int] = {}
        top, again = 0, set()

        def push(ranks: np.ndarray, places: np.ndarray) -> int:
            up = 0
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            at = [0, *cut.tolist(), len(ranks)]
            for r, s, e in zip(ranks[at[:-1]].tolist(), at[:-1], at[1:], strict=True):
                held = buckets.get(r)
                if held is None:
                    buckets[r] = [places[s:e]]
                    g = r >> 8
                    leaves[g] = leaves.get(g, 0) | 1 << (r & 255)
                    up |= 1 << g
                else:
                    held.append(places[s:e])
            return up

        first = np.flatnonzero(pair >= 0)
        if len(first):
            top = push(pair[first], first)
        while top:
            g = (top & -top).bit_length() - 1
            leaf = leaves[g]
            rank = g << 8 | (leaf & -leaf).bit_length() - 1
            leaves[g] = leaf = leaf & (leaf - 1)
            if not leaf:
                top ^= 1 << g
            held = buckets.pop(rank)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[pair[at] == rank]  # stale entries are skipped
            if not len(at):
                continue
            if len(held) > 1:
                at = np.unique(at)
            right = after[at]
            if len(at) > 1 and (chain := right[:-1] == at[1:]).any():
                # Overlapping pairs of one rank: from the left, every other one of a chain.
                i = np.arange(len(at))
                start = np.maximum.accumulate(np.where(np.append(True, ~chain), i, 0))
                left_most = (i - start) % 2 == 0
                at, right = at[left_most], right[left_most]
            end = after[right]
            unmerged = tok[end]
            tok[at] = rank
            after[at] = end
            before[end] = at
            alive[right] = False
            pair[right] = -1
            prev = before[at]
            new_right = self.joined(tok[at], tok[end])
            new_left = self.joined(tok[prev], tok[at])
            pair[at] = new_right
            pair[prev] = new_left
            pair[n] = -1
            moved = unmerged != tok[end]
            if moved.any():  # the pair as it was before its right neighbour merged too
                between = self.joined(tok[at[moved]], unmerged[moved])
                low = at[moved][(between >= 0) & (between < rank)]
                again.update(np.searchsorted(ends, low, side="right").tolist())
            ranks, places = np.concatenate([new_right, new_left]), np.concatenate([at, prev])
            ok = (ranks >= 0) & (places < n)
            if ok.any():
                ranks, places = ranks[ok], places[ok]
                if ranks.min() < rank:
                    again.update(np.searchsorted(ends, places[ranks < rank], side="right").tolist())
                top |= push(ranks, places)
        ids = tok[:n][alive].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.add.reduceat(alive, ends - sizes, dtype=np.int64))).tolist()
        out = [ids[s:e] for s, e in zip([0, *stops[:-1]], stops, strict=True)]
        for i in again:
            out[i] = np.array(merge(pieces[i], self.ranks), dtype="<u4").tobytes()
        return out

    def merge_rounds(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many short pre-tokens: those of one length form a matrix, and each round merges every
        row's lowest pair, the leftmost of equal ranks. For callers that need ids, not the rank queue."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        top = np.iinfo(np.int64).max
        for size in np.unique(sizes).tolist():
            who = np.flatnonzero(sizes == size)
            raw = np.frombuffer(b"".join([pieces[i] for i in who.tolist()]), dtype=np.uint8).reshape(-1, size)
            tok = self.bytes[raw]
            rank = self.byte_pairs[raw[:, :-1], raw[:, 1:]]
            rank[rank < 0] = top
            while True:
                width = tok.shape[1]
                at = rank.argmin(axis=1) if width > 1 else np.zeros(len(who), dtype=np.int64)
                row = np.arange(len(who))
                low = rank[row, at] if width > 1 else np.full(len(who), top)
                done = low == top
                if done.any():
                    blob, wide = tok[done].astype("<u4").tobytes(), 4 * width
                    for k, i in enumerate(who[done].tolist()):
                        out[i] = blob[k * wide : (k + 1) * wide]
                    go = ~done
                    who, tok, rank, at, low = who[go], tok[go], rank[go], at[go], low[go]
                    row = np.arange(len(who))
                if not len(who):
                    break
                after = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
                tok = np.take_along_axis(tok, after, axis=1)
                tok[row, at] = low
                if width == 2:
                    rank = rank[:, :0]
                    continue
                gone = np.arange(width - 2) + (np.arange(width - 2) >= at[:, None])
                rank = np.take_along_axis(rank, gone, axis=1)
                left = np.flatnonzero(at > 0)
                right = np.flatnonzero(at < width - 2)
                for rows, first in ((left, at[left] - 1), (right, at[right])):
                    r = self.joined(tok[rows, first], tok[rows, first + 1])
                    rank[rows, first] = np.where(r < 0, top, r)
        return out

    def split(self, text: str) -> list[str]:
        if self.fast is _SAME:
            try:
                text.encode("latin-1")
                return _LATIN.findall(text)
            except UnicodeEncodeError:
                if not any(map(_ODD.__getitem__, set(text))):
                    return _SAME.findall(text)
        return self.exact.findall(text)

    def learn(self, new: set[str], short: int = 0) -> None:
        """Remember the ids of new pre-tokens; those of up to `short` bytes don't go through the rank queue."""
        known, get = self.known, self.ranks.get
        few: tuple[list[str], list[bytes]] = ([], [])
        many: tuple[list[str], list[bytes]] = ([], [])
        for t in new:
            piece = t.encode("utf-8")
            whole = get(piece)
            if whole is not None:
                known[t] = whole.to_bytes(4, "little")
            else:
                names, pieces = few if len(piece) <= short else many
                names.append(t)
                pieces.append(piece)
        if few[0]:
            known.update(zip(few[0], self.merge_rounds(few[1]), strict=True))
        if many[0]:
            known.update(zip(many[0], self.merge_many(many[1]), strict=True))

    def encode_all(self, texts: Iterable[str], group_chars: int = GROUP_CHARS, short: int = 0) -> Iterator[bytes]:
        """Ids of each text, in order; the new pre-tokens of a group of texts are merged together."""
        group, chars = [], 0

        def finish() -> Iterator[bytes]:
            new = set().union(*group)
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
            new.difference_update(self.known)
            self.learn(new, short)
            known = self.known
            for toks in group:
                yield b"".join(map(known.__getitem__, toks))
            group.clear()

        for text in texts:
            group.append(self.split(text))
            chars += len(text)
            if chars >= group_chars:
                yield from finish()
                chars = 0
        if group:
            yield from finish()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(blob: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(blob).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(blob, pattern)
    return _codecs[key]


def vocabulary(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """Broadcast (file bytes, pattern): a vocabulary file is a few MB at any corpus size."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern or public_tokenizers.PATTERN))


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    digest: bool = False,
    digest_decoded: bool = False,
    group_chars: int = GROUP_CHARS // 2,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, binary), n_tokens, decoded (binary) per row of docs.

    With digest, ids and decoded are replaced by their SHA-256, so only a line per document leaves
    the workers; with digest_decoded, decoded alone. Null is empty text: no ids. Repeated rows each
    get a row. Whole texts are encoded; the work of a text grows linearly. Results leave a worker
    once they come to batch_bytes, so they don't pile up beside the texts; the pre-tokens of
    group_chars of text are held at a time. Neither changes a row. Other columns are ignored.
    """
    voc = vocabulary(docs.sparkSession, path, pattern)
    names = ["doc_id", "n_tokens", "ids_sha256" if digest else "ids", "decoded_sha256" if digest or digest_decoded else "decoded"]
    kinds = [pa.string() if x.endswith("sha256") else pa.binary() for x in names[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*voc.value)

        def full(doc_ids: pa.Array, n: list[int], ids: list, back: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(ids, kinds[0]), pa.array(back, kinds[1])], names=names)

        for b in batches:
            at, held, n, ids, back = 0, 0, [], [], []
            for e in c.encode_all((t.as_py() or "" for t in b.column(1)), group_chars):
                d = c.decode(e)
                n.append(len(e) // 4)
                ids.append(hashlib.sha256(e).hexdigest() if digest else e)
                back.append(hashlib.sha256(d).hexdigest() if digest or digest_decoded else d)
                held += len(ids[-1]) + len(back[-1])
                if held >= batch_bytes:
                    yield full(b.column(0).slice(at, len(n)), n, ids, back)
                    at, held, n, ids, back = at + len(n), 0, [], [], []
            yield full(b.column(0).slice(at), n, ids, back)
        c.known.clear()
        release_memory()

    schema = ", ".join(f"{x} {'string' if k == pa.string() else 'binary'}" for x, k in zip(names[2:], kinds, strict=True))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, {schema}")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of each row's ids; null ids decode to nothing."""
    voc = vocabulary(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*voc.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or b"") for x in b.column(1)], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")
