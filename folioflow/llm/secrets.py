"""Secret scans: patterns, and candidates confirmed by their structure."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "jwt", "openssh")
BASE_KINDS = KINDS[:3]
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # leftmost and greedy, so whole runs, as runs of 24 characters or more
_PEM_LINE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,-]*")
#: Runs that can hold a signed token; its three parts lie between dots.
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
#: Whole runs of either alphabet: a run of one can lie inside, or go over the end of, a run of the other.
_BLOBS = (re.compile(r"[A-Za-z0-9+/]{40,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{40,}={0,2}"))
_LONG_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
_HEX_MAP = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_BLOB_MAP = bytes(98 if chr(c).isalnum() and c < 128 or chr(c) in "+/_-" else 32 for c in range(256))
MAX_DEPTH = 12
#: Characters of the shortest header of a signed token, {"alg":""}.
LEAST_HEADER = 14


def _decode64(s: str) -> bytes | None:
    s = re.sub(r"\s+", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _items(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of each element that together fill b[at:end] exactly."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = b[at], b[at + 1], at + 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            size, at = int.from_bytes(b[at : at + k], "big"), at + k
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def _nested(b: bytes, at: int, end: int, depth: int = 0) -> bool:
    parts = _items(b, at, end)
    if parts is None or depth > MAX_DEPTH:
        return False
    return all(_nested(b, s, e, depth + 1) for tag, s, e in parts if tag in (0x30, 0x31))


def is_der_key(b: bytes | None) -> bool:
    """A DER sequence that fills b, with exact nested lengths, shaped like a private key.

    Shapes: version then integers (RSA, DSA), version then octets (EC), version, algorithm and
    octets (PKCS 8), or algorithm and octets (encrypted PKCS 8).
    """
    if not b or b[0] != 0x30:
        return False
    top = _items(b, 0, len(b))
    if top is None or len(top) != 1 or not _nested(b, 0, len(b)):
        return False
    parts = _items(b, top[0][1], top[0][2]) or []
    tags = [t for t, _, _ in parts]
    if len(tags) < 2:
        return False
    names_algorithm = lambda p: p[0] == 0x30 and p[2] > p[1] and b[p[1]] == 0x06
    version = tags[0] == 0x02 and parts[0][2] - parts[0][1] == 1 and b[parts[0][1]] <= 3
    if version and (tags[1] == 0x04 or len(tags) >= 6 and set(tags[:6]) == {0x02}):
        return True
    if version and len(tags) >= 3 and names_algorithm(parts[1]) and tags[2] == 0x04:
        return True
    return len(tags) == 2 and names_algorithm(parts[0]) and tags[1] == 0x04


def is_openssh_key(b: bytes | None) -> bool:
    """The OpenSSH private-key frame: magic, then length-prefixed cipher, kdf and options, key count, keys."""
    magic = b"openssh-key-v1\0"
    if not b or not b.startswith(magic):
        return False
    at = len(magic)
    for k in range(4):  # cipher, kdf, options; then the count, then the first public key
        if k == 3:
            at += 4
        if at + 4 > len(b):
            return False
        at += 4 + int.from_bytes(b[at : at + 4], "big")
        if at > len(b):
            return False
    return True


def _object64(s: str) -> dict | None:
    """The JSON object that s encodes. One ends with a brace in any encoding, so most other bytes need no parser."""
    raw = _decode64(s)
    if not raw or not raw.rstrip(b" \t\n\r\0").endswith(b"}"):
        return None
    try:
        x = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def is_signed_token(s: str) -> bool:
    """header.payload.signature whose header is JSON that names an algorithm and whose payload is JSON."""
    head, body, _ = s.split(".", 2)
    if len(head) < LEAST_HEADER:
        return False
    h = _object64(head)
    return h is not None and isinstance(h.get("alg"), str) and _object64(body) is not None


def pem_blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) from each BEGIN line to the END line of the same label that follows it. One pass."""
    begun = None
    for m in _PEM_LINE.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun and begun[2] == m[2] and _PEM_BODY.fullmatch(text, begun.end(), m.start()):
            yield begun.start(), m.end(), text[begun.end() : m.start()]
            begun = None


def token_candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans header.payload.signature whose header starts with the base64 of a brace and a quote. One pass."""
    for m in _DOTTED.finditer(text):
        run = m[0]
        if "eyJ" not in run or run.count(".") < 2:
            continue
        parts, at, i = run.split("."), m.start(), 0
        starts = []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        while i + 2 < len(parts):
            head = parts[i].find("eyJ")
            if head < 0 or len(parts[i]) < head + 4 or not parts[i + 1]:
                i += 1
                continue
            yield starts[i] + head, starts[i + 2] + len(parts[i + 2])
            i += 3


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """Spans of the three base kinds. raw (the UTF-8 text) tells quickly which patterns can't match."""
    out = []
    low = raw.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"h" * 24 in raw.translate(_HEX_MAP):
        out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return out


def confirmed_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """Spans whose decoded content parses as a key or a signed token."""
    out = []
    if b"PRIVATE KEY-----" in raw:
        for a, b, inner in pem_blocks(text):
            body = "".join(x for x in inner.split("\n") if ":" not in x and "," not in x)
            data = _decode64(body)
            if is_der_key(data) or is_openssh_key(data):
                out.append((a, b, "pem"))
    if b"eyJ" in raw:
        out += [(a, b, "jwt") for a, b in token_candidates(text) if is_signed_token(text[a:b])]
    if b"b" * 40 in raw.translate(_BLOB_MAP):
        # By start, then the longest: a span lies in an earlier one of its kind if that one ends no sooner.
        reach = {"der": 0, "openssh": 0}
        for a, b in sorted({m.span() for p in _BLOBS for m in p.finditer(text)}, key=lambda s: (s[0], -s[1])):
            data = _decode64(text[a:b])
            kind = "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None
            if kind and b > reach[kind]:
                out.append((a, b, kind))
                reach[kind] = b
        for m in _LONG_HEX.finditer(text):
            if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
                out.append((*m.span(), "der"))
    return out


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All (start, end, kind) in code points, by start, then kind."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    found = set(base_spans(text, raw)) | set(confirmed_spans(text, raw))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id and secrets, an array of (kind, start, end, value), in text order.

    Offsets are code points, end exclusive. Null is empty text; repeated rows each get a row; other
    columns are ignored. The time of a text grows linearly with its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                rows.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for s, e, k in scan(text)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "secrets"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:bigint,end:bigint,value:string>>")


def digest(found: DataFrame) -> DataFrame:
    """n_assign, n_access, n_hex, base_sha256 and spans from the result of find_secrets."""
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(of(*BASE_KINDS)), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )
