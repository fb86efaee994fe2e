"""Plain restatements of the contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
KINDS = ("assign", "access", "hex")


def words(text):
    return re.findall(WORD, text or "")


def quality(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


def simhash(text):
    w = [x for x in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    """fps: [(id, fingerprint)] -> {position: smallest id reachable}."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        r = find(i)
        low[r] = min(low.get(r, d), d)
    return [low[find(i)] for i in range(len(fps))]


def near_components(rows, least=0.8):
    """rows: [(id, text)] -> smallest id reachable over texts whose 5-word shingles have that Jaccard similarity."""
    sets = []
    for _, t in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    holders, root = defaultdict(list), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x])
        for j, m in shared.items():
            if m / (len(s) + len(sets[j]) - m) >= least:
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(rows))]


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        out += [(m.start(), 1, m.end())] * (len(m[0]) >= 20)
    for m in re.finditer(r"[0-9a-f]+", text):
        out += [(m.start(), 2, m.end())] * (len(m[0]) >= 24)
    n = [sum(k == i for _, k, _ in out) for i in range(3)]
    return (*n, hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)).encode()).hexdigest())


def repeats(docs, k=35):
    """docs: [(id, text)] -> [(id, n_words, n_removed, kept_sha256)]."""
    at = defaultdict(int)
    split = [(d, words(t)) for d, t in docs]
    for _, w in split:
        for i in range(len(w) - k + 1):
            at[tuple(w[i : i + k])] += 1
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if at[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """sizes: {source: words} -> {source: target}, by capping and sharing anew until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = goal - sum(full.values())
        if not rest:
            return full
        t = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if t[s] > cap * sizes[s]]
        if not over:
            return full | t
        full |= {s: cap * sizes[s] for s in over}
