"""Main text of web pages: a host suffix array over all text outside articles, guarded by page structure.

The visible text outside a page's article (menus, footers, adverts, unmarked blocks) of all pages of a
host is one token stream with separators. A long substring that another page has too is boilerplate
and its tokens go. Structure then guards both ways: an article is kept by contract even where pages
repeat it, so it is not part of the stream; and of the runs that are unique to a page, those that
stand in marked boilerplate or beside an article go too. So on a page that marks no article the
suffix array alone decides what of the unmarked text stays.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shortest repeated substring, in tokens, that counts as boilerplate.
MIN_TOKENS = 8
#: HTML bytes of one host that meet in one suffix array; larger hosts are dealt into shards by page.
SHARD_BYTES = 8_000_000

#: Elements whose text is never part of an article.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select option datalist textarea".split())
CHROME = frozenset("nav header footer aside form button menu dialog fieldset label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words of class, id and role that mark boilerplate.
_CHROME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|side|ad|ads|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|breadcrumbs?|comments?|commentlist|disqus|replies|respond|footer|header|masthead|topbar|toolbar|pagination|pager|skip|widget|search|complementary|contentinfo)(?=$|[\s_-])"
)
_MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)[_-]?(?:body|content|text)(?=$|[\s_-])")
#: Elements whose content is skipped to their end tag.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_TAG = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)(?:>|\Z))""", re.S)
#: For the rest of a page with an unbalanced quote: a tag ends at the next angle bracket.
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)")
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?=[\s=/]|\Z)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
_SPACE = re.compile(r"\s+")


def _marked(name: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element's attributes mark boilerplate, or the main text."""
    if not attrs:
        return False, False
    chrome = main = False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            main |= bool(_MAIN_WORDS.search(value)) or key == "role" and value == "main"
            chrome |= bool(_CHROME_WORDS.search(value))
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            chrome = True
        elif key == "style":
            chrome |= "display:none" in value.replace(" ", "")
    if name in ("html", "body", "article", "main"):
        chrome = False
    return chrome and not main, main


CHROME_LEVEL = -1


class Page:
    """Blocks of a page in order: (text, level). Levels: 2 in an article, 1 in the main element, 0 unmarked, -1 marked as boilerplate."""

    def __init__(self, source: str | None) -> None:
        self.blocks: list[tuple[str, int]] = []
        self._parts: list[str] = []
        self._side: list[str] = []
        # Open elements: name, silent, boilerplate; and how many of each name are open.
        stack: list[tuple[str, bool, bool]] = []
        opened: Counter[str] = Counter()
        silent = shut = 0
        levels = [0]
        text, at, tag = source or "", 0, _TAG
        unclosed: set[str] = set()

        def pop() -> str:
            nonlocal silent, shut
            e = stack.pop()
            opened[e[0]] -= 1
            silent -= e[1]
            shut -= e[2]
            levels.pop()
            return e[0]

        while at < len(text):
            lt = text.find("<", at)
            if lt < 0:
                lt = len(text)
            if lt > at and not silent:
                (self._side if shut else self._parts).append(text[at:lt])
            if lt == len(text):
                break
            m = tag.match(text, lt)
            if not m and tag is _TAG and (m := _LOOSE_TAG.match(text, lt)):
                tag = _LOOSE_TAG
            if not m and tag is _LOOSE_TAG and text[lt + 1 : lt + 2] in ("!", "?"):
                m = _TAG.match(text, lt)
            if not m:
                if not silent:
                    (self._side if shut else self._parts).append("<")
                at = lt + 1
                continue
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if name in BLOCKS:
                self._flush(levels[-1])
            if m[1]:
                if opened[name]:
                    while pop() != name:
                        pass
                continue
            if name in VOID or m[3].endswith("/") and name not in BLOCKS:
                continue
            if name in ("p", "li", "td", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                pop()
            chrome, main = _marked(name, m[3])
            level = levels[-1]
            if name == "article" or main:
                level = max(level, 2)
            elif name == "main":
                level = max(level, 1)
            # The header of an article holds its title; any other is the page's.
            hidden = name in SILENT
            closed = not hidden and (chrome or name in CHROME and not (name == "header" and level == 2))
            stack.append((name, hidden, closed))
            opened[name] += 1
            levels.append(level)
            silent += hidden
            shut += closed
            if name in RAW and name not in unclosed:
                end = _RAW_END[name].search(text, at)
                if end:
                    at = end.start()
                else:
                    unclosed.add(name)
        self._flush(levels[-1])

    def _flush(self, level: int) -> None:
        for parts, lv in ((self._parts, level), (self._side, CHROME_LEVEL)):
            if parts:
                t = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
                parts.clear()
                if t:
                    self.blocks.append((t, lv))

    def main(self) -> tuple[list[str], bool]:
        """The blocks of the innermost kind of container that the page marks, and whether it marks one."""
        top = self.top()
        return [t for t, lv in self.blocks if lv == top], top > 0

    def top(self) -> int:
        return max((lv for _, lv in self.blocks if lv >= 0), default=0)

    def outside(self) -> list[str]:
        """Tokens of the visible text outside the page's article; of a page without one, all tokens."""
        top = self.top()
        return [w for t, lv in self.blocks if lv < top or top == 0 for w in t.split(" ")]


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `depth` tokens at least, and each suffix's rank; by prefix doubling."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth and n:
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        s = key[order]
        step = np.ones(n, dtype=np.int64)
        step[1:] = s[1:] != s[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        width *= 2
    return order, rank


def repeated_tokens(streams: list[list[str]], least: int = MIN_TOKENS) -> list[np.ndarray]:
    """Per page, which tokens lie in a substring of `least` tokens that another page has too.

    The streams are concatenated with separators of their own; neighbours in the suffix array with
    equal first `least` tokens (a power of two) on different pages are repeated.
    """
    sizes = [len(s) + 1 for s in streams]
    flat = np.empty(sum(sizes), dtype=np.uint64)
    page = np.repeat(np.arange(len(streams)), sizes)
    at = 0
    for i, s in enumerate(streams):
        flat[at : at + len(s)] = [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in s]
        flat[at + len(s)] = xxhash.xxh64_intdigest(b"\0page", i)
        at += sizes[i]
    order, rank = suffix_array(flat, least)
    r, p = rank[order], page[order]
    first = np.ones(len(r), dtype=bool)
    first[1:] = r[1:] != r[:-1]
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    low, high = (np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)) if len(r) else (p, p)
    hit = order[(low < high)[group]] if len(r) else order
    change = np.zeros(len(flat) + least + 1, dtype=np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + least, -1)
    covered = np.cumsum(change)[: len(flat)] > 0
    ends = np.cumsum(sizes)
    return [covered[e - n : e - 1] for e, n in zip(ends.tolist(), sizes, strict=True)]


def windows(stream: list[str], least: int = MIN_TOKENS) -> list[bytes]:
    """128-bit hash of each run of `least` tokens, by its start. Tokens hold no spaces."""
    raw = [t.encode("utf-8", "surrogatepass") for t in stream]
    return [xxhash.xxh3_128_digest(b" ".join(raw[i : i + least])) for i in range(len(raw) - least + 1)]


def covered_tokens(stream: list[str], repeated: set[bytes], least: int = MIN_TOKENS) -> np.ndarray:
    """Which tokens lie in a window whose hash is in `repeated`."""
    out = np.zeros(len(stream), dtype=bool)
    for i, h in enumerate(windows(stream, least)):
        if h in repeated:
            out[i : i + least] = True
    return out


def extract(pages: list[str | None], least: int = MIN_TOKENS, repeated: set[bytes] | None = None) -> list[tuple[str, int]]:
    """Main text of each page of one host, or of a shard whose windows that the host repeats are given;
    and how many of its tokens outside the article the suffix array removes."""
    found = [Page(p) for p in pages]
    streams = [p.outside() for p in found]
    covered = repeated_tokens(streams, least)
    if repeated:
        covered = [c | covered_tokens(s, repeated, least) for c, s in zip(covered, streams, strict=True)]
    out = []
    for page, gone in zip(found, covered, strict=True):
        top = page.top()
        if top:
            out.append((" ".join(t for t, lv in page.blocks if lv == top), int(gone.sum())))
            continue
        kept, at = [], 0
        for t, lv in page.blocks:
            ws = t.split(" ")
            if lv == 0:
                kept += [w for w, x in zip(ws, gone[at : at + len(ws)].tolist(), strict=True) if not x]
            at += len(ws)
        out.append((" ".join(kept), int(gone.sum())))
    return out


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = MIN_TOKENS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated per row of pages.

    n_repeated counts the tokens outside the article that the host repeats on another page. Pages of a
    host meet in shards of about shard_bytes, so a host with a third of all pages is many groups. The
    shards of a host exchange hashes of the windows of `least` tokens outside articles, so that a passage
    on any two of its pages is seen wherever they lie. Null html is empty and gives an empty text;
    a null or odd url belongs to the host ""; repeated rows each get a row; an empty table gives no
    rows; other columns are ignored. The time of a page grows linearly with its length.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    p = p.withColumn("host", _host(F.col("url")))
    large = p.groupBy("host").agg(F.ceil(F.sum(F.octet_length("html")) / shard_bytes).cast("int").alias("shards")).filter("shards > 1")
    # At most one host per shard_bytes of input is large, so `large` is small and the html is not dealt for this join.
    p = p.join(F.broadcast(large), "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    shard = F.pmod(F.xxhash64("page_id", "url"), F.col("shards")).cast("string")
    # One key, so that no exchange by host alone can serve and the shards of a host spread over tasks.
    p = p.select("page_id", "url", "html", "host", "shards", F.concat(shard, F.lit(" "), "host").alias("part"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each distinct window of a page's text outside its article."""
        for b in batches:
            rows, found = [], []
            for i, source in enumerate(b.column("html")):
                mine = set(windows(Page(source.as_py()).outside(), least))
                rows += [i] * len(mine)
                found += mine
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("host").take(take), b.column("part").take(take), pa.array(found, pa.binary())], names=["host", "part", "h"])

    each = p.filter("shards > 1").select("host", "part", "html").mapInArrow(cut, "host string, part string, h binary")
    each = each.groupBy("host", "part", "h").agg(F.count(F.lit(1)).alias("n"))
    # Windows that two parts share; those of one part only are found by its own suffix array.
    shared = each.withColumn("m", F.count(F.lit(1)).over(W.partitionBy("host", "h"))).filter("m > 1").select("part", "h")

    def run(t: pa.Table, repeated: pa.Table) -> pa.Table:
        texts = extract(t.column("html").to_pylist(), least, set(repeated.column("h").to_pylist()))
        return pa.table(
            {
                "page_id": t.column("page_id").cast(pa.int64()),
                "url": t.column("url").cast(pa.string()),
                "text": pa.array([x for x, _ in texts], pa.string()),
                "n_chars": pa.array([len(x) for x, _ in texts], pa.int64()),
                "n_repeated": pa.array([n for _, n in texts], pa.int64()),
            }
        )

    rows = p.select("page_id", "url", "html", "part").groupBy("part")
    return rows.cogroup(shared.groupBy("part")).applyInArrow(run, "page_id long, url string, text string, n_chars long, n_repeated long")
