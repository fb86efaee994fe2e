"""Extraction, toxicity, substring dedup, packing and the pipeline on small tables and edge rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest

from folioflow.llm import bpe, html_extract, packing, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"


def test_substrings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    for size in (12_000_000, 40_000):  # one block, many blocks and buckets
        got = substring_dedup.substring_dedup(docs, block_bytes=size).collect()
        assert sorted(brute.repeats(data)) == sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got)


def test_substring_edges(spark):
    a = " ".join(f"w{i}" for i in range(80))
    b = "x " * 200
    rows = [(1, a), (2, "start " + a + "\tend"), (3, None), (4, ""), (5, b), (6, a[:50]), (None, "n " + " ".join(a.split()[:34])), (7, a), (7, a)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df, block_bytes=500).collect()), key=key)
    assert got == sorted(brute.repeats(rows), key=key)
    assert substring_dedup.substring_dedup(df.limit(0)).collect() == []
    assert substring_dedup.with_paths(df.limit(0)).collect() == []


def test_substrings_under_collisions(spark):
    """With hashes of a few bits nearly every window is a candidate; the words decide."""
    r = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(30):
        own = [f"d{i}w{j}" for j in range(int(r.integers(0, 120)))]
        cut = int(r.integers(0, len(own) + 1))
        a, z = sorted(r.integers(0, 91, 2).tolist())
        rows.append((i, " ".join(own[:cut] + passage[a:z] * (i % 3 > 0) + own[cut:])))
    rows.append((99, "a b " * 60))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute.repeats(rows))
    assert any(x[2] for x in want) and not all(x[2] for x in want)
    for bits, size in ((3, 12_000_000), (3, 2_000), (12, 2_000), (64, 2_000)):
        got = substring_dedup.with_paths(df, block_bytes=size, bits=bits).collect()
        assert want == sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got), (bits, size)


def test_long_text_repeats(spark):
    """A text of 150,000 words that has a passage twice, and a copy of its end elsewhere."""
    w = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(w + w[:60])), (2, " ".join(w[-100:])), (3, "z")]
    got = substring_dedup.with_paths(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_removed) for x in got) == [(1, 60 + 60 + 100), (2, 100), (3, 0)]


def test_paths(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(400)) for x in "abc")
    df = spark.createDataFrame([(1, f"{a} {b}"), (2, f"{a} {c}"), (3, f"{c} {b}")], "doc_id long, text string")
    found = substring_dedup.substring_dedup(df)
    p = substring_dedup.paths(found).collect()
    assert p and all(r.copies >= 1 and all(x.end - x.start >= 35 for x in r.spans) for r in p)
    spans = defaultdict(set)
    for r in p:
        if r.verified:
            spans[(r.path_hi, r.path_lo)].add((r.block, r.nth))
    assert all(len(v) > 1 for v in spans.values()) and spans


def test_sorted_blobs():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        v = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (substring_dedup.unpack_sorted(substring_dedup.pack_sorted(v)) == v).all()


def pages_reference(source):
    """The generator's template read by hand: the article's blocks, tags gone, references decoded."""
    import html

    m = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", source or "", re.S)
    blocks = re.split(r"</?(?:p|h1|br)>", m[1]) if m else []
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b))).strip() for b in blocks]
    return " ".join(b for b in blocks if b)


def texts(pages):
    return [t for t, _ in html_extract.extract(pages)]


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: pages_reference(r.html) for r in pages.collect()}
    got = html_extract.extract_pages(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert sum(r.n_repeated > 0 for r in got) > 0


def test_suffix_array_decides():
    """Pages without an article lose what another page has, wherever it stands there, and keep the rest."""
    line = "all rights reserved by the owners of this small site"
    pages = [f"<body><footer>{line}</footer><article>Own text {line}</article></body>", f"<body><div>first {line}</div><p>alone here</p></body>", f"<p>second page {line} and more</p>"]
    got = html_extract.extract(pages)
    assert [t for t, _ in got] == [f"Own text {line}", "first alone here", "second page and more"]
    assert [n for _, n in got] == [10, 10, 10]


def test_long_pages():
    """Pages of some MB that only repeat open tags, stray end tags, unclosed quotes or scripts."""
    import time

    n = 150_000
    crafted = ["<div>" * n + "</b>" * n, "<div>x" * n + "</p>" * n, "<script>" * n, "<svg>" * n + "</script>" * n, "<a '" * n + '"', "<a \"" * (n + 1), "<" * 4 * n, "<!--" * n, "a&amp;" * n, '<p class="-advert' * n, "<b><i>" * n + "</u>" * n]
    for x in crafted:
        began = time.process_time()
        html_extract.Page(x)
        assert time.process_time() - began < 5, x[:20]


def test_page_parts(spark):
    art = "<html><body><header>Site</header><nav>Menu</nav><main><article><header><h1>Title</h1></header><p>One &amp; two<br>three</p><aside>Side</aside><div class='ad-box'>Buy</div><p>Four</article><section id=comments><p>Nice</p></section></main><form>Mail <input></form><footer>Foot</footer></body>"
    assert texts([art]) == ["Title One & two three Four"]
    assert texts([None, "", "<p>a <b>b</b>c<script>x('</p>')</script></p><p hidden>no</p>"]) == ["", "", "a bc"]
    note = "<div class='cookie-notice'>We use cookies</div>"
    shared = "one two three four five six seven eight nine ten"
    pages = [f"<body>{note}<div>{shared}</div><div>{w}1 {w}2 {w}3 here</div></body>" for w in ("a", "b", "c")]
    assert texts(pages) == [f"{w}1 {w}2 {w}3 here" for w in ("a", "b", "c")]
    rows = [(1, None, None, 5), (2, "http://h/x", art, 5), (2, "http://h/x", art, 5), (3, "odd", "", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = sorted((r.page_id, r.text) for r in html_extract.extract_pages(df).collect())
    assert got == [(1, ""), (2, "Title One & two three Four"), (2, "Title One & two three Four"), (3, "")]
    assert html_extract.extract_pages(df.limit(0)).collect() == []


def test_repeats_by_brute_force():
    r = np.random.default_rng(2)
    streams = [[f"t{x}" for x in r.integers(0, 3, int(r.integers(0, 40)))] for _ in range(6)]
    for least in (4, 8):
        got = html_extract.repeated_tokens(streams, least)
        for i, s in enumerate(streams):
            want = np.zeros(len(s), dtype=bool)
            for a in range(len(s) - least + 1):
                gram = s[a : a + least]
                if any(t[b : b + least] == gram for j, t in enumerate(streams) if j != i for b in range(len(t) - least + 1)):
                    want[a : a + least] = True
            assert (got[i] == want).all()


def test_pages_across_shards(spark):
    """A passage on two pages of a host goes whether or not they lie in one shard."""
    rows = []
    for i in range(60):
        shared = " ".join(f"pair{i // 2}x{k}" for k in range(9))
        rows.append((i, "http://h/x%d" % i, f"<body><div>{shared}</div><div>own{i} text{i} of{i} page{i}</div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"own{i} text{i} of{i} page{i}" for i in range(60)}
    for size in (8_000_000, 1000):
        got = {r.page_id: r.text for r in html_extract.extract_pages(df, shard_bytes=size).collect()}
        assert got == want


def test_packing(spark):
    sizes = np.array([7, 5, 5, 3, 10, 1, 9])
    bins = packing.best_fit_decreasing(sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(7)) and all(sizes[b].sum() <= 10 for b in bins)
    assert len(bins) == 4
    docs = spark.createDataFrame([(1, "a b " * 3000), (2, ""), (3, None), (4, "short text"), (None, "no id"), (4, "short text")], "doc_id long, text string")
    packed = packing.pack_documents(docs, length=64)
    rows = packed.collect()
    for r in rows:
        assert len(r.ids) == 4 * 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        pos = np.frombuffer(r.positions, "<u4")
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert (pos[a:b] == np.arange(b - a)).all()
    back = defaultdict(list)
    for r in packing.unpack(packed).collect():
        back[r.doc_id].append((r.offset, bytes(r.ids)))
    want = {r.doc_id: bytes(r.ids) for r in bpe.encode(docs).collect()}
    assert b"".join(x for _, x in sorted(back[1])) == want[1]
    assert {x for _, x in back[4]} == {want[4]} and len(back[4]) == 2 and set(back) == {1, 4, None}
    assert packing.pack_documents(docs.limit(0)).collect() == []
    assert sorted(map(str, rows)) == sorted(map(str, packing.pack_documents(docs.repartition(5), length=64).collect()))


def plain_best_fit(sizes, length):
    """Best fit decreasing by looking at every open bin."""
    bins, room, filled = [], [], []
    for clock, i in enumerate(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))):
        fits = [(room[b], -filled[b], b) for b in range(len(bins)) if room[b] >= sizes[i]]
        if not fits:
            bins.append([])
            room.append(length)
            filled.append(clock)
        b = min(fits)[2] if fits else len(bins) - 1
        bins[b].append(i)
        room[b] -= int(sizes[i])
        filled[b] = clock
    return bins


def test_best_fit_by_brute_force():
    r = np.random.default_rng(4)
    for length in (1, 2, 7, 10, 64, 100):
        for n in (0, 1, 5, 60, 300):
            sizes = r.integers(1, length + 1, n)
            assert packing.best_fit_decreasing(sizes, length) == plain_best_fit(sizes, length)
    assert packing.best_fit_decreasing(np.array([4, 4, 4, 4]), 8) == [[0, 1], [2, 3]]


def test_packed_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(40)], "doc_id long, text string")
    packed = packing.pack_documents(docs, length=32)
    packing.save(packed, str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    want = packed.collect()
    assert sorted(map(str, rows)) == sorted(map(str, want))
    m = packing.matrix(rows)
    assert m.shape == (len(want), 32) and int(m.sum()) == int(packing.matrix(want).sum())
    assert sum(r.n_tokens for r in rows) == sum(r.n_tokens for r in bpe.encode(docs).collect())


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    mine = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, t in mine if not t], [s for s, t in mine if t]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.8 and np.mean([s >= 0.5 for s in good]) < 0.08
    odd = spark.createDataFrame([(1, None, 3), (1, "", 3), (None, "x y", 3)], "doc_id long, text string, score int")
    assert toxicity.score(odd, model).count() == 3 and toxicity.score(odd.limit(0), model).collect() == []
    assert toxicity.keep_rows(odd, model).columns == odd.columns


def test_toxicity_gradients():
    """Gradients against finite differences of the loss."""
    r = np.random.default_rng(8)
    n, m, d = 7, 9, 3
    row, col = np.repeat(np.arange(n), 4), r.integers(0, m, 4 * n)
    val, y, fitted = r.random(4 * n), r.integers(0, 2, n), r.random(n)
    params = [r.normal(size=(m, d)), r.normal(size=(d, 2)), r.normal(size=2)]

    def loss():
        _, p = toxicity.forward(params, row, col, val, n)
        return -(fitted * np.log(p[np.arange(n), y])).sum()

    x, p = toxicity.forward(params, row, col, val, n)
    for q, grad in zip(params, toxicity.gradients(params, x, p, y, fitted, row, col, val), strict=True):
        for at in np.ndindex(q.shape):
            kept = q[at]
            q[at] = kept + 1e-6
            up = loss()
            q[at] = kept - 1e-6
            down = loss()
            q[at] = kept
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-6


def test_toxicity_scores_by_hand(spark):
    """A text's score from its words' bucket means, long and repeated texts included."""
    r = np.random.default_rng(3)
    model = toxicity.Model(r.normal(size=(toxicity.BUCKETS, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    rows = [(1, "Alpha beta, alpha!"), (1, "Alpha beta, alpha!"), (2, "one two three " * 60_000), (3, "?!"), (4, None)]
    df = spark.createDataFrame([(*x, 9, "c") for x in rows], "doc_id long, text string, score int, held_out string")

    def plain(text):
        ws = re.findall(r"\w+", (text or "").lower())
        logits = model.bias.copy()
        for w in set(ws):
            logits = logits + ws.count(w) / len(ws) * (model.vectors[toxicity.grams(w)].mean(axis=0) @ model.weights)
        return 1 / (1 + np.exp(logits[0] - logits[1]))

    got = sorted((x.doc_id, x.score) for x in toxicity.score(df, model).collect())
    assert got == [(d, pytest.approx(plain(t), abs=1e-9)) for d, t in rows]


def test_untrained():
    m = toxicity.train(["a b"], [0])
    assert toxicity.Scorer(*m.shares()).score("a") < 0.5


def test_pipeline_edges(spark):
    """Nulls, empty texts, repeated rows, an empty table, and columns named as the operators' results."""
    import corpus_pipeline as p

    names = "doc_id long, text string, lang string, source string, n_chars long, size long, copies long, rate double, fp long, target double"
    rows = [(1, "a b c d", "en", "s", 7, 1, 2, 0.5, 4, 1.0), (1, "a b c d", "en", "s", 7, 1, 2, 0.5, 4, 1.0), (None, None, None, None, None, None, None, None, None, None), (2, "", "de", None, 0, 8, 9, 1.0, 1, 2.0), (None, "x y z w v u", None, "t", 3, 3, 3, 3.0, 3, 3.0)]
    for data in (rows, []):
        d = spark.createDataFrame(data, names)
        for name, f in p.STAGES:
            out = f(spark, d, SF)
            if name != "bpe":
                assert out.columns == d.columns
            kept = out.collect()
            if name in ("toxicity", "exact_dedup", "simhash", "mixing"):
                assert set(map(tuple, kept)) <= set(data)
            if name == "exact_dedup" and data:
                assert len(kept) == 3
            if not data:
                assert kept == []
            d = spark.createDataFrame(kept, out.schema)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    d = docs
    for name, f in p.STAGES:
        d = f(spark, d, SF)
        steps[name] = d.collect()
        d = spark.createDataFrame(steps[name], d.schema)
        if name != "bpe":
            assert d.columns == docs.columns
    norm = lambda t: "".join(brute.words(t))
    clean = steps["toxicity"]
    assert {norm(r.text) for r in steps["exact_dedup"]} == {norm(r.text) for r in clean} and len(steps["exact_dedup"]) == len({norm(r.text) for r in clean})
    unique = [(r.doc_id, r.text) for r in steps["exact_dedup"]]
    assert sorted(r.doc_id for r in steps["simhash"]) == sorted(set(brute.near_components(unique)))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in steps["simhash"]:
        sizes[r.source] += len(brute.words(r.text))
    for r in steps["mixing"]:
        taken[r.source] += len(brute.words(r.text))
    want = brute.targets(sizes)
    assert all(abs(taken[s] - want[s]) <= max(60, 0.03 * want[s]) for s in sizes)
    texts = {r.doc_id: r.text for r in steps["mixing"]}
    assert len(steps["bpe"]) == len(steps["mixing"])
    for r in steps["bpe"]:
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() and len(r.ids) == 4 * r.n_tokens
    assert sorted(map(str, p.run(spark, SF).collect())) == sorted(map(str, steps["bpe"]))


def test_packed_query_comes_from_rows(spark, tmp_path, monkeypatch):
    """op9's digests are those of the rows of ids that the operator returns."""
    import hashlib

    from folioflow.llm import queries

    docs = spark.createDataFrame([(i, f"text number {i} " * (i * 40)) for i in range(12)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed, seen = packing.pack_documents, []
    monkeypatch.setattr(packing, "pack_documents", lambda *a, **k: seen.append(packed(*a, **k)) or seen[-1])
    got = sorted((r.pack_group, r.pack_row, r.n_tokens, r.ids, r.positions, r.segments) for r in queries.op9_packing(spark, str(tmp_path)).collect())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    rows = seen[0].collect()
    assert {len(r.ids) for r in rows} == {len(r.positions) for r in rows} == {4 * packing.LENGTH}
    assert got == sorted((r.pack_group, r.pack_row, r.n_tokens, sha(r.ids), sha(r.positions), r.segments) for r in rows)


def test_encoded_rows_leave_in_slices(spark, monkeypatch):
    """A worker holds some MB of results at most, whatever the size of a batch, and decoded texts stay in it."""
    import corpus_pipeline
    import pyarrow as pa

    texts = [None, "", *(f"text number {i} — " * (i % 400) for i in range(3000))]
    ids = pa.array([None, *range(1, len(texts))], pa.int64())
    docs, seen = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), []
    whole = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: seen.append((f, schema)) or whole(self, f, schema))
    corpus_pipeline.to_tokens(spark, docs, SF)
    bpe.encode(docs)
    c = bpe.codec(*bpe.vocabulary(spark).value)
    want = [c.encode(t or "") for t in texts]
    for (f, schema), back in zip(seen, (lambda t: hashlib.sha256(t).hexdigest(), bytes), strict=True):
        out = list(f(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["doc_id", "text"])] * 2)))
        assert max(b.nbytes for b in out) < 5_000_000 < sum(b.nbytes for b in out)
        assert [x.split()[0] for x in schema.split(", ")] == out[0].schema.names
        rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
        assert rows == [(d, len(e) // 4, e, back((t or "").encode())) for d, e, t in zip(ids.to_pylist(), want, texts, strict=True)] * 2
    assert seen[0][1] == "doc_id long, n_tokens long, ids binary, decoded_sha256 string"
