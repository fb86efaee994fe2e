"""Queries over the operators, each with equivalent DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import language as L
from ..functions import text as T
from ..operators import fidelity, glossary, layout, spatial, structure, style, translate, units
from ..sources import layout_views as views

PAGE = ["doc_id"]
WIDTH, HEIGHT = 1240, 1754
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Shared pieces of SQL.

NORM = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
WORDS = "regexp_extract_all({0}, '[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9''\\-]*')"
SENTENCES = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?:;])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def _markers(text: str, lang: str) -> str:
    listed = ", ".join(f"'{w}'" for w in L.MARKERS[lang])
    return f"len(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({listed})))"


LINES_SQL = """
raw AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls FROM documents),
l0 AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS i FROM raw),
l1 AS (SELECT *, CASE WHEN length(t) <= 36 THEN 26 ELSE 16 END AS h FROM l0),
l2 AS (SELECT *, 40 + coalesce(sum(h + CASE WHEN i % 6 = 5 THEN 48 ELSE 6 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top,
              CASE WHEN i % 9 = 4 THEN 120 ELSE 60 END AS lft FROM l1),
lines AS (SELECT doc_id, i, t, lft::BIGINT AS x0, top::BIGINT AS y0, least(lft + 7 * length(t), 1180)::BIGINT AS x1, (top + h)::BIGINT AS y1 FROM l2)"""
BLOCKS_SQL = (
    LINES_SQL
    + """,
b0 AS (SELECT *, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b1 AS (SELECT *, ((y1 - y0) + (py1 - py0)) / 2.0 AS avg_h FROM b0),
b2 AS (SELECT *, CASE WHEN px0 IS NULL THEN 0 WHEN y0 - py1 > avg_h * 2.0 OR (y0 + y1) / 2.0 - (py0 + py1) / 2.0 > avg_h * 3.5 OR abs(x0 - px0) > avg_h * 2.5 OR abs((y1 - y0) - (py1 - py0)) > avg_h * 0.5 THEN 1 ELSE 0 END AS brk FROM b1),
b3 AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS blk FROM b2),
b4 AS (SELECT *, y0 - lag(y1) OVER w AS gap, (y0 + y1) / 2.0 - lag((y0 + y1) / 2.0) OVER w AS step FROM b3 WINDOW w AS (PARTITION BY doc_id, blk ORDER BY i)),
blocks AS (SELECT doc_id, blk, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
                  coalesce(median(gap), 0)::DOUBLE AS line_spacing, median(y1 - y0)::DOUBLE AS avg_line_height, coalesce(median(step), 0)::DOUBLE AS peak_spacing,
                  string_agg(t, ' ' ORDER BY i) AS t FROM b4 GROUP BY doc_id, blk)"""
)
WORDBOX_SQL = (
    LINES_SQL
    + """,
w0 AS (SELECT doc_id, i, x0 AS lx, y0, y1, list_filter(string_split_regex(t, '\\s+'), lambda s: s <> '') AS ws FROM lines),
w1 AS (SELECT doc_id, i, lx, y0, y1, unnest(ws) AS label, generate_subscripts(ws, 1) - 1 AS k FROM w0),
w2 AS (SELECT *, (lx + coalesce(sum(7 * length(label) + CASE WHEN k % 8 = 7 THEN 40 ELSE 7 END) OVER (PARTITION BY doc_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS x0 FROM w1),
words AS (SELECT doc_id, i, k, label, x0, y0, x0 + 7 * length(label) AS x1, y1 FROM w2)"""
)
ZONES_SQL = """
z0 AS (SELECT doc_id, unnest([0, 1]) AS z FROM documents),
zones AS (SELECT doc_id, z, (100 + 350 * z)::BIGINT AS x0, (200 + 37 * (doc_id % 11) + 400 * z)::BIGINT AS y0, (400 + 350 * z)::BIGINT AS x1, (320 + 37 * (doc_id % 11) + 400 * z)::BIGINT AS y1 FROM z0)"""
STYLES_SQL = """
styles AS (SELECT doc_id, i, ['Arial', 'Times', 'Courier'][i % 3 + 1] AS font, [10.0, 12.0, 12.5, 18.0][(doc_id + i) % 4 + 1]::DOUBLE AS size,
                  ['#222222', '#101010', '#204080', '#f0f0a0'][doc_id % 4 + 1] AS color, i % 5 = 0 AS bold, i % 7 = 3 AS italic, i % 3 = 1 AS serif FROM lines)"""
CROSS = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
AREA = "((({0}.x1 - {0}.x0)) * ({0}.y1 - {0}.y0))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(_docs(spark, sf_dir))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.block_boxes(structure.line_blocks(_lines(spark, sf_dir), PAGE), PAGE)


# Text


@_query(
    f"""
WITH s AS (SELECT lang, {NORM.format('text')} AS t FROM documents),
u AS (SELECT lang, unnest({SENTENCES.format('t')}) AS s FROM s),
m AS (SELECT lang, s, {_markers('s', 'en')} AS en, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN {_markers('s', 'fr')} WHEN 'es' THEN {_markers('s', 'es')} WHEN 'de' THEN {_markers('s', 'de')} ELSE 0 END AS tg, greatest(1, len({WORDS.format('s')})) AS n FROM u)
SELECT lang, count(*) AS sentences, sum(length(s))::BIGINT AS chars, round(avg(CASE WHEN lang = 'en' THEN 0 ELSE (en * 1.4 - tg * 0.9) / n END), 6) AS mean_leak
FROM m GROUP BY lang"""
)
def sentence_profile(spark, sf_dir):
    d = _docs(spark, sf_dir).select("lang", F.explode(T.sentences("text")).alias("s"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("s")).alias("chars"), F.round(F.avg(L.leak_score("s", F.col("lang"))), 6).alias("mean_leak"))


@_query(f"SELECT doc_id, length(lower({NORM.format('text')})) AS n, md5(lower({NORM.format('text')})) AS digest FROM documents")
def norm_text_stats(spark, sf_dir):
    s = T.norm_text("text")
    return _docs(spark, sf_dir).select("doc_id", F.length(s).cast("long").alias("n"), F.md5(s).alias("digest"))


@_query(f"WITH s AS (SELECT doc_id, {SENTENCES.format(NORM.format('text'))} AS u FROM documents) SELECT doc_id, len(u) AS n, coalesce(list_max(list_transform(u, lambda x: length(x))), 0) AS longest FROM s")
def sentence_units(spark, sf_dir):
    u = T.sentences("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(u).cast("long").alias("n"), F.coalesce(F.array_max(F.transform(u, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


@_query(f"SELECT doc_id, len({WORDS.format('text')}) AS n, len(list_distinct({WORDS.format('text')})) AS n_distinct FROM documents")
def lexical_word_counts(spark, sf_dir):
    w = T.words("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@_query("SELECT doc_id, " + ", ".join(f"{_markers('text', k)} AS {k}" for k in ("en", "fr", "es", "de")) + " FROM documents")
def language_marker_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *[L.marker_count("text", k).cast("long").alias(k) for k in ("en", "fr", "es", "de")])


@_query(
    f"""
WITH m AS (SELECT doc_id, lang, {_markers('text', 'en')} AS en, {_markers('text', 'fr')} AS fr FROM documents)
SELECT lang, count(*) AS n, round(avg((en + 1.0) / (fr + 1.0)), 6) AS leak, count(*) FILTER (WHERE (en + 1.0) / (fr + 1.0) <= 1.15) AS passed FROM m GROUP BY lang"""
)
def source_leak_by_lang(spark, sf_dir):
    leak = L.source_leak("text", F.lit("fr"), F.lit("en"))
    d = _docs(spark, sf_dir).select("lang", leak.alias("leak"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("leak"), 6).alias("leak"), F.count_if(F.col("leak") <= L.MAX_SOURCE_LEAK).alias("passed"))


@_query(
    f"""
WITH u AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: {NORM.format('s')}), lambda s: s <> '')) AS s FROM documents),
k AS (SELECT s, length(s) <= 2 OR regexp_matches(s, '^[A-Z]{{1,3}}$') OR regexp_matches(s, '(?i)(https?://|www\\.|[\\w.-]+@[\\w.-]+\\.\\w+|doi:\\s*|arxiv:)')
         OR regexp_matches(s, '(?i)(et al\\.|vol\\.|no\\.|pp\\.|doi|isbn|issn)') OR regexp_matches(s, '\\[[0-9,\\-\\s]+\\]') OR regexp_matches(s, '\\([A-Z][A-Za-z\\-]+,\\s*(19|20)\\d{{2}}\\)')
         OR regexp_matches(s, '[=<>±×÷∑∫∞≈≠≤≥√∆∂µλΩα-ωΑ-Ω]') OR regexp_matches(s, '\\b[a-zA-Z]\\s*/\\s*[a-zA-Z]\\b')
         OR len(list_filter(regexp_extract_all(s, '\\b[A-Za-z0-9]{{3,}}\\b'), lambda t: regexp_matches(t, '^(?:[A-Z][a-z]?\\d*){{2,}}$') AND regexp_matches(t, '[a-z\\d]'))) > 0
         OR regexp_matches(s, '\\b[A-Za-z]+\\^\\d+\\b|\\b\\d+\\s*[x*]\\s*10\\^-?\\d+\\b')
         OR len(list_filter(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9\\-]{{1,}}'), lambda t: regexp_matches(t, '^[A-Z]{{2,8}}$'))) >= greatest(2, floor(len(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9\\-]{{1,}}')) * 0.5)) AS protected,
       len(regexp_extract_all(s, '[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9''\\-]*')) AS n, len(regexp_extract_all(s, '[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ''\\-]*')) AS alpha, len({WORDS.format('s')}) AS lex FROM u)
SELECT CASE WHEN protected THEN 'symbole' WHEN n >= 4 AND alpha >= 3 AND (regexp_matches(s, '[.!?:;]$') OR n >= 5) THEN 'phrase' WHEN lex >= 2 THEN 'expression' WHEN lex = 1 THEN 'mot' ELSE 'symbole' END AS kind, count(*) AS n
FROM k GROUP BY 1"""
)
def unit_kind_distribution(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("s"))
    return units.counts(d.withColumn("kind", T.item_kind("s")).filter("kind != 'skip'"), [])


@_query(
    f"""
WITH s AS (SELECT doc_id, {SENTENCES.format(NORM.format('text'))} AS u FROM documents),
e AS (SELECT doc_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM s),
k AS (SELECT doc_id, i, lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS key FROM e),
p AS (SELECT doc_id, key <> lag(key) OVER (PARTITION BY doc_id ORDER BY i) AS new FROM k)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE new IS NULL OR new) AS kept FROM p GROUP BY doc_id"""
)
def consecutive_dup_sentences(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.sentences("text").alias("u"))
    key = lambda x: F.lower(F.regexp_replace(x, r"(?U)\W+", ""))
    kept = F.filter("u", lambda x, i: (i == 0) | (key(x) != key(F.get("u", F.greatest(i - 1, F.lit(0))))))
    return d.select("doc_id", F.size("u").cast("long").alias("n"), F.size(kept).cast("long").alias("kept")).filter("n > 0")


@_query(f"WITH {LINES_SQL} SELECT doc_id, i::BIGINT AS i, md5(t) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM lines) WHERE r = 1")
def first_wins_distinct_lines(spark, sf_dir):
    # The order is part of a struct, so the first row is found by a partial aggregate and not by a sort per text.
    d = _lines(spark, sf_dir).groupBy("t").agg(F.min(F.struct("doc_id", "i")).alias("f"))
    return d.select("f.doc_id", F.col("f.i").cast("long").alias("i"), F.md5("t").alias("digest"))


@_query(
    f"""
WITH t AS (SELECT doc_id, source, list_distinct(list_filter(string_split_regex(lower({NORM.format('text')}), '[^a-z0-9]+'), lambda w: w <> '')) AS k FROM documents),
p AS (SELECT doc_id, k, lag(doc_id) OVER w AS other, lag(k) OVER w AS j FROM t WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, other, CASE WHEN len(k) = 0 OR len(j) = 0 THEN 0.0 ELSE round(len(list_intersect(k, j))::DOUBLE / (len(k) + len(j) - len(list_intersect(k, j))), 9) END AS similarity
FROM p WHERE other IS NOT NULL"""
)
def token_jaccard_pairs(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source", T.tokens("text").alias("k"))
    w = W.partitionBy("source").orderBy("doc_id")
    d = d.withColumn("other", F.lag("doc_id").over(w)).withColumn("j", F.lag("k").over(w)).filter("other is not null")
    return d.select("doc_id", "other", F.round(T.jaccard(F.col("k"), F.col("j")), 9).alias("similarity"))


LEXICON = {"ing": ("ing", "nting", "edha"), "tion": ("tion", "ation"), "mente": ("ment", "mente"), "ung": ("ung", "lich", "keit")}


@_query(
    "WITH lex(domain, ord, ks) AS (VALUES "
    + ", ".join(f"('{d}', {i}, [{', '.join(repr(k) for k in ks)}])" for i, (d, ks) in enumerate(LEXICON.items()))
    + """),
s AS (SELECT doc_id, domain, ord, len(list_filter(ks, lambda k: contains(lower(coalesce(text, '')), k))) AS hits FROM documents, lex)
SELECT doc_id, CASE WHEN max(hits) > 0 THEN arg_max(domain, hits * 100 - ord) ELSE 'general' END AS domain, max(hits) AS hits FROM s GROUP BY doc_id"""
)
def domain_detect(spark, sf_dir):
    lex = L.lexicon(spark, LEXICON).withColumn("ord", F.lit(None).cast("int"))
    order = spark.createDataFrame([(d, i) for i, d in enumerate(LEXICON)], "domain string, ord int")
    lex = lex.drop("ord").join(order, "domain")
    d = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("t"))
    return glossary.detect_domain(d, lex, "doc_id").withColumn("hits", F.col("hits").cast("long"))


@_query(
    f"""
WITH d AS (SELECT doc_id, {NORM.format('text')} AS t FROM documents),
u AS (SELECT doc_id, unnest({SENTENCES.format('t')}) AS s FROM d),
p AS (SELECT doc_id, s, list_transform(list_filter(list_transform(string_split(regexp_replace(s, ',\\s+', concat(',', chr(1)), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), lambda x: {{'n': 0::BIGINT, 'm': 0::BIGINT, 'c': length(x)::BIGINT}}) AS parts FROM u),
r AS (SELECT doc_id, s, CASE WHEN length(s) > 260 THEN list_reduce(parts, lambda a, x: CASE WHEN a.c + 1 + x.c <= 260 THEN {{'n': a.n, 'm': a.m, 'c': a.c + 1 + x.c}} ELSE {{'n': a.n + 1, 'm': greatest(a.m, a.c), 'c': x.c}} END) ELSE {{'n': 0::BIGINT, 'm': 0::BIGINT, 'c': length(s)::BIGINT}} END AS e FROM p),
g AS (SELECT doc_id, sum(e.n + 1) AS n, max(greatest(e.m, e.c)) AS longest FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n, coalesce(longest, 0)::BIGINT AS longest FROM documents LEFT JOIN g USING (doc_id)"""
)
def direct_translation_chunks(spark, sf_dir):
    c = T.chunks("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(c).cast("long").alias("n"), F.coalesce(F.array_max(F.transform(c, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


# Structure


@_query(f"WITH {LINES_SQL} SELECT doc_id, i::BIGINT AS i, x0, y0, x1, y1, md5(t) AS digest FROM lines")
def synthetic_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", F.col("i").cast("long").alias("i"), "x0", "y0", "x1", "y1", F.md5("t").alias("digest"))


@_query(f"WITH {BLOCKS_SQL} SELECT doc_id, blk, n, x0, y0, x1, y1, line_spacing, avg_line_height, peak_spacing, md5(t) AS digest FROM blocks")
def line_blocks(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return b.select("doc_id", "blk", "n", "x0", "y0", "x1", "y1", "line_spacing", F.col("avg_line_height").cast("double").alias("avg_line_height"), "peak_spacing", F.md5("t").alias("digest"))


@_query(
    f"""
WITH {WORDBOX_SQL},
g AS (SELECT *, lag(x1) OVER (PARTITION BY doc_id, i ORDER BY x0, k) AS px1, avg(y1 - y0) OVER (PARTITION BY doc_id, i) AS mh FROM words),
p AS (SELECT *, sum(CASE WHEN x0 - px1 > 1.5 * mh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, i ORDER BY x0, k) AS phrase FROM g)
SELECT doc_id, i::BIGINT AS i, phrase::BIGINT AS phrase, count(*) AS n, min(x0) AS x0, max(x1) AS x1, md5(string_agg(label, ' ' ORDER BY k)) AS digest FROM p GROUP BY doc_id, i, phrase"""
)
def phrase_groups(spark, sf_dir):
    w = structure.word_phrases(views.words(_docs(spark, sf_dir)), ["doc_id", "i"])
    p = structure.phrase_boxes(w, ["doc_id", "i"])
    return p.select("doc_id", F.col("i").cast("long").alias("i"), "phrase", "n", "x0", "x1", F.md5("t").alias("digest"))


@_query(
    f"""
WITH {BLOCKS_SQL},
m AS (SELECT doc_id, blk, i, t, y1 - y0 AS h0, (x0 - min(x0) OVER (PARTITION BY doc_id, blk))::DOUBLE AS indent_px, y0, y1, x0 FROM b3),
f AS (SELECT *, row_number() OVER w - 1 AS line_index, greatest(1, first_value(h0) OVER w) AS h, greatest(0, y0 - lag(y1) OVER w) AS gap, abs(indent_px - lag(indent_px) OVER w) AS moved FROM m WINDOW w AS (PARTITION BY doc_id, blk ORDER BY y0, x0, i))
SELECT doc_id, blk, line_index, indent_px, line_index = 0 OR gap > greatest(2.5, h * 0.42) OR moved > greatest(8.0, h * 0.45) AS hard_break_before,
       coalesce(nullif(regexp_extract(t, '^([•▪◦·\\-*])\\s+', 1), ''), regexp_extract(t, '^((?:\\d+|[A-Za-z])[.)])\\s+', 1)) AS leading_marker FROM f"""
)
def line_markers(spark, sf_dir):
    b = structure.line_blocks(_lines(spark, sf_dir), PAGE)
    m = structure.line_markers(b, ["doc_id", "blk"])
    return m.select("doc_id", "blk", F.col("line_index").cast("long").alias("line_index"), "indent_px", "hard_break_before", "leading_marker")


CONTENT_SQL = f"""
page AS (SELECT doc_id, min(x0)::INT AS c0, min(y0)::INT AS c1, max(x1)::INT AS c2, max(y1)::INT AS c3 FROM blocks GROUP BY doc_id),
bands AS (SELECT *, {WIDTH} AS width, greatest({HEIGHT}, c3 + 60) AS height FROM page),
content AS (SELECT *, greatest(0, c0) AS margin_left, greatest(0, width - c2) AS margin_right, greatest(0, c1) AS margin_top, greatest(0, height - c3) AS margin_bottom,
                   least(height, greatest(24, floor(height * 0.10)::INT)) AS header_end, greatest(0, height - greatest(24, floor(height * 0.10)::INT)) AS footer_start FROM bands)"""


def _page_blocks(spark, sf_dir) -> DataFrame:
    b = _blocks(spark, sf_dir)
    last = F.max("y1").over(W.partitionBy("doc_id"))
    return b.withColumn("page_h", F.greatest(F.lit(HEIGHT), last + 60).cast("int"))


@_query(f"WITH {BLOCKS_SQL}, {CONTENT_SQL} SELECT doc_id, c0, c1, c2, c3, margin_left, margin_right, margin_top, margin_bottom, header_end, footer_start FROM content")
def content_bbox_margins(spark, sf_dir):
    c = layout.content_box(_page_blocks(spark, sf_dir), PAGE, F.lit(WIDTH), F.col("page_h"))
    return c.drop("width", "height")


@_query(
    f"""
WITH {BLOCKS_SQL}, {CONTENT_SQL},
r AS (SELECT b.*, c.c0, c.c2, c.header_end, c.footer_start, lower({NORM.format('b.t')}) AS s, greatest(1.0, b.x1 - b.x0) AS bw, (b.y0 + b.y1) / 2.0 AS cy, greatest(1.0, c.c2 - c.c0) AS cw, greatest(0.0, b.x0 - c.c0) AS lg, greatest(0.0, c.c2 - b.x1) AS rg FROM blocks b JOIN content c USING (doc_id)),
q AS (SELECT *, length(s) <= 140 AS short, bw < (c2 - c0) * 0.8 AS part, (length(s) <= 36 AND (regexp_matches(s, '(d[a-z]\\s*/\\s*d[a-z]|[a-z]\\s*/\\s*[a-z])') OR regexp_matches(s, '[=+\\-*/^()\\[\\]<>±×÷∑∫∞≈≠≤≥√∆∂µλΩα-ωΑ-Ω]')))
              OR (length(s) <= 64 AND length(regexp_replace(s, '[a-z0-9\\s]+', '', 'g')) >= greatest(3, floor(length(s) * 0.18)::INT)) AS eq FROM r)
SELECT doc_id, blk, CASE WHEN s <> '' AND eq THEN 'equation_inline' WHEN y1 <= header_end AND short THEN 'header' WHEN y0 >= footer_start AND short THEN 'footer'
       WHEN y1 <= header_end AND part THEN 'header' WHEN y0 >= footer_start AND part THEN 'footer' WHEN cy <= header_end AND short THEN 'header' WHEN cy >= footer_start AND short THEN 'footer'
       WHEN regexp_matches(s, '^\\s*(figure|fig\\.?)\\s*\\d+') THEN 'figure_caption' WHEN regexp_matches(s, '^\\s*(\\d+(\\.\\d+)+)\\b') THEN 'section_heading'
       WHEN short AND len(list_filter(string_split(s, ' '), lambda w: w <> '')) <= 12 AND part THEN 'title' ELSE 'body' END AS role,
       CASE WHEN bw >= cw * 0.88 AND lg <= greatest(8.0, cw * 0.03) AND rg <= greatest(8.0, cw * 0.03) THEN 'justify' WHEN abs(lg - rg) <= greatest(10.0, cw * 0.06) AND bw < cw * 0.88 THEN 'center'
            WHEN rg <= greatest(8.0, cw * 0.03) AND lg > greatest(8.0, cw * 0.03) THEN 'right' ELSE 'left' END AS alignment, lg::DOUBLE AS indent_px FROM q"""
)
def role_classify(spark, sf_dir):
    return layout.annotate(_page_blocks(spark, sf_dir), PAGE, F.lit(WIDTH), F.col("page_h")).select("doc_id", "blk", "role", "alignment", "indent_px")


@_query(
    f"""
WITH {BLOCKS_SQL}, s AS (SELECT *, CASE WHEN blk % 3 = 0 THEN 560 WHEN blk % 3 = 1 THEN 0 ELSE 620 END AS dx FROM blocks),
m AS (SELECT doc_id, x0 + dx AS a, least(x1, 600) + dx AS b FROM s)
SELECT doc_id, count(*) FILTER (WHERE a < 620 AND b > 620) AS crossing, count(*) FILTER (WHERE NOT (a < 620 AND b > 620) AND b <= 620) AS "left", count(*) FILTER (WHERE NOT (a < 620 AND b > 620) AND b > 620 AND a >= 620) AS "right",
       CASE WHEN "left" >= 3 AND "right" >= 3 AND crossing <= greatest(2, floor(0.25 * ("left" + "right"))) THEN 2 ELSE 1 END AS columns, CASE WHEN columns = 2 THEN 74 ELSE 0 END AS gutter FROM m GROUP BY doc_id"""
)
def columns_infer(spark, sf_dir):
    dx = F.when(F.col("blk") % 3 == 0, 560).when(F.col("blk") % 3 == 1, 0).otherwise(620)
    b = _blocks(spark, sf_dir).withColumn("x1", F.least("x1", F.lit(600)) + dx).withColumn("x0", F.col("x0") + dx)
    return layout.columns(b, PAGE, F.lit(WIDTH))


@_query(
    f"""
WITH {BLOCKS_SQL},
o AS (SELECT doc_id, y0, y1, greatest(0, coalesce(max(y1) OVER (PARTITION BY doc_id ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reach FROM blocks),
f AS (SELECT doc_id, reach AS f0, least(y0, {HEIGHT}) AS f1 FROM o UNION ALL SELECT doc_id, greatest(0, max(y1)), {HEIGHT} FROM blocks GROUP BY doc_id)
SELECT doc_id, f0::BIGINT AS f0, f1::BIGINT AS f1 FROM f WHERE f1 - f0 >= 14"""
)
def free_frames(spark, sf_dir):
    f = layout.free_frames(_blocks(spark, sf_dir), PAGE, F.lit(0), F.lit(HEIGHT))
    return f.select("doc_id", F.col("f0").cast("long").alias("f0"), F.col("f1").cast("long").alias("f1"))


@_query(
    f"""
WITH {LINES_SQL}, t AS (SELECT doc_id, i, {NORM.format('t')} AS s FROM lines),
k AS (SELECT * FROM t WHERE s <> '' AND NOT regexp_matches(s, '^(?:\\.\\.\\.|[•▪◦·\\-*]|\\d{{1,2}}[.)]?)$')),
u AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(s, '[.!?…]\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM k)
SELECT doc_id, unit::BIGINT AS unit, count(*) AS n_lines, bool_or(regexp_matches(s, '[.!?…]\\s*$')) AS ended FROM u GROUP BY doc_id, unit"""
)
def sentence_islands(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    s = units.sentence_stream(lines, PAGE)
    kept = lines.filter(~T.is_marker_only("t"))
    w = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    n = kept.withColumn("unit", F.coalesce(F.sum(F.col("t").rlike(r"[.!?…]\s*$").cast("int")).over(w), F.lit(0))).groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("n_lines"))
    return s.join(n, ["doc_id", "unit"]).select("doc_id", F.col("unit").cast("long").alias("unit"), "n_lines", "ended")


@_query()
def unit_hierarchy(spark, sf_dir):
    return units.counts(units.hierarchy(_lines(spark, sf_dir), PAGE), PAGE)


# Joins on rectangles


@_query(f"WITH {WORDBOX_SQL}, {ZONES_SQL} SELECT doc_id, count(*) AS n FROM words a WHERE NOT EXISTS (SELECT 1 FROM zones b WHERE b.doc_id = a.doc_id AND {CROSS} / {AREA.format('a')}::DOUBLE > 0.5) GROUP BY doc_id")
def ocr_native_anti(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return spatial.not_covered(views.words(docs), views.zones(docs), PAGE).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {LINES_SQL}, {ZONES_SQL} SELECT doc_id, i::BIGINT AS i FROM lines a WHERE NOT EXISTS (SELECT 1 FROM zones b WHERE b.doc_id = a.doc_id AND {CROSS} / {AREA.format('a')}::DOUBLE >= 0.25)")
def protected_regions_anti(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return spatial.covered_any(views.lines(docs), views.zones(docs), PAGE, 0.25, "left_anti").select("doc_id", F.col("i").cast("long").alias("i"))


@_query(
    f"""
WITH {LINES_SQL}, tall AS (SELECT doc_id, i, x0, y0, x1, y1 + 12 AS y1 FROM lines)
SELECT a.doc_id, a.i::BIGINT AS a, b.i::BIGINT AS b, round({CROSS} / least({AREA.format('a')}, {AREA.format('b')})::DOUBLE, 9) AS ratio FROM tall a JOIN tall b ON a.doc_id = b.doc_id AND a.i < b.i
WHERE {CROSS} > 0 AND {CROSS} / least({AREA.format('a')}, {AREA.format('b')})::DOUBLE > 0.10"""
)
def overlap_pairs(spark, sf_dir):
    tall = _lines(spark, sf_dir).withColumn("y1", F.col("y1") + 12)
    p = spatial.overlap_pairs(tall, PAGE, "i", 0.10)
    return p.select("doc_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("ratio", 9).alias("ratio"))


@_query(
    f"""
WITH {LINES_SQL}, {ZONES_SQL},
p AS (SELECT a.doc_id, a.i, b.z, pow((a.x0 + a.x1) / 2.0 - (b.x0 + b.x1) / 2.0, 2) + pow((a.y0 + a.y1) / 2.0 - (b.y0 + b.y1) / 2.0, 2) AS d2 FROM lines a JOIN zones b USING (doc_id)
      WHERE least(a.x1, b.x1 + 75) > greatest(a.x0, b.x0 - 75) AND least(a.y1, b.y1 + 85) > greatest(a.y0, b.y0 - 85))
SELECT doc_id, i::BIGINT AS i, arg_min(z, (d2, z))::BIGINT AS z, min(d2)::DOUBLE AS d2 FROM p GROUP BY doc_id, i"""
)
def nearest_anchor(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    n = spatial.nearest(views.lines(docs), views.zones(docs), PAGE, "i", "z", 75, 85)
    return n.select("doc_id", F.col("i").cast("long").alias("i"), F.col("z").cast("long").alias("z"), F.col("d2").cast("double").alias("d2"))


@_query(
    f"""
WITH {LINES_SQL},
p AS (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(CASE WHEN least(x1, px1) + 8 > greatest(x0, px0) AND y0 - 4 < py1 + 4 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM p)
SELECT doc_id, i::BIGINT AS i, CASE WHEN count(*) OVER (PARTITION BY doc_id, island) >= 3 THEN min(i) OVER (PARTITION BY doc_id, island) ELSE i END::BIGINT AS grp FROM g"""
)
def diagram_components(spark, sf_dir):
    """Components of all lines. On these pages a padded line meets its neighbours only, so the SQL needs no pairs."""
    g = spatial.label_groups(_lines(spark, sf_dir), PAGE, "i", 4.0)
    return g.select("doc_id", F.col("i").cast("long").alias("i"), F.col("grp").cast("long").alias("grp"))


#: Text bytes of one task of word_dedupe, whose words take some 40 times as much.
TASK_BYTES = 4_000_000


@_query()
def word_dedupe(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    docs = docs.repartition(max(1, -(-total // TASK_BYTES)), "doc_id")
    # A wide copy of each third word; rows stay in their page's partition.
    wide = F.explode(F.when(F.col("k") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    w = views.words(docs).select("*", wide.alias("wide"))
    word_id = F.col("i").cast("long") * 100_000_000 + F.col("k") + 50_000_000 * F.col("wide")
    w = w.select("doc_id", word_id.alias("word_id"), "label", "x0", "y0", (F.col("x1") + 3 * F.col("wide")).alias("x1"), "y1")
    return spatial.dedupe_words(w, PAGE, columns=PAGE).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# Styles


def _styles(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir)
    lines = structure.line_blocks(views.lines(docs), PAGE).select("doc_id", "i", "blk")
    return views.styles(docs).join(lines, ["doc_id", "i"])


STYLED_SQL = f"{BLOCKS_SQL}, {STYLES_SQL}, st AS (SELECT s.*, b.blk FROM styles s JOIN b3 b USING (doc_id, i))"


def _mode_sql(table: str, keys: str, col: str, order: str) -> str:
    return f"(SELECT {keys}, arg_max({col}, n * 100000000 - o) AS {col} FROM (SELECT {keys}, {col}, count(*) AS n, min({order}) AS o FROM {table} GROUP BY {keys}, {col}) GROUP BY {keys})"


@_query(
    f"WITH {STYLED_SQL}, sz AS (SELECT doc_id, blk, median(size)::DOUBLE AS size FROM st GROUP BY doc_id, blk) SELECT * FROM sz "
    + " ".join(f"JOIN {_mode_sql('st', 'doc_id, blk', c, 'i')} m_{c} USING (doc_id, blk)" for c in ("font", "color", "bold", "italic", "serif"))
)
def dominant_style(spark, sf_dir):
    return style.dominant_style(_styles(spark, sf_dir), ["doc_id", "blk"], "i")


def _style_blocks(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("i") % 4 == 0, "heading").when(F.col("i") % 11 == 5, "caption").otherwise("body")
    return views.styles(_docs(spark, sf_dir)).withColumn("semantic", kind)


SEMANTIC_SQL = f"{LINES_SQL}, {STYLES_SQL}, sb AS (SELECT *, CASE WHEN i % 4 = 0 THEN 'heading' WHEN i % 11 = 5 THEN 'caption' ELSE 'body' END AS semantic, round_even(size, 0)::INT AS size_bucket FROM styles)"
BUCKET_SQL = "CASE color WHEN '#222222' THEN '#202020' WHEN '#101010' THEN '#000000' WHEN '#204080' THEN '#204080' ELSE '#ffffa0' END"


@_query(
    f"""
WITH {SEMANTIC_SQL}, k AS (SELECT *, bold::INT AS is_bold, italic::INT AS is_italic, serif::INT AS is_serif, {BUCKET_SQL} AS color_bucket FROM sb),
g AS (SELECT doc_id, semantic, size_bucket, is_bold, is_italic, is_serif, color_bucket, count(*) AS occurrences, median(size)::DOUBLE AS size, min(i) AS first FROM k GROUP BY ALL)
SELECT doc_id, semantic, size_bucket, is_bold, is_italic, is_serif, color_bucket, occurrences, size, row_number() OVER (PARTITION BY doc_id ORDER BY occurrences DESC, first) AS rank FROM g"""
)
def style_clusters(spark, sf_dir):
    c = style.style_clusters(_style_blocks(spark, sf_dir), PAGE, "i")
    return c.select("doc_id", "semantic", "size_bucket", "is_bold", "is_italic", "is_serif", "color_bucket", "occurrences", "size", F.col("rank").cast("long").alias("rank"))


@_query(f"WITH {SEMANTIC_SQL}, d AS (SELECT DISTINCT doc_id, size_bucket AS size FROM sb WHERE semantic = 'heading') SELECT * FROM (SELECT doc_id, size, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS level FROM d) WHERE level <= 3")
def heading_levels(spark, sf_dir):
    return style.heading_levels(_style_blocks(spark, sf_dir), PAGE).withColumn("level", F.col("level").cast("long"))


@_query(
    f"WITH {LINES_SQL}, {STYLES_SQL}, g AS (SELECT doc_id % 50 AS doc_id, color, count(*) AS n, min(doc_id * 1000000 + i) AS first FROM styles GROUP BY 1, 2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank, color, n FROM g"
)
def palette_topk(spark, sf_dir):
    s = views.styles(_docs(spark, sf_dir)).withColumn("o", F.col("doc_id") * 1_000_000 + F.col("i")).withColumn("doc_id", F.col("doc_id") % 50)
    return style.palette(s, PAGE, "o").withColumn("rank", F.col("rank").cast("long"))


# Glossaries


def _glossary(spark, sf_dir, rule: str, value) -> DataFrame:
    p = _table(spark, sf_dir, "part").filter(rule)
    return p.select(
        F.lower(F.element_at(F.split("p_type", " "), 1)).alias("domain"),
        F.lit("en").alias("src"),
        F.lit("fr").alias("tgt"),
        F.lit("entry").alias("kind"),
        T.norm_text("p_name").alias("key"),
        value.alias("value"),
        F.col("p_partkey").alias("load_seq"),
    )


def _glossary_sql(rule: str, value: str) -> str:
    return f"SELECT lower(string_split(p_type, ' ')[1]) AS domain, lower({NORM.format('p_name')}) AS key, arg_max({value}, p_partkey) AS value FROM part WHERE {rule} GROUP BY 1, 2"


@_query(f"WITH o AS ({_glossary_sql('p_partkey % 2 = 0', 'p_brand')}), n AS ({_glossary_sql('p_partkey % 3 = 0', 'p_type')}) SELECT coalesce(o.domain, n.domain) AS domain, coalesce(o.key, n.key) AS key, coalesce(n.value, o.value) AS value FROM o FULL JOIN n ON o.domain = n.domain AND o.key = n.key")
def glossary_upsert(spark, sf_dir):
    old = glossary.last_wins(_glossary(spark, sf_dir, "p_partkey % 2 = 0", F.col("p_brand")))
    new = glossary.last_wins(_glossary(spark, sf_dir, "p_partkey % 3 = 0", F.col("p_type")))
    return glossary.upsert(old, new).select("domain", "key", "value")


@_query(
    f"""
WITH g AS ({_glossary_sql('p_partkey % 2 = 0', 'p_brand')}),
i AS (SELECT p_partkey AS id, lower({NORM.format('p_name')}) AS key, lower(string_split(p_type, ' ')[1]) AS d1 FROM part),
c AS (SELECT id, key, unnest([d1, 'general']) AS domain, unnest([0, 1]) AS rank FROM i)
SELECT id, arg_min(value, rank) AS value FROM c JOIN g USING (domain, key) GROUP BY id"""
)
def glossary_priority_lookup(spark, sf_dir):
    g = glossary.last_wins(_glossary(spark, sf_dir, "p_partkey % 2 = 0", F.col("p_brand")))
    items = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("t"), F.element_at(F.split("p_type", " "), 1).alias("domain"), F.lit("").alias("subdomain"), F.lit("en").alias("src"), F.lit("fr").alias("tgt")
    )
    return glossary.exact_lookup(items, g, "id", general=True)


@_query(
    """
WITH e AS (SELECT p_type AS synset, lower(p_brand) AS key, p_partkey AS o FROM part WHERE p_partkey % 2 = 0), t AS (SELECT p_type AS synset, p_name AS value, p_partkey AS o FROM part WHERE p_partkey % 2 = 1)
SELECT key, arg_min(value, e.o * 100000000 + t.o) AS value FROM e JOIN t USING (synset) GROUP BY key"""
)
def synset_first_wins(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    e = p.filter("p_partkey % 2 = 0").select(F.col("p_type").alias("synset"), F.col("p_brand").alias("lemma"), F.col("p_partkey").alias("ord"))
    t = p.filter("p_partkey % 2 = 1").select(F.col("p_type").alias("synset"), F.col("p_name").alias("lemma"), F.col("p_partkey").alias("ord"))
    return glossary.synset_pairs(e, t)


# Translation


def _pairs(spark, sf_dir) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "lang", F.explode(F.array(T.sentences("text"))).alias("u")).filter(F.size("u") >= 2)
    both = F.arrays_zip(F.slice("u", 1, F.size("u") - 1).alias("source"), F.slice("u", 2, F.size("u") - 1).alias("translation"))
    d = d.select("doc_id", "lang", F.posexplode(both).alias("at", "p"))
    role = F.when(F.col("doc_id") % 5 == 0, "header").otherwise("body")
    return d.select("doc_id", F.col("at").cast("long").alias("at"), "p.source", "p.translation", role.alias("role"), F.col("lang").alias("tgt"))


@_query(
    f"""
WITH u AS (SELECT doc_id, lang, {SENTENCES.format(NORM.format('text'))} AS u FROM documents),
e AS (SELECT doc_id, lang, u, unnest(range(0, len(u) - 1)) AS k FROM u WHERE len(u) >= 2),
p AS (SELECT doc_id, lang, k::BIGINT AS "at", u[k + 1] AS s, u[k + 2] AS t, CASE WHEN doc_id % 5 = 0 THEN 'header' ELSE 'body' END AS role FROM e),
m AS (SELECT *, len({WORDS.format('s')}) AS n, len({WORDS.format('t')}) AS m, {_markers('t', 'en')} AS en, CASE lang WHEN 'en' THEN {_markers('t', 'en')} WHEN 'fr' THEN {_markers('t', 'fr')} WHEN 'es' THEN {_markers('t', 'es')} WHEN 'de' THEN {_markers('t', 'de')} ELSE 0 END AS tg FROM p),
f AS (SELECT *, list_filter([CASE WHEN s = t THEN 'unchanged_translation' END, CASE WHEN n >= 5 AND m < greatest(3, floor(n * 0.45)) THEN 'too_short' END, CASE WHEN m > greatest(60, floor(greatest(1, n) * 2.7)) THEN 'too_long' END,
        CASE WHEN lang <> 'en' AND tg = 0 AND en >= 2 THEN 'english_leak' WHEN lang <> 'en' AND en > tg + 3 THEN 'mixed_language' END, CASE WHEN regexp_matches(t, '[!?]{{2,}}') THEN 'punctuation_noise' END,
        CASE WHEN NOT regexp_matches(s, '[.!?]\\s*$') AND n >= 8 THEN 'source_fragment' END,
        CASE WHEN length(s) - length(replace(s, '(', '')) <> length(t) - length(replace(t, '(', '')) OR length(s) - length(replace(s, ')', '')) <> length(t) - length(replace(t, ')', '')) THEN 'parenthesis_mismatch' END], lambda x: x IS NOT NULL) AS flags FROM m),
g AS (SELECT *, 100 - coalesce(list_sum(list_transform(flags, lambda x: CASE x WHEN 'unchanged_translation' THEN 40 WHEN 'too_short' THEN 20 WHEN 'too_long' THEN 15 WHEN 'english_leak' THEN 25 WHEN 'mixed_language' THEN 12 WHEN 'punctuation_noise' THEN 10 WHEN 'source_fragment' THEN 6 ELSE 8 END)), 0) AS raw FROM f),
h AS (SELECT *, greatest(0, least(100, CASE WHEN role = 'header' AND n <= 6 THEN greatest(raw, 70) ELSE raw END))::BIGINT AS score FROM g)
SELECT doc_id, "at", score, array_to_string(flags, ',') AS flags, CASE WHEN score < 72 THEN 'critical' WHEN score < 88 THEN 'review' ELSE 'ok' END AS status FROM h"""
)
def translation_quality(spark, sf_dir):
    """Every pair of neighbouring sentences."""
    d = L.with_quality(_pairs(spark, sf_dir), F.col("source"), F.col("translation"), F.col("role"), F.col("tgt"))
    return d.select("doc_id", "at", F.col("score").cast("long").alias("score"), F.array_join("flags", ",").alias("flags"), "status")


@_query()
def staged_translation(spark, sf_dir):
    """All sentences; equal ones take the same stages, so each distinct one is translated once and counted n times."""
    texts = _docs(spark, sf_dir).select(F.explode(T.sentences("text")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    items = texts.select(F.struct(F.unhex(F.md5("t")).alias("text"), "n").alias("id"), "t", F.lit("body").alias("role"), F.lit("general").alias("domain"), F.lit("").alias("subdomain"), F.lit("en").alias("src"), F.lit("fr").alias("tgt"))
    none = spark.createDataFrame([], glossary.SCHEMA)
    out = translate.translate(items, none)
    return out.groupBy("stage", "status").agg(F.coalesce(F.sum("id.n"), F.lit(0)).alias("n"))


@_query(
    f"""
WITH t AS (SELECT conv_id, turn, {NORM.format('text')} AS s FROM conversations)
SELECT conv_id, turn, md5(coalesce(string_agg(s, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS digest FROM t"""
)
def turn_previous_context(spark, sf_dir):
    d = units.previous_context(_table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return d.select("conv_id", "turn", F.md5("previous").alias("digest"))


# Fidelity


@_query(
    "WITH s AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id) SELECT user_id, v[floor(0.5 * (len(v) - 1))::INT + 1] AS p50, v[floor(0.8 * (len(v) - 1))::INT + 1] AS p80, v[floor(0.95 * (len(v) - 1))::INT + 1] AS p95 FROM s"
)
def percentile_signature(spark, sf_dir):
    s = fidelity.discrete_percentiles(_table(spark, sf_dir, "events"), ["user_id"], "value")
    return s.select("user_id", *[F.col("signature")[i].alias(n) for i, n in enumerate(("p50", "p80", "p95"))])


@_query(
    """
WITH p AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(greatest(0.0, least(1.0, 1 - list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE) / greatest(abs(z[1]::DOUBLE), abs(z[2]::DOUBLE), 1.0))) / len(a))), 6) AS similarity FROM p WHERE b IS NOT NULL"""
)
def vec_similarity(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    # Ids are consecutive, so the next vector is found by an equi-join and not by one sorted task.
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(n, "vec_id").select("vec_id", F.round(fidelity.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


METRIC_SQL = "SELECT user_id % 20 AS k, " + ", ".join(f"abs(sin(event_id * {i + 1}))::DOUBLE AS {c}" for i, c in enumerate(fidelity.WEIGHTS)) + " FROM events"


@_query(
    f"WITH m AS ({METRIC_SQL}), o AS (SELECT *, "
    + " + ".join(f"{w} * {c}" for c, w in fidelity.WEIGHTS.items())
    + " AS overall FROM m) SELECT k, count(overall) AS pages_compared, count(*) AS pages_total, "
    + ", ".join(f"round(avg({c}), 3) AS {c}" for c in fidelity.METRICS)
    + " FROM o GROUP BY k"
)
def page_metric_aggregate(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    m = e.select((F.col("user_id") % 20).alias("k"), *[F.abs(F.sin(F.col("event_id") * (i + 1))).alias(c) for i, c in enumerate(fidelity.WEIGHTS)])
    d = m.withColumn("overall", fidelity.overall())
    mean = d.groupBy("k").agg(F.count("overall").alias("pages_compared"), F.count(F.lit(1)).alias("pages_total"), *[F.round(F.avg(c), 3).alias(c) for c in fidelity.METRICS])
    return mean


@_query(
    f"""
WITH {LINES_SQL}, r AS (SELECT doc_id, i, length(t) % 4 = 0 AS blank FROM lines), g AS (SELECT *, sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM r),
runs AS (SELECT doc_id, grp, count(*) AS run FROM g WHERE blank GROUP BY doc_id, grp) SELECT doc_id, median(run)::DOUBLE AS mid, quantile_cont(run, 0.9)::DOUBLE AS p90 FROM runs GROUP BY doc_id"""
)
def whitespace_runs(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("ink", F.when(F.length("t") % 4 == 0, 0).otherwise(9))
    s = fidelity.gap_signature(fidelity.gap_runs(rows, PAGE, "i", "ink", F.lit(1240)), PAGE)
    return s.select("doc_id", F.col("signature")[0].alias("mid"), F.col("signature")[1].alias("p90"))


@_query("SELECT lang, quality, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, quality)")
def quality_rollup(spark, sf_dir):
    d = _docs(spark, sf_dir).join(_table(spark, sf_dir, "labels"), "doc_id")
    return d.rollup("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@_query(
    f"""
WITH {WORDBOX_SQL}, {ZONES_SQL},
v AS (SELECT *, lag(x1) OVER (PARTITION BY doc_id, i ORDER BY x0, k) AS px1 FROM words),
c AS (SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE x1 > {WIDTH} OR y1 > {HEIGHT}) AS off_page_words, count(*) FILTER (WHERE x0 < px1) AS n_over FROM v GROUP BY doc_id),
h AS (SELECT a.doc_id, count(*) AS n FROM lines a WHERE EXISTS (SELECT 1 FROM zones b WHERE b.doc_id = a.doc_id AND {CROSS} > 0 AND {CROSS} / least({AREA.format('a')}, {AREA.format('b')})::DOUBLE > 0.10) GROUP BY a.doc_id)
SELECT doc_id, sum(words)::BIGINT AS words, sum(off_page_words)::BIGINT AS off_page_words, sum(n_over)::BIGINT AS word_overlaps, coalesce(sum(n), 0)::BIGINT AS text_image_collisions FROM c LEFT JOIN h USING (doc_id) GROUP BY ROLLUP (doc_id)"""
)
def layout_quality(spark, sf_dir):
    """All counts over all words. Words of these pages overlap in their own line only, so the SQL compares neighbours."""
    docs = _docs(spark, sf_dir)
    words, lines, zones = views.words(docs), views.lines(docs), views.zones(docs)
    pages = docs.select("doc_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    off = spatial.off_page(words, pages, PAGE)
    hits = spatial.text_image_collisions(lines, zones, pages, PAGE)
    ids = words.withColumn("w", F.col("i").cast("long") * 100_000_000 + F.col("k"))
    return layout.quality_counts(words, off, spatial.overlap_pairs(ids, PAGE, "w", band=32), hits, PAGE)


_LINEAR = "CASE WHEN {0} / 255.0::DOUBLE <= 0.03928 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_ON_WHITE = "1.05 / (0.2126 * {0} + 0.7152 * {1} + 0.0722 * {2} + 0.05)"
_HEX = "printf('#%02x%02x%02x', {0}::INT, {1}::INT, {2}::INT)"
_DARK = [f"floor({c} * 0.42::DOUBLE)" for c in "rgb"]
_NEAR = [f"least(255, round_even({c} / 32.0, 0) * 32)" for c in "rgb"]


@_query(
    f"""
WITH c AS (SELECT c_custkey, (c_custkey * 7919) // 65536 % 256 AS r, (c_custkey * 7919) // 256 % 256 AS g, (c_custkey * 7919) % 256 AS b FROM customer)
SELECT c_custkey, {_HEX.format(*'rgb')} AS color, CASE WHEN {_ON_WHITE.format(*[_LINEAR.format(c) for c in 'rgb'])} >= 4.5 THEN {_HEX.format(*'rgb')} WHEN {_ON_WHITE.format(*[_LINEAR.format(c) for c in _DARK])} >= 4.5 THEN {_HEX.format(*_DARK)} ELSE '#222222' END AS readable, {_HEX.format(*_NEAR)} AS bucket FROM c"""
)
def colors_on_white(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", G.int_color(F.col("c_custkey") * 7919).alias("color"))
    return c.select("c_custkey", "color", G.readable_color(F.col("color")).alias("readable"), G.color_bucket(F.col("color")).alias("bucket"))
