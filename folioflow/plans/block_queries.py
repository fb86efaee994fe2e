"""Queries over lines, words, blocks, styles and glossaries that `queries` does not hold, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import language as L
from ..functions import text as T
from ..operators import blocks as B
from ..operators import fonts, glossary, layout, page_joins, spatial, structure, units
from ..sources import layout_views as views
from ..sources import profiles
from .queries import AREA, BLOCKS_SQL, CROSS, LINES_SQL, NORM, PAGE, STYLES_SQL, WORDBOX_SQL, ZONES_SQL, _blocks, _docs, _lines, _query, _styles, _table

_long = lambda c: F.col(c).cast("long").alias(c)


@_query(
    f"""
WITH {WORDBOX_SQL},
p AS (SELECT *, (y0 + y1) / 2.0 AS mid, y1 - y0 AS h, i * 100000 + k AS o FROM words WHERE k < 100000),
q AS (SELECT *, lag(mid) OVER w AS pm, lag(h) OVER w AS ph FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY mid, o)),
g AS (SELECT *, sum(CASE WHEN abs(mid - pm) >= 0.4 * least(h, ph) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY mid, o) AS line FROM q)
SELECT doc_id, line::BIGINT AS line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, md5(string_agg(label, ' ' ORDER BY x0, o)) AS digest FROM g GROUP BY doc_id, line"""
)
def word_line_groups(spark, sf_dir):
    w = views.words(_docs(spark, sf_dir)).withColumn("word_id", F.col("i").cast("long") * 100_000 + F.col("k"))
    b = structure.line_boxes(structure.word_lines(w, PAGE), PAGE)
    return b.select("doc_id", _long("line"), "x0", "y0", "x1", "y1", F.md5("t").alias("digest"))


_UNIT_SQL = f"""
c0 AS (SELECT doc_id, i, {NORM.format('t')} AS s FROM lines),
c1 AS (SELECT * FROM c0 WHERE s <> '')"""


@_query(
    f"""
WITH {LINES_SQL}, {_UNIT_SQL},
u AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(s, '[.!?]\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM c1),
j AS (SELECT doc_id, unit, string_agg(s || CASE WHEN s LIKE '%-' THEN chr(1) ELSE ' ' END, '' ORDER BY i) AS s FROM u GROUP BY doc_id, unit)
SELECT doc_id, unit::BIGINT AS unit, md5({NORM.format("replace(regexp_replace(s, '(-' || chr(1) || '| )$', CASE WHEN s LIKE '%-' || chr(1) THEN '-' ELSE '' END), '-' || chr(1), '')")}) AS digest FROM j"""
)
def block_sentence_units(spark, sf_dir):
    s = units.block_sentences(_lines(spark, sf_dir), PAGE)
    return s.select("doc_id", _long("unit"), F.md5("s").alias("digest"))


@_query(
    f"""
WITH {BLOCKS_SQL},
p AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY doc_id ORDER BY y0, x0) AS gap FROM blocks)
SELECT doc_id, round_even(median(gap)::DECIMAL(20, 6), 2)::DOUBLE AS block_gap, count(*) AS gaps FROM p WHERE gap >= 0 GROUP BY doc_id"""
)
def block_gap_medians(spark, sf_dir):
    return layout.block_gaps(_blocks(spark, sf_dir), PAGE)


@_query(
    f"""
WITH {LINES_SQL},
p AS (SELECT *, abs(y0 - lag(y0) OVER (PARTITION BY doc_id ORDER BY y0, x0)) > greatest(2.0, 0.5 * (y1 - y0)) AS far FROM lines)
SELECT doc_id, i::BIGINT AS i, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y0, x0)::BIGINT AS row FROM p"""
)
def slot_row_numbers(spark, sf_dir):
    r = layout.slot_rows(_lines(spark, sf_dir), PAGE)
    return r.select("doc_id", _long("i"), _long("row"))


@_query(
    f"""
WITH {LINES_SQL}, {ZONES_SQL},
m AS (SELECT a.doc_id, a.i, max(CASE WHEN {CROSS} / greatest(1e-9, {AREA.format('a')}) >= 0.25 THEN 1 ELSE 0 END) AS covered, max(CASE WHEN {CROSS} > 0 AND {CROSS} / least({AREA.format('a')}, {AREA.format('b')})::DOUBLE >= 0.25 THEN 1 ELSE 0 END) AS overlapping
      FROM lines a JOIN zones b ON a.doc_id = b.doc_id WHERE {AREA.format('a')} > 0 GROUP BY a.doc_id, a.i)
SELECT doc_id, sum(covered)::BIGINT AS covered, sum(overlapping)::BIGINT AS overlapping FROM m GROUP BY doc_id HAVING sum(covered) > 0 OR sum(overlapping) > 0"""
)
def zone_semi_joins(spark, sf_dir):
    lines, zones = _lines(spark, sf_dir), views.zones(_docs(spark, sf_dir))
    a = spatial.covered_any(lines, zones, PAGE).select("doc_id", F.lit(1).alias("c"), F.lit(0).alias("o"))
    b = spatial.overlapping_any(lines, zones, PAGE).select("doc_id", F.lit(0).alias("c"), F.lit(1).alias("o"))
    return a.unionByName(b).groupBy("doc_id").agg(F.sum("c").alias("covered"), F.sum("o").alias("overlapping"))


@_query(
    f"""
WITH {BLOCKS_SQL},
r AS (SELECT *, CASE blk % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'body' WHEN 2 THEN 'header' ELSE 'equation_inline' END AS role, CASE WHEN doc_id % 2 = 0 THEN 'native' ELSE 'ocr' END AS source,
             length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS upper FROM blocks)
SELECT doc_id, blk, role = 'equation_inline' OR (role = 'title' AND length(t) <= 96 AND n <= 3 AND source = 'native') AS figure_label,
       role = 'equation_inline' OR (contains(t, '=') AND greatest(1, y1 - y0) <= 40) OR (role = 'header' AND length(t) <= 220) OR (greatest(1, y1 - y0) <= 22 AND length(t) <= 60) AS risky,
       CASE WHEN y0 >= 400 AND y1 <= 700 THEN 'diagram_label' WHEN length(t) <= 80 AND letters > 0 AND upper / letters::DOUBLE > 0.6 THEN 'caption' ELSE 'body' END AS kind FROM r"""
)
def block_kinds(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    role = F.element_at(F.array(*[F.lit(x) for x in ("title", "body", "header", "equation_inline")]), (F.col("blk") % 4 + 1).cast("int"))
    b = b.withColumn("role", role).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "native").otherwise("ocr"))
    return b.select(
        "doc_id",
        "blk",
        B.is_figure_label(F.col("role"), F.col("t"), F.col("n"), F.col("source")).alias("figure_label"),
        B.is_risky_for_reflow(F.col("role"), F.col("t"), F.col("t").contains("=")).alias("risky"),
        B.block_kind(F.col("t"), F.col("y0").between(400, 9**9) & (F.col("y1") <= 700)).alias("kind"),
    )


@_query(
    f"""
WITH {LINES_SQL}, {STYLES_SQL},
s AS (SELECT *, i // 5 AS blk FROM styles)
SELECT doc_id, blk::BIGINT AS blk, median(size) FILTER (WHERE size > 0) AS median_size, arg_min(font, i) AS font, arg_min(size, i) AS size, arg_min(color, i) AS color, arg_min(bold, i) AS bold, arg_min(italic, i) AS italic FROM s GROUP BY doc_id, blk"""
)
def block_style_signatures(spark, sf_dir):
    s = _styles(spark, sf_dir).withColumn("blk", F.floor(F.col("i") / 5).cast("long"))
    return B.block_style(s, ["doc_id", "blk"], "i")


@_query(
    f"""
WITH {LINES_SQL}, {STYLES_SQL},
f AS (SELECT *, CASE WHEN font = 'Courier' THEN CASE WHEN bold AND italic THEN 'cobi' WHEN bold THEN 'cobo' WHEN italic THEN 'coit' ELSE 'cour' END
                     WHEN serif THEN CASE WHEN bold AND italic THEN 'tibi' WHEN bold THEN 'tibo' WHEN italic THEN 'tiit' ELSE 'tiro' END
                     WHEN bold AND italic THEN 'hebi' WHEN bold THEN 'hebo' WHEN italic THEN 'heit' ELSE 'helv' END AS code FROM styles)
SELECT code, count(*) AS n, count(*) FILTER (WHERE lower(font) NOT IN ('helv', 'times', 'courier', 'arial', 'helvetica') AND code = 'helv') AS unresolved FROM f GROUP BY code"""
)
def builtin_font_codes(spark, sf_dir):
    s = _styles(spark, sf_dir).withColumn("code", B.builtin_font(F.col("font") == "Courier", F.col("serif"), F.col("bold"), F.col("italic")))
    lost = B.is_font_unresolved(F.lit("native"), F.col("font"), F.lit(None).cast("string"), F.col("code"))
    return s.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if(lost).alias("unresolved"))


@_query(
    f"""
WITH {WORDBOX_SQL}
SELECT doc_id, i::BIGINT AS i, md5(coalesce(string_agg(label, ' ' ORDER BY k) FILTER (WHERE k % 3 <> 1), '')) AS digest FROM words GROUP BY doc_id, i"""
)
def phrase_export_texts(spark, sf_dir):
    w = views.words(_docs(spark, sf_dir))
    spans = F.sort_array(F.collect_list(F.struct("k", F.col("label").alias("texte"), (F.col("k") % 3 == 1).alias("skip_render"))))
    g = w.groupBy("doc_id", "i").agg(spans.alias("spans"))
    return g.select("doc_id", _long("i"), F.md5(B.phrase_text(F.lit(""), F.col("spans"))).alias("digest"))


def _keyword_sql(text: str, table: dict[str, tuple[str, ...]], default: str) -> str:
    hits = {k: " + ".join("contains({0}, '{1}')::INT".format(text, w) for w in ws) for k, ws in table.items()}
    best = f"greatest({', '.join(hits.values())})"
    return f"CASE WHEN {best} = 0 THEN '{default}' " + " ".join(f"WHEN {h} = {best} THEN '{k}'" for k, h in hits.items()) + " END"


_FIELDS = tuple(L.SUBDOMAINS)


@_query(
    f"""
WITH k AS (SELECT unnest([{', '.join(f"'{w}'" for table in L.SUBDOMAINS.values() for ws in table.values() for w in ws)}]) AS w, generate_subscripts([{', '.join(f"'{w}'" for table in L.SUBDOMAINS.values() for ws in table.values() for w in ws)}], 1) - 1 AS at),
c AS (SELECT customer.c_custkey, string_agg(k.w, ' ' ORDER BY k.at) AS s FROM customer JOIN k ON k.at % 41 = customer.c_custkey % 41 OR k.at % 17 = customer.c_custkey % 17 GROUP BY customer.c_custkey)
SELECT c_custkey, {_keyword_sql('s', L.DOMAINS, 'general')} AS domain, CASE c_custkey % {len(_FIELDS)} {' '.join(f"WHEN {i} THEN {_keyword_sql('s', L.SUBDOMAINS[d], '')}" for i, d in enumerate(_FIELDS))} END AS subdomain FROM c"""
)
def domain_and_subdomain(spark, sf_dir):
    """The library's own lexicons over a text of keywords for each customer."""
    words = [w for table in L.SUBDOMAINS.values() for ws in table.values() for w in ws]
    pick = lambda key: F.filter(F.transform(F.array(*[F.lit(w) for w in words]), lambda w, at: F.when((at % 41 == key % 41) | (at % 17 == key % 17), w)), lambda w: w.isNotNull())
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.array_join(pick(F.col("c_custkey")), " "))).alias("s"))
    field = F.element_at(F.array(*[F.lit(d) for d in _FIELDS]), (F.col("c_custkey") % len(_FIELDS) + 1).cast("int"))
    return c.select("c_custkey", L.domain_of("s").alias("domain"), L.subdomain_of("s", field).alias("subdomain"))


@_query(
    f"""
WITH {LINES_SQL}, n AS (SELECT doc_id, lower({NORM.format('t')}) AS s FROM lines)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(s, '^\\((\\d+|[ivxlcdm]+|[a-z])\\)$') OR regexp_matches(s, '^\\[\\d+([,\\-\\s]*\\d+)*\\]$')) AS reference_like,
       count(*) FILTER (WHERE length(s) BETWEEN 4 AND 48 AND regexp_matches(s, '[a-z]')) AS diagram_text,
       count(*) FILTER (WHERE regexp_matches(s, '^[\\s,.;:()\\[\\]{{}}\\-–—/]+$')) AS separators,
       count(*) FILTER (WHERE regexp_matches(s, '[一-鿿]')) AS han, count(*) FILTER (WHERE regexp_matches(s, '[àâçéèêëîïôùûœ]')) AS french FROM n GROUP BY doc_id"""
)
def line_predicates(spark, sf_dir):
    d = _lines(spark, sf_dir)
    return d.groupBy("doc_id").agg(
        F.count_if(T.is_reference_like("t")).alias("reference_like"),
        F.count_if(T.is_diagram_text("t")).alias("diagram_text"),
        F.count_if(T.is_separator("t")).alias("separators"),
        F.count_if(L.guess_language("t") == "zh").alias("han"),
        F.count_if(L.language_by_diacritics("t") == "fr").alias("french"),
    )


@_query(
    """
WITH c AS (SELECT n_nationkey, ['French', 'zh-cn', 'DE', 'klingon', ' spanish ', 'xx'][(n_nationkey % 6)::INT + 1] AS name FROM nation)
SELECT n_nationkey, CASE lower(trim(name)) WHEN 'french' THEN 'fr' WHEN 'zh-cn' THEN 'zh' WHEN 'spanish' THEN 'es' WHEN 'klingon' THEN 'fr' ELSE lower(name) END AS code,
       CASE lower(trim(name)) WHEN 'french' THEN 'fra_Latn' WHEN 'zh-cn' THEN 'zho_Hans' WHEN 'de' THEN 'deu_Latn' WHEN 'spanish' THEN 'spa_Latn' WHEN 'klingon' THEN 'fra_Latn' END AS model FROM c"""
)
def language_codes(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("French", "zh-cn", "DE", "klingon", " spanish ", "xx")])
    c = _table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(names, (F.col("n_nationkey") % 6 + 1).cast("int")).alias("name"))
    return c.select("n_nationkey", L.language_code("name").alias("code"), L.model_code("name").alias("model"))


def _terms(spark, sf_dir) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    place = F.element_at(F.array(*[F.lit(x) for x in ("science", "science.physics", "physics", "general")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select(place.alias("domain"), F.lit("en").alias("src"), F.lit("fr").alias("tgt"), F.lit("entry").alias("kind"), F.lower("p_brand").alias("key"), F.col("p_name").alias("value"), F.col("p_partkey").alias("load_seq"))


_TERMS_SQL = "terms AS (SELECT ['science', 'science.physics', 'physics', 'general'][(p_partkey % 4)::INT + 1] AS domain, lower(p_brand) AS key, arg_max(p_name, p_partkey) AS value FROM part GROUP BY 1, 2)"


@_query(
    f"""
WITH {_TERMS_SQL}, chain AS (SELECT * FROM (VALUES ('science.physics', 0), ('science/physics', 1), ('physics', 2), ('science', 3), ('general', 4)) v(domain, rank))
SELECT 1::BIGINT AS id, key, arg_max(value, rank) AS value FROM terms JOIN chain USING (domain) WHERE length(key) >= 4 GROUP BY key"""
)
def glossary_pair_map(spark, sf_dir):
    """All entries for one chain of domains; the least specific one overrides."""
    ask = spark.createDataFrame([(1, "science", "physics", "en", "fr")], "id long, domain string, subdomain string, src string, tgt string")
    return glossary.pair_map(ask, glossary.last_wins(_terms(spark, sf_dir)), "id", general=True)


@_query(
    f"""
WITH {_TERMS_SQL}, l AS (SELECT unnest(['fr', 'de', 'es']) AS tgt)
SELECT DISTINCT key, tgt FROM terms, l WHERE NOT (tgt = 'fr' AND domain = 'science') AND NOT EXISTS (SELECT 1 FROM terms t WHERE t.key = terms.key AND t.domain = 'science' AND l.tgt = 'fr')"""
)
def glossary_gaps(spark, sf_dir):
    t = glossary.last_wins(_terms(spark, sf_dir))
    wanted = spark.createDataFrame([("fr",), ("de",), ("es",)], "tgt string")
    return glossary.missing_translations(t.select("key").distinct(), wanted, t.filter("domain = 'science'"))


_CHANNELS = "(c_custkey * 7919) // 65536 % 256 AS r, (c_custkey * 7919) // 256 % 256 AS g, (c_custkey * 7919) % 256 AS b"


@_query(
    f"""
WITH c AS (SELECT c_custkey, {_CHANNELS} FROM customer)
SELECT c_custkey, printf('#%02x%02x%02x', r::INT, g::INT, b::INT) AS color, printf('#%02x%02x%02x', least(255, round_even(r / 32.0, 0) * 32)::INT, least(255, round_even(g / 32.0, 0) * 32)::INT, least(255, round_even(b / 32.0, 0) * 32)::INT) AS bucket FROM c"""
)
def color_buckets(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", G.int_color(F.col("c_custkey") * 7919).alias("color"))
    return c.select("c_custkey", "color", G.color_bucket(F.col("color")).alias("bucket"))


_FONT_NAMES = ("ABCDEE+Calibri-Bold", "Arial", "LiberationSans-Italic", "Times New Roman", "Consolas", "Unknown", "", "Carlito")
_FONT_FILES = (("liberationsans", "/f/LiberationSans-Regular.ttf"), ("liberationsans", "/f/LiberationSans-Bold.ttf"), ("liberationsans", "/f/LiberationSans-BoldItalic.ttf"), ("carlito", "/f/Carlito-DemiOblique.ttf"), ("carlito", "/f/Carlito.ttf"), ("freemono", "/f/FreeMono.ttf"))


@_query(
    f"""
WITH files AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{p}', {i})" for i, (k, p) in enumerate(_FONT_FILES))}) v(key, path, ord)),
s AS (SELECT p_partkey, {list(_FONT_NAMES)}[(p_partkey % 8)::INT + 1] AS font, p_partkey % 2 = 0 AS bold, p_partkey % 3 = 0 AS italic, p_partkey % 5 = 0 AS serif, p_partkey % 7 = 0 AS mono FROM part),
k AS (SELECT *, CASE WHEN font IN ('ABCDEE+Calibri-Bold', 'Carlito') THEN 'carlito' WHEN font IN ('Arial', 'LiberationSans-Italic') THEN 'liberationsans' WHEN font = 'Consolas' THEN 'freemono' END AS key FROM s),
f AS (SELECT p_partkey, arg_min(path, -10 * ((bold = regexp_matches(lower(path), 'bold|demi'))::INT + (italic = regexp_matches(lower(path), 'italic|oblique'))::INT) + ord) AS file FROM k JOIN files USING (key) GROUP BY p_partkey)
SELECT p_partkey, file, CASE WHEN file IS NOT NULL THEN NULL
    WHEN mono THEN CASE WHEN bold AND italic THEN 'cobi' WHEN bold THEN 'cobo' WHEN italic THEN 'coit' ELSE 'cour' END
    WHEN serif THEN CASE WHEN bold AND italic THEN 'tibi' WHEN bold THEN 'tibo' WHEN italic THEN 'tiit' ELSE 'tiro' END
    WHEN bold AND italic THEN 'hebi' WHEN bold THEN 'hebo' WHEN italic THEN 'heit' ELSE 'helv' END AS builtin FROM k LEFT JOIN f USING (p_partkey)"""
)
def font_files(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(x) for x in _FONT_NAMES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    every = lambda n: F.col("p_partkey") % n == 0
    s = _table(spark, sf_dir, "part").select("p_partkey", name.alias("font"), every(2).alias("bold"), every(3).alias("italic"), every(5).alias("serif"), every(7).alias("mono"))
    catalog = spark.createDataFrame([(k, p, i) for i, (k, p) in enumerate(_FONT_FILES)], "key string, path string, ord int")
    return fonts.resolve(s, catalog).select("p_partkey", "file", "builtin")


_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


@_query(
    f"""
WITH cat AS (SELECT {_PLAIN.format('n_name')} AS key, concat('/n/', n_name) AS path, n_nationkey AS ord FROM nation WHERE n_nationkey % 4 = 0
             UNION ALL SELECT concat('font', {_PLAIN.format('n_name')}, 'x'), concat('/f/', n_name), 100 + n_nationkey FROM nation WHERE n_nationkey % 6 = 3
             UNION ALL SELECT 'an', '/short/an', 200 UNION ALL SELECT 'in', '/short/in', 50),
c AS (SELECT n_name AS class_name, {_PLAIN.format('n_name')} AS own, CASE WHEN n_nationkey % 3 = 0 THEN concat('font', {_PLAIN.format('n_name')}, 'x') END AS mapped FROM nation),
x AS (SELECT class_name, own, coalesce(arg_min(a.path, a.ord), arg_min(b.path, b.ord)) AS path FROM c LEFT JOIN cat a ON a.key = c.mapped LEFT JOIN cat b ON b.key = c.own GROUP BY class_name, own),
y AS (SELECT class_name, arg_min(cat.path, ord) AS path FROM x JOIN cat ON contains(key, own) OR contains(own, key) GROUP BY class_name)
SELECT class_name, coalesce(x.path, y.path) AS path FROM x LEFT JOIN y USING (class_name)"""
)
def font_class_files(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    plain = F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", "")
    catalog = n.filter("n_nationkey % 4 = 0").select(plain.alias("key"), F.concat(F.lit("/n/"), "n_name").alias("path"), F.col("n_nationkey").cast("int").alias("ord"))
    catalog = catalog.unionByName(n.filter("n_nationkey % 6 = 3").select(F.concat(F.lit("font"), plain, F.lit("x")).alias("key"), F.concat(F.lit("/f/"), "n_name").alias("path"), (F.col("n_nationkey") + 100).cast("int").alias("ord")))
    catalog = catalog.unionByName(spark.createDataFrame([("an", "/short/an", 200), ("in", "/short/in", 50)], "key string, path string, ord int"))
    mapping = n.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("class_name"), F.concat(F.lit("Font "), "n_name", F.lit("-X.ttf")).alias("mapped"))
    return fonts.class_files(n.select(F.col("n_name").alias("class_name")), mapping, catalog)


@_query(
    f"""
WITH {LINES_SQL},
b AS (SELECT doc_id, i // 5 AS block, i % 5 AS i, t, i AS pos FROM lines),
s AS (SELECT *, CASE WHEN pos % 4 = 0 THEN '' ELSE t || '!' END AS text FROM b WHERE pos % 3 <> 1),
w AS (SELECT doc_id, block, trim(string_agg(text, chr(10) ORDER BY i) FILTER (WHERE text <> '')) AS whole FROM s GROUP BY doc_id, block)
SELECT b.doc_id, b.block::BIGINT AS block, b.i::BIGINT AS i, (s.pos + 1)::BIGINT AS line_index, CASE WHEN s.pos IS NULL THEN NULL WHEN s.pos % 7 = 0 THEN '' ELSE '-' END AS marker,
       CASE WHEN s.pos % 11 = 0 THEN 0 ELSE (s.pos % 5) * 1.5 END::DOUBLE AS indent, s.pos % 2 = 0 AS break_before, CASE WHEN s.pos IS NOT NULL THEN true END AS break_after,
       md5(CASE WHEN s.text <> '' THEN s.text ELSE b.t END) AS line_digest, md5(w.whole) AS block_digest
FROM b LEFT JOIN s ON b.doc_id = s.doc_id AND b.pos = s.pos LEFT JOIN w ON b.doc_id = w.doc_id AND b.block = w.block"""
)
def layout_line_join(spark, sf_dir):
    d = _lines(spark, sf_dir).select("doc_id", F.floor(F.col("i") / 5).cast("long").alias("block"), (F.col("i") % 5).cast("long").alias("i"), "t", F.col("i").cast("long").alias("at"))
    stored = d.filter("at % 3 <> 1").select(
        "doc_id",
        "block",
        "i",
        (F.col("at") + 1).alias("index"),
        F.when(F.col("at") % 7 != 0, "-").alias("marker"),
        F.when(F.col("at") % 11 != 0, (F.col("at") % 5) * 1.5).alias("indent"),
        (F.col("at") % 2 == 0).alias("break_before"),
        F.lit(None).cast("boolean").alias("break_after"),
        F.when(F.col("at") % 4 == 0, "").otherwise(F.concat("t", F.lit("!"))).alias("text"),
    )
    out = page_joins.with_layout(d.drop("at"), stored, PAGE)
    return out.select("doc_id", "block", "i", "line_index", "marker", "indent", "break_before", "break_after", F.md5("line_text").alias("line_digest"), F.md5("block_text").alias("block_digest"))


@_query(
    f"""
WITH {LINES_SQL}, {ZONES_SQL},
o AS (SELECT *, (x1 - x0) * (y1 - y0) >= 4500 AS large FROM lines),
r AS (SELECT doc_id, false AS translated, 'zone' AS origin, x0, y0, x1, y1 FROM zones
      UNION ALL SELECT doc_id, false, origin, x0, y0, x1, y1 FROM o, (VALUES ('image'), ('overlay')) v(origin)
      UNION ALL SELECT doc_id, true, 'image', x0, y0, x1, y1 FROM o WHERE large
      UNION ALL SELECT doc_id, true, 'overlay', x0, y0, x1, y1 FROM o WHERE large OR i % 10 IN (0, 1))
SELECT doc_id, translated, origin, count(*) AS n, sum((x1 - x0) * (y1 - y0))::DOUBLE / 4 AS area FROM r GROUP BY doc_id, translated, origin"""
)
def forbidden_zones(spark, sf_dir):
    zones, lines = views.zones(_docs(spark, sf_dir)), _lines(spark, sf_dir)
    overlays = lines.withColumn("kind", F.when(F.col("i") % 10 == 0, "Diagram_Block").when(F.col("i") % 10 == 1, "").otherwise("symbol")).withColumn("reason", F.lit("diagram_block"))
    out = [page_joins.forbidden_zones(zones, lines, overlays, PAGE, t, 0.5).withColumn("translated", F.lit(t)) for t in (False, True)]
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return out[0].unionByName(out[1]).groupBy("doc_id", "translated", "origin").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("area"))


_SETTINGS = ", ".join(f"('{s}', '{n}', '{v}')" for s, names in profiles.DEFAULTS.items() for n, v in names.items())


@_query(
    f"""
WITH over_ AS (SELECT ['default', 'fr', 'de'][(s_suppkey % 3)::INT + 1] AS profile, CASE WHEN s_suppkey % 2 = 1 THEN 'quality_penalties' ELSE 'post_edit' END AS section, ['too_short', 'own_rule', 'weak_connectors'][(s_suppkey % 5 % 3)::INT + 1] AS name, max(s_name) AS value FROM supplier GROUP BY 1, 2, 3),
base AS (SELECT 'default' AS profile, section, name, value FROM (VALUES {_SETTINGS}) v(section, name, value)),
every AS (SELECT * FROM over_ UNION ALL SELECT * FROM base WHERE NOT EXISTS (SELECT 1 FROM over_ o WHERE o.profile = base.profile AND o.section = base.section AND o.name = base.name)),
r AS (SELECT lang, section, name, value, CASE WHEN profile = 'default' THEN 1 ELSE 0 END AS rank FROM (VALUES ('fr'), ('de'), ('es')) l(lang) JOIN every ON profile = 'default' OR profile = lang)
SELECT lang, section, name, arg_min(value, rank) AS value FROM r GROUP BY lang, section, name"""
)
def profile_settings(spark, sf_dir):
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (at + 1).cast("int"))
    key = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(pick(("default", "fr", "de"), key % 3).alias("profile"), F.when(key % 2 == 1, "quality_penalties").otherwise("post_edit").alias("section"), pick(("too_short", "own_rule", "weak_connectors"), key % 5 % 3).alias("name"), "s_name")
    own = rows.groupBy("profile", "section", "name").agg(F.max("s_name").alias("value"))
    langs = spark.createDataFrame([("fr",), ("de",), ("es",)], "lang string")
    return profiles.for_languages(profiles.overlay(profiles.defaults(spark), own), langs)


@_query(
    f"""
WITH {LINES_SQL}, n AS (SELECT doc_id, i, {NORM.format("t || CASE WHEN i % 4 = 0 THEN ' z-' ELSE '' END")} AS s FROM lines),
k AS (SELECT * FROM n WHERE s <> '' AND NOT regexp_matches(s, '^(?:\\.\\.\\.|[•▪◦·\\-*]|\\d{{1,2}}[.)]?)$')),
p AS (SELECT *, lag(s) OVER w AS before FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT *, sum(CASE WHEN coalesce(before, '') LIKE '%-' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit FROM p),
l AS (SELECT *, i = max(i) OVER (PARTITION BY doc_id, unit) AS last FROM u)
SELECT doc_id, unit::BIGINT AS unit, md5(string_agg(CASE WHEN last THEN s ELSE left(s, length(s) - 1) END, '' ORDER BY i)) AS digest FROM l GROUP BY doc_id, unit"""
)
def dehyphenated_lines(spark, sf_dir):
    d = _lines(spark, sf_dir).withColumn("t", F.concat("t", F.when(F.col("i") % 4 == 0, " z-").otherwise("")))
    return units.dehyphenated_lines(d, PAGE).select("doc_id", _long("unit"), F.md5("s").alias("digest"))


@_query(
    f"""
WITH {LINES_SQL},
c AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[,:;|/()\\[\\]{{}}]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') AS chunks, regexp_extract_all(t, '[0-9]+|[A-Za-zÀ-ÿ]+|[^\\s]') AS atoms FROM lines)
SELECT doc_id, sum(len(chunks))::BIGINT AS chunks, sum(len(atoms))::BIGINT AS atoms,
       sum(len(list_filter(atoms, lambda a: regexp_full_match(a, '[0-9]'))))::BIGINT AS chiffre, sum(len(list_filter(atoms, lambda a: regexp_full_match(a, '[0-9]{{2,}}'))))::BIGINT AS nombre,
       sum(len(list_filter(atoms, lambda a: regexp_full_match(a, '[A-Za-zÀ-ÿ]'))))::BIGINT AS lettre, sum(len(list_filter(atoms, lambda a: regexp_full_match(a, '[A-Za-zÀ-ÿ]{{2,}}'))))::BIGINT AS mot_alpha,
       sum(len(list_filter(atoms, lambda a: NOT regexp_matches(a, '[0-9A-Za-zÀ-ÿ]'))))::BIGINT AS symbole FROM c GROUP BY doc_id"""
)
def residual_atoms(spark, sf_dir):
    d = _lines(spark, sf_dir).select("doc_id", F.size(T.residual_chunks("t")).alias("n"), T.atoms("t").alias("a"))
    d = d.select("doc_id", "n", F.size("a").alias("m"), F.transform("a", T.atom_kind).alias("k"))
    count = lambda kind: F.sum(F.size(F.filter("k", lambda x: x == kind))).alias(kind)
    return d.groupBy("doc_id").agg(F.sum("n").alias("chunks"), F.sum("m").alias("atoms"), *[count(k) for k in ("chiffre", "nombre", "lettre", "mot_alpha", "symbole")])


@_query(
    f"""
WITH {LINES_SQL}
SELECT doc_id, i::BIGINT AS i, md5(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped, md5(regexp_replace(t, '[^A-Za-z0-9_-]+', '-', 'g')) AS slug,
       regexp_replace(lower(regexp_replace(t, '^[^+]*\\+', '')), '[^a-z0-9]+', '', 'g') AS font_key,
       regexp_matches(lower(t), 'bold|black|heavy|semibold|demi') AS bold, regexp_matches(lower(t), 'times|serif|roman|georgia|garamond|minion|palatino|cambria') AND NOT contains(lower(t), 'sans') AS serif FROM lines"""
)
def name_and_markup_keys(spark, sf_dir):
    f = T.font_flags("t")
    return _lines(spark, sf_dir).select("doc_id", _long("i"), F.md5(T.html_escape("t")).alias("escaped"), F.md5(T.css_slug("t")).alias("slug"), T.font_key("t").alias("font_key"), f["bold"].alias("bold"), f["serif"].alias("serif"))
