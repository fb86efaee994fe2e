"""Readers: page content, layout XML, payloads, terminology files and listings, as flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import language as L
from ..functions import text as T

#: Column names accepted for a term and its translation.
SOURCE_NAMES = ("source", "src", "term", "text")
TARGET_NAMES = ("target", "tgt", "translation")
IMAGE_TYPES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
OFFICE_TYPES = (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".odt", ".odp", ".ods", ".rtf")
XML_MAX_BYTES = 1_048_576


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, length, extension and kind (pdf, office, image or other) of the files under a folder."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified"), "length")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.when(ext == ".pdf", "pdf").when(ext.isin(*OFFICE_TYPES), "office").when(ext.isin(*IMAGE_TYPES), "image").otherwise("other")
    return d.withColumn("extension", ext).withColumn("kind", kind)


def native_lines(spans: DataFrame, keys: list[str], scale: float = 150 / 72) -> DataFrame:
    """One phrase per native line: the span texts joined without a blank, and the box in whole pixels.

    spans: keys, block_no, line_no, span_no, text, x0..y1 in points. Blank spans are left out.
    """
    s = spans.filter(F.trim(T.text("text")) != "")
    px = [(F.col(c) * scale).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]
    s = s.select(*keys, "block_no", "line_no", "span_no", "text", *px)
    parts = F.sort_array(F.collect_list(F.struct("span_no", "text")))
    g = s.groupBy(*keys, "block_no", "line_no").agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("t"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    return g.filter(F.trim("t") != "")


def native_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Native lines to blocks n_0, n_1, ... in block order, with the union of their boxes."""
    g = lines.groupBy(*keys, "block_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n_lines"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("block_no")) - 1
    return g.withColumn("block_id", F.concat(F.lit("n_"), nth.cast("string"))).withColumn("source", F.lit("native"))


def native_zones(blocks: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """Image blocks (block_type 1), and drawings of positive extent."""
    z = blocks.filter("block_type = 1").withColumn("zone", F.lit("image"))
    if drawings is not None:
        z = z.unionByName(drawings.filter(G.area(G.rect()) > 0).withColumn("zone", F.lit("drawing")), allowMissingColumns=True)
    return z


def recognised_words(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Polygons (points, text, score) as words with an upright box in whole pixels."""
    axis = lambda k: F.transform("points", lambda p: p[k])
    return polygons.select(
        *keys,
        F.col("text").alias("label"),
        F.array_min(axis(0)).cast("int").alias("x0"),
        F.array_min(axis(1)).cast("int").alias("y0"),
        F.array_max(axis(0)).cast("int").alias("x1"),
        F.array_max(axis(1)).cast("int").alias("y1"),
        "score",
    )


def payload_pages(payloads: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Pages of JSON payloads: the fields of each entry, or of the structure inside it. fields: name to type."""
    flat = ",".join(f"{k}:{v}" for k, v in fields.items())
    schema = f"struct<pages:array<struct<structure:struct<{flat}>,{flat}>>>"
    d = payloads.select("payload_id", F.posexplode(F.from_json(column, schema)["pages"]).alias("page", "p"))
    return d.select("payload_id", "page", *[F.coalesce(F.col(f"p.structure.{f}"), F.col(f"p.{f}")).alias(f) for f in fields])


def layout_xml(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of layout XML files of at most XML_MAX_BYTES: attributes and lines as read."""
    d = spark.read.format("xml").option("rowTag", "block").load(path)
    return d.withColumn("file", F.col("_metadata.file_path")).filter(F.col("_metadata.file_size") <= XML_MAX_BYTES)


def box_csv(c: Column) -> list[Column]:
    """The four numbers of "x0,y0,x1,y1"."""
    p = F.split(c, r"\s*,\s*")
    return [F.get(p, F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]


def trusted(df: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """Files under one of the folders, without steps upwards."""
    ok = F.lit(False)
    for p in prefixes:
        ok = ok | F.col(path).startswith(p.rstrip("/") + "/")
    return df.filter(ok & ~F.col(path).contains("/../"))


# Terminology


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def _pairs(d: DataFrame, order: str = "at") -> DataFrame:
    """The glossary columns; load_seq follows path, then place in the file, so "last" is well defined."""
    d = d.withColumn("key", F.lower(T.clean_spaces("key"))).withColumn("value", T.clean_spaces("value")).filter("key != '' and value != ''")
    paths = d.select("path").distinct().withColumn("__p", F.row_number().over(W.orderBy("path")).cast("long"))  # a row per file
    d = d.join(paths, "path").withColumn("load_seq", F.col("__p") * 1_000_000_000_000 + F.col(order))
    return d.select("domain", "src", "tgt", "kind", "key", "value", "load_seq")


def glossary_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON glossaries under a folder: entries as an object or as source and target rows, and normalize; bad files give nothing."""
    d = _files(spark, path, "*.json")
    get = lambda k, dflt: F.coalesce(F.get_json_object("body", f"$.{k}"), F.lit(dflt))
    head = [F.lower(F.trim(get("domain", "general"))).alias("domain"), L.language_code(get("source_lang", "en")).alias("src"), L.language_code(get("target_lang", "fr")).alias("tgt")]
    d = d.select("path", "body", *head)
    as_map = lambda k: F.from_json(F.get_json_object("body", f"$.{k}"), "map<string,string>")
    rows = F.from_json(F.get_json_object("body", "$.entries"), "array<struct<source:string,target:string>>")
    is_list = F.get_json_object("body", "$.entries").startswith("[")
    keep = ["path", "domain", "src", "tgt"]
    a = d.filter(~is_list).select(*keep, F.lit("entry").alias("kind"), F.explode(F.map_entries(as_map("entries"))).alias("e"))
    b = d.filter(is_list).select(*keep, F.lit("entry").alias("kind"), F.explode(rows).alias("e"))
    c = d.select(*keep, F.lit("normalize").alias("kind"), F.explode(F.map_entries(as_map("normalize"))).alias("e"))
    flat = a.select(*keep, "kind", "e.key", "e.value").unionByName(c.select(*keep, "kind", "e.key", "e.value"))
    flat = flat.unionByName(b.select(*keep, "kind", F.col("e.source").alias("key"), F.col("e.target").alias("value")))
    return _pairs(flat.withColumn("at", F.lit(0).cast("long")))


def terms_delimited(spark: SparkSession, path: str, sep: str, domain: str, src: str, tgt: str) -> DataFrame:
    """CSV or TSV terms: headers trimmed and lower-cased, several names for a column, or the language code itself."""
    d = spark.read.csv(path, header=True, sep=sep, multiLine=True)
    d = d.toDF(*[c.strip().lower() for c in d.columns])
    pick = lambda names: F.coalesce(*[F.col(n) for n in names if n in d.columns], F.lit(None).cast("string"))
    own = F.coalesce(F.nullif(F.lower(F.trim(F.col("domain"))), F.lit("")), F.lit(domain)) if "domain" in d.columns else F.lit(domain)
    flat = d.select(
        F.lit(path).alias("path"),
        own.alias("domain"),
        F.lit(src).alias("src"),
        F.lit(tgt).alias("tgt"),
        F.lit("entry").alias("kind"),
        pick((*SOURCE_NAMES, "en", src)).alias("key"),
        pick((*TARGET_NAMES, tgt)).alias("value"),
        F.monotonically_increasing_id().alias("at"),
    )
    return _pairs(flat)


def terms_json(spark: SparkSession, path: str, domain: str, src: str, tgt: str) -> DataFrame:
    """JSON terms in three shapes: an object with entries, a list of rows, or a flat object of terms."""
    d = _files(spark, path, "*.json").withColumn("body", F.trim("body"))
    inner = F.get_json_object("body", "$.entries")
    d = d.withColumn("data", F.coalesce(inner, F.col("body"))).withColumn("domain", F.coalesce(F.get_json_object("body", "$.domain"), F.lit(domain)))
    rows = d.filter(F.col("data").startswith("[")).select("path", "domain", F.posexplode(F.from_json("data", "array<map<string,string>>")).alias("at", "m"))
    pick = lambda names: F.coalesce(*[F.try_element_at("m", F.lit(n)) for n in names])
    a = rows.select("path", "domain", F.col("at").cast("long").alias("at"), pick(SOURCE_NAMES).alias("key"), pick(TARGET_NAMES).alias("value"))
    b = d.filter(F.col("data").startswith("{")).select("path", "domain", F.explode(F.map_entries(F.from_json("data", "map<string,string>"))).alias("e"))
    b = b.select("path", "domain", F.lit(0).cast("long").alias("at"), "e.key", "e.value")
    flat = a.unionByName(b).select("path", "domain", F.lit(src).alias("src"), F.lit(tgt).alias("tgt"), F.lit("entry").alias("kind"), "key", "value", "at")
    return _pairs(flat)


def tmx(spark: SparkSession, path: str, domain: str, src: str, tgt: str) -> DataFrame:
    """Translation units: of each language the last variant; the pair of the two languages asked for."""
    d = _files(spark, path, "*.tmx")
    units = F.regexp_extract_all("body", F.lit(r"(?s)<tu\b.*?</tu>"), F.lit(0))
    d = d.select("path", F.posexplode(units).alias("at", "tu"))
    variants = F.regexp_extract_all("tu", F.lit(r"(?s)<tuv\b.*?</tuv>"), F.lit(0))
    d = d.select("path", F.col("at").cast("long").alias("at"), F.posexplode(variants).alias("k", "v"))
    lang = F.lower(F.substring(F.regexp_extract("v", r"(?:xml:)?lang=[\"']([^\"']+)", 1), 1, 2))
    seg = F.regexp_replace(F.regexp_extract("v", r"(?s)<seg[^>]*>(.*?)</seg>", 1), "<[^>]+>", "")
    d = d.withColumn("lang", lang).withColumn("seg", unescape(seg))
    best = d.groupBy("path", "at", "lang").agg(F.max_by("seg", "k").alias("seg"))
    flat = best.groupBy("path", "at").agg(F.max(F.when(F.col("lang") == src, F.col("seg"))).alias("key"), F.max(F.when(F.col("lang") == tgt, F.col("seg"))).alias("value"))
    flat = flat.select("path", F.lit(domain).alias("domain"), F.lit(src).alias("src"), F.lit(tgt).alias("tgt"), F.lit("entry").alias("kind"), "key", "value", "at")
    return _pairs(flat)


def tbx(spark: SparkSession, path: str, domain: str, src: str, tgt: str) -> DataFrame:
    """Term entries: the first term of each language set."""
    d = _files(spark, path, "*.tbx")
    d = d.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<termEntry\b.*?</termEntry>"), F.lit(0))).alias("at", "e"))
    d = d.select("path", F.col("at").cast("long").alias("at"), F.explode(F.regexp_extract_all("e", F.lit(r"(?s)<langSet\b.*?</langSet>"), F.lit(0))).alias("v"))
    lang = F.lower(F.substring(F.regexp_extract("v", r"(?:xml:)?lang=[\"']([^\"']+)", 1), 1, 2))
    d = d.withColumn("lang", lang).withColumn("term", unescape(F.regexp_extract("v", r"(?s)<term(?:\s[^>]*)?>(.*?)</term>", 1)))
    flat = d.groupBy("path", "at").agg(F.max(F.when(F.col("lang") == src, F.col("term"))).alias("key"), F.max(F.when(F.col("lang") == tgt, F.col("term"))).alias("value"))
    flat = flat.select("path", F.lit(domain).alias("domain"), F.lit(src).alias("src"), F.lit(tgt).alias("tgt"), F.lit("entry").alias("kind"), "key", "value", "at")
    return _pairs(flat)


def unescape(c) -> Column:
    out = T.text(c)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def markdown_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Front matter (source_lang, target_lang, domain) and the first pipe table of Markdown files."""
    d = _files(spark, path, "*.md")
    meta = lambda k, dflt: F.coalesce(F.nullif(F.trim(F.regexp_extract("body", rf"(?m)^{k}:\s*(.*)$", 1)), F.lit("")), F.lit(dflt))
    d = d.select("path", F.lower(meta("domain", "general")).alias("domain"), L.language_code(meta("source_lang", "en")).alias("src"), L.language_code(meta("target_lang", "fr")).alias("tgt"), F.posexplode(F.split("body", r"\r?\n")).alias("at", "row"))
    w = W.partitionBy("path").orderBy("at")
    piped = F.trim("row").startswith("|")
    d = d.withColumn("p", piped).withColumn("start", (F.col("p") & ~F.coalesce(F.lag("p").over(w), F.lit(False))).cast("int"))
    d = d.withColumn("island", F.sum("start").over(w.rowsBetween(W.unboundedPreceding, 0))).filter("p and island = 1")
    d = d.withColumn("nth", F.row_number().over(w)).filter("nth > 2")
    cells = F.transform(F.split(F.regexp_replace(F.trim("row"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    d = d.withColumn("cells", cells).filter(F.size("cells") >= 2)
    flat = d.select("path", "domain", "src", "tgt", F.lit("entry").alias("kind"), F.col("cells")[0].alias("key"), F.col("cells")[1].alias("value"), F.col("at").cast("long").alias("at"))
    return _pairs(flat)


def wordnet_tab(spark: SparkSession, path: str) -> DataFrame:
    """path, lang, synset, lemma, ord of WordNet tab files; comments and rows that are no lemma are left out."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    d = d.withColumn("ord", F.struct("path", "at"))  # files by path, lines by place, however the read is split
    p = F.split("value", "\t")
    d = d.filter((F.trim("value") != "") & ~F.col("value").startswith("#") & (F.size(p) >= 3)).filter(F.get(p, F.lit(1)).endswith(":lemma"))
    lang = F.regexp_extract("path", r"wn-(?:data-|[a-z0-9]+-)?([a-z]{2,3})\.tab$", 1)
    return d.select("path", lang.alias("lang"), F.trim(p[0]).alias("synset"), F.trim(F.replace(p[2], F.lit("_"), F.lit(" "))).alias("lemma"), "ord")


def fonts(files: DataFrame) -> DataFrame:
    """(key, path): fonts by their normalised name and by the part before a dash; the first path per key."""
    stem = F.regexp_extract("path", r"([^/]+)\.(?i:ttf|otf)$", 1)
    keys = F.array_distinct(F.array(T.font_key(stem), T.font_key(F.regexp_extract(stem, r"^([^-_]+)", 1))))
    d = files.filter(F.lower("path").rlike(r"\.(ttf|otf)$")).select("path", F.explode(keys).alias("key")).filter("key != ''")
    return d.groupBy("key").agg(F.min("path").alias("path"))


def mapping_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, key, value) of "key: value" lines and of "- item" lists (key is then the list's name)."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("ord", "row"))
    head = F.regexp_extract("row", r"^([A-Za-z0-9_]+):\s*$", 1)
    w = W.partitionBy("path").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("list", F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(w))
    item, k, v = F.regexp_extract("row", r"^\s*-\s*(.+)$", 1), F.regexp_extract("row", r"^\s*([^:#-][^:]*):\s*(.+)$", 1), F.regexp_extract("row", r"^\s*([^:#-][^:]*):\s*(.+)$", 2)
    return d.select("ord", F.when(item != "", F.col("list")).otherwise(F.trim(k)).alias("key"), F.trim(F.when(item != "", item).otherwise(v)).alias("value")).filter("value != ''")
