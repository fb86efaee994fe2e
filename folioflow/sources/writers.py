"""Writers: nested pages to JSON, XML, HTML and text, glossaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import glossary as G


def response(pages: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, body): a JSON body with a status and the pages of each document in order."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("page", F.struct(*fields).alias("p")))), lambda x: x["p"])
    return pages.groupBy(*keys).agg(F.to_json(F.struct(F.lit("success").alias("status"), rows.alias("results"))).alias("body"))


def box_text(prefix: str = "") -> Column:
    """The box as "x0,y0,x1,y1" in whole numbers, rounded half-even."""
    return F.concat_ws(",", *[F.bround(F.col(f"{prefix}{c}").cast("double")).cast("long").cast("string") for c in ("x0", "y0", "x1", "y1")])


def xml_escape(c) -> Column:
    s = T.text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def layout_xml(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xml): document_layout with blocks, lines and their text. lines: keys, block_id, role, i, t and a box."""
    line = F.concat(F.lit('<line index="'), F.col("i").cast("string"), F.lit('" bbox="'), box_text(), F.lit('"><text>'), xml_escape("t"), F.lit("</text></line>"))
    d = lines.withColumn("line", line).groupBy(*keys, "block_id").agg(
        F.min_by("role", "i").alias("role"),
        F.min("i").alias("first"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "").alias("body"),
    )
    block = F.concat(F.lit('<block id="'), xml_escape(F.col("block_id").cast("string")), F.lit('" role="'), xml_escape("role"), F.lit('" bbox="'), box_text(), F.lit('">'), F.col("body"), F.lit("</block>"))
    d = d.withColumn("block", block)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "block"))), lambda x: x["block"]), "")
    return d.groupBy(*keys).agg(F.concat(F.lit("<document_layout><blocks>"), body, F.lit("</blocks></document_layout>")).alias("xml"))


def fidelity_lines(lines: DataFrame) -> DataFrame:
    """Lines with the normalised marker and its code point."""
    return lines.withColumn("leading_marker_norm", T.marker_norm("leading_marker")).withColumn("marker_code", T.marker_code("leading_marker"))


def display_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): a readable listing of blocks and lines."""
    row = F.format_string("  [%d] (%s) %s", F.col("i").cast("int"), box_text(), F.col("t"))
    d = lines.withColumn("row", row).groupBy(*keys, "block_id").agg(F.min("i").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "row"))), lambda x: x["row"]), "\n").alias("rows"))
    block = F.concat(F.lit("Block "), F.col("block_id").cast("string"), F.lit("\n"), F.col("rows"))
    d = d.withColumn("block", block)
    return d.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "block"))), lambda x: x["block"]), "\n").alias("text"))


def html_blocks(blocks: DataFrame) -> Column:
    """A block as a heading of its level or a paragraph, with its class."""
    tag = F.when(F.col("semantic") == "heading", F.concat(F.lit("h"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("heading_level", F.lit(3)))).cast("string"))).otherwise("p")
    return F.concat(F.lit("<"), tag, F.lit(' class="'), T.css_slug("style_class"), F.lit('">'), T.html_escape("t"), F.lit("</"), tag, F.lit(">"))


def html(blocks: DataFrame, classes: DataFrame, keys: list[str], order: str = "block_id") -> DataFrame:
    """(keys, html): one document per key, with a style rule for each class, in class order."""
    d = blocks.withColumn("__h", html_blocks(blocks)).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "__h"))), lambda x: x["__h"]), "\n").alias("body"))
    rule = F.concat(F.lit("."), T.css_slug("class_id"), F.lit("{font-family:"), F.col("font"), F.lit(";font-size:"), F.col("size").cast("string"), F.lit("px;color:"), F.col("color"), F.lit("}"))
    css = classes.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(rule)), "\n").alias("css"))
    page = F.concat(F.lit("<!DOCTYPE html><html><head><style>"), F.coalesce("css", F.lit("")), F.lit("</style></head><body>"), F.col("body"), F.lit("</body></html>"))
    return d.join(css, keys, "left").select(*keys, page.alias("html"))


def write_glossary(old: DataFrame | None, new: DataFrame, path: str, keep_existing: bool = False) -> None:
    """The merged glossary as JSON lines, partitioned by domain and languages. path must not be what old reads."""
    merged = G.last_wins(new) if old is None else G.upsert(old, G.last_wins(new), keep_existing)
    merged.repartition("domain", "src", "tgt").sortWithinPartitions("domain", "src", "tgt", "key").write.mode("overwrite").partitionBy("domain", "src", "tgt").json(path)


def report(items: DataFrame) -> DataFrame:
    """Counts of translation items by domain, kind and status, with totals."""
    return items.rollup("domain", "kind", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


def dataset_csv(samples: DataFrame, path: str) -> None:
    """metadata (image_path, font_key, class_id, split) and the classes by key order."""
    from pyspark.sql import Window as W

    classes = samples.select("font_key").distinct().withColumn("class_id", F.row_number().over(W.orderBy("font_key")) - 1)
    samples.join(classes, "font_key").select("image_path", "font_key", "class_id", "split").write.mode("overwrite").csv(f"{path}/metadata", header=True)
    classes.write.mode("overwrite").csv(f"{path}/classes", header=True)
