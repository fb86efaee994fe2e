"""Fonts of styles and of font classes, looked up in a catalog of files.

A catalog has a row per key and file: key, path, ord (the order of its rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .blocks import builtin_font

# Style words inside font names, and stand-ins by words of a font's key, first match wins.
STYLE_WORDS = ("bold", "italic", "regular", "medium", "semibold", "demibold", "light", "black", "condensed", "narrow")
STAND_INS = (
    (("arial", "helvetica", "sans"), ("liberationsans", "dejavusans", "nimbussans", "freesans", "notosans")),
    (("times", "serif", "garamond", "georgia"), ("liberationserif", "dejavuserif", "nimbusroman", "freeserif", "notoserif")),
    (("courier", "mono", "consolas", "menlo"), ("liberationmono", "dejavusansmono", "freemono", "notosansmono")),
    (("calibri", "cambria", "candara"), ("carlito", "caladea", "liberationsans", "dejavusans")),
)
STYLE = ["font", "bold", "italic", "serif", "mono"]


def family_key(name) -> Column:
    """The font's key without words of style."""
    return T.font_key(F.regexp_replace(T.text(name), f"(?i)({'|'.join(STYLE_WORDS)})", ""))


def stand_ins(key: Column) -> Column:
    out = F.array().cast("array<string>")
    for words, fonts in reversed(STAND_INS):
        out = F.when(key.rlike("|".join(words)), F.array(*[F.lit(f) for f in fonts])).otherwise(out)
    return out


def _style_score(path: Column, bold: Column, italic: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.rlike("bold|demi") == bold, 2).otherwise(0) + F.when(name.rlike("italic|oblique") == italic, 2).otherwise(0)


def resolve(styles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds file, the best catalog file of a style, or builtin, a built-in font's code where there is none.

    Tried in turn: the font's key, its family, the stand-ins. Of a key's files the one that fits bold
    and italic best, then the first, is taken. Null flags count as false; fonts without a name get a
    built-in font. Each distinct style is looked up once.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    mine = styles.select(F.col("font"), *[flag(c).alias(c) for c in STYLE[1:]]).distinct()
    key = T.font_key("font")
    tried = F.filter(F.concat(F.array(key, family_key("font")), stand_ins(key)), lambda k: k != "")
    asked = mine.select(*STYLE, F.posexplode(tried).alias("rank", "key"))
    hits = asked.join(catalog.select("key", "path", "ord"), "key")
    best = F.min(F.struct("rank", (-_style_score(F.col("path"), F.col("bold"), F.col("italic"))).alias("miss"), "ord", "path")).path
    found = hits.groupBy(*STYLE).agg(best.alias("file"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in STYLE]
    on = same[0]
    for s in same[1:]:
        on = on & s
    d = styles.withColumns({c: flag(c) for c in STYLE[1:]}).alias("a").join(found.alias("b"), on, "left").select("a.*", "b.file")
    return d.withColumn("builtin", F.when(F.col("file").isNull(), builtin_font(F.col("mono"), F.col("serif"), F.col("bold"), F.col("italic"))))


def _substrings(key: Column) -> Column:
    n = F.length(key)
    starts = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda m: F.substring(key, i, m)))
    return F.array_distinct(F.flatten(starts))


def class_files(classes: DataFrame, mapping: DataFrame, catalog: DataFrame) -> DataFrame:
    """class_name, path: the catalog file of each class, null if none fits.

    classes: class_name; mapping: class_name, mapped (one row a class). Tried in turn: the mapped file
    name, it without its ending, the class name; else the first key that holds the class's key or is
    held by it. Of rows with one key the first counts. Held keys meet through their substrings, so no
    pair of a class and a key is formed that does not match.
    """
    first = catalog.filter("key != ''").groupBy("key").agg(F.min(F.struct("ord", "path")).alias("f"))
    plain = lambda name: F.regexp_replace(F.lower(T.text(name)), "[^a-z0-9]+", "")
    c = classes.select("class_name").distinct().join(mapping.select("class_name", "mapped"), "class_name", "left")
    bare = F.regexp_replace("mapped", r"(?<=[^/])\.[^./]*$", "")
    tried = F.array(F.col("mapped"), bare, F.col("class_name"))
    exact = c.select("class_name", F.posexplode(tried).alias("rank", "name")).withColumn("key", plain("name"))
    exact = exact.join(first, "key").groupBy("class_name").agg(F.min_by("f.path", "rank").alias("path"))
    rest = c.join(exact, "class_name", "left_anti").select("class_name", plain("class_name").alias("own")).filter("own != ''")
    holds = first.select("f", F.explode(_substrings(F.col("key"))).alias("own")).join(rest, "own").select("class_name", "f")
    held = rest.select("class_name", F.explode(_substrings(F.col("own"))).alias("key")).join(first, "key").select("class_name", "f")
    loose = holds.unionByName(held).groupBy("class_name").agg(F.min("f").path.alias("path"))
    return c.select("class_name").join(exact.unionByName(loose), "class_name", "left")
