"""Linguistic units: sentences stitched from lines, residual groups, words and characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

UNIT_ROLES = ("body", "figure_caption", "")


def _stitch(lines: DataFrame, keys: list[str], order: str, t: Column, ends: str, joined) -> DataFrame:
    """(keys, unit, s): lines joined up to the one whose text ends a sentence."""
    d = lines.withColumn("__t", t).filter("__t != ''")
    w = W.partitionBy(*keys).orderBy(order)
    done = F.col("__t").rlike(ends).cast("int")
    d = d.withColumn("unit", F.coalesce(F.sum(done).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "__t"))), lambda x: x["__t"])
    return d.groupBy(*keys, "unit").agg(parts.alias("__p")).select(*keys, "unit", T.normalize_spaces(F.aggregate("__p", F.lit(""), joined)).alias("s"))


def _page_join(acc: Column, x: Column) -> Column:
    closed = acc.endswith("-") & x.rlike("^[A-Za-zÀ-ÿ]")
    return F.when(closed, F.concat(F.regexp_replace(acc, "-$", ""), x)).otherwise(T.append_fragment(acc, x))


def sentence_stream(lines: DataFrame, keys: list[str], order: str = "i", text: str = "t") -> DataFrame:
    """(keys, unit, s, ended): sentences over line breaks; lines that are only a marker are left out."""
    t = F.when(T.is_marker_only(text), "").otherwise(T.normalize_spaces(text))
    d = _stitch(lines, keys, order, t, r"[.!?…]\s*$", _page_join)
    return d.withColumn("ended", F.col("s").rlike(r"[.!?…]\s*$"))


def block_sentences(lines: DataFrame, keys: list[str], order: str = "i", text: str = "t") -> DataFrame:
    """(keys, unit, s): the variant per block: a hyphen always closes up, and the tail is always kept."""
    hyphen = lambda acc, x: F.when(acc == "", x).when(acc.endswith("-"), F.concat(F.regexp_replace(acc, "-$", ""), x)).otherwise(F.concat(acc, F.lit(" "), x))
    return _stitch(lines, keys, order, T.normalize_spaces(text), r"[.!?]\s*$", hyphen)


def dehyphenated_lines(lines: DataFrame, keys: list[str], order: str = "i", text: str = "t") -> DataFrame:
    """(keys, unit, s): lines that end in a hyphen joined to the next; marker-only lines left out."""
    t = F.when(T.is_marker_only(text), "").otherwise(T.normalize_spaces(text))
    d = lines.withColumn("__t", t).filter("__t != ''")
    w = W.partitionBy(*keys).orderBy(order)
    open_ = F.coalesce(F.lag("__t").over(w).endswith("-"), F.lit(False))
    d = d.withColumn("__new", (~open_).cast("int")).withColumn("unit", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "__t"))), lambda x: x["__t"])
    close = lambda acc, x: F.concat(F.regexp_replace(acc, "-$", ""), x)
    return d.groupBy(*keys, "unit").agg(parts.alias("__p")).select(*keys, "unit", F.aggregate("__p", F.lit(""), close).alias("s"))


def hierarchy(lines: DataFrame, keys: list[str], order: str = "i", least_words: int = 4) -> DataFrame:
    """(keys, unit, seq, kind, value): sentences, and of an unfinished tail its groups, words and characters.

    lines: keys, order, t and, if present, role; other roles than body and figure_caption are left out.
    """
    if "role" in lines.columns:
        lines = lines.filter(F.lower(F.coalesce("role", F.lit(""))).isin(*UNIT_ROLES))
    s = sentence_stream(lines, keys, order)
    whole = F.col("ended") | (T.word_count("s") >= least_words)
    sentences = s.filter(whole).select(*keys, "unit", F.lit(0).alias("seq"), F.lit("phrase").alias("kind"), F.col("s").alias("value"))
    rest = s.filter(~whole).select(*keys, "unit", F.posexplode(T.residual_chunks("s")).alias("seq", "c"))
    n = T.word_count("c")
    single = (n == 1) & (F.get(T.words("c"), F.lit(0)) == F.col("c"))
    kind = F.when(n >= 2, "groupe").when(single, "mot")
    named = rest.withColumn("kind", kind)
    groups = named.filter("kind is not null").select(*keys, "unit", "seq", "kind", F.col("c").alias("value"))
    loose = named.filter("kind is null").select(*keys, "unit", "seq", F.explode(T.atoms("c")).alias("value"))
    loose = loose.withColumn("kind", T.atom_kind("value")).filter("kind != 'mot_alpha'").select(*keys, "unit", "seq", "kind", "value")
    return sentences.unionByName(groups).unionByName(loose)


def counts(units: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    return units.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))


def first_distinct(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by order."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def previous_context(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Adds `previous`: the texts before this one in its group, in order, joined by a blank."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("previous", F.array_join(F.collect_list(T.normalize_spaces(text)).over(w), " "))


def paragraph_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of body blocks with two content lines and 24 words at least."""
    content = ~T.is_marker_only("t") & (T.normalize_spaces("t") != "")
    d = lines.filter(content & (F.lower(F.coalesce("role", F.lit("body"))) == "body"))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(T.word_count("t", T.WORD_OR_NUMBER)).alias("n_words")).filter("n_lines >= 2 and n_words >= 24")
