"""Predicates and texts of blocks, phrases and spans, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Roles, limits and font codes that results depend on.
LABEL_ROLES = ("diagram_label", "diagram_text_label", "equation_inline", "equation_block", "figure_label")
LOCKED_ROLES = ("equation_inline", "diagram_text_label", "diagram_label")
EDGE_ROLES = ("figure_caption", "header", "footer")
#: By family: plain, bold, italic, bold italic.
BUILTIN_FONTS = {"mono": ("cour", "cobo", "coit", "cobi"), "serif": ("tiro", "tibo", "tiit", "tibi"), "sans": ("helv", "hebo", "heit", "hebi")}
FALLBACK_FONTS = ("helv", "times", "courier")
COMMON_FONTS = ("helv", "times", "courier", "arial", "helvetica")
DEFAULT_SIZE = 10.0


def is_figure_label(role, t, n_lines, source) -> Column:
    """Blocks of a label role, and native titles of at most 96 characters and 3 lines."""
    r = F.lower(F.coalesce(role, F.lit("body")))
    native = F.lower(F.coalesce(source, F.lit("ocr"))) == "native"
    return r.isin(*LABEL_ROLES) | ((r == "title") & (F.length(T.text(t)) <= 96) & (n_lines <= 3) & native)


def is_risky_for_reflow(role, t, symbols: Column | None = None) -> Column:
    """Blocks (with their box in reach) that lose their look if their text is laid out anew."""
    r, n = F.coalesce(role, F.lit("body")), F.length(T.text(t))
    h = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    symbols = T.is_symbol_heavy(t) if symbols is None else symbols
    return r.isin(*LOCKED_ROLES) | (symbols & (h <= 40)) | (r.isin(*EDGE_ROLES) & (n <= 220)) | ((h <= 22) & (n <= 60))


def block_kind(t, in_figure: Column) -> Column:
    """diagram_label inside a figure zone, caption for short texts of capitals, else body."""
    letters = F.length(F.regexp_replace(T.text(t), r"\P{L}+", ""))
    upper = F.length(F.regexp_replace(T.text(t), r"\P{Lu}+", ""))
    share = F.when(letters > 0, upper / letters).otherwise(F.lit(0.0))
    return F.when(in_figure, "diagram_label").when((F.length(T.text(t)) <= 80) & (share > 0.6), "caption").otherwise("body")


def is_translated(t, translated, phrases) -> Column:
    """A block whose translation differs from its text, or a phrase of it does. phrases: array of (texte, translated_text)."""
    own, done = F.trim(T.text(t)), F.trim(T.text(translated))
    parts = F.array_remove(F.transform(phrases, lambda p: F.trim(T.text(p["texte"]))), "")
    source = F.when(own != "", own).otherwise(F.coalesce(F.array_join(parts, " "), F.lit("")))
    phrase = F.exists(phrases, lambda p: (F.trim(T.text(p["translated_text"])) != "") & (F.trim(T.text(p["translated_text"])) != F.trim(T.text(p["texte"]))))
    return ((done != "") & (source != "") & (done != source)) | F.coalesce(phrase, F.lit(False))


def builtin_font(mono, serif, bold, italic) -> Column:
    face = F.when(bold & italic, 3).when(italic, 2).when(bold, 1).otherwise(0)
    pick = lambda family: F.element_at(F.array(*[F.lit(x) for x in BUILTIN_FONTS[family]]), face + 1)
    return F.when(mono, pick("mono")).when(serif, pick("serif")).otherwise(pick("sans"))


def is_font_unresolved(source, requested, file, builtin) -> Column:
    """A native block asks for a font of its own and gets a fallback."""
    want = F.lower(F.trim(T.text(requested)))
    fallback = F.lower(T.text(builtin)).isin(*FALLBACK_FONTS)
    return (source == "native") & (want != "") & file.isNull() & fallback & ~want.isin(*COMMON_FONTS)


def is_font_excluded(key, path, pattern: str | None) -> Column:
    if not pattern:
        return F.lit(False)
    return F.concat(T.text(key), F.lit(" "), F.lower(T.text(path))).rlike(f"(?i){pattern}")


def phrase_text(t, spans) -> Column:
    """Texts of the spans that are rendered, else the phrase's own. spans: array of (texte, skip_render)."""
    kept = F.filter(spans, lambda s: ~F.coalesce(s["skip_render"], F.lit(False)))
    parts = F.array_remove(F.transform(kept, lambda s: T.normalize_spaces(s["texte"])), "")
    return F.when(F.size(parts) > 0, T.normalize_spaces(F.array_join(parts, " "))).otherwise(T.normalize_spaces(t))


def without_skipped(t, spans) -> Column:
    """The text without the first occurrence of each skipped span's text, whatever its case and blanks."""
    skipped = F.filter(spans, lambda s: F.coalesce(s["skip_render"], F.lit(False)))
    toks = F.array_remove(F.transform(skipped, lambda s: T.normalize_spaces(s["texte"])), "")
    once = lambda tok: F.concat(F.lit(r"(?isu)\A(.*?)\Q"), F.replace(tok, F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E"))
    return F.aggregate(F.coalesce(toks, F.array().cast("array<string>")), T.normalize_spaces(t), lambda s, tok: T.normalize_spaces(F.regexp_replace(s, once(tok), F.lit("$1 "))))


def spans(phrases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at, texte, style of each span; a phrase without spans gives one row of its own text and style.

    phrases: keys, t, style, spans (array of texte, skip_render, style).
    """
    d = phrases.select(*keys, "t", "style", F.posexplode_outer("spans").alias("at", "s"))
    return d.select(*keys, F.coalesce("at", F.lit(0)).alias("at"), F.when(F.col("at").isNull(), F.col("t")).otherwise(F.col("s.texte")).alias("texte"), F.coalesce("s.style", "style").alias("style"))


def block_style(spans: DataFrame, keys: list[str], order: str = "at") -> DataFrame:
    """Per block: the median of positive sizes (10 if none), and font, size, color, bold and italic of its first span."""
    first = F.min_by(F.struct("font", F.round("size", 1).alias("size"), "color", "bold", "italic"), order)
    g = spans.groupBy(*keys).agg(F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(DEFAULT_SIZE)).alias("median_size"), first.alias("f"))
    return g.select(*keys, "median_size", "f.*")


def softmax_top(scores: Column) -> Column:
    """Struct of the place (from 0) of the largest score, the first on ties, and its softmax probability."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("at"), (1 / total).alias("p"))
