"""Quality rules: word and line statistics, and distribution divergence from language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stash

#: Frequent words of each language with a reference.
COMMON_WORDS = {
    "en": "the of and to in a is that it was for on are as with be by at this from or an not which".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er hat".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero".split(),
}
OTHER = "other"
#: Characters of the symbol rule.
SYMBOLS = "#*$%&|<>"
#: Character classes other than the first, which holds the rest: regex classes of their complements.
CLASSES = ("^A-Z", "^0-9", f"^{SPACE}", "^.,;:!?'\"()\\-", "^#*$%&|<>@=+_/~^{}\\\\\\[\\]`", r"\x00-\x7F")
MIN_CHARS = 200
MIN_WORDS = 100
MAX_CLASS_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.29


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def window_hashes(words: Column, n: Column) -> Column:
    """A hash for each 3-word window, in order."""
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])))


def window_keys(hashes: Column) -> Column:
    """Sorted longs, one per window: 32 hash bits above, the window's place below; null if all hashes differ."""
    key = F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, F.lit(32)).bitwiseOR(i.cast("long")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(key))


def suspects(keys: Column) -> Column:
    """Places of the windows that share their hash bits with another: all repeated windows, and chance collisions."""
    last = F.size(keys) - 1
    bits = lambda x: F.call_function("shiftright", x, F.lit(32))
    near = lambda x, j: ((j > 0) & (bits(x) == bits(keys[F.greatest(j - 1, F.lit(0))]))) | ((j < last) & (bits(x) == bits(keys[F.least(j + 1, last)])))
    return F.transform(F.filter(keys, near), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))


def sorted_windows(words: Column, places: Column) -> Column:
    """The words of the windows at `places`, sorted, each with its place. Words hold no spaces."""
    return F.sort_array(F.transform(places, lambda p: F.struct(F.concat_ws(" ", words[p], words[p + 1], words[p + 2]).alias("g"), p.alias("p"))))


def repeated_word_count(windows: Column) -> Column:
    """Words covered by windows that occur twice or more: neighbours in `windows` with equal words."""
    last = F.size(windows) - 1
    same = lambda x, j: ((j > 0) & (x["g"] == windows[F.greatest(j - 1, F.lit(0))]["g"])) | ((j < last) & (x["g"] == windows[F.least(j + 1, last)]["g"]))
    spread = F.flatten(F.transform(F.filter(windows, same), lambda x: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: x["p"] + k)))
    return F.when(windows.isNull(), 0).otherwise(F.size(F.array_distinct(spread))).cast("long")


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: the base statistics, the character-class counts and the common-word counts."""
    lang = F.col(lang_col)
    ref = F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(OTHER))
    d = docs.select(F.col(id_col).alias("doc_id"), ref.alias("ref"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("words", word_array(F.col("text")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    listed = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    hits = F.concat(F.lit(" "), F.array_join(F.filter("words", lambda w: w.isin(*listed)), "  "), F.lit(" "))
    gone = lambda cls: F.length(F.regexp_replace("text", f"[{cls}]+", "")).cast("long")
    d = d.select(
        "doc_id",
        "ref",
        F.size("words").alias("n"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length("text").cast("long").alias("chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array(*[gone(c) for c in CLASSES]).alias("special"),
        hits.alias("hits"),
        window_hashes(F.col("words"), F.size("words")).alias("hashes"),
        "words",
    )
    d = d.withColumn("keys", window_keys(F.col("hashes"))).withColumn("places", suspects(F.col("keys")))
    d = d.withColumn("windows", sorted_windows(F.col("words"), F.col("places")))
    own = F.lit(None).cast("array<string>")
    for k, ws in COMMON_WORDS.items():
        own = F.when(F.col("ref") == k, F.array(*[F.lit(w) for w in ws])).otherwise(own)
    count = lambda w: ((F.length("hits") - F.length(F.replace(F.col("hits"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)).cast("long")
    d = d.withColumn("own", own)
    d = d.select(
        "doc_id",
        "ref",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "chars",
        "n_symbols",
        "n_dup_lines",
        repeated_word_count(F.col("windows")).alias("n_repeat_words"),
        F.concat(F.array(F.col("chars") - F.aggregate("special", F.lit(0).cast("long"), lambda a, x: a + x)), F.col("special")).alias("class_n"),
        F.transform("own", count).alias("word_n"),
    )
    rest = F.col("n_words") - F.aggregate("word_n", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("word_n", F.concat("word_n", F.array(rest)))


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of equal length; null if one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    p, q = total(counts), total(reference)

    def part(x: Column, y: Column) -> Column:
        a, b = x / p, y / q
        m = (a + b) / 2
        half = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0))
        return (half(a) + half(b)) / 2

    return F.when((p > 0) & (q > 0), F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(counts, reference, part)))))


def references(stats: DataFrame) -> DataFrame:
    """Histograms of each reference language over all documents; a row per language at most."""
    widest = max(map(len, COMMON_WORDS.values())) + 1
    cls = [F.sum(F.col("class_n")[i]).cast("double").alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    wrd = [F.sum(F.get("word_n", F.lit(i))).cast("double").alias(f"w{i}") for i in range(widest)]
    sums = stats.groupBy("ref").agg(*cls, *wrd)
    return sums.select(
        "ref",
        F.array(*[f"c{i}" for i in range(len(CLASSES) + 1)]).alias("class_ref"),
        F.filter(F.array(*[f"w{i}" for i in range(widest)]), lambda x: x.isNotNull()).alias("word_ref"),
    )


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_class: float = MAX_CLASS_DISTANCE,
    max_word: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Verdict per row of docs: statistics, class_distance, word_distance, base_failed, kept.

    A document that passes the base rules is dropped if its character classes, or the common words of
    its language, lie too far from the reference of that language, which is summed over all documents.
    Guards: texts under MIN_CHARS are not judged by divergence, and texts under MIN_WORDS words not by
    their common words. Languages without a list, and null, share the reference "other"
    and are judged by character classes only. Null text is empty. Repeated rows each get a row; an
    empty table gives an empty result; other columns are ignored.
    """
    stats = stash(base_rules(docs, id_col, text_col, lang_col), "quality-stats")
    refs = references(stats)
    d = stats.join(F.broadcast(refs), "ref", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    dist = lambda a, b: js_distance(F.col(a), F.col(b))
    d = d.withColumn("class_distance", dist("class_n", "class_ref")).withColumn("word_distance", dist("word_n", "word_ref")).withColumn("base_failed", failed)
    far = (F.col("class_distance") > max_class) | ((F.col("n_words") >= MIN_WORDS) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) > max_word))
    kept = ~F.col("base_failed") & ~((F.col("chars") >= MIN_CHARS) & F.coalesce(far, F.lit(False)))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "word_distance")
