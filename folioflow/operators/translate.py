"""Staged translation with an injected back-end.

A back-end is a function from a list of texts, a source and a target language to a list of texts. It
runs in batches over distinct texts; everything around it is Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import language as L
from ..functions import text as T
from . import glossary as G

Backend = Callable[[list[str], str, str], list[str]]


def identity(texts: list[str], src: str, tgt: str) -> list[str]:
    """The back-end without a model: texts come back as they are."""
    return texts


def cascade(*backends: Backend) -> Backend:
    """The first back-end whose answer is neither empty nor the text itself; else the text."""

    def run(texts: list[str], src: str, tgt: str) -> list[str]:
        out, todo = list(texts), list(range(len(texts)))
        for b in backends:
            if not todo:
                break
            left = []
            for i, answer in zip(todo, b([texts[i] for i in todo], src, tgt), strict=True):
                if answer and answer.strip() and answer.strip() != texts[i].strip():
                    out[i] = answer
                else:
                    left.append(i)
            todo = left
        return out

    return run


#: For RE2, over texts of Latin-1: what may need the rules of source texts, answers and French style. A text without PLAIN's
#: finds is clean, and has none of the characters outside Latin-1 that fold to a letter of a pattern.
PLAIN = T.NOT_PRINTED + "|^ | $|  "
SOURCE_RULES = "|".join((PLAIN, "[@:/\\[(^=<>±×÷µ]", T.MAY_BE_FORMULA, r"(?i:www\.|et al\.|vol\.|no\.|pp\.|doi|isbn|issn)", r"^.{0,2}$"))
ANSWER_RULES = "|".join((PLAIN, r"[<:\-]|!!|\?\?|[!?]{2}| [,;.!?]|[.!?;] ", "(?i:only|rule|r[eè]gle|assistant|system|système|im_|traduction|phrase|mot)", "^.?$"))
NO_WORD = r"[^0-9A-Z_a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+"
STYLE_RULES = "(?i:" + "|".join(L.LITERAL_HINTS + L.WEAK_HINTS) + ")"


def _counted(t: pa.Array, where: pa.Array, pattern: str) -> pa.Array:
    found = pc.count_substring_regex(t.filter(where), pattern).cast(pa.int32())
    return pc.replace_with_mask(pa.nulls(len(t), pa.int32()), where, found)


def _plain(t: pa.Array, raw: pa.Array, tgt: pa.Array) -> dict[str, pa.Array]:
    """For texts that come back as they are and that no rule may touch: numbers of words and markers; null for others."""
    ruled = pc.or_(pc.match_substring_regex(t, f"{SOURCE_RULES}|{ANSWER_RULES}"), pc.match_substring_regex(t, STYLE_RULES))
    ok = pc.fill_null(pc.and_(pc.equal(t, raw), pc.invert(ruled)), False)
    ascii_ = pc.and_(ok, pc.fill_null(pc.string_is_ascii(t), False))
    latin = pc.and_not(ok, ascii_)
    # RE2's word boundaries are those of ASCII, so other texts are written with two spaces for what is between words.
    spaced = pc.binary_join_element_wise("", pc.replace_substring_regex(t.filter(latin), NO_WORD, "  "), "", " ")
    spaced = pc.replace_with_mask(t, latin, spaced)

    def markers(lang: str, where: pa.Array) -> pa.Array:
        alts = "|".join(L.MARKERS[lang])
        return pc.coalesce(_counted(t, pc.and_(where, ascii_), rf"(?i)\b(?:{alts})\b"), _counted(spaced, pc.and_(where, latin), f"(?i) (?:{alts}) "))

    tg = pc.if_else(ok, pa.scalar(0, pa.int32()), pa.scalar(None, pa.int32()))
    for lang in {x for x in pc.unique(tgt).to_pylist() if x in L.MARKERS}:
        tg = pc.coalesce(markers(lang, pc.fill_null(pc.equal(tgt, lang), False)), tg)
    return {"__n": _counted(t, ok, T.WORD), "__en": markers("en", ok), "__tg": tg}


def translate_distinct(items: DataFrame, backend: Backend, text: str = "t", facts=None, names=()) -> DataFrame:
    """items with `raw`: each distinct (text, src, tgt) goes through the back-end once; null where one is null.

    facts(t, raw, tgt), a function over columns, may add integer columns of these names.
    The window brings equal texts together and numbers them; each takes the answer of its number 1.
    """
    keys = [text, "src", "tgt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            first = pc.equal(b.column("__r"), 1).to_numpy(zero_copy_only=False)
            new = pd.DataFrame({k: b.column(k).filter(pa.array(first)).to_pylist() for k in keys}, dtype=object).assign(raw=None)
            for (src, tgt), part in new.dropna(subset=keys).groupby(["src", "tgt"], sort=False):
                new.loc[part.index, "raw"] = pd.Series(backend(part[text].tolist(), src, tgt), part.index, dtype=object)
            # Rows before the batch's first number 1 go on with the text of the batch before.
            answers = pa.array([last, *new["raw"]], pa.string(), from_pandas=True)
            raw = answers.take(pa.array(np.cumsum(first)))
            last = answers[-1].as_py()
            at = b.schema.get_field_index("__r")
            out = b.set_column(at, "raw", raw)
            if facts:
                more = facts(b.column("t"), raw, b.column("tgt"))
                out = pa.RecordBatch.from_arrays([*out.columns, *[more[k] for k in names]], [*out.schema.names, *names])
            yield out

    numbered = items.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*keys)))
    return numbered.mapInArrow(run, StructType([*items.schema, StructField("raw", StringType()), *[StructField(k, IntegerType()) for k in names]]))


def _ruled(clean, target: Column, rules=()) -> Column:
    s = T.fix_ligatures(clean)
    return F.when(target == "fr", T.apply_rules(s, rules)).otherwise(s) if rules else s


def normalized_translation(translated, original, target: Column, rules=()) -> Column:
    """Invisible characters, ligatures, configured rules, punctuation and repeated sentences put right."""
    return T.without_repeats(T.fix_punctuation(_ruled(T.clean_spaces(translated), target, rules)))


def _answer(source: Column, raw: Column, target: Column, rules) -> Column:
    """The back-end's output put right: normalized_translation with its acronyms restored, step by step over clean texts."""
    even = lambda s: T.let(T.tidy(s), T.without_repeats_clean)
    pointed = lambda s: T.let(T.fix_punctuation_clean(s), even)
    ruled = lambda s: T.let(_ruled(s, target, rules), pointed)
    restored = lambda s: T.let(T.restore_acronyms_clean(source, s), ruled)
    clean = lambda s: T.let(T.tidy(s), restored)
    return T.let(F.lower(raw), lambda low: T.let(T.first_paragraph_lazy(raw, low), lambda cut: T.let(T.sanitize_paragraph(cut, source, low), clean)))


def translate(items: DataFrame, glossary: DataFrame, backend: Backend = identity, ident: str = "id", fixes=()) -> DataFrame:
    """ident, source, translation, stage, score, flags, status, gate_ok.

    items: ident, t, role, domain, subdomain, src, tgt. Protected text stays; then a connector
    fragment, a whole-text glossary entry, and the back-end's acceptable answer; else the source text with
    the glossary's terms in it replaced.
    """
    d = items.withColumn("__q", T.let(T.tidy(F.col("t")), T.sanitize_source_clean))
    facts = ("__n", "__en", "__tg")
    if fixes:  # rules that may touch any text
        d = translate_distinct(d, backend, "__q").withColumns({k: F.lit(None).cast("int") for k in facts})
    else:
        d = translate_distinct(d, backend, "__q", _plain, facts)
    if glossary.isEmpty():  # nothing to look up: no joins over the items
        d = d.withColumn("__exact", F.lit(None).cast("string")).withColumn("__forced", F.lit(None).cast("string"))
    else:
        exact = G.exact_lookup(items, glossary, ident).withColumnRenamed("value", "__exact")
        d = d.join(exact, ident, "left")
        rules = G.matching_rules(items, glossary, ident)
        forced = G.replace_terms(items.join(rules.select(ident).distinct(), ident, "left_semi"), rules, ident)
        d = d.join(forced.select(ident, F.col("t").alias("__forced")), ident, "left")
    # Each text is computed once per row, and what the next step has several times is a column or a let before it.
    # Most texts have nothing to put right: the back-end's pass tells for many, and every step looks for a hint before
    # its patterns run.
    known = F.col("__n").isNotNull()
    source, raw, tgt, role = F.col("source"), F.col("raw"), F.col("tgt"), F.col("role")
    d = L.once(d, source=F.when(known, F.col("t")).otherwise(T.tidy(F.col("t"))))
    guarded = T.let(source, lambda s: T.is_protected_clean(s, F.lower(s), role))
    d = L.once(d, __protected=F.when(known, T.protected_role(source, role)).otherwise(guarded), __model=F.when(known, source).otherwise(_answer(source, T.text(raw), tgt, fixes)))
    short = F.when((F.col("src") == "en") & (F.col("tgt") == "fr"), T.connector_fragment_clean(source))
    meta = T.let(F.col("__model"), lambda s: T.any_in(F.lower(s), T.META_HINTS) & s.rlike(T.META_WORDS))
    good = known | (T.is_acceptable_clean(source, F.col("__model"), meta) & F.coalesce(raw.rlike(T.SAYS), F.lit(False)))
    changed = F.col("__forced").isNotNull() & (T.clean_spaces("__forced") != F.col("source"))
    d = L.once(d, __short=short, __good=good)
    stage = F.when(F.col("__protected"), "protected").when(F.col("__short").isNotNull(), "connector").when(F.col("__exact").isNotNull(), "glossary").when(F.col("__good"), "model").when(changed, "terms").otherwise("source")
    d = L.once(d, stage=stage)
    pick = F.when(F.col("stage") == "connector", F.col("__short")).when(F.col("stage") == "glossary", F.col("__exact")).when(F.col("stage") == "model", F.col("__model")).when(F.col("stage") == "terms", T.clean_spaces("__forced")).otherwise(F.col("source"))
    d = L.once(d, translation=pick)
    d = L.with_quality(d, F.col("source"), F.col("translation"), F.col("role"), F.col("tgt"), F.col("__protected"), F.when((F.col("source") == F.col("translation")) & F.col("__n").isNotNull(), F.struct(F.col("__n").alias("n"), F.col("__en").alias("en"), F.col("__tg").alias("tg"))))
    return d.select(ident, "source", "translation", "stage", "score", "flags", "status", L.gate_ok("translation", F.col("tgt"), F.col("src")).alias("gate_ok"))


def best_candidate(items: DataFrame, candidates: list[str], target: Column) -> Column:
    """Of candidate columns, the one with the least leak score; the first on ties."""
    ranked = F.array(*[F.struct(L.leak_score(c, target).alias("leak"), F.lit(i).alias("i"), F.col(c).alias("t")) for i, c in enumerate(candidates)])
    return F.array_min(ranked)["t"]


def revise(items: DataFrame, gain: int = 8) -> DataFrame:
    """Critical translations replaced by `alternative` where it scores `gain` more: adds auto_revised."""
    tgt, role = F.col("tgt"), F.col("role")
    d = items.withColumn("__a", L.quality("source", "translation", role, tgt)).withColumn("__b", L.quality("source", "alternative", role, tgt))
    better = (F.col("__a.status") == "critical") & (F.col("__b.score") >= F.col("__a.score") + gain)
    pick = lambda f: F.when(better, F.col(f"__b.{f}")).otherwise(F.col(f"__a.{f}"))
    return d.select(
        *[c for c in items.columns if c not in ("translation", "alternative")],
        F.when(better, F.col("alternative")).otherwise(F.col("translation")).alias("translation"),
        pick("score").alias("score"),
        pick("flags").alias("flags"),
        pick("status").alias("status"),
        better.alias("auto_revised"),
    )
