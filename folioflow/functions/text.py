"""Text normalisation, splitting and row-level classifiers as Column expressions.

Null counts as the empty string throughout. Nothing here leaves the JVM except nfc().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and thresholds that results depend on.
INVISIBLE = r"[­​-‏⁠﻿]"
WORD = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9'\-]*"
WORD_OR_NUMBER = r"[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9'\-]*"
ALPHA_WORD = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'\-]*"
SENTENCE_GAP = r"(?U)(?<=[.!?:;])\s+"
MATH = r"[=<>±×÷∑∫∞≈≠≤≥√∆∂µλΩα-ωΑ-Ω]"
GREEK_OR_SYMBOL = r"[α-ωΑ-ΩµλΩ∑∫∞≈≠≤≥√∆∂±×÷]"
EQUATION_MARK = r"[=+\-*/^()\[\]<>±×÷∑∫∞≈≠≤≥√∆∂µλΩα-ωΑ-Ω]"
ADDRESS = r"(?iU)(https?://|www\.|[\w.-]+@[\w.-]+\.\w+|doi:\s*|arxiv:)"
BIBLIOGRAPHY = r"(?i)(et al\.|vol\.|no\.|pp\.|doi|isbn|issn)"
FORMULA_TOKEN = r"^(?:[A-Z][a-z]?\d*){2,}$"
ACRONYM = r"^[A-Z]{2,8}$"
BULLETS = r"•▪◦·\-*"
GRAPHIC_ROLES = ("diagram_label", "diagram_text_label", "figure_label", "equation_inline", "equation_block")
META_WORDS = r"(?iU)\b(traduction|phrase|mot|assistant|système|system)\b"
CORRUPT_OUTPUT = r"(?i)(rule|r[èe]gle|assistant|system|im_start|im_end)"
LEAKED_INSTRUCTIONS = (
    r"<\|im_start\|>.*",
    r"<\|im_end\|>.*",
    r"^\s*(system|assistant|user)\s*[:\-].*$",
    r"^\s*(rule|r[èe]gle)\s*[:\-].*$",
    r"^\s*(output constraints|instruction)\s*[:\-].*$",
    r"\b(propose|provide)\s+only\b.*",
)
GLOSSARY_STOPWORDS = tuple(
    "a an the and or to of in on at for by with is are be was were this that these those it as from into over under between about after before through very more most less least".split()
)
CONNECTORS = {
    "for": "pour",
    "and": "et",
    "or": "ou",
    "of": "de",
    "to": "a",
    "in": "dans",
    "on": "sur",
    "with": "avec",
    "from": "de",
    "by": "par",
    "at": "a",
    "the": "le",
    "a": "un",
    "an": "un",
}
LIGATURE_FIXES = {"c-ur": "coeur", "c-urs": "coeurs", "n-ud": "noeud", "n-uds": "noeuds", "d-": "d'", "l-": "l'"}
MAX_CHUNK = 260
# Necessary conditions, for texts looked at before the rules above run. A text without UNTIDY characters and double spaces
# is its own clean_spaces but for spaces around it; a clean text without MAY_PROTECT and PROTECT_HINTS (lower-cased) matches
# no pattern of is_protected. No hint for a case-insensitive Unicode pattern has i, k or s, which three other characters fold to.


def _none_of(chars: str) -> str:
    """A class of all but these characters, listed one by one: Java looks those up in one table of Latin-1."""
    return "[^" + "".join(rf"\x{ord(c):02x}" for c in chars) + "]"


_PRINTED = "".join(map(chr, [*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]))
NOT_PRINTED = _none_of(_PRINTED)
UNTIDY = r"[^ -~\u00a1-\u00ac\u00ae-\u024f\u0370-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u4e00-\u9fff]"
MAY_PROTECT = _none_of("".join(c for c in _PRINTED if c not in "@:/[(^=<>±×÷µ"))
MAY_BE_FORMULA = "[A-Z][a-z]?[0-9]*[A-Z]"
PROTECT_HINTS = ("www.", "et al.", "vol.", "no.", "pp.", "doi", "isbn", "issn")
META_HINTS = ("traduct", "phra", "mot", "tant", "tem", "t\u00e8me")
CORRUPT_HINTS = ("rule", "gle", "tant", "tem", "m_")
SAYS = rf"(?U)[^\s\p{{Cf}}{INVISIBLE[1:-1]}]"
LEAK_HINTS = ("<|", ":", "-", "only", "\n\n")


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _chain(c: Column, rules) -> Column:
    return reduce(lambda s, r: F.regexp_replace(s, r[0], r[1]), rules, c)


def normalize_spaces(c) -> Column:
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def strip_invisible(c) -> Column:
    return F.regexp_replace(text(c), INVISIBLE + r"|\p{Cf}", "")


def has_invisible(c) -> Column:
    return text(c).rlike(INVISIBLE)


def clean_spaces(c) -> Column:
    """normalize_spaces after removal of invisible characters."""
    return normalize_spaces(strip_invisible(c))


def untidy(c: Column) -> Column:
    """Whether there may be something for clean_spaces to do but for spaces around the text."""
    return c.contains("  ") | (c.rlike(NOT_PRINTED) & c.rlike(UNTIDY))


def let(c: Column, f) -> Column:
    """f of a value that is computed once, and only where it is asked for; out of the generated method."""
    return F.element_at(F.transform(F.array(c), f), 1)


def tidy(c: Column) -> Column:
    """clean_spaces of a column; a text with nothing to clean is only looked at."""
    return F.when(untidy(c), let(c, clean_spaces)).otherwise(F.trim(text(c)))


def any_in(c: Column, hints) -> Column:
    """Whether one of the strings is in the text."""
    return reduce(lambda a, b: a | b, (c.contains(h) for h in hints))


def norm_text(c) -> Column:
    return F.lower(normalize_spaces(c))


def tokens(c) -> Column:
    """Distinct tokens of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.array_remove(F.split(norm_text(c), r"[^a-z0-9]+"), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def words(c, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(0))


def word_count(c, pattern: str = WORD) -> Column:
    return F.size(words(c, pattern))


def sentences(c) -> Column:
    """Non-empty parts of the text between sentence ends."""
    return F.array_remove(F.transform(F.split(normalize_spaces(c), SENTENCE_GAP), lambda s: F.trim(s)), "")


# Classifiers


def is_equation_like(c) -> Column:
    s = norm_text(c)
    n, symbols = F.length(s), F.length(F.regexp_replace(s, r"(?U)[a-z0-9\s]+", ""))
    short = (n <= 36) & (s.rlike(r"(?U)(d[a-z]\s*/\s*d[a-z]|[a-z]\s*/\s*[a-z])") | s.rlike(EQUATION_MARK))
    dense = (n <= 64) & (symbols >= F.greatest(F.lit(3), F.floor(n * 0.18).cast("int")))
    return (n > 0) & (short | dense)


def is_reference_like(c) -> Column:
    s = norm_text(c)
    return s.rlike(r"^\((\d+|[ivxlcdm]+|[a-z])\)$") | s.rlike(r"^\[\d+([,\-\s]*\d+)*\]$")


def has_greek_or_symbol(c) -> Column:
    return text(c).rlike(GREEK_OR_SYMBOL)


def is_immutable_inline(c) -> Column:
    """Bullets, list numbers, equations, symbols and references. Upper-case rules can't apply: the text is lower-cased first."""
    s = norm_text(c)
    return (F.length(s) > 0) & (s.rlike(rf"^[{BULLETS}]$") | s.rlike(r"^\d{1,2}[.)]?$") | is_equation_like(s) | has_greek_or_symbol(s) | is_reference_like(s))


def is_diagram_text(c) -> Column:
    s = norm_text(c)
    return F.length(s).between(4, 48) & s.rlike("[a-z]")


def is_hard_protected(c) -> Column:
    s = normalize_spaces(c)
    return (s == "") | s.rlike(ADDRESS) | s.rlike(MATH)


def protected_role(s: Column, role: Column | str) -> Column:
    r = F.lower(F.coalesce(role if isinstance(role, Column) else F.lit(role), F.lit("body")))
    return (s == "") | r.isin(*GRAPHIC_ROLES) | (r.isin("header", "footer") & (F.length(s) <= 80)) | (F.length(s) <= 2)


def _protected_pattern(s: Column) -> Column:
    formula = F.exists(
        F.regexp_extract_all(s, F.lit(r"\b[A-Za-z0-9]{3,}\b"), F.lit(0)),
        lambda t: t.rlike(FORMULA_TOKEN) & t.rlike(r"[a-z\d]"),
    )
    toks = F.regexp_extract_all(s, F.lit(r"[A-Za-z][A-Za-z0-9\-]{1,}"), F.lit(0))
    acronyms = F.size(F.filter(toks, lambda t: t.rlike(ACRONYM)))
    return (
        s.rlike(r"^[A-Z]{1,3}$")
        | s.rlike(ADDRESS)
        | s.rlike(BIBLIOGRAPHY)
        | s.rlike(r"(?U)\[[0-9,\-\s]+\]")
        | s.rlike(r"(?U)\([A-Z][A-Za-z\-]+,\s*(19|20)\d{2}\)")
        | s.rlike(MATH)
        | s.rlike(r"(?U)\b[a-zA-Z]\s*/\s*[a-zA-Z]\b")
        | s.rlike(r"(?U)\b[dD][A-Za-z]\s*/\s*d[A-Za-z]\b")
        | formula
        | s.rlike(r"(?U)\b[A-Za-z]+\^\d+\b|\b\d+\s*[x*]\s*10\^-?\d+\b")
        | ((F.size(toks) > 0) & (acronyms >= F.greatest(F.lit(2), F.floor(F.size(toks) * 0.5).cast("int"))))
    )


def is_protected(c, role: Column | str = "body") -> Column:
    """Segments that are never translated."""
    s = clean_spaces(c)
    return protected_role(s, role) | _protected_pattern(s)


def is_protected_clean(s: Column, low: Column, role: Column | str = "body") -> Column:
    """is_protected of a column of clean texts, lower-cased in low; the patterns run where one of them may match."""
    may = s.rlike(MAY_PROTECT) | s.rlike(MAY_BE_FORMULA) | any_in(low, PROTECT_HINTS)
    return protected_role(s, role) | (may & let(s, _protected_pattern))


def is_sentence(c) -> Column:
    """Four words or more, three of letters, and an end mark or five words."""
    s = clean_spaces(c)
    n = word_count(s, WORD_OR_NUMBER)
    return (n >= 4) & (word_count(s, ALPHA_WORD) >= 3) & (s.rlike(r"[.!?:;]$") | (n >= 5))


def is_page_sentence(c) -> Column:
    """The page variant: few symbols, and an end mark with two words or six words."""
    s = normalize_spaces(c)
    n = word_count(s)
    symbols = F.length(F.regexp_replace(s, r"(?U)[\w\sÀ-ÿ]+", ""))
    return (s != "") & (symbols <= 0.22 * F.length(s)) & ((s.rlike(r"[.!?]\s*$") & (n >= 2)) | (n >= 6))


def is_separator(c) -> Column:
    return text(c).rlike(r"(?U)^[\s,.;:()\[\]{}\-–—/]+$")


def is_marker_only(c) -> Column:
    return normalize_spaces(c).rlike(rf"^(?:\.\.\.|[{BULLETS}]|\d{{1,2}}[.)]?)$")


def is_symbol_heavy(c) -> Column:
    s = normalize_spaces(c)
    symbols = F.length(F.regexp_replace(s, r"(?U)[A-Za-zÀ-ÿ0-9\s]+", ""))
    return s.rlike(MATH) | ((symbols >= 3) & (symbols >= F.greatest(F.lit(2), F.floor(F.length(s) * 0.25).cast("int"))))


def is_acceptable_translation(original, translated) -> Column:
    o, t = clean_spaces(original), clean_spaces(translated)
    return (t != "") & (F.length(t) <= F.greatest(F.lit(500), F.length(o) * 6)) & F.when(is_protected(o), t == o).otherwise(_free_translation(o, t, t.rlike(META_WORDS)))


def _free_translation(o: Column, t: Column, meta: Column) -> Column:
    n, base = F.length(t), F.greatest(F.lit(1), F.length(o))
    return ~meta & (n >= F.floor(base * 0.35)) & (n <= F.floor(base * 3.0))


def is_acceptable_clean(o: Column, t: Column, meta: Column) -> Column:
    """is_acceptable_translation of clean texts, the original not protected; meta: whether the translation has META_WORDS."""
    return (t != "") & (F.length(t) <= F.greatest(F.lit(500), F.length(o) * 6)) & _free_translation(o, t, meta)


def is_safe_glossary_key(c) -> Column:
    k = F.lower(clean_spaces(c))
    alnum = F.length(F.regexp_replace(k, "[^a-z0-9]+", ""))
    return (F.length(k) >= 4) & ~k.isin(*GLOSSARY_STOPWORDS) & (alnum >= F.greatest(F.lit(3), F.floor(F.length(k) * 0.6).cast("int")))


# Splitting and joining


def residual_chunks(c) -> Column:
    parts = F.transform(F.split(text(c), r"[,:;|/()\[\]{}]+"), lambda s: normalize_spaces(s))
    return F.array_remove(parts, "")


def atoms(c) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r"(?U)[0-9]+|[A-Za-zÀ-ÿ]+|[^\s]"), F.lit(0))


def atom_kind(c) -> Column:
    """chiffre, nombre, lettre, mot_alpha or symbole; null for blank."""
    s = normalize_spaces(c)
    return (
        F.when(s == "", F.lit(None).cast("string"))
        .when(s.rlike(r"^\d$"), "chiffre")
        .when(s.rlike(r"^\d+$"), "nombre")
        .when(s.rlike(r"^[A-Za-zÀ-ÿ]$"), "lettre")
        .when(s.rlike(r"^[A-Za-zÀ-ÿ]+$"), "mot_alpha")
        .otherwise("symbole")
    )


def item_kind(c, role: Column | str = "body") -> Column:
    """skip, symbole, phrase, expression or mot."""
    s = normalize_spaces(c)
    n = word_count(s)
    return F.when(s == "", "skip").when(is_protected(s, role), "symbole").when(is_sentence(s), "phrase").when(n >= 2, "expression").when(n == 1, "mot").otherwise("symbole")


EXPRESSION_GAP = r"\s*[,:;]\s*|\s+-\s+|\s+–\s+|\s+—\s+|\s*\(\s*|\s*\)\s*"


def expressions(c) -> Column:
    """Parts between separators of expressions, without the separators and blanks."""
    return F.array_remove(F.transform(F.split(text(c), "(?U)" + EXPRESSION_GAP), lambda s: normalize_spaces(s)), "")


def expressions_with_gaps(c) -> Column:
    """The parts and the separators between them, in order; joined they give the text again."""
    marked = F.regexp_replace(text(c), f"(?U)({EXPRESSION_GAP})", "\x01$1\x01")
    return F.array_remove(F.split(marked, "\x01"), "")


def word_pieces(c) -> Column:
    """Words and the white space and punctuation between them, in order."""
    marked = F.regexp_replace(text(c), r"(?U)(\s+|[,.;:()\[\]{}\-–—/])", "\x01$1\x01")
    return F.array_remove(F.split(marked, "\x01"), "")


def append_fragment(base: Column, frag: Column) -> Column:
    """Join two fragments: a hyphen at the end is closed up, end punctuation takes no space."""
    b, f = normalize_spaces(base), normalize_spaces(frag)
    return (
        F.when(b == "", f)
        .when(f == "", b)
        .when(b.endswith("-"), F.concat(F.expr("substring('', 1)"), F.regexp_replace(b, "-$", ""), f))
        .when(f.rlike(r"^[.,;:!?%)\]}]"), F.concat(b, f))
        .otherwise(F.concat(b, F.lit(" "), f))
    )


def leading_marker(c) -> Column:
    s = F.regexp_replace(text(c), r"(?U)^\s+", "")
    bullet = F.regexp_extract(s, rf"(?U)^([{BULLETS}])\s+", 1)
    return F.when(bullet != "", bullet).otherwise(F.regexp_extract(s, r"(?U)^((?:\d+|[A-Za-z])[.)])\s+", 1))


def marker_norm(c) -> Column:
    """List marks other than the bullet, and the empty one, become the bullet."""
    return F.when(text(c).isin("", "▪", "◦", "·", "*"), "•").otherwise(text(c))


def marker_code(c) -> Column:
    return F.when(text(c) == "", "").otherwise(F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(text(c))), 4, "0")))


def bullet(c) -> Column:
    return F.regexp_extract(text(c), rf"(?U)^\s*([{BULLETS}]+)\s*", 1)


def without_bullet(c) -> Column:
    return normalize_spaces(F.regexp_replace(text(c), rf"(?U)^\s*[{BULLETS}]+\s*", ""))


def close_spaced_caps(c) -> Column:
    """"A B C" to "ABC": single capitals in a row are closed up."""
    return F.regexp_replace(text(c), r"(?U)\b([A-Z])\s+(?=[A-Z]\b)", "$1")


def chunks(c, limit: int = MAX_CHUNK) -> Column:
    """Sentences of at most `limit` characters; longer ones are cut at commas and packed greedily."""

    def pack(sentence: Column) -> Column:
        parts = F.array_remove(F.transform(F.split(sentence, r"(?U)(?<=,)\s+"), lambda s: F.trim(s)), "")
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

        def step(acc: Column, t: Column) -> Column:
            cand = F.when(acc["cur"] == "", t).otherwise(F.concat(acc["cur"], F.lit(" "), t))
            fits = F.length(cand) <= limit
            done = F.when(fits | (acc["cur"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))
            return F.struct(done.alias("done"), F.when(fits, cand).otherwise(t).alias("cur"))

        end = F.aggregate(parts, start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))
        return F.when(F.length(sentence) <= limit, F.array(sentence)).otherwise(end)

    return F.flatten(F.transform(sentences(c), pack))


def without_repeats(c) -> Column:
    """The text without sentences that repeat the one before, compared by letters and digits."""
    s = clean_spaces(c)
    parts = sentences(s)
    key = lambda x: F.lower(F.regexp_replace(x, r"(?U)\W+", ""))
    # Each part beside the key of the one before it; array_join leaves nulls out.
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), F.transform(parts, key)), 1, F.size(parts))
    kept = F.zip_with(parts, before, lambda x, k: F.when(k.isNull() | (key(x) != k), x))
    return F.when(F.size(parts) == 0, s).otherwise(F.array_join(kept, " "))


def without_repeats_clean(s: Column) -> Column:
    """without_repeats of a column of clean texts; a single sentence is its own."""
    return F.when(s.rlike("[.!?:;] "), let(s, without_repeats)).otherwise(s)


# Translation text


def sanitize_source(c) -> Column:
    s = clean_spaces(c)
    s = F.translate(s, "·’", "''")
    return clean_spaces(_chain(s, [(r"(?U)([A-Za-zÀ-ÿ])-\s+([A-Za-zÀ-ÿ])", "$1$2"), (r"(?U)\s+\.\.\.\s*", " ... ")]))


def sanitize_source_clean(s: Column) -> Column:
    """sanitize_source of clean texts."""
    return F.when(any_in(s, ("- ", " ...", "·", "’")), let(s, sanitize_source)).otherwise(s)


def first_paragraph(translated) -> Column:
    """The first paragraph of a model's output without leaked instructions."""
    cut = reduce(lambda s, p: F.trim(F.regexp_replace(s, "(?imU)" + p, "")), LEAKED_INSTRUCTIONS, F.trim(text(translated)))
    return normalize_spaces(F.split(cut, r"\n{2,}", 2)[0])


def first_paragraph_lazy(s: Column, low: Column) -> Column:
    """first_paragraph of texts, lower-cased in low; the patterns run where one of them may match."""
    return F.when(untidy(s) | any_in(low, LEAK_HINTS), let(s, first_paragraph)).otherwise(F.trim(text(s)))


def _corrupt_length(cut: Column, o: Column) -> Column:
    return (F.length(cut) < 2) | (F.length(cut) > F.greatest(F.lit(400), F.length(o) * 6))


def sanitize_translation(translated, original) -> Column:
    """The first clean paragraph of a model's output; the original if it looks corrupt."""
    o, cut = text(original), first_paragraph(translated)
    return F.when((F.trim(text(translated)) == "") | _corrupt_length(cut, o) | cut.rlike(CORRUPT_OUTPUT), o).otherwise(cut)


def sanitize_paragraph(c: Column, o: Column, low: Column) -> Column:
    """sanitize_translation from first_paragraph; an empty output's paragraph is too short as well. low: the output lower-cased."""
    corrupt = any_in(low, CORRUPT_HINTS) & c.rlike(CORRUPT_OUTPUT)
    return F.when(_corrupt_length(c, o) | corrupt, o).otherwise(c)


def fix_punctuation(c) -> Column:
    return _chain(text(c), [(r"(?U)\s+([,;:.!?])", "$1"), (r"([!?])\1+", "$1")])


def fix_punctuation_clean(s: Column) -> Column:
    """fix_punctuation of texts; the patterns run where one of them may match."""
    return F.when(untidy(s) | any_in(s, ("!!", "??", " ,", " ;", " :", " .", " !", " ?")), let(s, fix_punctuation)).otherwise(s)


def fix_ligatures(c) -> Column:
    return reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), F.lit(kv[1])), LIGATURE_FIXES.items(), text(c))


def apply_rules(c, rules) -> Column:
    """Ordered (pattern, replacement) rows, case-insensitive and Unicode-aware."""
    return _chain(text(c), [("(?iU)" + p, r) for p, r in rules])


def restore_acronyms(original, translated) -> Column:
    """Upper-case acronyms of the original, longest first, where the translation has them in another case."""
    o, t = clean_spaces(original), clean_spaces(translated)
    found = F.array_distinct(F.regexp_extract_all(o, F.lit(r"\b[A-Z]{2,8}\b"), F.lit(0)))
    ordered = F.array_sort(found, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    fixed = F.aggregate(ordered, t, lambda s, w: F.when(s.contains(w), s).otherwise(F.regexp_replace(s, F.concat(F.lit(r"(?iU)\b"), w, F.lit(r"\b")), w)))
    return F.when((o == "") | (t == ""), F.when(o != "", o).otherwise(t)).otherwise(fixed)


def restore_acronyms_clean(o: Column, t: Column) -> Column:
    """restore_acronyms of clean texts; one without capitals side by side, or unchanged, has none to restore."""
    return F.when((t != "") & ((o == t) | ~o.rlike("[A-Z]{2}")), t).otherwise(let(F.struct(o.alias("o"), t.alias("t")), lambda x: restore_acronyms(x["o"], x["t"])))


def reinject_spacing(original: Column, translated: Column) -> Column:
    o = text(original)
    return F.concat(F.regexp_extract(o, r"(?U)^(\s+)", 1), text(translated), F.regexp_extract(o, r"(?U)\S(\s+)$", 1))


def connector_fragment(c) -> Column:
    """French for English fragments of at most four connectors; null for anything else."""
    ws = F.transform(words(clean_spaces(c), WORD_OR_NUMBER), lambda w: F.lower(w))
    table = F.create_map(*[F.lit(x) for kv in CONNECTORS.items() for x in kv])
    known = F.forall(ws, lambda w: w.isin(*CONNECTORS))
    return F.when(F.size(ws).between(1, 4) & known, F.array_join(F.transform(ws, lambda w: F.element_at(table, w)), " "))


def connector_fragment_clean(s: Column) -> Column:
    """connector_fragment of clean texts; one pattern tells whether the words are connectors."""
    gap = "[^A-Za-zÀ-ÿ0-9]*"
    only = rf"^{gap}(?:(?i:{'|'.join(CONNECTORS)})(?![A-Za-zÀ-ÿ0-9'\-]){gap}){{1,4}}$"
    return F.when(s.rlike(only), let(s, connector_fragment))


def swap_header_number(c) -> Column:
    """"Title 12" to "12 Title"."""
    return F.regexp_replace(normalize_spaces(c), r"^(\D.*\S)\s+(\d{1,4})$", "$2 $1")


def html_escape(c) -> Column:
    s = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def css_slug(c) -> Column:
    return F.regexp_replace(text(c), r"[^A-Za-z0-9_-]+", "-")


def font_key(c) -> Column:
    """A font's name without its subset prefix, as lower-case letters and digits."""
    s = F.regexp_replace(text(c), r"^[^+]*\+", "")
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def font_flags(c) -> Column:
    s = F.lower(text(c))
    return F.struct(
        s.rlike("bold|black|heavy|semibold|demi").alias("bold"),
        s.rlike("italic|oblique").alias("italic"),
        (s.rlike("times|serif|roman|georgia|garamond|minion|palatino|cambria") & ~s.contains("sans")).alias("serif"),
        s.rlike("mono|courier|consol|code").alias("mono"),
    )


def nfc(c) -> Column:
    """Unicode NFC; Spark has no built-in, so an Arrow UDF normalises the texts that are not ASCII."""
    import pandas as pd

    def run(s):
        return s.str.normalize("NFC")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    t = text(c)
    return F.when(t.rlike(r"^\p{ASCII}*$"), t).otherwise(F.pandas_udf(run, "string")(t))
