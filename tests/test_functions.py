"""Row-level functions on literal rows with expected values worked out by hand from their rules."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions import language as L
from folioflow.functions import text as T


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize(
    ("fn", "rows"),
    [
        (T.norm_text, {"  A\t b\n C ": "a b c", None: "", "a b": "a b"}),
        (T.clean_spaces, {"co­op​ x": "coop x"}),
        (T.is_equation_like, {"dx / dy": True, "multi-layer": True, "plain words": False, "": False, "a#b$c%d&e@f!g~ and more words to reach fort": True, "a#b and a longer plain text of many words": False, "##$$%%&&@@!!~~ and more words here to reach": True}),
        (T.is_reference_like, {"(iv)": True, "[3-5]": True, "12": False, "(2)": True}),
        (T.is_immutable_inline, {"•": True, "12.": True, "CNN": False, "plain words": False, "α": True}),
        (T.is_hard_protected, {"see www.x.org": True, "": True, "a b": False, "x = y": True}),
        (T.is_protected, {"H2SO4": True, "CNN": True, "see (Smith, 2019)": True, "mail a@b.co": True, "A/B": True, "plain words only": False, "CNN RNN networks": True}),
        (T.is_sentence, {"one two three four": False, "one two three four.": True, "one two three four five": True, "1 2 3 4 5": False}),
        (T.is_marker_only, {"-": True, "12.": True, "...": True, "a": False}),
        (T.leading_marker, {"• item": "•", "1. item": "1.", "a) item": "a)", "- item": "-", "1": "", "12.": ""}),
        (T.without_bullet, {"• item": "item", "item": "item"}),
        (T.close_spaced_caps, {"C HAPTER": "C HAPTER", "A B C D": "ABCD", "plain": "plain"}),
        (T.atom_kind, {"7": "chiffre", "77": "nombre", "x": "lettre", "xy": "mot_alpha", "+": "symbole", " ": None}),
        (T.without_repeats, {"Go on. go ON! Stop.": "Go on. Stop.", "": ""}),
        (T.connector_fragment, {"of the": "de le", "of the net": None}),
        (T.sanitize_source, {"fea- tures · x": "features ' x"}),
        (T.html_escape, {"<a & 'b'>": "&lt;a &amp; &#x27;b&#x27;&gt;"}),
        (T.font_key, {"ABCDEF+Times-Roman": "timesroman"}),
        (T.nfc, {"é": "é", "plain": "plain", None: ""}),
        (T.is_safe_glossary_key, {"the": False, "from": False, "neural net": True, "a-b": False}),
        (T.swap_header_number, {"Title 12": "12 Title", "12 Title": "12 Title"}),
        (T.marker_code, {"•": "U+2022", "": ""}),
    ],
)
def test_text(spark, fn, rows):
    for given, want in rows.items():
        assert value(spark, fn(F.lit(given).cast("string"))) == want, given


def test_splits(spark):
    assert value(spark, T.sentences(F.lit("One. Two?  Three"))) == ["One.", "Two?", "Three"]
    assert value(spark, T.residual_chunks(F.lit("a, b;(c)"))) == ["a", "b", "c"]
    assert value(spark, T.atoms(F.lit("ab12+"))) == ["ab", "12", "+"]
    assert "".join(value(spark, T.expressions_with_gaps(F.lit("a, b (c) - d")))) == "a, b (c) - d"
    assert "".join(value(spark, T.word_pieces(F.lit("a, b  c.")))) == "a, b  c."
    long = ", ".join(["word" * 5] * 30)
    parts = value(spark, T.chunks(F.lit(long)))
    assert " ".join(parts) == long and max(map(len, parts)) <= T.MAX_CHUNK
    assert value(spark, T.append_fragment(F.lit("fea-"), F.lit("tures"))) == "features"
    assert value(spark, T.append_fragment(F.lit("end"), F.lit(", so"))) == "end, so"
    assert value(spark, T.jaccard(T.tokens(F.lit("")), T.tokens(F.lit("a")))) == 0.0


def test_translation_text(spark):
    assert value(spark, T.restore_acronyms(F.lit("The CNN and RNN"), F.lit("le cnn et rnn"))) == "le CNN et RNN"
    assert value(spark, T.sanitize_translation(F.lit("assistant: bad"), F.lit("src text"))) == "src text"
    assert value(spark, T.sanitize_translation(F.lit("Bon texte.\n\nReste"), F.lit("Good text"))) == "Bon texte."
    assert value(spark, T.is_acceptable_translation(F.lit("a good plain text"), F.lit("un bon texte clair")))
    assert not value(spark, T.is_acceptable_translation(F.lit("H2SO4"), F.lit("acide")))
    assert value(spark, T.reinject_spacing(F.lit("  a "), F.lit("b"))) == "  b "
    assert value(spark, T.fix_ligatures(F.lit("and-or"))) == "and'or"


def test_language(spark):
    assert value(spark, L.marker_count(F.lit("The end of THE road"), "en")) == 3
    assert value(spark, L.leak_score(F.lit(""), F.lit("fr"))) == 1e9
    assert value(spark, L.leak_score(F.lit("the cat"), F.lit("fr"))) == pytest.approx(0.7)
    assert value(spark, L.guess_language(F.lit("漢字かな"))) == "zh"
    assert value(spark, L.language_code(F.lit("German"))) == "de"
    assert value(spark, L.language_code(F.lit("klingon"))) == "fr"
    assert value(spark, L.model_code(F.lit("fr"))) == "fra_Latn"
    assert value(spark, L.domain_of(F.lit("the court and a contract"))) == "legal"
    assert value(spark, L.domain_of(F.lit("nothing"))) == "general"
    assert not value(spark, L.gate_ok(F.lit("we see the end"), F.lit("fr")))
    q = value(spark, L.quality(F.lit("A sentence of words."), F.lit("A sentence of words."), F.lit("body"), F.lit("fr")))
    assert (q.score, q.flags, q.status) == (60, ["unchanged_translation"], "critical")
    q = value(spark, L.quality(F.lit("x"), F.lit(""), F.lit("body"), F.lit("fr")))
    assert (q.score, q.flags, q.status) == (0, ["empty_translation"], "critical")


def test_geometry(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert value(spark, G.overlap(box(0, 0, 10, 10), box(5, 5, 15, 15))) == pytest.approx(0.25)
    assert value(spark, G.overlap(box(0, 0, 1, 1), box(5, 5, 6, 6))) == 0.0
    assert value(spark, G.alignment(box(0, 0, 100, 10), box(0, 0, 100, 100))) == "justify"
    assert value(spark, G.alignment(box(70, 0, 100, 10), box(0, 0, 100, 100))) == "right"
    assert value(spark, G.alignment(box(30, 0, 70, 10), box(0, 0, 100, 100))) == "center"
    assert value(spark, G.readable_color(F.lit("#ffff00"))) in ("#6b6b00", "#222222")
    assert value(spark, G.readable_color(F.lit("#000"))) == "#000000"
    assert value(spark, G.color_bucket(F.lit("#505050"))) == "#404040"  # 80 / 32 = 2.5 rounds to 2
    assert value(spark, G.int_color(F.lit(0x0A0B0C))) == "#0a0b0c"
    assert value(spark, G.body_color(F.lit("#f0f0f0"), F.lit("body"))) == "#101010"
