"""Glossaries as a long table: domain, src, tgt, kind (entry or normalize), key, value, load_seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMA = "domain string, src string, tgt string, kind string, key string, value string, load_seq long"
# The seed glossary, English to French, by domain; and French variants put right.
SEED = {
    "science": {
        "gradient descent": "descente de gradient",
        "learning rate": "taux d'apprentissage",
        "neural network": "réseau de neurones",
        "error": "erreur",
        "hyperparameter": "hyperparamètre",
        "optimization": "optimisation",
        "oscillating": "oscillant",
        "feedforward": "propagation avant",
    },
    "economy": {"interest rate": "taux d'intérêt", "gross domestic product": "produit intérieur brut", "inflation": "inflation"},
    "politics": {"foreign policy": "politique étrangère", "rule of law": "état de droit", "public policy": "politique publique"},
    "biology": {"cell membrane": "membrane cellulaire", "gene expression": "expression génique", "immune response": "réponse immunitaire"},
    "general": {},
}
SEED_NORMALIZE = {
    "science": {
        "descent gradient": "descente de gradient",
        "gradient descente": "descente de gradient",
        "taux d’apprentissage": "taux d'apprentissage",
        "réseau nerveux": "réseau de neurones",
    },
}
KEYS = ["domain", "src", "tgt", "kind", "key"]


def seed(spark) -> DataFrame:
    """The seed glossary in the table's shape, loaded before all files."""
    rows = [(d, "en", "fr", "entry", k, v) for d, entries in SEED.items() for k, v in entries.items()]
    rows += [(d, "fr", "fr", "normalize", k, v) for d, entries in SEED_NORMALIZE.items() for k, v in entries.items()]
    return spark.createDataFrame([(*r, i - len(rows)) for i, r in enumerate(rows)], SCHEMA)


def clean_key(c) -> Column:
    return F.lower(T.clean_spaces(c))


def normalized(raw: DataFrame) -> DataFrame:
    """Lower-cased keys and trimmed values; rows without either are left out."""
    d = raw.withColumn("domain", F.coalesce(F.nullif(F.lower(F.trim("domain")), F.lit("")), F.lit("general")))
    d = d.withColumn("key", clean_key("key")).withColumn("value", T.clean_spaces("value"))
    return d.filter("key != '' and value != ''")


def last_wins(rows: DataFrame) -> DataFrame:
    """One row per key: the one loaded last."""
    return rows.groupBy(*KEYS).agg(F.max_by("value", "load_seq").alias("value"), F.max("load_seq").alias("load_seq"))


def first_wins(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.min_by("value", "load_seq").alias("value"), F.min("load_seq").alias("load_seq"))


def upsert(old: DataFrame, new: DataFrame, keep_existing: bool = False) -> DataFrame:
    """Full outer merge by key: new values override old ones, or old ones stay."""
    o = old.select(*KEYS, F.col("value").alias("__o"), F.col("load_seq").alias("__os"))
    n = new.select(*KEYS, F.col("value").alias("__n"), F.col("load_seq").alias("__ns"))
    a, b = ("o", "n") if keep_existing else ("n", "o")
    return o.join(n, KEYS, "full").select(*KEYS, F.coalesce(f"__{a}", f"__{b}").alias("value"), F.when(F.col(f"__{a}").isNotNull(), F.col(f"__{a}s")).otherwise(F.col(f"__{b}s")).alias("load_seq"))


def priority_chain(domain: Column, subdomain: Column, general: bool = False) -> Column:
    """Domains to look in, most specific first."""
    d, s = F.coalesce(F.nullif(clean_key(domain), F.lit("")), F.lit("general")), clean_key(subdomain)
    deep = F.array(F.concat(d, F.lit("."), s), F.concat(d, F.lit("/"), s), s)
    chain = F.concat(F.when((d != "general") & (s != ""), deep).otherwise(F.array().cast("array<string>")), F.array(d))
    return F.array_distinct(F.concat(chain, F.array(F.lit("general"))) if general else chain)


def exact_lookup(items: DataFrame, glossary: DataFrame, ident: str, general: bool = False) -> DataFrame:
    """(ident, value): the entry for an item's whole text from the most specific domain that has it.

    items: ident, t, domain, subdomain, src, tgt.
    """
    chain = items.select(ident, clean_key("t").alias("key"), "src", "tgt", F.posexplode(priority_chain(F.col("domain"), F.col("subdomain"), general)).alias("rank", "domain"))
    hit = chain.join(glossary.filter("kind = 'entry'").select(*KEYS[:3], "key", "value"), ["domain", "src", "tgt", "key"])
    return hit.groupBy(ident).agg(F.min_by("value", "rank").alias("value"))


def pair_map(domains: DataFrame, glossary: DataFrame, ident: str, general: bool = False) -> DataFrame:
    """(ident, key, value): all safe entries for a domain's chain; less specific domains override."""
    chain = domains.select(ident, "src", "tgt", F.posexplode(priority_chain(F.col("domain"), F.col("subdomain"), general)).alias("rank", "domain"))
    safe = glossary.filter("kind = 'entry'").filter(T.is_safe_glossary_key("key"))
    return chain.join(safe.select(*KEYS[:3], "key", "value"), ["domain", "src", "tgt"]).groupBy(ident, "key").agg(F.max_by("value", "rank").alias("value"))


def _term_words(c) -> Column:
    return F.regexp_extract_all(F.lower(T.clean_spaces(c)), F.lit(r"(?U)[\w'-]+"), F.lit(0))


def term_matches(items: DataFrame, terms: DataFrame, ident: str) -> DataFrame:
    """Leftmost longest glossary terms in texts: (ident, at, n, key, value), at and n in words.

    Texts and keys are cut into words; runs of the lengths that keys have, whatever these are, are looked
    up by an equi-join. Of overlapping hits the longest at the leftmost place stays, found by a fold over a
    text's hits. Keys of equal words give the smallest key.
    """
    known = terms.select("key", "value", _term_words("key").alias("__w")).filter(F.size("__w") > 0)
    known = known.groupBy(F.array_join("__w", " ").alias("__k")).agg(F.min(F.struct("key", "value")).alias("e"), F.first(F.size("__w")).alias("__n"))
    lengths = sorted(r[0] for r in known.select("__n").distinct().collect())  # few: one number per length of a term
    d = items.select(ident, _term_words("t").alias("w")).filter(F.size("w") > 0)

    def runs_of(n: int) -> Column:
        run = lambda at: F.struct(at.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(F.col("w"), at + 1, n), " ").alias("__k"))
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), run)).otherwise(none)

    none = F.expr("cast(array() as array<struct<at:int,n:int,__k:string>>)")
    runs = [runs_of(n) for n in lengths]
    grams = d.select(ident, F.explode(F.concat(*runs) if runs else none).alias("g")).select(ident, "g.at", "g.n", "g.__k")
    hits = grams.join(known.select("__k", "e.key", "e.value"), "__k")
    best = hits.groupBy(ident, "at").agg(F.max_by(F.struct("n", "key", "value"), "n").alias("h"))
    row = F.struct("at", F.col("h.n").alias("n"), F.col("h.key").alias("key"), F.col("h.value").alias("value"))
    listed = best.groupBy(ident).agg(F.sort_array(F.collect_list(row)).alias("hits"))
    start = F.struct(F.lit(0).alias("free"), F.expr("cast(array() as array<struct<at:int,n:int,key:string,value:string>>)").alias("out"))
    step = lambda a, x: F.when(x["at"] >= a["free"], F.struct((x["at"] + x["n"]).alias("free"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    return listed.select(ident, F.explode(F.aggregate("hits", start, step, lambda a: a["out"])).alias("m")).select(ident, "m.at", "m.n", "m.key", "m.value")


def matching_rules(items: DataFrame, glossary: DataFrame, ident: str, general: bool = False) -> DataFrame:
    """(ident, key, value): the safe entries of an item's chain whose key stands in its text; less specific domains override.

    The same rows as pair_map has for these keys, found through the text's runs of words, so items don't
    meet the whole glossary.
    """
    safe = glossary.filter("kind = 'entry'").filter(T.is_safe_glossary_key("key"))
    held = term_matches(items, safe.select("key", F.col("key").alias("value")).distinct(), ident).select(ident, "key").distinct()
    chain = items.select(ident, "src", "tgt", F.posexplode(priority_chain(F.col("domain"), F.col("subdomain"), general)).alias("rank", "domain"))
    return chain.join(held, ident).join(safe.select(*KEYS[:3], "key", "value"), [*KEYS[:3], "key"]).groupBy(ident, "key").agg(F.max_by("value", "rank").alias("value"))


def replace_terms(items: DataFrame, rules: DataFrame, ident: str) -> DataFrame:
    """(ident, t): word-bounded, case-insensitive replacement of keys by values, longest key first.

    In sentences only keys of several words are replaced. rules: ident, key, value.
    """
    listed = rules.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct((-F.length("key")).alias("n"), "key", "value"))).alias("r"))
    quote = lambda k: F.concat(F.lit(r"(?iU)\b\Q"), k, F.lit(r"\E\b"))
    literal = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
    d = items.join(listed, ident, "left")
    use = F.filter("r", lambda x: ~T.is_sentence(F.col("t")) | x["key"].contains(" "))
    out = F.aggregate(use, T.text("t"), lambda s, x: F.regexp_replace(s, quote(x["key"]), literal(x["value"])))
    return d.select(ident, F.coalesce(out, T.text("t")).alias("t"))


def synset_pairs(english: DataFrame, other: DataFrame) -> DataFrame:
    """(key, value): English lemma to the first target lemma that shares a synset. Columns: synset, lemma, ord.

    Only a synset's first target and a lemma's first place in a synset can win, so each side is reduced
    to these before the join. Targets of equal ord give the smallest.
    """
    e = english.select("synset", clean_key("lemma").alias("key"), F.struct(F.col("ord").alias("eo")).alias("e")).filter("key != ''")
    o = other.select("synset", T.clean_spaces("lemma").alias("value"), F.col("ord").alias("oo")).filter("value != ''")
    e = e.groupBy("synset", "key").agg(F.min("e").alias("e"))
    o = o.groupBy("synset").agg(F.min(F.struct("oo", "value")).alias("o"))
    return e.join(o, "synset").groupBy("key").agg(F.min(F.struct("e", "o"))["o"]["value"].alias("value"))


def missing_translations(terms: DataFrame, languages: DataFrame, have: DataFrame) -> DataFrame:
    """(key, tgt) of each term and language that has no entry yet: small term and language lists crossed."""
    return terms.select("key").crossJoin(F.broadcast(languages.select("tgt"))).join(have.select("key", "tgt"), ["key", "tgt"], "left_anti")


def detect_domain(docs: DataFrame, lexicon: DataFrame, ident: str, default: str = "general") -> DataFrame:
    """(ident, domain, hits): the domain with most keywords inside the text, the first of the lexicon on ties.

    lexicon: domain, ord, keyword; a small configured table, so it is grouped into one row and broadcast.
    """
    table = lexicon.groupBy("domain", "ord").agg(F.collect_set("keyword").alias("ks"))
    table = table.agg(F.sort_array(F.collect_list(F.struct("ord", "domain", "ks"))).alias("lex"))
    d = docs.select(ident, F.lower(T.text("t")).alias("s")).crossJoin(F.broadcast(table))
    score = F.transform("lex", lambda x: F.struct(F.size(F.filter(x["ks"], lambda k: F.contains(F.col("s"), k))).alias("hits"), (-x["ord"]).alias("o"), x["domain"].alias("domain")))
    best = F.array_max(score)
    return d.select(ident, F.when(best["hits"] > 0, best["domain"]).otherwise(default).alias("domain"), F.greatest(F.lit(0), best["hits"]).alias("hits"))
