"""Language markers, leak scores, domains and translation quality as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Marker words, codes, profile numbers and patterns that results depend on.
MARKERS = {
    "en": ("the", "and", "of", "for", "with", "from", "to", "in", "is", "are", "this", "that", "will", "when"),
    "fr": ("le", "la", "les", "de", "des", "du", "et", "est", "sont", "pour", "avec", "dans", "ce", "cette", "qui", "que"),
    "es": ("el", "la", "los", "las", "de", "del", "y", "en", "para", "con", "que", "por", "es", "son"),
    "de": ("der", "die", "das", "und", "mit", "für", "von", "zu", "in", "ist", "sind", "den", "dem"),
    "it": ("il", "lo", "la", "gli", "le", "di", "e", "con", "per", "in", "che", "è", "sono"),
    "pt": ("o", "a", "os", "as", "de", "do", "da", "e", "com", "para", "em", "que", "é", "são"),
    "ru": ("и", "в", "на", "с", "для", "что", "это", "к", "из", "по"),
    "ar": ("و", "في", "من", "على", "مع", "إلى", "أن", "هذا", "هذه"),
}
LANGUAGE_NAMES = {
    "french": "fr",
    "english": "en",
    "spanish": "es",
    "german": "de",
    "italian": "it",
    "portuguese": "pt",
    "russian": "ru",
    "arabic": "ar",
    "chinese": "zh",
    "zh-cn": "zh",
    "japanese": "ja",
    "korean": "ko",
    "hindi": "hi",
    "vietnamese": "vi",
    "thai": "th",
    "indonesian": "id",
    "turkish": "tr",
    "dutch": "nl",
    "polish": "pl",
    "ukrainian": "uk",
}
MODEL_CODES = {
    "en": "eng_Latn",
    "fr": "fra_Latn",
    "es": "spa_Latn",
    "de": "deu_Latn",
    "it": "ita_Latn",
    "pt": "por_Latn",
    "ru": "rus_Cyrl",
    "ar": "arb_Arab",
    "zh": "zho_Hans",
    "ja": "jpn_Jpan",
    "ko": "kor_Hang",
    "hi": "hin_Deva",
    "vi": "vie_Latn",
    "th": "tha_Thai",
    "id": "ind_Latn",
    "tr": "tur_Latn",
    "nl": "nld_Latn",
    "pl": "pol_Latn",
    "uk": "ukr_Cyrl",
}
SCRIPTS = (("zh", r"[一-鿿]"), ("ja", r"[぀-ヿ]"), ("ko", r"[가-힯]"), ("ar", r"[؀-ۿ]"), ("ru", r"[Ѐ-ӿ]"))
GATE_STOP = r"(?iU)\b(the\b|we\b|you\b|suppose\b|look at\b|remember\b|passes through\b|high-level\b|architecture\b)"
GATE_ENGLISH = ("the", "and", "with", "for", "from", "this", "that", "are", "you", "your", "will", "layers", "feature", "network", "looks", "suppose", "building", "classify", "passes", "through", "detect", "patterns", "extract")
MAX_SOURCE_LEAK = 1.15
PENALTIES = {
    "unchanged_translation": 40,
    "too_short": 20,
    "too_long": 15,
    "english_leak": 25,
    "mixed_language": 12,
    "punctuation_noise": 10,
    "source_fragment": 6,
    "parenthesis_mismatch": 8,
    "weak_style_connectors": 8,
    "literal_style_per_hit": 6,
    "literal_style_max": 18,
}
THRESHOLDS = {"critical_below": 72, "review_below": 88}
RULES = {"min_source_words_for_ratio_check": 5, "short_ratio": 0.45, "long_ratio": 2.7}
LITERAL_FR = (
    r"\bce processus est appelé\b",
    r"\ble gradient détermine seulement\b",
    r"\bce peut être un pas\b",
    r"\bnous relançons le processus\b",
    r"\bnous choisissons cette voie\b",
    r"\bcela nous amène\b",
    r"\bvous finissez au point\b",
)
# Lower-case parts of the phrases above and below, without i, k and s, which other characters fold to.
LITERAL_HINTS = ("appel", "grad", "ce peut", "relan", "cette vo", "cela nou", "ez au po")
WEAK_HINTS = ("et a", "pour l'", "tout ")
WEAK_FR = ("et ainsi de suite", "pour l'instant", "pas tout à fait")
DOMAINS = {
    "science": ("equation", "theorem", "integral", "derivative", "matrix", "vector", "physics", "molecule", "chemical", "astronomy", "galaxy", "orbit", "telescope", "neural", "learning rate", "optimization", "algorithm"),
    "economy": ("inflation", "gdp", "interest rate", "fiscal", "monetary", "economy", "market", "bond", "equity", "exchange rate", "trade balance"),
    "politics": ("election", "parliament", "government", "policy", "constitution", "diplomacy", "senate", "legislative", "executive", "public administration"),
    "biology": ("cell", "protein", "gene", "dna", "rna", "enzyme", "organism", "immune", "genome", "microbiology", "ecology"),
    "medicine": ("patient", "diagnosis", "therapy", "clinical", "pharmacology", "epidemiology", "oncology", "cardiology", "neurology", "hospital", "symptom"),
    "engineering": ("mechanical", "electrical", "civil engineering", "control system", "signal processing", "manufacturing", "structural", "embedded", "robotics", "cad"),
    "legal": ("court", "statute", "regulation", "contract", "criminal law", "civil law", "jurisdiction", "compliance", "litigation", "tax law"),
    "technology": ("software", "hardware", "database", "cloud", "cybersecurity", "api", "protocol", "distributed system", "operating system", "container"),
    "education": ("curriculum", "pedagogy", "assessment", "learning outcomes", "classroom", "didactics", "instructional design", "student performance"),
    "history": ("historical period", "chronology", "empire", "archival", "historiography", "medieval", "antiquity", "industrial revolution"),
    "geography": ("latitude", "longitude", "topography", "cartography", "climate", "river basin", "geology", "landform", "ecosystem", "geospatial"),
}
# Keywords of each domain's subdomains, in the order that decides ties.
SUBDOMAINS = {
    "science": {
        "mathematics": ("equation", "theorem", "lemma", "integral", "derivative", "matrix", "vector", "probability", "statistics", "algebra", "calculus", "topology"),
        "physics": ("force", "energy", "velocity", "acceleration", "quantum", "relativity", "mass", "momentum", "thermodynamics", "electromagnetic", "wave", "particle"),
        "chemistry": ("molecule", "molar", "stoichiometry", "reaction", "compound", "acid", "base", "catalyst", "polymer", "organic chemistry", "inorganic", "ph", "atom"),
        "astronomy": ("galaxy", "planet", "star", "orbit", "cosmology", "telescope", "nebula", "astrophysics", "solar system", "exoplanet", "supernova"),
        "computer_science": (
            "algorithm", "neural", "learning rate", "gradient descent", "dataset", "model", "training", "inference", "backpropagation", "optimization", "network", "cpu",
            "memory", "complexity", "compiler",
        ),
    },
    "economy": {
        "macroeconomics": ("inflation", "gdp", "fiscal policy", "monetary policy", "unemployment", "cpi"),
        "finance": ("equity", "bond", "portfolio", "derivative", "volatility", "asset pricing"),
        "banking": ("interest rate", "credit risk", "liquidity", "deposit", "loan", "capital adequacy"),
        "trade": ("export", "import", "tariff", "trade balance", "customs", "exchange rate"),
    },
    "politics": {
        "governance": ("governance", "public administration", "institutional", "accountability", "transparency"),
        "public_policy": ("public policy", "policy design", "implementation", "regulatory impact"),
        "diplomacy": ("foreign policy", "diplomacy", "treaty", "bilateral", "multilateral"),
        "elections": ("election", "electoral", "ballot", "voter", "campaign"),
        "law": ("constitutional", "legislative", "judiciary", "rule of law", "jurisdiction"),
    },
    "biology": {
        "genetics": ("gene", "genome", "mutation", "inheritance", "genetic expression"),
        "microbiology": ("bacteria", "virus", "microorganism", "culture medium", "pathogen"),
        "immunology": ("immune", "antibody", "antigen", "innate immunity", "adaptive immunity"),
        "ecology": ("ecosystem", "biodiversity", "habitat", "population dynamics", "food web"),
        "physiology": ("metabolism", "homeostasis", "organ system", "cell membrane", "enzyme"),
    },
    "medicine": {
        "cardiology": ("cardiac", "heart failure", "arrhythmia", "hypertension", "ecg"),
        "oncology": ("tumor", "cancer", "metastasis", "chemotherapy", "radiotherapy"),
        "neurology": ("neuron", "brain", "stroke", "epilepsy", "neurodegenerative"),
        "pharmacology": ("drug", "dosage", "pharmacokinetics", "adverse effect", "contraindication"),
        "epidemiology": ("incidence", "prevalence", "cohort", "outbreak", "public health"),
    },
    "engineering": {
        "mechanical": ("thermofluid", "mechanics", "kinematics", "dynamics", "stress", "strain"),
        "electrical": ("circuit", "voltage", "current", "resistance", "signal", "control"),
        "civil": ("structural", "geotechnical", "concrete", "beam", "foundation", "load"),
        "materials": ("alloy", "composite", "microstructure", "fatigue", "fracture"),
        "control_systems": ("feedback", "stability", "controller", "pid", "state space"),
    },
    "legal": {
        "civil_law": ("civil law", "tort", "liability", "damages", "obligation"),
        "criminal_law": ("criminal law", "offense", "prosecution", "penalty", "felony"),
        "international_law": ("international law", "treaty", "sovereignty", "jurisdiction", "convention"),
        "labor_law": ("employment", "collective bargaining", "labor code", "workplace", "union"),
        "tax_law": ("taxable income", "deduction", "vat", "withholding", "tax compliance"),
    },
    "technology": {
        "software": ("software architecture", "refactoring", "testing", "deployment", "dependency"),
        "data": ("database", "etl", "data warehouse", "query optimization", "schema"),
        "cloud": ("cloud", "container", "kubernetes", "autoscaling", "infrastructure as code"),
        "cybersecurity": ("encryption", "vulnerability", "threat model", "authentication", "authorization"),
    },
    "education": {
        "pedagogy": ("pedagogy", "didactics", "teaching strategy", "active learning"),
        "assessment": ("assessment", "rubric", "summative", "formative", "evaluation"),
        "curriculum": ("curriculum", "syllabus", "learning outcomes", "competency framework"),
    },
    "history": {
        "ancient_history": ("antiquity", "ancient empire", "classical period", "archaeological"),
        "medieval_history": ("medieval", "feudal", "kingdom", "chronicle", "manorial"),
        "modern_history": ("industrial revolution", "colonial", "nation-state", "modern era"),
    },
    "geography": {
        "physical_geography": ("landform", "hydrology", "geomorphology", "climate", "tectonic"),
        "human_geography": ("urbanization", "migration", "demography", "settlement", "economic geography"),
        "geospatial": ("gis", "cartography", "geospatial", "remote sensing", "geodesy"),
    },
}


def marker_count(c, lang: str) -> Column:
    """Occurrences of the language's marker words; 0 for languages without markers."""
    if lang not in MARKERS:
        return F.lit(0)
    return F.regexp_count(T.clean_spaces(c), F.lit(rf"(?iU)\b({'|'.join(MARKERS[lang])})\b"))


def marker_count_clean(s: Column, lang: str) -> Column:
    """marker_count of clean text: first letters are looked for before the words."""
    first = "".join(sorted({m[0] for m in MARKERS[lang]}))
    return F.regexp_count(s, F.lit(rf"(?iU)\b(?=[{first}])(?:{'|'.join(MARKERS[lang])})\b"))


def marker_count_by(c, lang: Column, count=marker_count) -> Column:
    out = F.lit(0)
    for k in MARKERS:
        out = F.when(lang == k, count(c, k)).otherwise(out)
    return out


def guess_language(c, default: str = "en") -> Column:
    """By script; Japanese with CJK characters counts as zh, as the CJK test comes first."""
    out = None
    for lang, pattern in SCRIPTS:
        hit = T.text(c).rlike(pattern)
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out.otherwise(default)


def language_by_diacritics(c) -> Column:
    s = F.lower(T.text(c))
    return F.when(s.rlike("[àâçéèêëîïôùûœ]"), "fr").when(s.rlike("[ñ¿¡áíóú]"), "es").when(s.rlike("[äöüß]"), "de").otherwise("en")


def language_code(c) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit("French"))))
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, s), F.when(s.rlike("^[a-z]{2,3}$"), s), F.lit("fr"))


def model_code(c) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in MODEL_CODES.items() for x in kv])
    return F.try_element_at(codes, language_code(c))


def leak_score(c, lang: Column) -> Column:
    """English markers less target markers per word; lower is better. 1e9 for empty text, 0 for English."""
    s = T.clean_spaces(c)
    n = F.greatest(F.lit(1), T.word_count(s))
    score = (marker_count(s, "en") * F.lit(1.4) - marker_count_by(s, lang) * F.lit(0.9)) / n
    return F.when(s == "", F.lit(1e9)).when(lang.isin("", "en"), F.lit(0.0)).otherwise(score)


def source_leak(c, target: Column, source: Column) -> Column:
    s = T.clean_spaces(c)
    ratio = (marker_count_by(s, source) + F.lit(1.0)) / (marker_count_by(s, target) + F.lit(1.0))
    return F.when((s == "") | (source == "") | (source == target), F.lit(0.0)).otherwise(ratio)


def gate_ok(c, target: Column, source: Column | None = None, strict: bool = True) -> Column:
    s = T.clean_spaces(c)
    clean = (s != "") & ~T.has_invisible(s)
    if not strict:
        return clean
    english = F.regexp_count(s, F.lit(rf"(?iU)\b({'|'.join(GATE_ENGLISH)})\b"))
    french = (target == "fr") & (s.rlike(GATE_STOP) | (english > 1))
    return clean & ~french & (source_leak(s, target, F.lit("en") if source is None else source) <= MAX_SOURCE_LEAK)


def _literal_count(out: Column) -> Column:
    return sum((out.rlike("(?iU)" + p).cast("int") for p in LITERAL_FR), F.lit(0))


def _weak_count(out: Column) -> Column:
    return F.regexp_count(out, F.lit(rf"(?iU)\b({'|'.join(WEAK_FR)})\b"))


def _marks(src: Column, out: Column) -> dict[str, Column]:
    count = lambda s, ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    return {
        "noise": out.rlike("[!?]{2,}"),
        "closed": src.rlike(r"[.!?]\s*$"),
        "parens": (src == out) | ((count(src, "(") == count(out, "(")) & (count(src, ")") == count(out, ")"))),
    }


def _quality_inputs(source, translation, target: Column) -> dict[str, Column]:
    src, out = T.normalize_spaces(source), T.normalize_spaces(translation)
    return {
        "src": src,
        "out": out,
        "n": T.word_count(src),
        "m": T.word_count(out),
        "en": marker_count(out, "en"),
        "tg": marker_count_by(out, target),
        "literal": _literal_count(out),
        "weak": _weak_count(out),
    } | _marks(src, out)


def _quality_verdict(x: dict[str, Column], role: Column, target: Column, protected: Column) -> Column:
    n, m, en, tg, p = x["n"], x["m"], x["en"], x["tg"], PENALTIES
    leak = (target != "en") & (tg == 0) & (en >= 2)
    short = F.greatest(F.lit(3), F.floor(n * F.lit(RULES["short_ratio"])).cast("int"))
    long = F.greatest(F.lit(60), F.floor(F.greatest(F.lit(1), n) * F.lit(RULES["long_ratio"])).cast("int"))
    rows = [
        ("unchanged_translation", (x["out"] == x["src"]) & ~protected, F.lit(p["unchanged_translation"])),
        ("too_short", (n >= RULES["min_source_words_for_ratio_check"]) & (m < short), F.lit(p["too_short"])),
        ("too_long", m > long, F.lit(p["too_long"])),
        ("english_leak", leak, F.lit(p["english_leak"])),
        ("mixed_language", (target != "en") & ~leak & (en > tg + 3), F.lit(p["mixed_language"])),
        ("punctuation_noise", x["noise"], F.lit(p["punctuation_noise"])),
        ("literal_style", (target == "fr") & (x["literal"] > 0), F.least(F.lit(p["literal_style_max"]), x["literal"] * p["literal_style_per_hit"])),
        ("weak_style_connectors", (target == "fr") & (x["weak"] >= 2), F.lit(p["weak_style_connectors"])),
        ("source_fragment", (x["src"] != "") & ~x["closed"] & (n >= 8), F.lit(p["source_fragment"])),
        ("parenthesis_mismatch", ~x["parens"], F.lit(p["parenthesis_mismatch"])),
    ]
    empty = x["out"] == ""
    raw = F.lit(100) - sum((F.when(hit, pen).otherwise(0) for _, hit, pen in rows), F.lit(0))
    floor = F.when(role.isin("header", "footer") & (n <= 6), F.greatest(raw, F.lit(70))).otherwise(raw)
    score = F.when(empty, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), floor)))
    flags = F.when(empty, F.array(F.lit("empty_translation"))).otherwise(F.array_compact(F.array(*[F.when(hit, name) for name, hit, _ in rows])))
    return F.struct(score.cast("int").alias("score"), flags.alias("flags"))


def _status(score: Column) -> Column:
    return F.when(score < THRESHOLDS["critical_below"], "critical").when(score < THRESHOLDS["review_below"], "review").otherwise("ok")


def quality(source, translation, role: Column, target: Column, protected: Column | None = None) -> Column:
    """Struct of score 0 to 100, flags in order, and status ok, review or critical."""
    v = _quality_verdict(_quality_inputs(source, translation, target), role, target, F.lit(False) if protected is None else protected)
    return F.struct(v["score"].alias("score"), v["flags"].alias("flags"), _status(v["score"]).alias("status"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns; a generator keeps the optimiser from copying them into what uses them."""
    d = df.withColumn("__c", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
    return d.select(*df.columns, *[F.col(f"__c.{k}").alias(k) for k in columns])


def with_quality(df: DataFrame, source, translation, role: Column, target: Column, protected: Column | None = None, known: Column | None = None) -> DataFrame:
    """df with score, flags and status as quality() gives them. Counts are taken once per row, and those that
    hints, or counts before them, show to be idle are not taken. known: a struct of n, en and tg where both texts are
    clean, equal and without LITERAL_FR and WEAK_FR, else null."""
    at = lambda k: F.col(f"__q_{k}")
    known = F.lit(None).cast("struct<n:int,en:int,tg:int>") if known is None else known
    normal = lambda c: T.let(T.text(c), lambda s: F.when(T.untidy(s), T.let(s, T.normalize_spaces)).otherwise(F.trim(s)))
    ready = at("known").isNotNull()
    d = once(df, __q_a=source, __q_b=translation, __q_role=role, __q_target=target, __q_protected=F.lit(False) if protected is None else protected, __q_known=known)
    d = once(d, __q_src=F.when(ready, at("a")).otherwise(normal(at("a"))), __q_out=F.when(ready, at("b")).otherwise(normal(at("b"))))
    fresh = lambda f: T.let(T.tidy(at("out")), f)
    d = once(
        d,
        __q_n=F.when(ready, at("known.n")).otherwise(T.word_count(at("src"))),
        __q_en=F.when(ready, at("known.en")).otherwise(fresh(lambda s: marker_count_clean(s, "en"))),
        __q_low=F.when(~ready, F.lower(at("out"))),
    )
    hit = lambda hints, counted: F.when(~ready & (at("target") == "fr") & T.any_in(at("low"), hints), T.let(at("out"), counted)).otherwise(0)
    # Fewer than two English markers raise no flag, whatever the target's count.
    tg = F.when(ready, at("known.tg")).when(at("en") >= 2, fresh(lambda s: marker_count_by(s, at("target"), marker_count_clean))).otherwise(0)
    m = F.when(at("out") == at("src"), at("n")).otherwise(T.word_count(at("out")))
    d = once(d, __q_m=m, __q_tg=tg, __q_literal=hit(LITERAL_HINTS, _literal_count), __q_weak=hit(WEAK_HINTS, _weak_count))
    x = {k: at(k) for k in ("src", "out", "n", "m", "en", "tg", "literal", "weak")} | _marks(at("src"), at("out"))
    d = once(d, __q_v=_quality_verdict(x, at("role"), at("target"), at("protected")))
    return d.select(*df.columns, F.col("__q_v.score").alias("score"), F.col("__q_v.flags").alias("flags"), _status(F.col("__q_v.score")).alias("status"))


def lexicon(spark, table: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(domain, ord, keyword) from keyword lists."""
    rows = [(d, i, k) for i, (d, ks) in enumerate((table or DOMAINS).items()) for k in ks]
    return spark.createDataFrame(rows, "domain string, ord int, keyword string")


def domain_of(c, table: dict[str, tuple[str, ...]] | None = None, default: str = "general") -> Column:
    """The domain with the most keywords inside the lower-cased text; the first one on ties, default if none hits."""
    s = F.lower(T.text(c))
    scores = [
        F.struct(sum((s.contains(k).cast("int") for k in ks), F.lit(0)).alias("hits"), F.lit(-i).alias("order"), F.lit(d).alias("domain"))
        for i, (d, ks) in enumerate((table or DOMAINS).items())
    ]
    best = F.array_max(F.array(*scores))
    return F.when(best["hits"] > 0, best["domain"]).otherwise(default)


def subdomain_of(c, domain: Column) -> Column:
    """The subdomain of `domain` with most keywords inside the lower-cased text; the first on ties, "" if none hits."""
    out = F.lit("")
    for d, table in SUBDOMAINS.items():
        out = F.when(F.lower(T.text(domain)) == d, domain_of(c, table, "")).otherwise(out)
    return out
