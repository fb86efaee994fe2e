"""Translation profiles: settings as rows (profile, section, name, value), laid over each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language as L

DEFAULT = "default"
# Fixed values of the default profile, by section.
DEFAULTS = {
    "quality_thresholds": {k: str(v) for k, v in L.THRESHOLDS.items()},
    "quality_penalties": {k: str(v) for k, v in L.PENALTIES.items()},
    "quality_rules": {k: str(v) for k, v in L.RULES.items()},
    "post_edit": {"generic_cleanup": "true", "generic_replacements": "[]", "literal_patterns": "[]", "weak_connectors": "[]"},
}
KEYS = ["profile", "section", "name"]


def defaults(spark: SparkSession) -> DataFrame:
    rows = [(DEFAULT, s, n, v) for s, names in DEFAULTS.items() for n, v in names.items()]
    return spark.createDataFrame(rows, "profile string, section string, name string, value string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON file of profiles; lists and objects stay JSON text. Broken files and other shapes give no rows."""
    d = spark.read.text(path, wholetext=True)
    d = d.select(F.explode(F.from_json("value", "map<string, map<string, map<string, string>>>")).alias("profile", "s"))
    return d.select("profile", F.explode("s").alias("section", "n")).select("profile", "section", F.explode("n").alias("name", "value"))


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """base with the settings of `over` in place of its own and beside them."""
    cols = [*KEYS, "value"]
    return base.join(over.select(*KEYS), KEYS, "left_anti").select(*cols).unionByName(over.select(*cols))


def for_languages(profiles: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, section, name, value: the default profile with each language's own settings over it. langs: lang."""
    asked = langs.select("lang").distinct().select("lang", F.explode(F.array(F.col("lang"), F.lit(DEFAULT))).alias("profile"))
    d = asked.join(profiles, "profile")
    return d.groupBy("lang", "section", "name").agg(F.min_by("value", F.col("profile") == DEFAULT).alias("value"))
