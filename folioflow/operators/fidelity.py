"""Page fidelity: signatures of measured values, their similarity, and the weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of the overall score.
WEIGHTS = {"hierarchy_consistency": 0.26, "spacing_consistency": 0.22, "alignment_consistency": 0.20, "color_distance": 0.14, "table_fidelity": 0.18}
METRICS = (*WEIGHTS, "overall")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def discrete_percentiles(df: DataFrame, keys: list[str], value: str, qs: tuple[float, ...] = (0.5, 0.8, 0.95)) -> DataFrame:
    """(keys, signature): the sorted values at index floor(q * (n - 1)); zeros for none."""
    vs = F.sort_array(F.collect_list(F.col(value).cast("double")))
    g = df.groupBy(*keys).agg(vs.alias("__v"))
    at = lambda q: F.coalesce(F.get("__v", F.floor(F.lit(q) * (F.size("__v") - 1)).cast("int")), F.lit(0.0))
    return g.select(*keys, F.array(*[at(q) for q in qs]).alias("signature"))


def gap_runs(rows: DataFrame, keys: list[str], order: str, ink: str, width: Column) -> DataFrame:
    """(keys, run): lengths of the runs of rows without text, the trailing one included."""
    blank = F.col(ink) <= F.greatest(F.lit(1), F.floor(width * 0.002))
    w = W.partitionBy(*keys).orderBy(order)
    d = rows.withColumn("__b", blank).withColumn("__g", F.sum((~F.col("__b")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.filter("__b").groupBy(*keys, "__g").agg(F.count(F.lit(1)).alias("run")).drop("__g")


def gap_signature(runs: DataFrame, keys: list[str], value: str = "run") -> DataFrame:
    return runs.groupBy(*keys).agg(F.array(F.median(value), F.percentile(value, 0.9)).alias("signature"))


def spread_signature(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, signature): median and population deviation."""
    return df.groupBy(*keys).agg(F.array(F.median(value), F.stddev_pop(value)).alias("signature"))


def similarity(a: Column, b: Column) -> Column:
    """1 less the mean relative difference of two vectors, within 0 to 1."""
    rel = F.zip_with(a, b, lambda x, y: F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)))
    return clamp01(1 - F.aggregate(rel, F.lit(0.0), lambda s, v: s + v) / F.size(rel))


def overall() -> Column:
    return clamp01(sum((F.lit(w) * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0)))


def zip_pages(original: DataFrame, rebuilt: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """Pages side by side up to the shorter document; a missing source page gives an error row."""
    last = rebuilt.groupBy(*keys).agg(F.max(page).alias("__last"))
    d = original.join(last, keys).filter(F.col(page) <= F.col("__last")).drop("__last")
    d = d.join(rebuilt, [*keys, page], "left")
    return d.withColumn("error", F.when(F.col("image").isNull(), "source_image_missing"))


def aggregate(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each metric over the pages without an error, to four decimals half-even, and page counts."""
    mean = lambda c: F.bround(F.avg(c).cast("decimal(20,10)"), 4).cast("double")
    return pages.groupBy(*keys).agg(F.count("overall").alias("pages_compared"), F.count(F.lit(1)).alias("pages_total"), *[F.coalesce(mean(m), F.lit(0.0)).alias(m) for m in METRICS])


def audit(records: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of style differences between what was asked and what was drawn."""
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if("fallback").alias("font_fallbacks"),
        F.count_if(F.abs(F.col("size_used") - F.col("size_wanted")) > 0.5).alias("size_changes"),
        F.count_if(~F.col("color_used").eqNullSafe(F.col("color_wanted"))).alias("color_changes"),
        F.count_if(~F.col("align_used").eqNullSafe(F.col("align_wanted"))).alias("alignment_changes"),
    )
