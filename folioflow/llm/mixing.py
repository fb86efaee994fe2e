"""Mixing sources to target weights by entropy balancing.

Each document gets a rate in (0, cap). Rates maximise entropy relative to one copy of every
document under the constraint that a source's expected words meet its target. The convex dual has
one multiplier per source, the rate is the tilted exponential cap / (1 + (cap-1) exp(-l x)) with
x = words / scale, and Newton steps with a bracket solve it from (source, size) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, unstash, word_count

#: Id hashes are kept in so many parts, which salts are made of.
PARTS = 1 << 20
#: Terms of sums are rounded to this share of a word and summed exactly, so the order of tasks doesn't show.
QUANTUM = 1 << 30
#: Rows that one (source, salt) group may hold on average when a source has a third of all rows.
SALT_ROWS = 60_000
MAX_STEPS = 80
TOLERANCE_WORDS = 0.25
TOLERANCE_SHARE = 1e-9


def _rate(cap: float) -> Column:
    return F.lit(cap) / (1 + F.lit(cap - 1.0) * F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("l") * F.col("size") / F.col("scale")))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets from (source, no_source, source_size): weights repeat in source order (code points, null last).

    A target is weight * level, at most cap * source_size; the level makes the targets sum to
    share * all words. One row per source; sources are a registry, so ordering them takes one task.
    """
    order = W.orderBy("no_source", "source")
    pick = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(pick, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * cap
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    fill = W.orderBy("ratio", "no_source", "source")
    s = s.withColumn("ratio", limit / F.col("weight"))
    s = s.withColumn("goal", F.sum("source_size").over(every) * share)
    s = s.withColumn("capped_before", F.coalesce(F.sum(limit).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    level_here = (F.col("goal") - F.col("capped_before")) / F.col("weight_left")
    # In order of ratio, the first source that is not above its limit has the level; it falls from there on.
    s = s.withColumn("level", F.max(F.when(level_here <= F.col("ratio"), level_here)).over(every))
    target = F.when(F.col("level").isNull(), limit).otherwise(F.least(limit, F.col("weight") * F.col("level")))
    return s.select("source", "no_source", "source_size", "weight", target.alias("target"))


def _exact_sum(term: Column) -> Column:
    """Sum over m documents of a term each, to 1/QUANTUM, the same in any order."""
    whole = F.rint(term * QUANTUM).cast("decimal(28,0)") * F.col("m").cast("decimal(10,0)")
    return F.sum(whole.cast("decimal(38,0)")).cast("double") / QUANTUM


def solve(counts: DataFrame, targets: DataFrame, cap: float = 2.0, max_steps: int = MAX_STEPS) -> DataFrame:
    """Multiplier l and scale per source. counts: source, no_source, size, m (documents of that size).

    Raises if a source has not come within its tolerance of the target after max_steps.
    """
    key = ["source", "no_source"]
    words, m = F.col("size").cast("decimal(15,0)"), F.col("m").cast("decimal(10,0)")
    square = F.sum((m * words * words).cast("decimal(38,0)")).cast("double")
    plain = F.sum((m * words).cast("decimal(38,0)")).cast("double")
    scale = F.greatest(F.lit(1.0), square / F.greatest(F.lit(1.0), plain))
    state = targets.join(counts.groupBy(*key).agg(scale.alias("scale")), key)
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    no_bound = F.lit(float("inf"))
    state = stash(state.select(*key, "source_size", "target", "scale", F.when(full, F.lit(1e6)).otherwise(F.lit(0.0)).alias("l"), (-no_bound).alias("lo"), no_bound.alias("hi"), full.alias("done")), "mix-state")
    for _ in range(max_steps):
        if state.filter(~F.col("done")).isEmpty():
            return state
        live = state.filter(~F.col("done"))
        r, x = _rate(cap), F.col("size") / F.col("scale")
        sums = (
            counts.join(live, key)
            .groupBy(*key)
            .agg(
                _exact_sum(F.col("size") * r).alias("got"),
                _exact_sum(F.col("size") * x * r * (1 - r / cap)).alias("slope"),
            )
        )
        gap = F.col("got") - F.col("target")
        s = state.join(sums, key, "left")
        s = s.withColumn("lo", F.when(gap < 0, F.col("l")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("l")).otherwise(F.col("hi")))
        near = F.greatest(F.lit(TOLERANCE_WORDS), F.col("target") * TOLERANCE_SHARE)
        s = s.withColumn("done", F.col("done") | F.col("got").isNull() | (F.abs(gap) <= near))
        step = F.col("l") - gap / F.greatest(F.col("slope"), F.lit(1e-12))
        above, below = F.col("hi") == no_bound, F.col("lo") == -no_bound
        wide = F.when(above, F.greatest(F.lit(1.0), F.col("lo") * 4)).when(below, F.least(F.lit(-1.0), F.col("hi") * 4)).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = (step > F.col("lo")) & (step < F.col("hi")) & (F.abs(step - F.col("l")) <= 4 + F.abs(F.col("l")))
        s = s.withColumn("l", F.when(F.col("done"), F.col("l")).when(inside, step).otherwise(wide))
        new = stash(s.select(*state.columns), "mix-state")
        unstash(state)
        state = new
    if not state.filter(~F.col("done")).isEmpty():
        raise RuntimeError(f"sources have not met their targets after {max_steps} steps")
    return state


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
) -> DataFrame:
    """docs plus size, source_size, target, rate, copies, taken (= copies * size).

    Copies are whole, 0 to cap. In each (source, salt) the sizes are rounded from long to short and
    each rounding error is carried to the next size, so a source ends within a short document of its
    target times its number of salts; within a size the documents with the smallest hash of id, source and text get the
    extra copy, so reruns agree whatever the order of rows and tasks. Null texts have size 0, a null source is a source of its own, ordered last; repeated
    rows count each. Columns of docs with the names of the results are replaced.
    """
    size = word_count(F.col(text_col))
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "rate", "copies", "taken")]
    key = ["source", "no_source"]
    src = [F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(source_col).isNull().alias("no_source")]
    pick = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col), F.lit("mix"))

    raw = stash(docs.select(*src, size.alias("size"), pick.alias("pick")).groupBy("source", "no_source", "size", F.pmod("pick", F.lit(PARTS)).alias("part")).agg(F.count(F.lit(1)).alias("m")), "mix-raw")
    total = raw.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    salts = min(PARTS, max(1, -(-total // SALT_ROWS)))
    salt = F.pmod(F.col("part"), F.lit(salts))
    counts = stash(raw.groupBy(*key, "size").agg(F.sum("m").alias("m")), "mix-counts")
    targets = source_targets(counts.groupBy(*key).agg(F.sum(F.col("m") * F.col("size")).alias("source_size")), weights, share, float(cap))
    state = solve(counts, targets, float(cap))

    groups = raw.groupBy(*key, salt.alias("salt"), "size").agg(F.sum("m").alias("m"))
    groups = groups.join(state.select(*key, "source_size", "target", "scale", "l"), key).withColumn("rate", _rate(float(cap)))
    listed = groups.groupBy(*key, "salt", "source_size", "target").agg(F.sort_array(F.collect_list(F.struct("size", "m", "rate")), asc=False).alias("g"))
    # K(size) = nearest whole number of copies to m * rate plus the words owed by longer sizes.
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<bigint>").alias("k"))

    def carry(acc: Column, x: Column) -> Column:
        want = x["m"] * x["rate"]
        n = F.greatest(x["size"], F.lit(1)).cast("double")
        k = F.greatest(F.lit(0), F.least(x["m"] * cap, F.round(want + acc["owed"] / n).cast("bigint")))
        owed = F.when(x["size"] > 0, acc["owed"] + (want - k) * x["size"]).otherwise(acc["owed"])
        return F.struct(owed.alias("owed"), F.concat(acc["k"], F.array(k.cast("bigint"))).alias("k"))

    quota = (
        listed.withColumn("k", F.aggregate("g", start, carry)["k"])
        .select(*key, "salt", "source_size", "target", F.explode(F.arrays_zip("g", "k")).alias("z"))
        .select(*key, "salt", "source_size", "target", F.col("z.g.size").alias("size"), F.col("z.g.m").alias("m"), F.col("z.g.rate").alias("rate"), F.col("z.k").alias("k"))
    )
    quota = stash(quota, "mix-quota")
    unstash(raw, counts, state)

    tag = {"source": "__mix_source", "no_source": "__mix_null", "salt": "__mix_salt", "size": "size"}
    rows = docs.select(
        *own,
        src[0].alias("__mix_source"),
        src[1].alias("__mix_null"),
        F.pmod(F.pmod(pick, F.lit(PARTS)), F.lit(salts)).alias("__mix_salt"),
        size.alias("size"),
        pick.alias("__mix_pick"),
    )
    q = quota.select(*[F.col(a).alias(b) for a, b in tag.items()], "source_size", "target", "rate", F.col("m").alias("__mix_m"), F.col("k").alias("__mix_k"))
    # Dealt by the keys that the window below needs anyway: no further exchange, and nothing is broadcast.
    joined = rows.join(q.hint("merge"), list(tag.values()))
    nth = F.row_number().over(W.partitionBy(*tag.values()).orderBy("__mix_pick", F.col(id_col)))
    base = F.floor(F.col("__mix_k") / F.col("__mix_m"))
    copies = (base + (nth <= F.col("__mix_k") - base * F.col("__mix_m")).cast("long")).cast("long")
    return joined.withColumn("copies", copies).select(*own, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of docs with their own columns, whatever their names, each as often as the mix takes it."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    mixed = mix(whole, f"__row.`{id_col}`", f"__row.`{text_col}`", f"__row.`{source_col}`", **settings).filter("copies > 0")
    return mixed.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")
