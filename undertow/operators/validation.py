"""Samples for review, and agreement among raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def krippendorff_alpha(ratings: DataFrame, unit: str = "unit_id", label: str = "label") -> DataFrame:
    """(alpha, n_units, n_values): nominal alpha over units with two ratings or more; missing ratings are absent rows."""
    cells = ratings.filter(F.col(label).isNotNull() & F.col(unit).isNotNull()).groupBy(unit, label).agg(F.count("*").alias("c"))
    by_unit = Window.partitionBy(unit)
    cells = cells.withColumn("m", F.sum("c").over(by_unit)).filter("m >= 2")
    units = cells.groupBy(unit).agg(F.max("m").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    a = units.agg(F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("disagree"), F.count("*").alias("n_units"), F.sum("m").alias("n_values"))
    b = cells.groupBy(label).agg(F.sum("c").alias("n_c")).agg(F.sum(F.col("n_c") * F.col("n_c")).alias("labels_sq"))
    n = F.col("n_values")
    return a.crossJoin(F.broadcast(b)).select((1 - F.try_divide((n - 1) * F.col("disagree"), n * n - F.col("labels_sq"))).alias("alpha"), "n_units", "n_values")


def pairwise_agreement(ratings: DataFrame, unit: str = "unit_id", rater: str = "rater", label: str = "label") -> DataFrame:
    """(rater_a, rater_b, n, agreement) over the units that both rated."""
    a = ratings.select(unit, F.col(rater).alias("rater_a"), F.col(label).alias("label_a"))
    b = ratings.select(unit, F.col(rater).alias("rater_b"), F.col(label).alias("label_b"))
    j = a.join(b, unit).filter("rater_a < rater_b")
    return j.groupBy("rater_a", "rater_b").agg(F.count("*").alias("n"), F.avg((F.col("label_a") == F.col("label_b")).cast("double")).alias("agreement"))


def label_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(both, only_a, only_b, neither, rate) of two boolean labels."""
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    return df.agg(n(x & y).alias("both"), n(x & ~y).alias("only_a"), n(~x & y).alias("only_b"), n(~x & ~y).alias("neither"), F.avg((x == y).cast("double")).alias("rate"))


def hash_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows in the order of a hash of (seed, key): the same rows in any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def weighted_sample(df: DataFrame, n: int, key: str, weight: Column, seed: int) -> DataFrame:
    """n rows without replacement, by the keys -ln(u) / w of their hashes."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return df.withColumn("_w", weight).filter("_w > 0").orderBy(-F.log(u) / F.col("_w"), key).limit(n).drop("_w")


def stratified_sample(df: DataFrame, strata: list[tuple[str, Column, int]], key: str, seed: int) -> DataFrame:
    """Rows with their stratum; each stratum draws from rows that no earlier one has drawn, and the draw is small by its sizes."""
    out = None
    for i, (name, condition, n) in enumerate(strata):
        pool = df.filter(F.coalesce(condition, F.lit(False)))
        if out is not None:
            pool = pool.join(out.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
        one = hash_sample(pool, n, key, seed + i).withColumn("stratum", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def prompt_comparison(df: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """(prompt, false_negatives, false_positives), and how often both differ."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    t, x, y = F.col(truth), F.col(a), F.col(b)
    one = df.agg(n(t & ~x).alias("fa"), n(~t & x).alias("pa"), n(t & ~y).alias("fb"), n(~t & y).alias("pb"), n(x != y).alias("d"))
    row = lambda name, f, p: F.struct(F.lit(name).alias("prompt"), F.col(f).alias("false_negatives"), F.col(p).alias("false_positives"), F.col("d").alias("disagreements"))
    return one.select(F.inline(F.array(row("a", "fa", "pa"), row("b", "fb", "pb"))))


def sample_grid(low: int, high: int, points: int) -> list[int]:
    """Sample sizes from low to high, evenly spaced by their logarithm, each once."""
    if points < 2:
        return [low]
    return sorted({round(low * (high / low) ** (i / (points - 1))) for i in range(points)})


def power_simulation(spark: SparkSession, alphas: list[float], sizes: list[int], n_categories: int, n_sims: int, seed: int, level: float = 0.95) -> DataFrame:
    """(true_alpha, n_items, mean, low, high, n_defined): nominal alpha of two simulated raters.

    They agree with probability true_alpha and else rate independently. Draws are hashes of (seed, alpha, size, run, item), so
    they don't depend on the partitioning; a run is a few counts after partial aggregation. A run whose values are all in one
    category has no alpha and is left out.
    """
    grid = spark.createDataFrame([(float(a), int(n)) for a in alphas for n in sizes], "true_alpha double, n_items int")
    runs = grid.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))
    items = runs.repartition("true_alpha", "n_items", "run").withColumn("item", F.explode(F.sequence(F.lit(1), F.col("n_items"))))

    def draw(what: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "true_alpha", "n_items", "run", "item", F.lit(what)), F.lit(1 << 52)) / F.lit(float(1 << 52))

    pick = lambda what: F.floor(draw(what) * n_categories).cast("int")
    items = items.withColumn("a", pick(1)).withColumn("b", F.when(draw(0) < F.col("true_alpha"), F.col("a")).otherwise(pick(2)))
    counts = [F.sum((F.col("a") == c).cast("long") + (F.col("b") == c).cast("long")).alias(f"c{c}") for c in range(n_categories)]
    by_run = items.groupBy("true_alpha", "n_items", "run").agg(F.sum((F.col("a") != F.col("b")).cast("long")).alias("differ"), *counts)
    n, same = 2 * F.col("n_items"), sum((F.col(f"c{c}") * F.col(f"c{c}") for c in range(n_categories)), F.lit(0))
    alpha = by_run.withColumn("alpha", 1 - F.try_divide((n - 1) * 2.0 * F.col("differ"), n * n - same))
    tail = (1 - level) / 2
    return alpha.groupBy("true_alpha", "n_items").agg(
        F.avg("alpha").alias("mean"), F.percentile("alpha", F.lit(tail)).alias("low"), F.percentile("alpha", F.lit(1 - tail)).alias("high"), F.count("alpha").alias("n_defined")
    )
