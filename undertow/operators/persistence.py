"""Year-to-year persistence of suppliers, with resampling inference."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach_buyer(records: DataFrame, primes: DataFrame) -> DataFrame:
    """Adds buyer, department | office, by prime id; rows without an office have none."""
    b = primes.select(F.col("award_id").alias("_id"), F.concat(F.coalesce("department", F.lit("")), F.lit(" | "), F.col("office")).alias("buyer")).dropDuplicates(["_id"])
    return records.join(b, records.original_prime_id == b["_id"], "left").drop("_id")


def retention(records: DataFrame, key: str, buyer: str = "buyer", year: str = "fiscal_year") -> DataFrame:
    """(buyer, at_risk, retained): supplier-years whose buyer buys next year, and those where the supplier is there next year."""
    cells = records.filter(F.col(buyer).isNotNull() & F.col(key).isNotNull() & F.col(year).isNotNull()).select(buyer, year, key).distinct()
    active = cells.select(buyer, (F.col(year) - 1).alias(year)).distinct().withColumn("_active", F.lit(True))
    following = F.lead(year).over(Window.partitionBy(buyer, key).orderBy(year)) == F.col(year) + 1
    marked = cells.withColumn("_stays", F.coalesce(following, F.lit(False))).join(active, [buyer, year], "left")
    risk = F.coalesce(F.col("_active"), F.lit(False))
    return marked.groupBy(buyer).agg(F.sum(risk.cast("long")).alias("at_risk"), F.sum((risk & F.col("_stays")).cast("long")).alias("retained"))


def persistence(records: DataFrame, naive: str, unclouded: str) -> DataFrame:
    """(c_naive, c_unclouded, ratio, n_buyers): pooled retention in both views."""
    a = retention(records, naive).select("buyer", F.col("at_risk").alias("na"), F.col("retained").alias("nr"))
    b = retention(records, unclouded).select("buyer", F.col("at_risk").alias("ua"), F.col("retained").alias("ur"))
    j = a.join(b, "buyer").filter("na > 0 and ua > 0")
    t = j.agg(F.try_divide(F.sum("nr"), F.sum("na")).alias("c_naive"), F.try_divide(F.sum("ur"), F.sum("ua")).alias("c_unclouded"), F.count("*").alias("n_buyers"))
    return t.withColumn("ratio", F.try_divide("c_unclouded", "c_naive"))


def bca_interval(estimate: float, draws: np.ndarray, jackknife: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated bootstrap interval."""
    normal, n = NormalDist(), len(draws)
    share = float((draws < estimate).mean() + (draws == estimate).mean() / 2)
    z0 = normal.inv_cdf(min(max(share, 1 / n), 1 - 1 / n))
    gap = jackknife.mean() - jackknife
    square = float((gap**2).sum())
    acceleration = float((gap**3).sum()) / (6 * square**1.5) if square > 0 else 0.0
    ends = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal.inv_cdf(p)
        ends.append(100 * normal.cdf(z0 + z / (1 - acceleration * z)))
    low, high = np.percentile(draws, ends)
    return float(low), float(high)


def bootstrap_persistence(counts: DataFrame, n_boot: int, seed: int, blocks: int = 16) -> DataFrame:
    """(draw, c_naive, c_unclouded, ratio): buyers resampled with Poisson(1) weights, both views with the same weights.

    counts: (buyer, na, nr, ua, ur). Weights come from a hash of (seed, draw, buyer), so the draws are the same in any
    partitioning; nothing is gathered but sums by draw.
    """
    # inverse of the Poisson(1) distribution function at a uniform hash
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", "buyer"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    steps, total, term = [], 0.0, float(np.exp(-1))
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    w = F.lit(0)
    for s in steps:
        w = w + (u >= s).cast("int")
    grid = counts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("w", w).filter("w > 0")
    sums = grid.groupBy("draw").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("na", "nr", "ua", "ur")])
    out = sums.select("draw", F.try_divide("nr", "na").alias("c_naive"), F.try_divide("ur", "ua").alias("c_unclouded"))
    return out.withColumn("ratio", F.try_divide("c_unclouded", "c_naive"))


def shuffle_within_year(records: DataFrame, key: str, seed: int, year: str = "fiscal_year", order: str = "record_id") -> DataFrame:
    """The records with their keys dealt anew within each year, by the order of a hash of (seed, record)."""
    a = records.withColumn("_n", F.row_number().over(Window.partitionBy(year).orderBy(order)))
    b = records.select(F.col(year).alias("_y"), F.col(key).alias("_k"), F.row_number().over(Window.partitionBy(year).orderBy(F.xxhash64(F.lit(seed), order), order)).alias("_m"))
    return a.join(b, (a[year] == b["_y"]) & (a["_n"] == b["_m"])).drop("_y", "_m", "_n").withColumn(key, F.col("_k")).drop("_k")


def bootstrap_hhi(cells: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(draw, hhi) from (award, key, dollars): awards resampled by Poisson weights, all their rows carried."""
    base = cells.select(F.col("award").alias("buyer"), "key", "dollars").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", "buyer"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    steps, total, term = [], 0.0, float(np.exp(-1))
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    w = F.lit(0)
    for s in steps:
        w = w + (u >= s).cast("int")
    t = base.withColumn("w", w).filter("w > 0").groupBy("draw", "key").agg(F.sum(F.col("dollars") * F.col("w")).alias("t"))
    return t.groupBy("draw").agg(F.try_divide(F.sum(F.col("t") * F.col("t")) * 10000, F.pow(F.sum("t"), F.lit(2))).alias("hhi"))


