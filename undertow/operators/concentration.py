"""Market concentration: HHI, concentration ratios, Gini, rolling windows, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(df: DataFrame, key: str, by: tuple[str, ...] = (), dollars: str = "dollars", positive: bool = True) -> DataFrame:
    """Dollars and rows by key; rows without a key, and without positive dollars, don't count."""
    d = df.filter(F.col(key).isNotNull())
    d = d.filter(F.col(dollars) > 0) if positive else d
    return d.groupBy(*by, key).agg(F.sum(dollars).alias("dollars"), F.count("*").alias("n"))


def hhi_class(c: Column) -> Column:
    return F.when(c < 1500, "unconcentrated").when(c < 2500, "moderate").otherwise("high")


def concentration(df: DataFrame, key: str, by: tuple[str, ...] = (), dollars: str = "dollars", positive: bool = True) -> DataFrame:
    """By group: n, total, HHI and its class, C4, C10, Gini, equivalent firms. Ranks are taken over keys, not rows."""
    t = totals(df, key, by, dollars, positive)
    down = Window.partitionBy(*by).orderBy(F.desc("dollars"), key)
    up = Window.partitionBy(*by).orderBy("dollars", key)
    ranked = t.withColumn("rank", F.row_number().over(down)).withColumn("place", F.row_number().over(up))
    out = ranked.groupBy(*by).agg(
        F.count("*").alias("n_keys"),
        F.sum("dollars").alias("total"),
        F.sum(F.col("dollars") * F.col("dollars")).alias("_squares"),
        F.sum(F.when(F.col("rank") <= 4, F.col("dollars")).otherwise(0.0)).alias("_c4"),
        F.sum(F.when(F.col("rank") <= 10, F.col("dollars")).otherwise(0.0)).alias("_c10"),
        F.sum(F.col("place") * F.col("dollars")).alias("_ranked"),
    )
    hhi = F.try_divide(F.col("_squares") * 10000, F.col("total") * F.col("total"))
    n = F.col("n_keys")
    return out.select(
        *by, "n_keys", "total", hhi.alias("hhi"), hhi_class(hhi).alias("hhi_class"), F.try_divide(F.col("_c4") * 100, "total").alias("c4"), F.try_divide(F.col("_c10") * 100, "total").alias("c10"),
        (F.try_divide(2 * F.col("_ranked"), n * F.col("total")) - (n + 1) / n).alias("gini"), F.try_divide(F.lit(10000.0), hhi).alias("equivalent_firms"),
    )


def hhi(df: DataFrame, key: str, by: tuple[str, ...] = (), dollars: str = "dollars", positive: bool = True) -> DataFrame:
    """HHI alone: two partial aggregations and no sort."""
    t = totals(df, key, by, dollars, positive)
    return t.groupBy(*by).agg(F.sum("dollars").alias("total"), F.try_divide(F.sum(F.col("dollars") * F.col("dollars")) * 10000, F.pow(F.sum("dollars"), 2)).alias("hhi"))


def windows(df: DataFrame, first: int, last: int, width: int = 3, year: str = "fiscal_year") -> DataFrame:
    """Each record once for every window [start, start + width - 1] that it lies in."""
    starts = F.sequence(F.greatest(F.lit(first), F.col(year) - width + 1), F.least(F.lit(last), F.col(year)))
    inside = df.filter(F.col(year).between(first, last + width - 1))
    return inside.withColumn("window_start", F.explode(starts))


def rolling_hhi(df: DataFrame, keys: tuple[str, ...], first: int, last: int, width: int = 3) -> DataFrame:
    """By window, the HHI for each key, and the ratio of the last key's to the first's."""
    w = windows(df, first, last, width)
    out = None
    for k in keys:
        one = hhi(w, k, ("window_start",)).select("window_start", F.col("hhi").alias(f"hhi_{k}"))
        out = one if out is None else out.join(one, "window_start", "outer")
    return out.withColumn("ratio", F.try_divide(F.col(f"hhi_{keys[-1]}"), F.col(f"hhi_{keys[0]}")))


def expand_mentions(df: DataFrame, mentions: str = "platform_mentions", base: str = "final_platform", known: list[str] | None = None) -> DataFrame:
    """Each record once for every platform it mentions, its dollars in equal parts; without mentions, its base platform."""
    m = F.coalesce(F.col(mentions), F.array().cast("array<string>"))
    m = F.array_intersect(F.array(*[F.lit(k) for k in known]), m) if known else F.array_distinct(m)
    n = F.size(m)
    return (
        df.withColumn("_n", n)
        .withColumn("platform_for_analysis", F.explode(F.when(n > 0, m).otherwise(F.array(F.col(base)))))
        .withColumn("dollars_split", F.col("dollars") / F.greatest(F.col("_n"), F.lit(1)))
        .withColumn("split_method", F.when(F.col("_n") > 1, "multi_platform_split").when(F.col("_n") == 1, "single_mention").otherwise("base"))
        .drop("_n")
    )


def lorenz(df: DataFrame, key: str) -> DataFrame:
    """(key, dollars, key_share, dollar_share): cumulative shares, smallest first."""
    t = totals(df, key)
    w = Window.orderBy("dollars", key)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return t.select(key, "dollars", (F.row_number().over(w) / F.count("*").over(whole)).alias("key_share"), (F.sum("dollars").over(run) / F.sum("dollars").over(whole)).alias("dollar_share"))


def pivot_year(df: DataFrame, key: str, values: list[str], year: str = "fiscal_year") -> DataFrame:
    """Dollars in millions by year and key, with a total."""
    p = df.groupBy(year).pivot(key, values).agg(F.sum("dollars")).na.fill(0.0)
    cells = [F.col(f"`{v}`") / 1e6 for v in values]
    return p.select(year, *[c.alias(v) for c, v in zip(cells, values, strict=True)], sum(cells[1:], cells[0]).alias("Total"))


def sensitivity(df: DataFrame, known: list[str], key: str = "platform") -> DataFrame:
    """(scenario, hhi): as it is; known platforms alone; unattributed dollars allotted to known ones in proportion."""
    t = totals(df, key)
    is_known = F.col(key).isin(known)
    base = t.agg(F.sum("dollars").alias("all"), F.sum(F.when(is_known, F.col("dollars"))).alias("known"), F.sum(F.pow("dollars", F.lit(2))).alias("sq"), F.sum(F.when(is_known, F.pow("dollars", F.lit(2)))).alias("known_sq"))
    as_is = F.try_divide(F.col("sq") * 10000, F.pow("all", F.lit(2)))
    alone = F.try_divide(F.col("known_sq") * 10000, F.pow("known", F.lit(2)))
    row = lambda n, h: F.struct(F.lit(n).alias("scenario"), h.alias("hhi"))
    # shares stay as they are under proportional allotment
    return base.select(F.inline(F.array(row("as_is", as_is), row("known_only", alone), row("proportional", alone))))


def gap(df: DataFrame, naive: str, platform: str) -> DataFrame:
    """(naive_hhi, platform_hhi, gap)."""
    a = hhi(df, naive).select(F.col("hhi").alias("naive_hhi"))
    b = hhi(df, platform).select(F.col("hhi").alias("platform_hhi"))
    return a.crossJoin(b).withColumn("gap", F.try_divide("platform_hhi", "naive_hhi"))


def dependency_matrix(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.sum("dollars")).na.fill(0.0)


def hidden_concentration(df: DataFrame, naive: str, platform: str) -> DataFrame:
    """By provider, its share as a contractor and as a platform; change in percent, null where it is new."""
    a = totals(df, naive).select(F.col(naive).alias("provider"), F.col("dollars").alias("as_contractor"))
    b = totals(df, platform).select(F.col(platform).alias("provider"), F.col("dollars").alias("as_platform"))
    both = b.join(a, "provider", "left").na.fill(0.0, ["as_contractor"])
    return both.withColumn("change_pct", F.try_divide((F.col("as_platform") - F.col("as_contractor")) * 100, F.when(F.col("as_contractor") > 0, F.col("as_contractor"))))


def jackknife_hhi(df: DataFrame, key: str, award: str = "original_prime_id") -> DataFrame:
    """(award, hhi without it) in closed form: (sum T^2 - 2 sum T d + sum d^2) / (S - D)^2 over each award's cells."""
    cells = df.filter(F.col(key).isNotNull() & (F.col("dollars") > 0)).groupBy(award, key).agg(F.sum("dollars").alias("d"))
    keys = cells.groupBy(key).agg(F.sum("d").alias("t"))
    whole = keys.agg(F.sum("t").alias("s"), F.sum(F.col("t") * F.col("t")).alias("q"))
    own = cells.join(keys, key).groupBy(award).agg(F.sum("d").alias("dd"), F.sum(F.col("t") * F.col("d")).alias("cross"), F.sum(F.col("d") * F.col("d")).alias("sq"))
    return own.crossJoin(F.broadcast(whole)).select(award, F.try_divide((F.col("q") - 2 * F.col("cross") + F.col("sq")) * 10000, F.pow(F.col("s") - F.col("dd"), F.lit(2))).alias("hhi"))
