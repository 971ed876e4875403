"""The two views of attributed records, and the masks, recodes and summaries that reports take from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Methods that attribute a record to a platform.
ATTRIBUTED = ["phase1_direct", "phase2_description", "phase3_pattern"]


def view_keys(records: DataFrame, first: int, last: int, year: str = "fiscal_year") -> DataFrame:
    """Cloud records of the years with positive dollars: naive (the contractor), unclouded (the platform, where attributed) and key_source."""
    known = F.coalesce(F.col("attribution_method").isin(ATTRIBUTED), F.lit(False))
    kept = records.filter(F.coalesce("is_cloud", F.lit(False)) & (F.col("dollars") > 0) & F.col(year).between(first, last))
    return kept.select("*", F.col("contractor").alias("naive"), F.when(known, F.col("final_platform")).otherwise(F.col("contractor")).alias("unclouded"), F.when(known, "attributed").otherwise("contractor").alias("key_source"))


def name_contains(name: str | Column, words: list[str]) -> Column:
    """Whether the name holds any of the words, in any case; false for null."""
    up = F.upper(F.col(name) if isinstance(name, str) else name)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(up, F.lit(w.upper()))
    return F.coalesce(out, F.lit(False))


def recode(label: str | Column, changes: dict[str, str]) -> Column:
    """The label's replacement, or the label itself where there is none."""
    c = F.col(label) if isinstance(label, str) else label
    return F.coalesce(F.create_map(*[F.lit(x) for kv in changes.items() for x in kv])[c], c) if changes else c


def recode_from(label: Column, mask: Column, since: Column, becomes: str) -> Column:
    """The label, but `becomes` where the mask and the date condition hold."""
    return F.when(F.coalesce(mask & since, F.lit(False)), becomes).otherwise(label)


def rating_filter(ratings: DataFrame, raters: list[str] | None = None, confidence: list[str] | None = None, drop: list[str] | None = None, units: DataFrame | None = None) -> DataFrame:
    """Ratings by rater and confidence, without some labels, of some units; what is None doesn't filter. A null confidence is none of them."""
    out = ratings
    if raters is not None:
        out = out.filter(F.col("rater").isin(raters))
    if confidence is not None:
        out = out.filter(F.col("confidence").isin(confidence))
    if drop is not None:
        out = out.filter(~F.coalesce(F.col("label").isin(drop), F.lit(False)))
    return out if units is None else out.join(units.select("unit_id").distinct(), "unit_id", "left_semi")


def wide(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """(unit_id, a column by rater): of several labels the first in order."""
    return ratings.groupBy("unit_id").pivot("rater", raters).agg(F.min("label"))


def repeated(df: DataFrame, *columns: str) -> DataFrame:
    """(columns, n) of combinations that occur more than once."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def parent_lookup(pairs: DataFrame) -> DataFrame:
    """(uei, parent_uei): an id's first parent in order that isn't itself."""
    return pairs.filter("uei is not null and parent_uei is not null and uei <> parent_uei").groupBy("uei").agg(F.min("parent_uei").alias("parent_uei"))


def with_parent(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """The column's ids, by their parents where these are known."""
    p = parents.select(F.col("uei").alias("_uei"), F.col("parent_uei").alias("_parent"))
    return df.join(p, df[column] == p["_uei"], "left").withColumn(column, F.coalesce("_parent", column)).drop("_uei", "_parent")


def method_sums(records: DataFrame) -> DataFrame:
    """One row: cloud dollars, those of each method and of none, and the attributed share in percent."""
    d = F.when(F.coalesce("is_cloud", F.lit(False)), F.col("dollars"))
    of = lambda m: F.coalesce(F.sum(F.when(F.col("attribution_method") == m, d)), F.lit(0.0))
    named = F.coalesce(F.sum(F.when(F.col("attribution_method").isin(ATTRIBUTED), d)), F.lit(0.0))
    cloud = F.coalesce(F.sum(d), F.lit(0.0))
    return records.agg(cloud.alias("cloud"), *[of(m).alias(m) for m in ATTRIBUTED], (cloud - named).alias("unattributed"), F.try_divide(named * 100, cloud).alias("attributed_pct"))


def layer_table(records: DataFrame, known: list[str], key: str = "final_platform", layer: str = "cloud_classification") -> DataFrame:
    """By known platform and for Other: dollars of infrastructure and dependence, and their percents of the whole layer."""
    infra = F.sum(F.when(F.col(layer) == "cloud-infrastructure", F.col("dollars")))
    rest = F.sum(F.when(F.col(layer) == "cloud-dependent", F.col("dollars")))
    t = records.groupBy(F.when(F.col(key).isin(known), F.col(key)).otherwise("Other").alias("platform")).agg(F.coalesce(infra, F.lit(0.0)).alias("infrastructure"), F.coalesce(rest, F.lit(0.0)).alias("dependent"))
    # a row for each platform that is known, and one more
    whole = t.agg(F.sum("infrastructure").alias("_i"), F.sum("dependent").alias("_d"))
    return t.crossJoin(F.broadcast(whole)).select("*", F.try_divide(F.col("infrastructure") * 100, "_i").alias("infrastructure_pct"), F.try_divide(F.col("dependent") * 100, "_d").alias("dependent_pct")).drop("_i", "_d")


def year_profile(records: DataFrame, key: str = "contractor", year: str = "fiscal_year", top: int = 10) -> DataFrame:
    """By year: records, median dollars, keys, percent of dollars that the top keys hold, and the change of records in percent."""
    t = records.groupBy(year, key).agg(F.sum("dollars").alias("d"))
    w = Window.partitionBy(year).orderBy(F.desc("d"), key)
    share = t.withColumn("_r", F.row_number().over(w)).groupBy(year).agg(F.count(key).alias("n_keys"), F.try_divide(F.sum(F.when(F.col("_r") <= top, F.col("d"))) * 100, F.sum("d")).alias("top_pct"))
    n = records.groupBy(year).agg(F.count("*").alias("n"), F.median("dollars").alias("median"))
    before = n.select((F.col(year) + 1).alias(year), F.col("n").alias("_before"))
    return n.join(share, year).join(before, year, "left").withColumn("change_pct", F.try_divide((F.col("n") - F.col("_before")) * 100, "_before")).drop("_before")


def window_delta(shares: DataFrame, key: str, window: str, share: str) -> DataFrame:
    """(key, first, last, delta, emerging): the share in the earliest and latest window of all; emerging where there was none."""
    ends = shares.agg(F.min(window).alias("_a"), F.max(window).alias("_b"))
    s = shares.crossJoin(F.broadcast(ends)).groupBy(key).agg(F.sum(F.when(F.col(window) == F.col("_a"), F.col(share))).alias("first"), F.sum(F.when(F.col(window) == F.col("_b"), F.col(share))).alias("last"))
    first, last = F.coalesce("first", F.lit(0.0)), F.coalesce("last", F.lit(0.0))
    return s.select(key, first.alias("first"), last.alias("last"), (last - first).alias("delta"), ((first == 0) & (last > 0)).alias("emerging"))


def stacked(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds place (from 0) and start (the sum of what stands before) within each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w) - 1).withColumn("start", F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def at_rank(df: DataFrame, by: list[str], order: list, rank: int) -> DataFrame:
    """The row of each group that stands at the rank, from 1."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") == rank).drop("_r")


def evidence(records: DataFrame, key: str = "contractor") -> DataFrame:
    """(key, any_subcontract, any_cloud, years): what a contractor's records show."""
    return records.groupBy(key).agg(
        F.coalesce(F.bool_or(F.col("record_type") == "subcontract"), F.lit(False)).alias("any_subcontract"), F.coalesce(F.bool_or("is_cloud"), F.lit(False)).alias("any_cloud"), F.sort_array(F.collect_set("fiscal_year")).alias("years"),
    )


def label_conflicts(records: DataFrame) -> DataFrame:
    """(n, dollars): records with an explicit mention that the model calls non-cloud."""
    hit = F.coalesce(F.col("explicit_cloud_mention") & (F.col("llm_classification") == "non-cloud"), F.lit(False))
    return records.agg(F.sum(hit.cast("long")).alias("n"), F.coalesce(F.sum(F.when(hit, F.col("dollars"))), F.lit(0.0)).alias("dollars"))


def leave_one_out(counts: DataFrame) -> DataFrame:
    """(buyer, c_naive, c_unclouded, ratio) without that buyer, in closed form. counts: (buyer, na, nr, ua, ur)."""
    c = counts.filter("na > 0 and ua > 0")
    whole = c.agg(*[F.sum(x).alias(f"_{x}") for x in ("na", "nr", "ua", "ur")])
    less = lambda x: F.col(f"_{x}") - F.col(x)
    out = c.crossJoin(F.broadcast(whole)).select("buyer", F.try_divide(less("nr"), less("na")).alias("c_naive"), F.try_divide(less("ur"), less("ua")).alias("c_unclouded"))
    return out.withColumn("ratio", F.try_divide("c_unclouded", "c_naive"))
