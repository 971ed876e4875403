"""Filtering, deduplication and decomposition of prime awards and subawards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions.scalar import contains_count, fiscal_year

# Product codes of hardware.
HARDWARE_CODES = ["7010", "7020", "7021", "7025", "7035", "5895", "5998"]

# Words of hardware and of services, matched as substrings of lower-cased text.
HARDWARE_WORDS = [
    "desktop", "laptop", "computer", "workstation", "pc", "personal computer", "printer", "monitor", "keyboard", "mouse", "display", "server hardware", "rack mount",
    "blade server", "physical server", "network switch", "router", "firewall appliance", "firewall hardware", "storage array", "disk drive", "hard drive", "tape backup",
    "equipment procurement", "hardware refresh", "hardware upgrade", "ups", "uninterruptible power", "power supply",
]
SERVICE_WORDS = [
    "cloud", "aws", "azure", "google cloud", "gcp", "oracle cloud", "iaas", "paas", "saas", "cloud migration", "cloud hosting", "serverless", "lambda", "elastic compute",
    "ec2", "s3", "software", "application", "platform", "database", "software license", "software development", "custom software", "software as a service", "erp", "crm",
    "enterprise software", "consulting", "integration", "managed services", "support services", "implementation", "maintenance", "technical support", "help desk",
    "development services", "engineering services", "professional services", "cybersecurity services", "security operations", "security services", "devops", "devsecops",
    "agile development", "systems integration",
]


def keyword_class(df: DataFrame, text: str = "description", hardware: list[str] = HARDWARE_WORDS, services: list[str] = SERVICE_WORDS, out: str = "keyword_class") -> DataFrame:
    """hardware (two words or more, no service), service, hardware_weak or unknown."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hw, sv = contains_count(low, hardware), contains_count(low, services)
    return df.withColumn(out, F.when((hw >= 2) & (sv == 0), "hardware").when(sv > 0, "service").when(hw > 0, "hardware_weak").otherwise("unknown"))


def filter_primes(df: DataFrame, year_min: int, year_max: int, code: str = "psc_code", deny: list[str] = HARDWARE_CODES) -> DataFrame:
    """Awards of the years, whose product code isn't denied and whose words aren't hardware's. A null code stays."""
    kept = keyword_class(df.filter(F.year("effective_date").between(year_min, year_max)))
    return kept.filter(~F.coalesce(F.substring(code, 1, 4).isin(deny), F.lit(False))).filter("keyword_class <> 'hardware'")


def filter_funnel(df: DataFrame, steps: list[tuple[str, object]]) -> DataFrame:
    """(step, name, n, dollars): rows and dollars that pass all conditions up to each step, in one scan."""
    passed, exprs = F.lit(True), []
    for i, (_, condition) in enumerate(steps):
        passed = passed & F.coalesce(condition, F.lit(False))
        exprs += [F.sum(passed.cast("long")).alias(f"n{i}"), F.sum(F.when(passed, F.col("dollars")).otherwise(0.0)).alias(f"d{i}")]
    one = df.agg(*exprs)
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("dollars")) for i, (name, _) in enumerate(steps)])
    return one.select(F.inline(rows))


def dedupe_awards(df: DataFrame, key: str = "award_id", order: str = "_ord", longest: tuple[str, ...] = ("description",), first: tuple[str, ...] = (), dollars_agg: str = "max") -> DataFrame:
    """One row per award: dollars by max or sum, latest date, longest text (first on ties), first known value of other columns."""
    d = df.filter(F.col(key).isNotNull())
    agg = [(F.max if dollars_agg == "max" else F.sum)("dollars").alias("dollars"), F.max("effective_date").alias("effective_date")]
    agg += [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.length(c), -F.col(order)))).alias(c) for c in longest]
    agg += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    return d.groupBy(key).agg(*agg).withColumn("fiscal_year", fiscal_year("effective_date"))


def prefix_candidates(subs: DataFrame, primes: DataFrame, key: str = "award_id", sub_key: str = "subaward_id") -> DataFrame:
    """(sub_key, priority, prime_id): for each distinct id its prefixes that can be a prime's id, the first to take lowest.

    A prefix of as many parts as no prime's id has is none: the first parts are alike in most ids, and would meet in one task."""
    parts = F.split(F.col(sub_key), "_")
    n = F.size(parts)
    candidates = F.when(
        n >= 2,
        F.concat(
            F.when((n >= 6) & F.array_contains("_sizes", 6), F.array(F.struct(F.lit(0).alias("priority"), F.array_join(F.slice(parts, 1, 6), "_").alias("prime_id")))).otherwise(F.array()),
            F.transform(
                F.filter(F.sequence(F.lit(2), n), lambda k: F.array_contains("_sizes", k) & ((n < 6) | (k != 6))),
                lambda k: F.struct((n - k + 1).alias("priority"), F.array_join(F.slice(parts, F.lit(1), k), "_").alias("prime_id")),
            ),
        ),
    )
    sizes = primes.filter(F.col(key).isNotNull()).agg(F.collect_set(F.size(F.split(key, "_"))).alias("_sizes"))
    return subs.select(sub_key).distinct().crossJoin(F.broadcast(sizes)).select(sub_key, F.inline(candidates))


def link_subawards(subs: DataFrame, primes: DataFrame, key: str = "award_id", sub_key: str = "subaward_id") -> DataFrame:
    """Adds prime_id: the six-part prefix of the subaward's id if it is a prime, else the longest prefix of two parts or more."""
    ids = primes.select(F.col(key).alias("prime_id")).filter("prime_id is not null")
    # candidates are sought once for each distinct id; the semi-join's sides are plain shuffles, so that Spark can split a frequent prefix
    found = prefix_candidates(subs, primes, key, sub_key).join(ids, "prime_id", "left_semi").groupBy(sub_key).agg(F.min_by("prime_id", "priority").alias("prime_id"))
    return subs.join(found, sub_key, "left")


def merge_awards(primes: DataFrame, linked: DataFrame) -> DataFrame:
    """Primes without subawards as they are; else what the prime retains, and its subawards, scaled down where they exceed it.

    Dollars are conserved for each prime with a known amount. A retained part of a cent or less is left out.
    """
    subs = linked.filter("prime_id is not null").withColumn("sub_dollars", F.col("dollars"))
    totals = subs.groupBy("prime_id").agg(F.coalesce(F.sum("dollars"), F.lit(0.0)).alias("sub_total"))
    p = primes.withColumn("entity", F.coalesce("parent_uei", "uei")).withColumn("fiscal_year", fiscal_year("effective_date"))
    t = p.join(totals, p.award_id == totals.prime_id, "left")
    scale = F.when((F.col("sub_total") > F.col("dollars")) & (F.col("sub_total") > 0), F.col("dollars") / F.col("sub_total")).otherwise(F.lit(1.0))
    none = t.filter("prime_id is null").select("entity", "contractor_name", "dollars", "description", F.lit("prime_no_subs").alias("record_type"), "award_id", "fiscal_year", F.lit(None).cast("string").alias("prime_contractor"))
    has = t.filter("prime_id is not null")
    kept = has.withColumn("kept", F.when(scale < 1, F.lit(0.0)).otherwise(F.col("dollars") - F.col("sub_total"))).filter((F.col("kept") > 0.01) & ~F.isnan("kept"))
    kept = kept.select("entity", "contractor_name", F.col("kept").alias("dollars"), "description", F.lit("prime_retained").alias("record_type"), "award_id", "fiscal_year", F.lit(None).cast("string").alias("prime_contractor"))
    parents = has.select("award_id", "entity", "contractor_name", "fiscal_year", scale.alias("scale"), F.col("description").alias("prime_description"))
    sub_rows = subs.join(parents, subs.prime_id == parents.award_id).select(
        F.coalesce("sub_uei", "sub_name").alias("entity"), F.col("sub_name").alias("contractor_name"), (F.coalesce("sub_dollars", F.lit(0.0)) * F.col("scale")).alias("dollars"),
        F.coalesce(subs["description"], F.col("prime_description")).alias("description"), F.lit("subcontract").alias("record_type"), "award_id", "fiscal_year", parents["entity"].alias("prime_contractor"),
    )
    return none.unionByName(kept).unionByName(sub_rows).withColumnRenamed("entity", "contractor").withColumnRenamed("award_id", "original_prime_id")


def dollar_integrity(merged: DataFrame, primes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(merged_dollars, prime_dollars, ok)."""
    a = merged.agg(F.coalesce(F.sum("dollars"), F.lit(0.0)).alias("merged_dollars"))
    b = primes.agg(F.coalesce(F.sum("dollars"), F.lit(0.0)).alias("prime_dollars"))
    return a.crossJoin(b).withColumn("ok", F.abs(F.col("merged_dollars") - F.col("prime_dollars")) < tolerance)
