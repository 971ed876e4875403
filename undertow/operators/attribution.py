"""Text classification, label synthesis and attribution of records to platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions.scalar import any_pattern, pattern_count

# Platforms, in order.
PLATFORMS = ["AWS", "Azure", "Google Cloud", "Oracle Cloud", "IBM Cloud", "Salesforce", "ServiceNow", "Workday"]

# Explicit mentions of a provider.
EXPLICIT = {
    "AWS": [r"\bAWS\b", r"Amazon\s+Web\s+Services", r"Amazon\s+Cloud"],
    "Azure": [r"\bAzure\b", r"Microsoft\s+Azure", r"\bMS\s+Azure\b"],
    "Google Cloud": [r"\bGoogle\s+Cloud\b", r"\bGCP\b", r"Google\s+Cloud\s+Platform"],
}

# Company names of platforms, upper case.
ENTITY_NAMES = {
    "AWS": ["AMAZON WEB SERVICES, INC.", "AMAZON WEB SERVICES LLC", "AMAZON WEB SERVICES INC.", "AMAZON WEB SERVICES INC", "AMAZON.COM SERVICES LLC", "AMAZON.COM, INC."],
    "Azure": ["MICROSOFT CORPORATION", "MICROSOFT CORP.", "MICROSOFT CORP"],
    "Google Cloud": ["GOOGLE LLC", "GOOGLE INC.", "ALPHABET INC."],
    "Salesforce": ["SALESFORCE.COM, INC.", "SALESFORCE, INC.", "SALESFORCE.COM INC.", "SALESFORCE INC.", "SALESFORCE.COM, INC"],
    "Oracle Cloud": ["ORACLE AMERICA, INC.", "ORACLE CORPORATION", "ORACLE AMERICA INC."],
    "IBM Cloud": ["IBM CORPORATION", "INTERNATIONAL BUSINESS MACHINES CORPORATION", "IBM CORP."],
    "ServiceNow": ["SERVICENOW, INC.", "SERVICENOW INC.", "SERVICENOW INC"],
    "Workday": ["WORKDAY, INC.", "WORKDAY INC.", "WORKDAY INC"],
}
# Words of contractor names.
ENTITY_WORDS = {
    "AWS": ["amazon", "aws", "amazon web services"],
    "Azure": ["microsoft", "azure"],
    "Google Cloud": ["google", "alphabet"],
    "Oracle Cloud": ["oracle"],
    "IBM Cloud": ["ibm", "international business machines"],
    "Salesforce": ["salesforce"],
    "ServiceNow": ["servicenow"],
    "Workday": ["workday"],
}

NOT_A_PLATFORM = ["Unspecified", "N/A", "Multi-cloud"]


def regex_classify(df: DataFrame, bank: dict[str, list[str]], generic: list[str], explicit: dict[str, list[str]] = EXPLICIT, multi: str = "Multi-cloud", text: str = "description", name: str = "contractor_name") -> DataFrame:
    """Adds regex_is_cloud, regex_platforms, regex_platforms_list, regex_confidence and the explicit mentions.

    bank: patterns by platform, a bag each: hits are counted, an explicit mention counts two more. Distinct texts are judged
    once and joined back, so a text that many records share costs one pass over the bank.
    """
    d = F.lower(F.coalesce(F.col("_text"), F.lit("")))
    n = F.lower(F.coalesce(F.col("_name"), F.lit("")))
    keys = df.select(F.col(text).alias("_text"), F.col(name).alias("_name")).distinct()
    order = [*bank, *[p for p in explicit if p not in bank]]
    said = {p: any_pattern(d, ps) | any_pattern(n, ps) for p, ps in explicit.items()}
    keys = keys.select("_text", "_name", *[pattern_count(d, bank.get(p, [])).alias(f"h{i}") for i, p in enumerate(order)], *[said[p].alias(f"e{i}") for i, p in enumerate(explicit)], any_pattern(d, generic).alias("_generic"))
    mention = {p: f"e{i}" for i, p in enumerate(explicit)}
    score = [F.col(f"h{i}") + (F.when(F.col(mention[p]), 2).otherwise(0) if p in mention else 0) for i, p in enumerate(order)]
    concrete = [(p, s) for p, s in zip(order, score, strict=True) if p != multi]
    hits = F.filter(F.array(*[F.struct(F.lit(p).alias("p"), s.cast("int").alias("s")) for p, s in concrete]), lambda x: x["s"] > 0)
    multi_hit = next((s > 0 for p, s in zip(order, score, strict=True) if p == multi), F.lit(False))
    any_hit = F.lit(False)
    for i in range(len(order)):
        any_hit = any_hit | (F.col(f"h{i}") > 0)
    explicit_list = F.filter(F.array(*[F.when(F.col(c), F.lit(p)) for p, c in mention.items()]), lambda x: x.isNotNull()) if mention else F.array().cast("array<string>")
    keys = keys.withColumn("_hits", hits).withColumn("_multi", multi_hit)
    size, top = F.size("_hits"), F.get(F.col("_hits"), F.lit(0))
    judged = keys.select(
        "_text", "_name",
        explicit_list.alias("explicit_hyperscaler_mentions"),
        (F.size(explicit_list) > 0).alias("explicit_cloud_mention"),
        ((F.size(explicit_list) > 0) | F.col("_generic") | any_hit).alias("regex_is_cloud"),
        F.when(size >= 2, multi).when(size == 1, top["p"]).when(F.col("_multi"), multi).alias("regex_platforms"),
        F.transform("_hits", lambda x: x["p"]).alias("regex_platforms_list"),
        F.when(size >= 2, "Medium").when((size == 1) & (top["s"] >= 3), "High").when((size == 1) & (top["s"] >= 2), "Medium").otherwise("Low").alias("regex_confidence"),
    )
    return df.join(judged, df[text].eqNullSafe(judged["_text"]) & df[name].eqNullSafe(judged["_name"]), "left").drop("_text", "_name")


def parse_label(text: str | Column) -> Column:
    """A model's answer as (classification, platform, confidence, evidence): JSON within optional fences, else what can be found."""
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    raw = F.trim(F.regexp_replace(raw, r"^```[a-zA-Z]*\s*|\s*```$", ""))
    j = F.from_json(raw, "classification string, platform string, confidence string, evidence string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    broken = j.isNull() | j["_corrupt_record"].isNotNull()
    kinds = ["non-cloud", "cloud-dependent", "cloud-infrastructure"]
    kind = F.when(j["classification"].isin(kinds), j["classification"]).otherwise("error")
    up = F.upper(j["platform"])
    has = lambda *words: F.coalesce(up.rlike("|".join(words)), F.lit(False))
    platform = (
        F.when(j["platform"].isin([*PLATFORMS, *NOT_A_PLATFORM]), j["platform"])
        .when(has("AWS", "AMAZON"), "AWS").when(has("AZURE", "MICROSOFT"), "Azure").when(has("GOOGLE", "GCP"), "Google Cloud").when(has("ORACLE"), "Oracle Cloud").when(has("IBM"), "IBM Cloud")
        .when(has("SERVICENOW", "SERVICE NOW"), "ServiceNow").when(has("WORKDAY"), "Workday").when(has("SALESFORCE"), "Salesforce")
        .when(F.coalesce(F.lower(j["platform"]), F.lit("")).isin("", "null", "none"), F.when(kind == "non-cloud", "N/A").otherwise("Unspecified"))
        .otherwise("Unspecified")
    )
    found = lambda p: F.nullif(F.regexp_extract(raw, p, 1), F.lit(""))
    rough = F.struct(
        F.coalesce(found(r'"classification"\s*:\s*"(non-cloud|cloud-dependent|cloud-infrastructure)"'), F.lit("error")).alias("classification"),
        F.coalesce(found(r'"platform"\s*:\s*"([^"]+)"'), F.lit("error")).alias("platform"), F.lit("low").alias("confidence"), F.lit("parse_error").alias("evidence"),
    )
    clean = F.struct(
        kind.alias("classification"), platform.alias("platform"), F.when(j["confidence"].isin("high", "medium", "low"), j["confidence"]).otherwise("low").alias("confidence"),
        F.substring(F.coalesce(j["evidence"], F.lit("")), 1, 200).alias("evidence"),
    )
    return F.when(broken, rough).otherwise(clean)


def synthesize(df: DataFrame, conflict_mode: str = "explicit_override", override_confidence: str = "high") -> DataFrame:
    """Joins pattern and model labels of a record into is_cloud, classification, platform, confidence and source."""
    if conflict_mode not in ("explicit_override", "llm_strict"):
        raise ValueError("conflict_mode is explicit_override or llm_strict")
    rank = lambda c: F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)
    limit = {"low": 1, "medium": 2, "high": 3}.get(override_confidence, 3)
    rc, rp = F.coalesce(F.col("regex_is_cloud"), F.lit(False)), F.col("regex_platforms")
    lc, lp = F.col("llm_classification"), F.col("llm_platform")
    l_cloud = F.coalesce(lc.isin("cloud-dependent", "cloud-infrastructure"), F.lit(False))
    error = F.coalesce(lc == "error", F.lit(False))
    named = lp.isNotNull() & ~lp.isin("N/A", "error")
    row = lambda cloud, kind, plat, conf, src: F.struct(cloud.alias("is_cloud"), kind.alias("cloud_classification"), plat.alias("platform_stage1"), F.lit(conf).alias("classification_confidence") if isinstance(conf, str) else conf.alias("classification_confidence"), (F.lit(src) if isinstance(src, str) else src).alias("classification_source"))
    yes, no, infra, non, na = F.lit(True), F.lit(False), F.lit("cloud-infrastructure"), F.lit("non-cloud"), F.lit("N/A")
    agree = F.coalesce(rp.isNotNull() & (lp == rp), F.lit(False))
    specific = named & (lp != "Unspecified")
    override = F.coalesce(F.col("explicit_cloud_mention"), F.lit(False)) & (rank(F.col("llm_confidence")) < limit) & F.lit(conflict_mode == "explicit_override")
    s = (
        F.when(error, row(rc, F.when(rc, infra).otherwise(non), F.when(rc, F.coalesce(rp, F.lit("Unspecified"))).otherwise(na), "low", "regex_only_llm_error"))
        .when(rc & l_cloud, row(yes, lc, F.coalesce(F.when(named, lp), rp, F.lit("Unspecified")), F.when(agree, "high").otherwise("medium"), F.when(agree, "regex+llm_agree").when(specific, "llm_platform").otherwise("both_cloud_no_platform")))
        .when(l_cloud, row(yes, lc, F.coalesce(F.when(named, lp), F.lit("Unspecified")), "medium", "llm_only"))
        .when(~rc, row(no, non, na, "high", "both_noncloud"))
        .when(override, row(yes, infra, F.coalesce(rp, F.lit("Unspecified")), "medium", "conflict_resolved_cloud"))
        .otherwise(row(no, non, na, "low", "conflict_resolved_noncloud"))
    )
    mentions = F.array_union(F.coalesce("regex_platforms_list", F.array().cast("array<string>")), F.when(lp.isin(PLATFORMS), F.array(lp)).otherwise(F.array().cast("array<string>")))
    return df.withColumn("_s", s).select("*", "_s.*", mentions.alias("platform_mentions")).drop("_s")


def entity_platform(name: str | Column) -> Column:
    """The platform a contractor's name stands for: equal name, else contained name, else whole word."""
    up = F.upper(F.trim(F.col(name) if isinstance(name, str) else name))
    out = F
    for p, names in ENTITY_NAMES.items():
        out = out.when(up.isin(names), p)
    for p, names in ENTITY_NAMES.items():
        for x in names:
            out = out.when(F.contains(up, F.lit(x)), p)
    for p, words in ENTITY_WORDS.items():
        for w in words:
            out = out.when(up.rlike(rf"\b{w.upper()}\b"), p)
    return out


def learn_patterns(df: DataFrame, key: str = "contractor", platform: str = "platform", min_evidence: int = 5, threshold: float = 0.9, use_dollars: bool = False) -> DataFrame:
    """(contractor, learned_platform, share, evidence): the platform that most of a contractor's attributed records name."""
    d = df.filter(F.col(key).isNotNull() & F.col(platform).isNotNull() & (F.col("dollars") > 0))
    by = d.groupBy(key, platform).agg((F.sum("dollars") if use_dollars else F.count("*")).cast("double").alias("metric"))
    top = by.groupBy(key).agg(F.sum("metric").alias("evidence"), F.max("metric").alias("most"), F.min_by(platform, F.struct(-F.col("metric"), F.col(platform))).alias("learned_platform"))
    share = F.col("most") / F.col("evidence")
    return top.filter((F.col("evidence") >= min_evidence) & (share >= threshold)).select(key, "learned_platform", share.alias("share"), "evidence")


def attribute(df: DataFrame, min_evidence: int = 5, threshold: float = 0.9, entity: Column | None = None) -> DataFrame:
    """Three phases: the contractor's name, the description's platform, the contractor's pattern; then the final platform."""
    cloud = F.coalesce(F.col("is_cloud"), F.lit(False))
    name = F.coalesce("contractor_name", "contractor")
    d = df.withColumn("platform_phase1", F.when(cloud, entity if entity is not None else entity_platform("contractor_name")))
    d = d.withColumn("platform_phase2", F.when(cloud & F.col("platform_phase1").isNull() & ~F.coalesce(F.col("platform_stage1"), F.lit("N/A")).isin(NOT_A_PLATFORM), F.col("platform_stage1")))
    known = d.withColumn("platform", F.coalesce("platform_phase1", "platform_phase2")).filter(cloud & F.col("platform").isNotNull())
    learned = learn_patterns(known, min_evidence=min_evidence, threshold=threshold).select(F.col("contractor").alias("_c"), "learned_platform")
    d = d.join(learned, d.contractor == learned["_c"], "left").drop("_c")
    p1, p2, p3 = F.col("platform_phase1"), F.col("platform_phase2"), F.col("learned_platform")
    pick = lambda a, b, c, e, f: F.when(~cloud, a).when(p1.isNotNull(), b).when(p2.isNotNull(), c).when(p3.isNotNull(), e).otherwise(f)
    return d.select(
        "*",
        pick(name, p1, p2, p3, name).alias("final_platform"),
        pick(F.lit("non_cloud_contractor"), F.lit("phase1_direct"), F.lit("phase2_description"), F.lit("phase3_pattern"), F.lit("cloud_unattributed_contractor")).alias("attribution_method"),
        pick(F.lit("N/A"), F.lit("conclusive"), F.coalesce(F.col("classification_confidence"), F.lit("medium")), F.lit("pattern_inferred"), F.lit("unattributed")).alias("confidence"),
    )


def discovery_layers(df: DataFrame, layers: list[tuple[str, Column]], rest: str = "rest") -> DataFrame:
    """(layer, place, dollars): dollars by the first layer that flags a record."""
    names = [n for n, _ in layers] + [rest]
    first = F
    for n, c in layers:
        first = first.when(F.coalesce(c, F.lit(False)), n)
    got = df.withColumn("layer", first.otherwise(rest)).groupBy("layer").agg(F.sum("dollars").alias("dollars"))
    order = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("layer")) for i, n in enumerate(names)])
    return df.sparkSession.range(1).select(F.inline(order)).join(got, "layer", "left").na.fill(0.0, ["dollars"])


def overlay(base: DataFrame, retry: DataFrame, key: str, columns: list[str], error: str) -> DataFrame:
    """Rows whose `error` column says error are replaced by retried rows that don't; by key, never by position."""
    good = retry.filter(F.coalesce(F.col(error), F.lit("error")) != "error").select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = base.join(good, base[key] == good["_k"], "left")
    use = F.col("_k").isNotNull() & (F.coalesce(base[error], F.lit("error")) == "error")
    return j.select(*[(F.when(use, F.col(f"_{c}")).otherwise(base[c]).alias(c) if c in columns else base[c]) for c in base.columns])
