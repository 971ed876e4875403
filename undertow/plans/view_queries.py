"""The view and report queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertow.operators import persistence as pe
from undertow.operators import views as vi
from undertow.plans.fixtures import PRIMES_SQL, RECORDS_SQL, primes, read, records
from undertow.plans.registry import RET, _buyers, _ret, query, rounded

METHOD = "CASE WHEN parent IN ('1', '2') THEN 'phase1_direct' WHEN contains(description, 'gear') THEN 'phase3_pattern' ELSE 'cloud_unattributed_contractor' END"
ATT = f"{RECORDS_SQL}, att AS (SELECT *, {METHOD} AS m, CASE WHEN contains(description, 'PROMO') THEN 'cloud-infrastructure' ELSE 'cloud-dependent' END AS layer FROM records)"


def _attributed(spark, sf):
    r = records(spark, sf).withColumnRenamed("platform", "final_platform")
    method = F.when(F.col("parent").isin("1", "2"), "phase1_direct").when(F.contains("description", F.lit("gear")), "phase3_pattern").otherwise("cloud_unattributed_contractor")
    return r.withColumn("attribution_method", method).withColumn("cloud_classification", F.when(F.contains("description", F.lit("PROMO")), "cloud-infrastructure").otherwise("cloud-dependent"))


@query(f"WITH {ATT} SELECT contractor AS naive, CASE WHEN m LIKE 'phase%' THEN platform ELSE contractor END AS unclouded, CASE WHEN m LIKE 'phase%' THEN 'attributed' ELSE 'contractor' END AS key_source, count(*) AS n, round(sum(dollars), 2) AS dollars "
       "FROM att WHERE is_cloud AND dollars > 0 AND fiscal_year BETWEEN 1993 AND 1996 GROUP BY 1, 2, 3")  # fmt: skip
def view_keys(spark, sf):
    v = vi.view_keys(_attributed(spark, sf), 1993, 1996)
    return rounded(v.groupBy("naive", "unclouded", "key_source").agg(F.count("*").alias("n"), F.sum("dollars").alias("dollars")), 2)


@query(f"WITH {ATT} SELECT round(sum(dollars) FILTER (is_cloud), 2) AS cloud, round(sum(dollars) FILTER (is_cloud AND m = 'phase1_direct'), 2) AS phase1_direct, 0.0::DOUBLE AS phase2_description, round(sum(dollars) FILTER (is_cloud AND m = 'phase3_pattern'), 2) AS phase3_pattern, "
       "round(sum(dollars) FILTER (is_cloud AND m NOT LIKE 'phase%'), 2) AS unattributed, round(sum(dollars) FILTER (is_cloud AND m LIKE 'phase%') * 100 / sum(dollars) FILTER (is_cloud), 2) AS attributed_pct FROM att")  # fmt: skip
def method_sums(spark, sf):
    return rounded(vi.method_sums(_attributed(spark, sf)), 2)


@query(f"WITH {ATT}, t AS (SELECT CASE WHEN platform IN ('Brand#11', 'Brand#12') THEN platform ELSE 'Other' END AS platform, sum(CASE WHEN layer = 'cloud-infrastructure' THEN dollars ELSE 0 END) AS i, sum(CASE WHEN layer = 'cloud-dependent' THEN dollars ELSE 0 END) AS d FROM att GROUP BY 1) "
       "SELECT platform, round(i, 2) AS infrastructure, round(d, 2) AS dependent, round(i * 100 / sum(i) OVER (), 2) AS infrastructure_pct, round(d * 100 / sum(d) OVER (), 2) AS dependent_pct FROM t")  # fmt: skip
def layer_table(spark, sf):
    return rounded(vi.layer_table(_attributed(spark, sf), ["Brand#11", "Brand#12"]), 2)


@query(f"WITH {RECORDS_SQL}, t AS (SELECT fiscal_year, contractor, sum(dollars) AS d FROM records GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY fiscal_year ORDER BY d DESC, contractor) AS k FROM t), "
       "s AS (SELECT fiscal_year, count(*) AS n_keys, sum(d) FILTER (k <= 10) * 100 / sum(d) AS top_pct FROM r GROUP BY 1), n AS (SELECT fiscal_year, count(*) AS n, median(dollars) AS median FROM records GROUP BY 1) "
       "SELECT n.fiscal_year, n.n, round(n.median, 2) AS median, n_keys, round(top_pct, 4) AS top_pct, round((n.n - b.n) * 100 / b.n, 4) AS change_pct FROM n JOIN s USING (fiscal_year) LEFT JOIN n b ON b.fiscal_year = n.fiscal_year - 1")  # fmt: skip
def year_profile(spark, sf):
    return rounded(vi.year_profile(records(spark, sf)), 4, median=2)


@query(f"WITH {RECORDS_SQL}, s AS (SELECT fiscal_year, platform, sum(dollars) * 100 / sum(sum(dollars)) OVER (PARTITION BY fiscal_year) AS p FROM records GROUP BY 1, 2), e AS (SELECT min(fiscal_year) AS a, max(fiscal_year) AS b FROM s) "
       "SELECT platform, round(x, 4) AS \"first\", round(y, 4) AS \"last\", round(y - x, 4) AS delta, x = 0 AND y > 0 AS emerging FROM (SELECT platform, coalesce(sum(p) FILTER (fiscal_year = a), 0) AS x, coalesce(sum(p) FILTER (fiscal_year = b), 0) AS y FROM s, e GROUP BY 1)")  # fmt: skip
def window_delta(spark, sf):
    t = records(spark, sf).groupBy("fiscal_year", "platform").agg(F.sum("dollars").alias("d"))
    whole = t.groupBy("fiscal_year").agg(F.sum("d").alias("all"))
    return rounded(vi.window_delta(t.join(whole, "fiscal_year").withColumn("p", F.col("d") * 100 / F.col("all")), "platform", "fiscal_year", "p"))


@query(f"WITH {RECORDS_SQL}, t AS (SELECT fiscal_year, platform, sum(dollars) AS d FROM records GROUP BY 1, 2) SELECT fiscal_year, platform, CAST(row_number() OVER w - 1 AS INTEGER) AS place, round(coalesce(sum(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS start "
       "FROM t WINDOW w AS (PARTITION BY fiscal_year ORDER BY platform)")  # fmt: skip
def stacked_bars(spark, sf):
    t = records(spark, sf).groupBy("fiscal_year", "platform").agg(F.sum("dollars").alias("d"))
    return rounded(vi.stacked(t, ["fiscal_year"], ["platform"], "d").drop("d"), 2)


@query(f"WITH {RECORDS_SQL}, t AS (SELECT fiscal_year, contractor, sum(dollars) AS d FROM records GROUP BY 1, 2) SELECT fiscal_year, contractor, round(d, 2) AS dollars FROM t QUALIFY row_number() OVER (PARTITION BY fiscal_year ORDER BY d DESC, contractor) = 3")
def third_contractor(spark, sf):
    t = records(spark, sf).groupBy("fiscal_year", "contractor").agg(F.sum("dollars").alias("dollars"))
    return rounded(vi.at_rank(t, ["fiscal_year"], [F.desc("dollars"), "contractor"], 3), 2)


@query(f"WITH {PRIMES_SQL}, p AS (SELECT uei, min(parent_uei) AS q FROM primes WHERE parent_uei <> uei GROUP BY 1) SELECT award_id, coalesce(q, uei) AS uei FROM primes LEFT JOIN p USING (uei)")
def parent_lookup(spark, sf):
    p = primes(spark, sf)
    return vi.with_parent(p.select("award_id", "uei"), "uei", vi.parent_lookup(p))


@query("WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label FROM labels) SELECT label AS label, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 1")
def label_recode(spark, sf):
    q = read(spark, sf, "labels").select(vi.recode(F.col("quality").cast("string"), {"1": "good", "0": "bad"}).alias("label"))
    return vi.repeated(q, "label")


@query("SELECT s_suppkey, contains(s_name, '01') OR contains(s_name, '7') AS hit, CASE WHEN contains(s_name, '7') AND s_nationkey >= 10 THEN 'Seven' ELSE 'Any' END AS label FROM supplier")
def name_masks(spark, sf):
    s = read(spark, sf, "supplier")
    return s.select("s_suppkey", vi.name_contains("s_name", ["01", "7"]).alias("hit"), vi.recode_from(F.lit("Any"), vi.name_contains("s_name", ["7"]), F.col("s_nationkey") >= 10, "Seven").alias("label"))


@query("SELECT doc_id AS unit_id, CAST(quality AS VARCHAR) AS human, CAST(toxic AS VARCHAR) AS model FROM labels WHERE quality = 1")
def wide_ratings(spark, sf):
    l_ = read(spark, sf, "labels")
    a = l_.select(F.col("doc_id").alias("unit_id"), F.lit("human").alias("rater"), F.col("quality").cast("string").alias("label"), F.lit("high").alias("confidence"))
    b = l_.select(F.col("doc_id").alias("unit_id"), F.lit("model").alias("rater"), F.col("toxic").cast("string").alias("label"), F.lit("low").alias("confidence"))
    both = a.unionByName(b)
    units = vi.rating_filter(both, raters=["human"], confidence=["high"], drop=["0"])
    return vi.wide(vi.rating_filter(both, units=units), ["human", "model"])


@query(f"WITH {RECORDS_SQL} SELECT contractor, bool_or(CAST(original_prime_id AS BIGINT) % 5 = 0) AS any_subcontract, bool_or(is_cloud) AS any_cloud, CAST(min(fiscal_year) AS INTEGER) AS first_year, CAST(count(DISTINCT fiscal_year) AS INTEGER) AS n_years FROM records GROUP BY 1")
def evidence_types(spark, sf):
    r = records(spark, sf).withColumn("record_type", F.when(F.col("original_prime_id").cast("long") % 5 == 0, "subcontract").otherwise("prime_no_subs"))
    return vi.evidence(r).select("contractor", "any_subcontract", "any_cloud", F.get("years", F.lit(0)).alias("first_year"), F.size("years").alias("n_years"))


@query(f"WITH {RECORDS_SQL} SELECT count(*) AS n, round(coalesce(sum(dollars), 0), 2) AS dollars FROM records WHERE is_cloud AND contains(description, 'gear')")
def label_conflicts(spark, sf):
    r = records(spark, sf).withColumn("explicit_cloud_mention", F.contains("description", F.lit("gear"))).withColumn("llm_classification", F.when(F.col("is_cloud"), "non-cloud").otherwise("cloud-dependent"))
    return rounded(vi.label_conflicts(r), 2)


@query(f"WITH {RET}, p AS ({_ret('n')}), q AS ({_ret('u')}), j AS (SELECT p.buyer, p.at_risk AS na, p.retained AS nr, q.at_risk AS ua, q.retained AS ur FROM p JOIN q USING (buyer) WHERE p.at_risk > 0 AND q.at_risk > 0), "
       "w AS (SELECT sum(na) AS a, sum(nr) AS b, sum(ua) AS c, sum(ur) AS d FROM j) SELECT buyer, round((b - nr) / (a - na), 6) AS c_naive, round((d - ur) / (c - ua), 6) AS c_unclouded, round(((d - ur) / (c - ua)) / ((b - nr) / (a - na)), 6) AS ratio FROM j, w")  # fmt: skip
def persistence_jackknife(spark, sf):
    b = _buyers(spark, sf)
    a = pe.retention(b, "naive").select("buyer", F.col("at_risk").alias("na"), F.col("retained").alias("nr"))
    c = pe.retention(b, "unclouded").select("buyer", F.col("at_risk").alias("ua"), F.col("retained").alias("ur"))
    return rounded(vi.leave_one_out(a.join(c, "buyer")), 6)
