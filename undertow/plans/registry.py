"""Every query on the award-style projection of the test tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertow.functions import names
from undertow.functions.scalar import fiscal_year
from undertow.operators import attribution as at
from undertow.operators import concentration as co
from undertow.operators import exposure as ex
from undertow.operators import persistence as pe
from undertow.operators import prep
from undertow.operators import validation as va
from undertow.plans.fixtures import PRIMES_SQL, RECORDS_SQL, SUBS_SQL, primes, read, records, subawards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4, **names: int) -> DataFrame:
    """Doubles rounded, so that the order of addition doesn't show."""
    return df.select(*[F.round(c, names.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CONC = """SELECT {by} count(*) AS n_keys, round(sum(d), 2) AS total, round(sum(d*d) * 10000 / (sum(d) * sum(d)), 4) AS hhi,
  CASE WHEN sum(d*d) * 10000 / (sum(d) * sum(d)) < 1500 THEN 'unconcentrated' WHEN sum(d*d) * 10000 / (sum(d) * sum(d)) < 2500 THEN 'moderate' ELSE 'high' END AS hhi_class,
  round(sum(CASE WHEN r <= 4 THEN d ELSE 0 END) * 100 / sum(d), 4) AS c4, round(sum(CASE WHEN r <= 10 THEN d ELSE 0 END) * 100 / sum(d), 4) AS c10,
  round(2 * sum(p * d) / (count(*) * sum(d)) - (count(*) + 1.0) / count(*), 4) AS gini, round(10000 / (sum(d*d) * 10000 / (sum(d) * sum(d))), 4) AS equivalent_firms
FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY d DESC, k) AS r, row_number() OVER (PARTITION BY {part} ORDER BY d, k) AS p FROM t) {group}"""


@query(f"WITH {RECORDS_SQL}, t AS (SELECT contractor AS k, sum(dollars) AS d FROM records WHERE dollars > 0 GROUP BY contractor) " + CONC.format(by="", part="1", group=""))
def hhi_contractor(spark, sf):
    return rounded(co.concentration(records(spark, sf), "contractor"), total=2)


@query(f"WITH {RECORDS_SQL}, t AS (SELECT fiscal_year, platform AS k, sum(dollars) AS d FROM records WHERE dollars > 0 GROUP BY 1, 2) " + CONC.format(by="fiscal_year,", part="fiscal_year", group="GROUP BY fiscal_year"))
def annual_hhi_platform(spark, sf):
    return rounded(co.concentration(records(spark, sf), "platform", ("fiscal_year",)), total=2)


@query(f"""WITH {RECORDS_SQL}, a AS (SELECT contractor k, sum(dollars) d FROM records GROUP BY 1), b AS (SELECT platform k, sum(dollars) d FROM records GROUP BY 1)
SELECT round(x, 4) AS naive_hhi, round(y, 4) AS platform_hhi, round(y / x, 4) AS gap FROM (SELECT sum(d*d)*10000/(sum(d)*sum(d)) AS x FROM a), (SELECT sum(d*d)*10000/(sum(d)*sum(d)) AS y FROM b)""")
def concentration_gap(spark, sf):
    return rounded(co.gap(records(spark, sf), "contractor", "platform"))


@query(f"""WITH {RECORDS_SQL}, w AS (SELECT r.*, s AS window_start FROM records r JOIN (SELECT unnest(range(1995, 2000)) AS s) ON fiscal_year BETWEEN s AND s + 2),
a AS (SELECT window_start, sum(d*d)*10000/(sum(d)*sum(d)) AS h FROM (SELECT window_start, contractor, sum(dollars) d FROM w GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT window_start, sum(d*d)*10000/(sum(d)*sum(d)) AS h FROM (SELECT window_start, platform, sum(dollars) d FROM w GROUP BY 1, 2) GROUP BY 1)
SELECT CAST(window_start AS INTEGER) AS window_start, round(a.h, 4) AS hhi_contractor, round(b.h, 4) AS hhi_platform, round(b.h / a.h, 4) AS ratio FROM a JOIN b USING (window_start)""")
def rolling_hhi(spark, sf):
    return rounded(co.rolling_hhi(records(spark, sf), ("contractor", "platform"), 1995, 1999))


@query(f"""WITH {RECORDS_SQL}, m AS (SELECT original_prime_id, dollars, platform,
  list_filter(['bolt','gear','PROMO'], lambda x: contains(description, x)) AS ms FROM records),
e AS (SELECT unnest(CASE WHEN len(ms) > 0 THEN ms ELSE [platform] END) AS platform_for_analysis, dollars / greatest(len(ms), 1) AS d FROM m)
SELECT platform_for_analysis, round(sum(d), 2) AS dollars, count(*) AS n FROM e GROUP BY 1""")
def mention_split(spark, sf):
    words = ["bolt", "gear", "PROMO"]
    r = records(spark, sf).withColumn("platform_mentions", F.filter(F.array(*[F.when(F.contains("description", F.lit(w)), F.lit(w)) for w in words]), lambda x: x.isNotNull()))
    e = co.expand_mentions(r.withColumnRenamed("platform", "final_platform"))
    return rounded(e.groupBy("platform_for_analysis").agg(F.sum("dollars_split").alias("dollars"), F.count("*").alias("n")), 2)


@query(f"""WITH {RECORDS_SQL}, t AS (SELECT contractor, sum(dollars) AS dollars FROM records GROUP BY 1)
SELECT contractor, round(dollars, 2) AS dollars, round(row_number() OVER (ORDER BY dollars, contractor) * 1.0 / count(*) OVER (), 6) AS key_share,
  round(sum(dollars) OVER (ORDER BY dollars, contractor ROWS UNBOUNDED PRECEDING) / sum(dollars) OVER (), 6) AS dollar_share FROM t""")
def lorenz_contractor(spark, sf):
    return rounded(co.lorenz(records(spark, sf), "contractor"), 6, dollars=2)


@query(f"""WITH {RECORDS_SQL} SELECT fiscal_year, round(sum(CASE WHEN parent = '1' THEN dollars ELSE 0 END) / 1e6, 6) AS "1", round(sum(CASE WHEN parent = '2' THEN dollars ELSE 0 END) / 1e6, 6) AS "2",
  round(sum(CASE WHEN parent IN ('1', '2') THEN dollars ELSE 0 END) / 1e6, 6) AS "Total" FROM records GROUP BY 1""")
def pivot_year_parent(spark, sf):
    return rounded(co.pivot_year(records(spark, sf), "parent", ["1", "2"]), 6)


@query(f"""WITH {RECORDS_SQL}, t AS (SELECT platform, sum(dollars) d, platform IN ('Brand#11','Brand#12','Brand#13') AS k FROM records GROUP BY 1)
SELECT 'as_is' AS scenario, round(sum(d*d)*10000/(sum(d)*sum(d)), 4) AS hhi FROM t UNION ALL SELECT 'known_only', round(sum(d*d)*10000/(sum(d)*sum(d)), 4) FROM t WHERE k
UNION ALL SELECT 'proportional', round(sum(power(d * f, 2))*10000/power(sum(d * f), 2), 4) FROM (SELECT d, (SELECT sum(d) FROM t) / (SELECT sum(d) FROM t WHERE k) AS f FROM t WHERE k)""")
def hhi_sensitivity(spark, sf):
    return rounded(co.sensitivity(records(spark, sf), ["Brand#11", "Brand#12", "Brand#13"]))


@query(f"""WITH {RECORDS_SQL} SELECT fiscal_year, round(sum(CASE WHEN is_cloud THEN dollars ELSE 0 END), 2) AS "true", round(sum(CASE WHEN NOT is_cloud THEN dollars ELSE 0 END), 2) AS "false" FROM records GROUP BY 1""")
def dependency_matrix(spark, sf):
    r = records(spark, sf).withColumn("cloud", F.col("is_cloud").cast("string"))
    return rounded(co.dependency_matrix(r, "fiscal_year", "cloud", ["true", "false"]), 2)


@query(f"""WITH {RECORDS_SQL}, a AS (SELECT contractor k, sum(dollars) d FROM records GROUP BY 1), b AS (SELECT parent k, sum(dollars) d FROM records GROUP BY 1)
SELECT b.k AS provider, round(b.d, 2) AS as_platform, round(coalesce(a.d, 0), 2) AS as_contractor, round(CASE WHEN a.d > 0 THEN (b.d - a.d) * 100 / a.d END, 2) AS change_pct FROM b LEFT JOIN a USING (k)""")
def hidden_concentration(spark, sf):
    return rounded(co.hidden_concentration(records(spark, sf), "contractor", "parent"), 2)


@query(f"""WITH {RECORDS_SQL}, c AS (SELECT original_prime_id, platform, sum(dollars) d FROM records GROUP BY 1, 2), k AS (SELECT platform, sum(d) t FROM c GROUP BY 1),
w AS (SELECT sum(t) s, sum(t*t) q FROM k), o AS (SELECT original_prime_id, sum(d) dd, sum(t*d) cr, sum(d*d) sq FROM c JOIN k USING (platform) GROUP BY 1)
SELECT original_prime_id, round((q - 2*cr + sq) * 10000 / power(s - dd, 2), 4) AS hhi FROM o, w""")
def jackknife_hhi(spark, sf):
    return rounded(co.jackknife_hhi(records(spark, sf), "platform"))


@query(f"""WITH {PRIMES_SQL} SELECT CAST(year(effective_date) + CASE WHEN month(effective_date) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, coalesce(parent_uei, uei) AS entity,
  round(sum(dollars), 2) AS dollars, count(*) AS n FROM primes GROUP BY 1, 2""")
def fiscal_year_entity(spark, sf):
    p = primes(spark, sf).select(fiscal_year("effective_date").alias("fiscal_year"), F.coalesce("parent_uei", "uei").alias("entity"), "dollars")
    return rounded(p.groupBy("fiscal_year", "entity").agg(F.sum("dollars").alias("dollars"), F.count("*").alias("n")), 2)


@query("""SELECT doc_id, CASE WHEN h >= 2 AND s = 0 THEN 'hardware' WHEN s > 0 THEN 'service' WHEN h > 0 THEN 'hardware_weak' ELSE 'unknown' END AS keyword_class FROM (
  SELECT doc_id, CAST(contains(lower(text), 'ing ') AS INT) + CAST(contains(lower(text), 'ment') AS INT) AS h, CAST(contains(lower(text), 'tion ') AS INT) + CAST(contains(lower(text), 'keit') AS INT) AS s FROM documents)""")
def keyword_class(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text")
    return prep.keyword_class(d, "text", ["ing ", "ment"], ["tion ", "keit"]).select("doc_id", "keyword_class")


@query(f"""WITH {PRIMES_SQL}, f AS (SELECT dollars, year(effective_date) BETWEEN 1996 AND 1999 AS a, substr(description, 1, 4) NOT IN ('1-UR') AS b, dollars > 100000 AS c FROM primes)
SELECT 0 AS step, 'years' AS name, count(*) FILTER (a) AS n, round(sum(dollars) FILTER (a), 2) AS dollars FROM f
UNION ALL SELECT 1, 'codes', count(*) FILTER (a AND b), round(sum(dollars) FILTER (a AND b), 2) FROM f
UNION ALL SELECT 2, 'large', count(*) FILTER (a AND b AND c), round(sum(dollars) FILTER (a AND b AND c), 2) FROM f""")
def filter_funnel(spark, sf):
    steps = [("years", F.year("effective_date").between(1996, 1999)), ("codes", ~F.substring("description", 1, 4).isin("1-UR")), ("large", F.col("dollars") > 100000)]
    return rounded(prep.filter_funnel(primes(spark, sf), steps), 2)


@query(f"""WITH {PRIMES_SQL}, g AS (SELECT uei AS award_id, max(dollars) AS dollars, max(effective_date) AS effective_date, arg_max(description, (length(description) * 1000000000::HUGEINT - _ord)) AS description,
  arg_min(parent_uei, _ord) FILTER (parent_uei IS NOT NULL) AS parent_uei, arg_min(office, _ord) FILTER (office IS NOT NULL) AS office FROM primes GROUP BY 1)
SELECT *, CAST(year(effective_date) + CASE WHEN month(effective_date) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year FROM g""")
def dedupe_awards(spark, sf):
    p = primes(spark, sf).drop("award_id").withColumnRenamed("uei", "award_id")
    return prep.dedupe_awards(p, first=("parent_uei", "office"))


@query(f"WITH {PRIMES_SQL}, {SUBS_SQL} SELECT prime_id, count(*) AS n, round(sum(dollars), 2) AS dollars FROM subs WHERE prime_id IN (SELECT award_id FROM primes) GROUP BY 1")
def link_subawards(spark, sf):
    linked = prep.link_subawards(subawards(spark, sf), primes(spark, sf))
    return rounded(linked.filter("prime_id is not null").groupBy("prime_id").agg(F.count("*").alias("n"), F.sum("dollars").alias("dollars")), 2)


@query(f"""WITH {PRIMES_SQL}, {SUBS_SQL}, t AS (SELECT prime_id, sum(dollars) st FROM subs GROUP BY 1), p AS (SELECT *, coalesce(parent_uei, uei) AS e FROM primes LEFT JOIN t ON award_id = prime_id),
m AS (SELECT 'prime_no_subs' AS record_type, e AS contractor, dollars FROM p WHERE prime_id IS NULL
  UNION ALL SELECT 'prime_retained', e, dollars - st FROM p WHERE prime_id IS NOT NULL AND NOT (st > dollars AND st > 0) AND dollars - st > 0.01
  UNION ALL SELECT 'subcontract', s.sub_uei, s.dollars * CASE WHEN st > p.dollars AND st > 0 THEN p.dollars / st ELSE 1 END FROM subs s JOIN p ON s.prime_id = p.award_id)
SELECT record_type, contractor, count(*) AS n, round(sum(dollars), 2) AS dollars FROM m GROUP BY 1, 2""")
def merge_awards(spark, sf):
    p = primes(spark, sf)
    m = prep.merge_awards(p, prep.link_subawards(subawards(spark, sf), p))
    return rounded(m.groupBy("record_type", "contractor").agg(F.count("*").alias("n"), F.sum("dollars").alias("dollars")), 2)


@query(f"WITH {PRIMES_SQL} SELECT round(sum(dollars), 0) AS merged_dollars, round(sum(dollars), 0) AS prime_dollars, true AS ok FROM primes")
def dollar_integrity(spark, sf):
    p = primes(spark, sf)
    return rounded(prep.dollar_integrity(prep.merge_awards(p, prep.link_subawards(subawards(spark, sf), p)), p), 0)


BANK = {"Bolt": ["bolt", "steel"], "Gear": ["gear", r"pi\w+", "gear"], "Promo": ["promo", "economy"]}


def _classified(spark, sf):
    r = records(spark, sf).withColumn("contractor_name", F.concat(F.lit("Supplier "), F.col("contractor")))
    return at.regex_classify(r, BANK, ["small"], {"Bolt": [r"\bpromo bolt\b"]}, multi="Many")


@query(f"""WITH {RECORDS_SQL}, h AS (SELECT *, lower(description) AS d FROM records), s AS (SELECT *,
  regexp_matches(d, '\\bpromo bolt\\b') AS ex, CAST(contains(d, 'bolt') AS INT) + CAST(contains(d, 'steel') AS INT) AS b0, 2 * CAST(contains(d, 'gear') AS INT) + CAST(regexp_matches(d, 'pi\\w+') AS INT) AS g,
  CAST(contains(d, 'promo') AS INT) + CAST(contains(d, 'economy') AS INT) AS p FROM h), z AS (SELECT *, b0 + CASE WHEN ex THEN 2 ELSE 0 END AS b FROM s),
k AS (SELECT *, CAST(b > 0 AS INT) + CAST(g > 0 AS INT) + CAST(p > 0 AS INT) AS c, greatest(b, g, p) AS top FROM z)
SELECT ex OR c > 0 OR contains(d, 'small') AS regex_is_cloud, CASE WHEN c >= 2 THEN 'Many' WHEN b > 0 THEN 'Bolt' WHEN g > 0 THEN 'Gear' WHEN p > 0 THEN 'Promo' END AS regex_platforms,
  CASE WHEN c >= 2 THEN 'Medium' WHEN c = 1 AND top >= 3 THEN 'High' WHEN c = 1 AND top = 2 THEN 'Medium' ELSE 'Low' END AS regex_confidence, count(*) AS n, round(sum(dollars), 2) AS dollars
FROM k GROUP BY 1, 2, 3""")
def regex_classify(spark, sf):
    c = _classified(spark, sf)
    return rounded(c.groupBy("regex_is_cloud", "regex_platforms", "regex_confidence").agg(F.count("*").alias("n"), F.sum("dollars").alias("dollars")), 2)


@query(f"""WITH {RECORDS_SQL}, e AS (SELECT contractor, platform, count(*) AS m FROM records WHERE dollars > 0 GROUP BY 1, 2), t AS (SELECT contractor, sum(m) AS ev FROM e GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY contractor ORDER BY m DESC, platform) AS k FROM e)
SELECT contractor, platform AS learned_platform, round(m / ev, 6) AS share, CAST(ev AS DOUBLE) AS evidence FROM r JOIN t USING (contractor) WHERE k = 1 AND ev >= 5 AND m / ev >= 0.06""")
def learn_patterns(spark, sf):
    return rounded(at.learn_patterns(records(spark, sf), min_evidence=5, threshold=0.06), 6)


@query(f"""WITH {RECORDS_SQL}, d AS (SELECT *, CASE WHEN is_cloud AND parent IN ('1', '2') THEN 'N' || parent END AS p1, CASE WHEN contains(description, 'gear') THEN 'Gear' ELSE 'Unspecified' END AS st FROM records),
q AS (SELECT *, CASE WHEN is_cloud AND p1 IS NULL AND st = 'Gear' THEN st END AS p2 FROM d), e AS (SELECT contractor, coalesce(p1, p2) AS pl, count(*) AS m FROM q WHERE is_cloud AND coalesce(p1, p2) IS NOT NULL AND dollars > 0 GROUP BY 1, 2),
l AS (SELECT contractor, max(m) AS mm, sum(m) AS ev, arg_min(pl, (-m, pl)) AS lp FROM e GROUP BY 1), f AS (SELECT q.*, CASE WHEN l.ev >= 5 AND l.mm / l.ev >= 0.9 THEN lp END AS p3 FROM q LEFT JOIN l USING (contractor))
SELECT CASE WHEN NOT is_cloud THEN 'non_cloud_contractor' WHEN p1 IS NOT NULL THEN 'phase1_direct' WHEN p2 IS NOT NULL THEN 'phase2_description' WHEN p3 IS NOT NULL THEN 'phase3_pattern' ELSE 'cloud_unattributed_contractor' END AS attribution_method,
  CASE WHEN NOT is_cloud THEN 'Supplier ' || contractor WHEN p1 IS NOT NULL THEN p1 WHEN p2 IS NOT NULL THEN p2 WHEN p3 IS NOT NULL THEN p3 ELSE 'Supplier ' || contractor END AS final_platform, count(*) AS n, round(sum(dollars), 2) AS dollars
FROM f GROUP BY 1, 2""")
def attribute(spark, sf):
    r = records(spark, sf).withColumn("contractor_name", F.concat(F.lit("Supplier "), F.col("contractor")))
    r = r.withColumn("platform_stage1", F.when(F.contains("description", F.lit("gear")), "Gear").otherwise("Unspecified")).withColumn("classification_confidence", F.lit("medium")).drop("platform")
    a = at.attribute(r, entity=F.when(F.col("parent").isin("1", "2"), F.concat(F.lit("N"), F.col("parent"))))
    return rounded(a.groupBy("attribution_method", "final_platform").agg(F.count("*").alias("n"), F.sum("dollars").alias("dollars")), 2)


@query(f"""WITH {RECORDS_SQL} SELECT layer, place, round(coalesce(sum(dollars), 0), 2) AS dollars FROM (VALUES (0, 'returned'), (1, 'gear'), (2, 'rest')) v(place, layer)
LEFT JOIN (SELECT dollars, CASE WHEN is_cloud THEN 'returned' WHEN contains(description, 'gear') THEN 'gear' ELSE 'rest' END AS layer FROM records) USING (layer) GROUP BY 1, 2""")
def discovery_layers(spark, sf):
    return rounded(at.discovery_layers(records(spark, sf), [("returned", F.col("is_cloud")), ("gear", F.contains("description", F.lit("gear")))]), 2)


SYN = """SELECT doc_id, quality = 1 AS rc, CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'AWS' END AS rp, doc_id % 4 = 0 AS ex,
  CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN toxic = 1 OR doc_id % 2 = 0 THEN 'cloud-dependent' ELSE 'non-cloud' END AS lc,
  CASE WHEN doc_id % 5 = 0 THEN 'AWS' WHEN doc_id % 5 = 1 THEN 'Azure' WHEN doc_id % 5 = 2 THEN 'Unspecified' ELSE 'N/A' END AS lp, CASE WHEN doc_id % 7 = 0 THEN 'high' ELSE 'low' END AS lf FROM labels"""


@query(f"""WITH s AS ({SYN}), t AS (SELECT *, lc IN ('cloud-dependent', 'cloud-infrastructure') AS l, lp NOT IN ('N/A', 'error') AS nm FROM s)
SELECT doc_id, CASE WHEN lc = 'error' THEN rc WHEN l THEN true WHEN NOT rc THEN false ELSE ex AND lf <> 'high' END AS is_cloud,
  CASE WHEN lc = 'error' THEN CASE WHEN rc THEN coalesce(rp, 'Unspecified') ELSE 'N/A' END WHEN l AND rc THEN CASE WHEN nm THEN lp ELSE coalesce(rp, 'Unspecified') END WHEN l THEN CASE WHEN nm THEN lp ELSE 'Unspecified' END
    WHEN rc AND ex AND lf <> 'high' THEN coalesce(rp, 'Unspecified') ELSE 'N/A' END AS platform_stage1,
  CASE WHEN lc = 'error' THEN 'regex_only_llm_error' WHEN l AND rc THEN CASE WHEN rp = lp THEN 'regex+llm_agree' WHEN lp NOT IN ('Unspecified', 'N/A', 'error') THEN 'llm_platform' ELSE 'both_cloud_no_platform' END
    WHEN l THEN 'llm_only' WHEN NOT rc THEN 'both_noncloud' WHEN ex AND lf <> 'high' THEN 'conflict_resolved_cloud' ELSE 'conflict_resolved_noncloud' END AS classification_source FROM t""")
def synthesize(spark, sf):
    d = F.col("doc_id")
    s = read(spark, sf, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("regex_is_cloud"), F.when((F.col("quality") == 1) & (d % 3 == 0), "AWS").alias("regex_platforms"), (d % 4 == 0).alias("explicit_cloud_mention"),
        F.when(d % 11 == 0, "error").when((F.col("toxic") == 1) | (d % 2 == 0), "cloud-dependent").otherwise("non-cloud").alias("llm_classification"),
        F.when(d % 5 == 0, "AWS").when(d % 5 == 1, "Azure").when(d % 5 == 2, "Unspecified").otherwise("N/A").alias("llm_platform"),
        F.when(d % 7 == 0, "high").otherwise("low").alias("llm_confidence"), F.array().cast("array<string>").alias("regex_platforms_list"),
    )
    return at.synthesize(s).select("doc_id", "is_cloud", "platform_stage1", "classification_source")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'error' WHEN toxic = 1 THEN 'cloud-dependent' ELSE 'non-cloud' END AS classification,
  CASE WHEN doc_id % 5 = 4 THEN 'error' WHEN doc_id % 5 = 0 THEN 'AWS' WHEN doc_id % 5 = 1 THEN 'Azure' WHEN doc_id % 5 = 2 THEN CASE WHEN toxic = 1 THEN 'Unspecified' ELSE 'N/A' END ELSE 'Unspecified' END AS platform,
  CASE WHEN doc_id % 5 = 4 THEN 'parse_error' ELSE 'e' || doc_id END AS evidence FROM labels""")
def parse_label(spark, sf):
    d = F.col("doc_id")
    name = F.when(d % 5 == 0, "Amazon EC2").when(d % 5 == 1, "microsoft azure").when(d % 5 == 2, "none").otherwise("Other")
    body = F.format_string('```json\n{"classification": "%s", "platform": "%s", "confidence": "high", "evidence": "e%d"}\n```', F.when(F.col("toxic") == 1, "cloud-dependent").otherwise("non-cloud"), name, d)
    raw = read(spark, sf, "labels").select("doc_id", F.when(d % 5 == 4, "not json").otherwise(body).alias("raw"))
    return raw.select("doc_id", at.parse_label("raw").alias("p")).select("doc_id", "p.classification", "p.platform", "p.evidence")


def _buyers(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fiscal_year"))
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    s = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey).select((F.col("o_custkey") % 50).cast("string").alias("buyer"), "fiscal_year", F.col("l_suppkey").alias("naive"), F.col("s_nationkey").alias("unclouded"))


RET = """r AS (SELECT DISTINCT CAST(o_custkey % 50 AS VARCHAR) AS buyer, year(o_orderdate) AS y, l_suppkey AS naive, s_nationkey AS unclouded FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
a AS (SELECT DISTINCT buyer, y FROM r), n AS (SELECT DISTINCT buyer, y, naive AS k FROM r), u AS (SELECT DISTINCT buyer, y, unclouded AS k FROM r)"""


def _ret(t: str) -> str:
    return f"""SELECT buyer, CAST(sum(CAST(ar AS INT)) AS BIGINT) AS at_risk, CAST(sum(CAST(ar AND st AS INT)) AS BIGINT) AS retained FROM (SELECT x.buyer, EXISTS (SELECT 1 FROM a WHERE a.buyer = x.buyer AND a.y = x.y + 1) AS ar,
  EXISTS (SELECT 1 FROM {t} z WHERE z.buyer = x.buyer AND z.y = x.y + 1 AND z.k = x.k) AS st FROM {t} x) GROUP BY 1"""


@query(f"WITH {RET} {_ret('n')}")
def retention(spark, sf):
    return pe.retention(_buyers(spark, sf), "naive")


@query(f"WITH {RET}, p AS ({_ret('n')}), q AS ({_ret('u')}) SELECT round(c1, 6) AS c_naive, round(c2, 6) AS c_unclouded, nb AS n_buyers, round(c2 / c1, 6) AS ratio FROM (SELECT sum(p.retained) / sum(p.at_risk) AS c1, sum(q.retained) / sum(q.at_risk) AS c2, count(*) AS nb FROM p JOIN q USING (buyer) WHERE p.at_risk > 0 AND q.at_risk > 0)")
def persistence(spark, sf):
    return rounded(pe.persistence(_buyers(spark, sf), "naive", "unclouded"), 6)


@query()
def bootstrap_persistence(spark, sf):
    b = _buyers(spark, sf)
    a = pe.retention(b, "naive").select("buyer", F.col("at_risk").alias("na"), F.col("retained").alias("nr"))
    c = pe.retention(b, "unclouded").select("buyer", F.col("at_risk").alias("ua"), F.col("retained").alias("ur"))
    return pe.bootstrap_persistence(a.join(c, "buyer"), 20_000, 20260928)


@query()
def bootstrap_hhi(spark, sf):
    cells = records(spark, sf).groupBy(F.col("original_prime_id").alias("award"), F.col("platform").alias("key")).agg(F.sum("dollars").alias("dollars"))
    return pe.bootstrap_hhi(cells, 20, 7)


def _ratings(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars")
    l_ = read(spark, sf, "labels").join(d, "doc_id")
    a = l_.select(F.col("doc_id").alias("unit_id"), F.lit("human").alias("rater"), F.col("quality").cast("string").alias("label"))
    return a.unionByName(l_.select(F.col("doc_id").alias("unit_id"), F.lit("rule").alias("rater"), (F.col("n_chars") > 500).cast("int").cast("string").alias("label")))


RAT = "x AS (SELECT doc_id, quality AS a, CAST(n_chars > 500 AS INT) AS b FROM labels JOIN documents USING (doc_id)), l AS (SELECT doc_id, a AS v FROM x UNION ALL SELECT doc_id, b FROM x)"


@query(f"""WITH {RAT} SELECT round(1 - (nv - 1) * dis / (nv * nv - sq), 6) AS alpha, nu AS n_units, CAST(nv AS BIGINT) AS n_values FROM (SELECT sum(CASE WHEN a <> b THEN 2 ELSE 0 END) AS dis, count(*) AS nu, 2 * count(*) AS nv FROM x), (SELECT sum(c * c) AS sq FROM (SELECT v, count(*) AS c FROM l GROUP BY 1))""")
def krippendorff_alpha(spark, sf):
    return rounded(va.krippendorff_alpha(_ratings(spark, sf)), 6)


@query(f"WITH {RAT} SELECT 'human' AS rater_a, 'rule' AS rater_b, count(*) AS n, round(avg(CAST(a = b AS INT)), 6) AS agreement FROM x")
def pairwise_agreement(spark, sf):
    return rounded(va.pairwise_agreement(_ratings(spark, sf)), 6)


@query("SELECT CAST(count(*) FILTER (q AND t) AS BIGINT) AS \"both\", count(*) FILTER (q AND NOT t) AS only_a, count(*) FILTER (t AND NOT q) AS only_b, count(*) FILTER (NOT q AND NOT t) AS neither, round(avg(CAST(q = t AS INT)), 6) AS rate FROM (SELECT quality = 1 AS q, toxic = 1 AS t FROM labels)")
def label_crosstab(spark, sf):
    l_ = read(spark, sf, "labels").select((F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
    return rounded(va.label_crosstab(l_, "q", "t"), 6)


@query()
def stratified_sample(spark, sf):
    r = primes(spark, sf)
    strata = [("large", F.col("dollars") > 200000, 30), ("urgent", F.col("department").startswith("1"), 25), ("rest", F.lit(True), 45)]
    return va.stratified_sample(r, strata, "award_id", 11).select("award_id", "stratum", "dollars")


@query(f"""WITH {PRIMES_SQL} SELECT award_id, department || ' | ' || office AS buyer, dollars FROM primes WHERE office IS NOT NULL""")
def attach_buyer(spark, sf):
    p = primes(spark, sf)
    r = p.select(F.col("award_id").alias("original_prime_id"), "dollars")
    return pe.attach_buyer(r, p.drop("dollars")).filter("buyer is not null").select(F.col("original_prime_id").alias("award_id"), "buyer", "dollars")


@query(f"""WITH {RECORDS_SQL}, t AS (SELECT contractor, sum(dollars) d, count(*) n FROM records GROUP BY 1) SELECT contractor, round(d, 2) AS dollars, n, row_number() OVER (ORDER BY d DESC, contractor) AS place FROM t QUALIFY place <= 15""")
def top_contractors(spark, sf):
    t = co.totals(records(spark, sf), "contractor").orderBy(F.desc("dollars"), "contractor").limit(15)
    return rounded(t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("dollars"), "contractor")).cast("long")), 2)


@query("""SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ' '), lambda x: CASE WHEN length(x) <= 3 THEN x ELSE upper(x[1]) || lower(x[2:]) END), ' ') AS short_name FROM nation""")
def short_names(spark, sf):
    n = read(spark, sf, "nation")
    return n.select("n_nationkey", names.short_name(F.concat("n_name", F.lit(", L.L.C., INC."))).alias("short_name"))


@query("""WITH p AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END, s_suppkey % 3, CAST(s_suppkey AS VARCHAR)) - 1 AS p FROM supplier)
SELECT s_nationkey, s_suppkey, round(sqrt(0.52 * 0.52 + (p + 0.5) / (pi() * 27.4)) * cos(p * pi() * (3 - sqrt(5))), 4) + 0.0 AS x, round(sqrt(0.52 * 0.52 + (p + 0.5) / (pi() * 27.4)) * sin(p * pi() * (3 - sqrt(5))), 4) + 0.0 AS y FROM p""")
def ego_layout(spark, sf):
    s = read(spark, sf, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 3).alias("d"), (F.col("s_suppkey") % 2 == 0).alias("v"))
    at_ = ex.annulus_layout(s, "s_suppkey", "d", "v", ("s_nationkey",)).select("s_nationkey", "s_suppkey", "x", "y")
    return rounded(at_).withColumn("x", F.col("x") + 0.0).withColumn("y", F.col("y") + 0.0)


@query()
def power_simulation(spark, sf):
    return va.power_simulation(spark, [0.5, 0.7, 0.8, 0.9], va.sample_grid(10, 300, 15), 3, 2000, 13)
