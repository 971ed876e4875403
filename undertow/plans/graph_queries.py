"""The graph queries: awards, subawards and attributed records of the test tables, ids whole, and their SQL twins.

An order is an award of its customer (E and the key; two customers have one parent), a line item a subaward to its supplier
(S and the key, or E where the supplier holds awards as well) and an attributed record.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.operators import exposure as ex
from undertow.operators import graph as gr
from undertow.plans.fixtures import read
from undertow.plans.registry import query, rounded
from undertow.session import kept


def _entity(c: str):
    return F.concat(F.lit("E"), F.col(c).cast("string"))


def _supplier():
    """One supplier in twenty is an entity that holds awards too; the rest only subcontract."""
    return F.when(F.col("l_suppkey") % 20 == 0, _entity("l_suppkey")).otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))


def _customer() -> list:
    parent = F.when(F.col("o_custkey") % 13 != 0, F.concat(F.lit("E"), F.floor(F.col("o_custkey") / 2).cast("string")))
    name = F.when(F.col("o_custkey") % 101 == 1, "Oracle America, Inc.").otherwise(F.concat(F.lit("Company "), F.col("o_custkey").cast("string")))
    return [_entity("o_custkey").alias("uei"), parent.alias("parent_uei"), name.alias("name")]


def awards(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    dollars = F.when(F.col("o_orderkey") % 50 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    p = o.select(F.col("o_orderkey").cast("string").alias("award_id"), *_customer(), dollars.alias("dollars"))
    return p.withColumnRenamed("name", "contractor_name").withColumn("entity", F.coalesce("parent_uei", "uei"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their orders' customers: subawards and records are both read off these."""
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_returnflag", "l_quantity")
    return li.join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def subs(joined: DataFrame) -> DataFrame:
    s = F.col("l_suppkey")
    name = F.when(s % 19 == 1, "MICROSOFT CORP").when(s % 19 == 2, "Amazon Web Services Gov").otherwise(F.concat(F.lit("Supplier "), s.cast("string")))
    prime = [c.alias(f"prime_{n}") for c, n in zip(_customer(), ("uei", "parent_uei", "name"), strict=True)]
    return joined.select(_supplier().alias("sub_uei"), name.alias("sub_name"), *prime)


def attributed(joined: DataFrame) -> DataFrame:
    sub = F.col("l_linenumber") > 1
    uei, parent, _ = _customer()
    return joined.select(
        F.col("l_orderkey").cast("string").alias("original_prime_id"), F.when(sub, _supplier()).otherwise(F.coalesce(parent, uei)).alias("contractor"), F.when(sub, "subcontract").otherwise("prime_retained").alias("record_type"),
        F.col("l_extendedprice").alias("dollars"), (F.col("l_returnflag") != "N").alias("is_cloud"),
        F.when(F.col("l_partkey") % 4 == 0, "AWS").when(F.col("l_partkey") % 4 == 1, "Azure").otherwise("Unspecified").alias("final_platform"),
        F.when(F.col("l_quantity") > 40, F.array(F.lit("Google Cloud"), F.lit("AWS"), F.lit("Other"))).alias("platform_mentions"),
    )


class Graph:
    """The parts that a query asks for; what several walks share is written once."""

    def __init__(self, spark: SparkSession, sf: str):
        self.primes, joined = awards(spark, sf), kept(lines(spark, sf))
        self.subs, self.records = subs(joined), attributed(joined)

    @cached_property
    def pairs(self) -> DataFrame:
        return kept(gr.name_pairs(self.primes, self.subs))

    @cached_property
    def alias(self) -> DataFrame:
        return kept(gr.platform_alias(self.pairs))

    @cached_property
    def labels(self) -> DataFrame:
        return gr.entity_labels(self.pairs, self.alias)

    @cached_property
    def normal(self) -> DataFrame:
        return kept(ex.edges_of(gr.subaward_edges(self.subs, self.alias)))

    @cached_property
    def clouded(self) -> DataFrame:
        return kept(gr.clouded_edges(self.normal, self.records, self.alias))

    @cached_property
    def population(self) -> DataFrame:
        return kept(gr.contract_population(self.primes, self.alias))

    @cached_property
    def deps(self) -> DataFrame:
        return kept(gr.contract_deps(self.records, self.alias))

    @cached_property
    def nodes(self) -> DataFrame:
        return kept(gr.node_universe(self.population, self.normal, self.deps))

    @cached_property
    def platforms(self) -> DataFrame:
        """The platforms of the nodes; node_universe names each of them, reached or not."""
        return gr.platform_nodes(self.primes.sparkSession)

    def contracts(self, k: int, clouded: bool, permissive: bool = False, weights: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
        edges = gr.view_edges("clouded" if clouded else "normal", permissive, self.normal, self.clouded)
        return ex.contract_exposure(self.population, self.deps, edges, self.nodes if nodes is None else nodes, k, permissive, clouded, weights)


BASE = """aw AS (SELECT CAST(o_orderkey AS VARCHAR) AS award_id, 'E' || o_custkey AS uei, CASE WHEN o_custkey % 13 <> 0 THEN 'E' || (o_custkey // 2) END AS parent_uei,
  CASE WHEN o_custkey % 101 = 1 THEN 'Oracle America, Inc.' ELSE 'Company ' || o_custkey END AS name, CASE WHEN o_orderkey % 50 = 0 THEN -o_totalprice ELSE o_totalprice END AS dollars FROM orders),
a AS (SELECT *, coalesce(parent_uei, uei) AS entity FROM aw),
s AS (SELECT CASE WHEN l_suppkey % 20 = 0 THEN 'E' ELSE 'S' END || l_suppkey AS sub_uei, CASE WHEN l_suppkey % 19 = 1 THEN 'MICROSOFT CORP' WHEN l_suppkey % 19 = 2 THEN 'Amazon Web Services Gov' ELSE 'Supplier ' || l_suppkey END AS sub_name,
  a.uei AS prime_uei, a.parent_uei AS prime_parent_uei, a.name AS prime_name, a.entity FROM lineitem JOIN a ON CAST(l_orderkey AS VARCHAR) = a.award_id),
rec AS (SELECT award_id, CASE WHEN l_linenumber > 1 THEN CASE WHEN l_suppkey % 20 = 0 THEN 'E' ELSE 'S' END || l_suppkey ELSE entity END AS contractor, l_linenumber > 1 AS sub, l_extendedprice AS dollars, l_returnflag <> 'N' AS is_cloud,
  list_distinct(list_concat(CASE WHEN l_partkey % 4 = 0 THEN ['AWS'] WHEN l_partkey % 4 = 1 THEN ['Azure'] ELSE [] END, CASE WHEN l_quantity > 40 THEN ['AWS', 'Google Cloud'] ELSE [] END)) AS platforms
  FROM lineitem JOIN a ON CAST(l_orderkey AS VARCHAR) = a.award_id),
pairs0 AS (SELECT 0 AS src, entity AS uei, name FROM a UNION ALL SELECT 1, uei, name FROM a UNION ALL SELECT 2, parent_uei, name FROM a UNION ALL SELECT 3, sub_uei, sub_name FROM s
  UNION ALL SELECT 4, prime_uei, prime_name FROM s UNION ALL SELECT 5, prime_parent_uei, prime_name FROM s),
pairs AS (SELECT uei, name, min(src) AS src FROM pairs0 WHERE uei IS NOT NULL GROUP BY 1, 2),
al AS (SELECT uei, 'PLATFORM:' || arg_min(p, (src, name)) AS node FROM (SELECT *, CASE WHEN name LIKE 'Oracle America%' THEN 'Oracle Cloud' WHEN name = 'MICROSOFT CORP' THEN 'Azure' WHEN name LIKE 'Amazon Web%' THEN 'AWS' END AS p FROM pairs) WHERE p IS NOT NULL GROUP BY 1),
lab AS (SELECT uei AS node, arg_min(name, (-length(name), src, name)) AS label FROM pairs WHERE uei NOT IN (SELECT uei FROM al) GROUP BY 1),
e0 AS (SELECT coalesce(x.node, entity) AS src, coalesce(y.node, sub_uei) AS dst FROM s LEFT JOIN al x ON x.uei = entity LEFT JOIN al y ON y.uei = sub_uei),
en AS (SELECT src, dst, count(*) AS observations FROM e0 WHERE src <> dst GROUP BY 1, 2),
ec AS (SELECT DISTINCT coalesce(node, contractor) AS src, 'PLATFORM:' || p AS dst FROM (SELECT contractor, unnest(platforms) AS p FROM rec WHERE is_cloud) LEFT JOIN al ON uei = contractor WHERE coalesce(node, contractor) <> 'PLATFORM:' || p),
ek AS (SELECT src, dst FROM en UNION SELECT src, dst FROM ec),
pop AS (SELECT award_id AS c, coalesce(node, entity) AS n, greatest(dollars, 0.0) AS w FROM a LEFT JOIN al ON al.uei = entity),
d AS (SELECT DISTINCT award_id AS c, coalesce(node, contractor) AS s, 1 AS t, 'sub' AS kind FROM rec LEFT JOIN al ON uei = contractor WHERE sub
  UNION SELECT DISTINCT award_id, 'PLATFORM:' || p, CASE WHEN sub THEN 2 ELSE 1 END, 'cloud' FROM (SELECT award_id, sub, unnest(platforms) AS p FROM rec WHERE is_cloud)),
v AS (SELECT n AS node FROM pop UNION SELECT src FROM en UNION SELECT dst FROM en UNION SELECT s FROM d UNION SELECT 'PLATFORM:' || unnest(['AWS', 'Azure', 'Google Cloud', 'Oracle Cloud', 'IBM Cloud', 'Salesforce', 'ServiceNow', 'Workday']))"""


def _hops(name: str, edges: str, k: int) -> str:
    """CTEs up to {name}: (src, dst, hops), hops from 1 to k."""
    out = f"{name}1 AS (SELECT DISTINCT src, dst, 1 AS hops FROM {edges})"
    for h in range(2, k + 1):
        out += f", {name}{h} AS (SELECT src, dst, min(hops) AS hops FROM (SELECT * FROM {name}{h - 1} UNION ALL SELECT DISTINCT a.src, b.dst, {h} FROM (SELECT DISTINCT src, dst FROM {edges}) a JOIN {name}{h - 1} b ON a.dst = b.src WHERE a.src <> b.dst AND b.hops = {h - 1}) GROUP BY 1, 2)"
    return out + f", {name} AS (SELECT * FROM {name}{k})"


def _entities(name: str, hops: str) -> str:
    """CTE {name}: (node, c, exposure) over all nodes."""
    return f"{name} AS (SELECT node, CAST(coalesce(c, 0) AS DOUBLE) AS c, coalesce(c, 0) / ((SELECT count(*) FROM v) - 1) AS exposure FROM v LEFT JOIN (SELECT dst AS node, count(*) AS c FROM {hops} GROUP BY 1) USING (node))"


def _contracts_sql(name: str, hops: str, k: int, clouded: bool, permissive: bool, weight: str = "1.0") -> str:
    """CTE {name}: (node, c, exposure)."""
    seeds = f"SELECT c, s, t FROM d{'' if clouded else chr(32) + 'WHERE kind <> ' + repr('cloud')}" + (" UNION SELECT c, n, 0 FROM pop" if permissive else "")
    return f"""{name} AS (WITH z AS ({seeds}), x AS (SELECT DISTINCT c, node FROM (SELECT c, s AS node, t AS at_ FROM z UNION ALL SELECT z.c, h.dst, z.t + h.hops FROM z JOIN {hops} h ON z.s = h.src) WHERE at_ <= {k})
      SELECT node, CAST(coalesce(m, 0) AS DOUBLE) AS c, coalesce(m, 0) / (SELECT sum({weight}) FROM pop) AS exposure FROM v LEFT JOIN (SELECT x.node, sum({weight}) AS m FROM x JOIN pop ON x.c = pop.c WHERE x.node <> pop.n GROUP BY 1) USING (node))"""


@query(f"WITH {BASE} SELECT uei, node FROM al")
def platform_alias(spark, sf):
    return Graph(spark, sf).alias


@query(f"WITH {BASE} SELECT node, label FROM lab")
def entity_labels(spark, sf):
    return Graph(spark, sf).labels


@query(f"WITH {BASE} SELECT src, dst, CAST(max(o) AS BIGINT) AS observations, min(kind) AS kind FROM (SELECT src, dst, observations AS o, 'sub' AS kind FROM en UNION ALL SELECT src, dst, NULL, 'cloud' FROM ec) GROUP BY 1, 2")
def clouded_graph(spark, sf):
    return Graph(spark, sf).clouded


@query(f"WITH {BASE} SELECT c AS contract_id, n AS performing_node, round(w, 2) AS weight FROM pop")
def contract_population(spark, sf):
    return rounded(Graph(spark, sf).population, 2)


@query(f"WITH {BASE} SELECT c AS contract_id, s AS dep_node, CAST(t AS INTEGER) AS tier, kind FROM d")
def contract_deps(spark, sf):
    return Graph(spark, sf).deps


@query(f"WITH {BASE} SELECT coalesce(node, contractor) AS node, round(greatest(sum(dollars), 0), 2) AS weight FROM rec LEFT JOIN al ON uei = contractor GROUP BY 1")
def entity_weights(spark, sf):
    g = Graph(spark, sf)
    return rounded(gr.entity_weights(g.records, g.alias), 2)


@query(f"WITH {BASE}, {_hops('r', 'ek', 2)}, {_entities('x', 'r')} SELECT node, c AS dependents, round(exposure, 6) AS exposure FROM x")
def entity_exposure(spark, sf):
    g = Graph(spark, sf)
    return rounded(ex.entity_exposure(g.clouded, g.nodes, 2), 6)


@query(f"WITH {BASE}, {_hops('r', 'ek', 3)}, w AS (SELECT v.node, coalesce(w, 0) AS w FROM v LEFT JOIN (SELECT coalesce(node, contractor) AS node, greatest(sum(dollars), 0) AS w FROM rec LEFT JOIN al ON uei = contractor GROUP BY 1) USING (node)) "
       "SELECT node, round(coalesce(m, 0) / (SELECT sum(w) FROM w), 6) AS exposure FROM v LEFT JOIN (SELECT dst AS node, sum(w) AS m FROM r JOIN w ON r.src = w.node GROUP BY 1) USING (node)")  # fmt: skip
def entity_value_exposure(spark, sf):
    g = Graph(spark, sf)
    return rounded(ex.entity_exposure(g.clouded, g.nodes, 3, gr.entity_weights(g.records, g.alias)), 6).select("node", "exposure")


@query(f"WITH {BASE}, {_hops('r', 'ek', 2)}, {_contracts_sql('x', 'r', 2, True, True)} SELECT node, c AS contracts, round(exposure, 6) AS exposure FROM x")
def contract_exposure(spark, sf):
    return rounded(Graph(spark, sf).contracts(2, True, True), 6)


@query(f"WITH {BASE}, {_hops('r', 'en', 2)}, {_contracts_sql('x', 'r', 2, True, False, 'w')} SELECT node, round(exposure, 6) AS exposure FROM x")
def contract_value_exposure(spark, sf):
    g = Graph(spark, sf)
    return rounded(g.contracts(2, True, weights=g.population.select("contract_id", "weight")), 6).select("node", "exposure")


SWEEP = [(v, p, k) for v in ("normal", "clouded") for p in (False, True) for k in (1, 2, 3)]


@query(f"WITH {BASE}, {_hops('rn', 'en', 3)}, {_hops('rc', 'ek', 3)}, "
       + ", ".join(_contracts_sql(f"x{i}", "rc" if (v, p) == ("clouded", True) else "rn", k, v == "clouded", p) for i, (v, p, k) in enumerate(SWEEP)) + " "
       + " UNION ALL ".join(f"SELECT '{v}' AS view, {str(p).lower()} AS permissive, {k} AS k, node, c AS contracts, round(exposure, 6) AS exposure FROM x{i} WHERE node LIKE 'PLATFORM:%'" for i, (v, p, k) in enumerate(SWEEP)))
def exposure_sweep(spark, sf):
    """Every setting, reported for platforms."""
    g = Graph(spark, sf)
    return rounded(gr.exposure_sweep(g.population, g.deps, g.normal, g.clouded, g.platforms, [1, 2, 3]), 6)


@query(f"WITH {BASE}, {_hops('rn', 'en', 2)}, {_hops('rc', 'ek', 2)}, {_entities('xn', 'rn')}, {_entities('xc', 'rc')}, "
       "b AS (SELECT n.node, n.exposure AS normal, c.exposure AS clouded, rank() OVER (ORDER BY n.exposure DESC) AS normal_rank, rank() OVER (ORDER BY c.exposure DESC) AS clouded_rank, "
       "row_number() OVER (ORDER BY n.exposure DESC, n.node) AS pn, row_number() OVER (ORDER BY c.exposure DESC, n.node) AS pc FROM xn n JOIN xc c USING (node)), m AS (SELECT count(*) AS m FROM v) "
       "SELECT node, CASE WHEN node LIKE 'PLATFORM:%' THEN substr(node, 10) ELSE coalesce(label, node) END AS label, node LIKE 'PLATFORM:%' AS is_platform, round(normal, 6) AS normal, round(clouded, 6) AS clouded, "
       "CAST(round_even(normal * m, 0) AS BIGINT) AS normal_count, CAST(round_even(clouded * m, 0) AS BIGINT) AS clouded_count, round(clouded - normal, 6) AS delta, CAST(round_even((clouded - normal) * m, 0) AS BIGINT) AS delta_count, "
       "round(CASE WHEN normal > 0 THEN clouded / normal END, 6) AS ratio, CAST(normal_rank AS INTEGER) AS normal_rank, CAST(clouded_rank AS INTEGER) AS clouded_rank, pn <= 10 AS in_top_normal, pc <= 10 AS in_top_clouded "
       "FROM b LEFT JOIN lab USING (node), m WHERE pn <= 10 OR pc <= 10")  # fmt: skip
def barbell(spark, sf):
    g = Graph(spark, sf)
    n, c = kept(ex.entity_exposure(g.normal, g.nodes, 2)), kept(ex.entity_exposure(g.clouded, g.nodes, 2))
    return rounded(gr.barbell_table(n, c, g.labels, g.nodes.agg(F.count("*").alias("n")), 10), 6)


@query(f"WITH {BASE}, {_hops('r', 'en', 2)}, {_contracts_sql('xn', 'r', 2, False, False)}, {_contracts_sql('xc', 'r', 2, True, False)}, m AS (SELECT count(*) AS m FROM pop) "
       "SELECT substr(node, 10) AS platform, CAST(round_even(xn.exposure * m, 0) AS BIGINT) AS normal_count, CAST(round_even(xc.exposure * m, 0) AS BIGINT) AS clouded_count, round(xn.exposure * 100, 6) AS normal_pct, "
       "round(xc.exposure * 100, 6) AS clouded_pct, round((xc.exposure - xn.exposure) * 100, 6) AS hidden_pp, round(CASE WHEN xn.exposure > 0 THEN xc.exposure / xn.exposure END, 6) AS ratio FROM xn JOIN xc USING (node), m WHERE node LIKE 'PLATFORM:%'")  # fmt: skip
def platform_table(spark, sf):
    g = Graph(spark, sf)
    return rounded(gr.platform_table(g.contracts(2, False, nodes=g.platforms), g.contracts(2, True, nodes=g.platforms), g.population.agg(F.count("*").alias("n"))), 6)


@query(f"WITH {BASE}, {_hops('rn', 'en', 1)}, {_hops('rc', 'ek', 1)}, {_entities('xn', 'rn')}, {_entities('xc', 'rc')}, "
       "u AS (SELECT 'normal' AS view, * FROM xn UNION ALL SELECT 'clouded', * FROM xc) "
       "SELECT view, CAST(row_number() OVER (PARTITION BY view ORDER BY exposure DESC, node) AS INTEGER) AS place, node, CASE WHEN node LIKE 'PLATFORM:%' THEN substr(node, 10) ELSE coalesce(label, node) END AS label, node LIKE 'PLATFORM:%' AS is_platform, "
       "round(exposure, 6) AS exposure FROM u LEFT JOIN lab USING (node) QUALIFY place <= 15")  # fmt: skip
def leaderboards(spark, sf):
    g = Graph(spark, sf)
    return rounded(gr.leaderboards(kept(ex.entity_exposure(g.normal, g.nodes, 1)), kept(ex.entity_exposure(g.clouded, g.nodes, 1)), g.labels, 15), 6)


@query(f"WITH {BASE}, {_hops('rn', 'en', 2)}, {_hops('rc', 'ek', 2)} SELECT c.src AS node, CAST(c.hops AS INTEGER) AS hops, n.src IS NOT NULL AS in_normal FROM rc c LEFT JOIN rn n ON n.src = c.src AND n.dst = c.dst WHERE c.dst = 'PLATFORM:Azure'")
def ego_network(spark, sf):
    g = Graph(spark, sf)
    return ex.ego(g.normal, g.clouded, "PLATFORM:Azure", 2)


@query(f"WITH {BASE}, {_hops('r', 'en', 2)}, z AS (SELECT c, s, t FROM d), x AS (SELECT DISTINCT c FROM (SELECT c, s AS node, t AS at_ FROM z UNION ALL SELECT z.c, r.dst, z.t + r.hops FROM z JOIN r ON z.s = r.src) WHERE at_ <= 2 AND node = 'PLATFORM:AWS') "
       "SELECT c AS contract_id FROM x JOIN pop USING (c) WHERE n <> 'PLATFORM:AWS'")  # fmt: skip
def target_contracts(spark, sf):
    g = Graph(spark, sf)
    return gr.target_contracts(g.population, g.deps, g.normal, "PLATFORM:AWS", 2)


@query(f"WITH {BASE} SELECT node FROM v WHERE node NOT LIKE 'PLATFORM:%' AND node NOT IN (SELECT node FROM lab)")
def unlabelled_nodes(spark, sf):
    g = Graph(spark, sf)
    return gr.unlabelled(g.nodes, g.labels)


@query(f"WITH {BASE}, {_hops('r', 'ek', 2)}, {_entities('x', 'r')}, f AS (SELECT exposure FROM x WHERE node IN (SELECT dst FROM ek)), g AS (SELECT exposure AS e, row_number() OVER (ORDER BY exposure) AS i FROM f WHERE exposure > 0) "
       "SELECT count(*) AS n, (SELECT count(*) FROM x WHERE exposure = 0) AS zeros, round(max(exposure), 6) AS \"max\", round(quantile_cont(exposure, 0.95), 6) AS p95, round(avg(exposure), 6) AS mean, "
       "(SELECT round(2 * sum(i * e) / (count(*) * sum(e)) - (count(*) + 1.0) / count(*), 6) FROM g) AS gini, count(*) FILTER (exposure > 0.1) AS above_10_pct FROM f")  # fmt: skip
def exposure_summary(spark, sf):
    g = Graph(spark, sf)
    return rounded(ex.exposure_summary(kept(ex.entity_exposure(g.clouded, g.nodes, 2)), g.clouded), 6)
