"""From awards, subawards and attributed records to the dependency graph, its contracts and its reports.

Nodes are entity ids, or `PLATFORM:` and a platform's name, with which all ids of the platform's own companies are fused, so that
both views have the same nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.operators import exposure as ex
from undertow.operators.attribution import PLATFORMS, entity_platform

PREFIX = "PLATFORM:"
#: Aliases are platforms' own ids, few beside all ids; more than these are joined.
BROADCAST = 400_000
#: Tiers of a contract's direct dependencies: a subcontractor, a platform under the prime, a platform under a subcontract.
SUBCONTRACTOR, PLATFORM_OF_PRIME, PLATFORM_OF_SUB = 1, 1, 2


def name_pairs(primes: DataFrame, subs: DataFrame) -> DataFrame:
    """(uei, name, source): each distinct pair of an id and a name that stands beside it, with the first column pair that shows it.

    primes: entity, uei, parent_uei, contractor_name. subs: sub_uei, sub_name, prime_uei, prime_parent_uei, prime_name.
    """
    # whole rows first, each once, and their ids afterwards
    none = F.lit(None).cast("string")
    row = lambda place, *ueis, name: F.struct(F.lit(place).alias("place"), *[(none if u is None else F.col(u)).alias(f"u{i}") for i, u in enumerate(ueis)], F.col(name).alias("name"))
    a = primes.select(F.inline(F.array(row(0, "entity", "uei", "parent_uei", name="contractor_name"))))
    b = subs.select(F.inline(F.array(row(3, "sub_uei", None, None, name="sub_name"), row(4, "prime_uei", "prime_parent_uei", None, name="prime_name"))))
    rows = a.unionByName(b).filter("name is not null").distinct()
    pair = F.array(*[F.struct(F.col(f"u{i}").alias("uei"), F.col("name"), (F.col("place") + i).alias("source")) for i in range(3)])
    return rows.select(F.inline(pair)).filter("uei is not null").groupBy("uei", "name").agg(F.min("source").alias("source"))


def platform_alias(pairs: DataFrame) -> DataFrame:
    """(uei, node): ids whose name is a platform's; of several the first source's, then the first in order of the names."""
    named = pairs.withColumn("_p", entity_platform("name")).filter("_p is not null")
    return named.groupBy("uei").agg(F.concat(F.lit(PREFIX), F.min_by("_p", F.struct("source", "name"))).alias("node"))


def fuse(df: DataFrame, columns: list[str], alias: DataFrame) -> DataFrame:
    """The columns' ids, a platform's own ones by its node. Up to BROADCAST aliases go to every task, so that no row is shuffled."""
    small = alias.limit(BROADCAST + 1).count() <= BROADCAST
    for c in columns:
        a = alias.select(F.col("uei").alias("_uei"), F.col("node").alias("_node"))
        a = F.broadcast(a) if small else a
        df = df.join(a, df[c] == a["_uei"], "left").withColumn(c, F.coalesce("_node", c)).drop("_uei", "_node")
    return df


def entity_labels(pairs: DataFrame, alias: DataFrame) -> DataFrame:
    """(node, label): an entity's longest name; of equally long ones the first source's, then the first in order."""
    rest = pairs.join(alias.select("uei"), "uei", "left_anti")
    return rest.groupBy(F.col("uei").alias("node")).agg(F.min_by("name", F.struct(-F.length("name"), "source", "name")).alias("label"))


def label_of(node: str | Column, label: str | Column) -> Column:
    """A platform's name, an entity's label, else the id."""
    n = F.col(node) if isinstance(node, str) else node
    return F.when(n.startswith(PREFIX), F.substring(n, len(PREFIX) + 1, 1 << 20)).otherwise(F.coalesce(label, n))


def subaward_edges(subs: DataFrame, alias: DataFrame) -> DataFrame:
    """(src, dst), a row for a subaward: the prime's parent, or the prime, and the subcontractor; none to itself."""
    pairs = subs.select(F.coalesce("prime_parent_uei", "prime_uei").alias("src"), F.col("sub_uei").alias("dst")).filter("src is not null and dst is not null")
    return fuse(pairs, ["src", "dst"], alias).filter("src <> dst")


def contract_population(primes: DataFrame, alias: DataFrame) -> DataFrame:
    """(contract_id, performing_node, weight): one row for an award, its dollars without negative ones.

    An award listed more than once takes the row of the greatest dollars, then of the first entity."""
    p = primes.filter("award_id is not null").groupBy("award_id").agg(F.min_by(F.struct("entity", "dollars"), F.struct(-F.coalesce("dollars", F.lit(0.0)), "entity")).alias("_p"))
    p = p.select(F.col("award_id").alias("contract_id"), F.col("_p.entity").alias("performing_node"), F.greatest(F.coalesce("_p.dollars", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    return fuse(p, ["performing_node"], alias)


def entity_weights(records: DataFrame, alias: DataFrame) -> DataFrame:
    """(node, weight): the dollars that an entity holds, not below 0. One partial sum by id comes before the fusion."""
    held = records.filter("contractor is not null").groupBy(F.col("contractor").alias("node")).agg(F.sum("dollars").alias("dollars"))
    return fuse(held, ["node"], alias).groupBy("node").agg(F.greatest(F.coalesce(F.sum("dollars"), F.lit(0.0)), F.lit(0.0)).alias("weight"))


def record_platforms(final: str = "final_platform", mentions: str = "platform_mentions", known: list[str] = PLATFORMS) -> Column:
    """The known platforms of a record: its final one and those it mentions."""
    none = F.array().cast("array<string>")
    return F.array_intersect(F.array(*[F.lit(k) for k in known]), F.array_union(F.array(F.col(final)), F.coalesce(F.col(mentions), none)))


def contract_deps(records: DataFrame, alias: DataFrame) -> DataFrame:
    """(contract_id, dep_node, tier, kind): subcontractors (kind sub) and platforms of cloud records (kind cloud), each once."""
    r = records.filter("original_prime_id is not null")
    sub = F.col("record_type") == "subcontract"
    subs = r.filter(sub & F.col("contractor").isNotNull()).select(F.col("original_prime_id").alias("contract_id"), F.col("contractor").alias("dep_node"))
    subs = fuse(subs, ["dep_node"], alias).select("contract_id", "dep_node", F.lit(SUBCONTRACTOR).alias("tier"), F.lit("sub").alias("kind"))
    cloud = r.filter(F.coalesce("is_cloud", F.lit(False))).select(
        F.col("original_prime_id").alias("contract_id"), F.explode(F.transform(record_platforms(), lambda p: F.concat(F.lit(PREFIX), p))).alias("dep_node"),
        F.when(sub, PLATFORM_OF_SUB).otherwise(PLATFORM_OF_PRIME).alias("tier"), F.lit("cloud").alias("kind"),
    )
    return subs.unionByName(cloud).distinct()


def platform_nodes(spark: SparkSession, known: list[str] = PLATFORMS) -> DataFrame:
    """(node): every known platform."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(PREFIX + p) for p in known])).alias("node"))


def node_universe(population: DataFrame, edges: DataFrame, deps: DataFrame, known: list[str] = PLATFORMS) -> DataFrame:
    """(node): performers, ends of edges, dependencies and every platform, reached or not."""
    return ex.nodes_of(population.select("performing_node"), edges.select("src"), edges.select("dst"), deps.select("dep_node"), platform_nodes(population.sparkSession, known))


def clouded_edges(normal: DataFrame, records: DataFrame, alias: DataFrame) -> DataFrame:
    """The normal view's edges (src, dst, observations, kind) and one from each cloud record's entity to its platforms, of kind cloud.

    An edge of both kinds stays one, with its observations, of kind cloud."""
    c = records.filter(F.coalesce("is_cloud", F.lit(False)) & F.col("contractor").isNotNull())
    pairs = c.select(F.col("contractor").alias("src"), F.explode(F.transform(record_platforms(), lambda p: F.concat(F.lit(PREFIX), p))).alias("dst")).distinct()
    cloud = fuse(pairs, ["src"], alias).filter("src <> dst").select("src", "dst", F.lit(None).cast("long").alias("observations"), F.lit("cloud").alias("kind"))
    # only edges to platforms can be of both kinds
    of = F.col("dst").startswith(PREFIX)
    n = normal.select("src", "dst", "observations", "kind")
    both = n.filter(of).unionByName(cloud).groupBy("src", "dst").agg(F.max("observations").alias("observations"), F.min("kind").alias("kind"))
    return n.filter(~of).unionByName(both)


def view_edges(view: str, permissive: bool, normal: DataFrame, clouded: DataFrame) -> DataFrame:
    """The edges that a view walks: the clouded ones only in the permissive clouded view; else platforms come by contract alone."""
    if view not in ("normal", "clouded"):
        raise ValueError("view is normal or clouded")
    return clouded if view == "clouded" and permissive else normal


def target_contracts(population: DataFrame, deps: DataFrame, edges: DataFrame, target: str, k: int, permissive: bool = False, clouded: bool = True) -> DataFrame:
    """(contract_id): the contracts of others that depend on one node within k tiers, sought from the node backwards."""
    spark = population.sparkSession
    one = spark.range(1).select(F.lit(target).alias("node"))
    near = one.select("node", F.lit(0).alias("hops"))
    if k > 0:
        near = near.unionByName(ex.reach(edges, k, one).select(F.col("src").alias("node"), "hops"))
    used = deps if clouded else deps.filter("kind <> 'cloud'")
    seeds = used.select("contract_id", F.col("dep_node").alias("node"), "tier")
    if permissive:
        seeds = seeds.unionByName(population.select("contract_id", F.col("performing_node").alias("node"), F.lit(0).alias("tier")))
    hit = seeds.join(near, "node").filter(F.col("tier") + F.col("hops") <= k).select("contract_id").distinct()
    others = population.filter(~F.col("performing_node").eqNullSafe(F.lit(target))).select("contract_id")
    return hit.join(others, "contract_id", "left_semi")


def leaderboards(normal: DataFrame, clouded: DataFrame, labels: DataFrame, top: int = 15) -> DataFrame:
    """(view, place, node, label, is_platform, exposure): the top nodes of either view, one under the other."""
    both = ex.leaderboard(normal, top).withColumn("view", F.lit("normal")).unionByName(ex.leaderboard(clouded, top).withColumn("view", F.lit("clouded")))
    return both.join(labels, "node", "left").select("view", "place", "node", label_of("node", "label").alias("label"), F.col("node").startswith(PREFIX).alias("is_platform"), "exposure")


def barbell_table(normal: DataFrame, clouded: DataFrame, labels: DataFrame, size: DataFrame, top: int = 15) -> DataFrame:
    """The barbell with names, counts and the view that brought each node in. size: one row, n, what the shares are of."""
    inside = lambda v, n: v.orderBy(F.desc("exposure"), "node").limit(top).select("node", F.lit(True).alias(n))
    b = ex.barbell(normal, clouded, top).join(inside(normal, "in_top_normal"), "node", "left").join(inside(clouded, "in_top_clouded"), "node", "left").na.fill(False, ["in_top_normal", "in_top_clouded"])
    b = b.join(labels, "node", "left").crossJoin(F.broadcast(size.select(F.col("n").alias("_n"))))
    count = lambda c: F.rint(F.col(c) * F.col("_n")).cast("long")
    return b.select(
        "node", label_of("node", "label").alias("label"), F.col("node").startswith(PREFIX).alias("is_platform"), "normal", "clouded", count("normal").alias("normal_count"),
        count("clouded").alias("clouded_count"), "delta", count("delta").alias("delta_count"), "ratio", "normal_rank", "clouded_rank", "in_top_normal", "in_top_clouded",
    )


def platform_table(normal: DataFrame, clouded: DataFrame, size: DataFrame, known: list[str] = PLATFORMS) -> DataFrame:
    """By platform, counts and percents in both views, the hidden part in points, and the ratio (null where the normal view has none)."""
    nodes = [PREFIX + p for p in known]
    a = normal.filter(F.col("node").isin(nodes)).select("node", F.col("exposure").alias("a"))
    b = clouded.filter(F.col("node").isin(nodes)).select("node", F.col("exposure").alias("b"))
    t = a.join(b, "node", "left").na.fill(0.0, ["b"]).crossJoin(F.broadcast(size.select(F.col("n").alias("_n"))))
    x, y = F.col("a"), F.col("b")
    return t.select(
        label_of("node", F.lit(None).cast("string")).alias("platform"), F.rint(x * F.col("_n")).cast("long").alias("normal_count"), F.rint(y * F.col("_n")).cast("long").alias("clouded_count"),
        (x * 100).alias("normal_pct"), (y * 100).alias("clouded_pct"), ((y - x) * 100).alias("hidden_pp"), F.when(x > 0, y / x).alias("ratio"),
    )


def unlabelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node): entities without a name."""
    return nodes.filter(~F.col("node").startswith(PREFIX)).join(labels, "node", "left_anti")


def exposure_sweep(population: DataFrame, deps: DataFrame, normal: DataFrame, clouded: DataFrame, nodes: DataFrame, depths: list[int]) -> DataFrame:
    """(view, permissive, k, node, contracts, exposure): contract exposure under every setting.

    A few nodes are sought backwards, once for either graph, and every depth is counted in one pass."""
    few = ex.few_nodes(nodes)
    graphs = {view: view_edges(view, True, normal, clouded) for view in ("normal", "clouded")}
    hops = {v: ex.target_hops(e, few, max(depths)) for v, e in graphs.items()} if few else {}
    out = None
    for view in ("normal", "clouded"):
        for permissive in (False, True):
            walked = "clouded" if view == "clouded" and permissive else "normal"
            if few:
                some = [ex.contract_depths(population, deps, hops[walked], few, depths, permissive, view == "clouded")]
            else:
                some = [ex.contract_exposure(population, deps, graphs[walked], nodes, k, permissive, clouded=view == "clouded").withColumn("k", F.lit(k)) for k in depths]
            for one in some:
                one = one.select(F.lit(view).alias("view"), F.lit(permissive).alias("permissive"), "k", "node", "contracts", "exposure")
                out = one if out is None else out.unionByName(one)
    return out
