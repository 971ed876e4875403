"""Bounded-depth dependency exposure over a directed entity graph."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.session import kept

#: A node is a hub if its predecessors times its successors are more; ways over hubs are counted by class, never listed.
HEAVY = 100_000
#: At most this many hubs, the heaviest: more would make too many classes. Ways over other nodes are listed in pairs.
MAX_HUBS = 8
#: Up to this many nodes asked for are sought backwards, as bits of one number.
FEW = 62


def edges_of(pairs: DataFrame, kind: str = "sub") -> DataFrame:
    """(src, dst, observations, kind): distinct edges without self loops."""
    return pairs.filter("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("observations")).withColumn("kind", F.lit(kind))


def nodes_of(*columns: DataFrame) -> DataFrame:
    """(node): the union of one-column frames."""
    out = None
    for c in columns:
        one = c.select(F.col(c.columns[0]).alias("node"))
        out = one if out is None else out.unionByName(one)
    return out.filter("node is not null").distinct()


def _bit(column: str, hubs: list) -> Column:
    """The hub's bit, 0 for other nodes and null."""
    return reduce(Column.bitwiseOR, [F.when(F.col(column) == h, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, h in enumerate(hubs)], F.lit(0).cast("long"))


def _any(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda x, y: x | y, [a.bitwiseAND(b) != 0 for a, b in pairs], F.lit(False))


def _hub_hops(edges: DataFrame, k: int, hubs: list, near: str = "src", far: str = "dst", out: str = "a") -> DataFrame:
    """(node, a1 to ak): the bits of the hubs that a node reaches within 1 to k hops; with near and far changed over, that reach it.

    A round is one row a node, however many ways there are."""
    m = kept(edges.select(F.col(near).alias("node"), _bit(far, hubs).alias("_m")).filter("_m <> 0").groupBy("node").agg(F.bit_or("_m").alias(f"{out}1")))
    for h in range(2, k + 1):
        last = f"{out}{h - 1}"
        step = edges.join(m.select(F.col("node").alias(far), F.col(last).alias("_m")), far).groupBy(F.col(near).alias("node")).agg(F.bit_or("_m").alias("_m"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        m = kept(m.join(step, "node", "full").select("node", *[zero(f"{out}{i}").alias(f"{out}{i}") for i in range(1, h)], zero(last).bitwiseOR(zero("_m")).alias(f"{out}{h}")))
    return m


class _Walk:
    """A graph's nodes numbered, and what they have to do with its hubs.

    nodes: (node, code, n_in, n_out, a0 to ak, b1 to bk): bits of the hubs that a node reaches within so many hops, and that reach it.
    A way of h hops over a hub shows in the two nodes' bits alone; the other ways are listed, but only if no way over a hub is as short."""

    def __init__(self, edges: DataFrame, k: int, *more: DataFrame, heavy: int | None = None):
        self.k = k
        e = edges.select("src", "dst").filter("src <> dst")
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        rows = e.select(F.inline(F.array(F.struct(F.col("src").alias("node"), none.alias("i"), one.alias("o")), F.struct(F.col("dst").alias("node"), one.alias("i"), none.alias("o")))))
        for c in more:
            rows = rows.unionByName(c.select(F.col(c.columns[0]).alias("node"), none.alias("i"), none.alias("o")).filter("node is not null"))
        n = kept(rows.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).withColumn("code", F.monotonically_increasing_id()))
        weight = F.col("n_in") * F.greatest("n_out", one)
        self.hubs = [r.node for r in n.filter(weight > (HEAVY if heavy is None else heavy)).orderBy(weight.desc(), "node").limit(MAX_HUBS).collect()]
        self.a, self.b = [f"a{i}" for i in range(k + 1)], [f"b{i}" for i in range(1, k + 1)]
        if self.hubs:
            n = n.join(_hub_hops(e, k, self.hubs), "node", "left").join(_hub_hops(e, k, self.hubs, "dst", "src", "b"), "node", "left")
        else:
            n = n.select("*", *[none.alias(c) for c in self.a[1:] + self.b])
        self.nodes = kept(n.withColumn("a0", _bit("node", self.hubs)).na.fill(0, self.a + self.b))
        self.edges = e

    def over_hub(self, h: int, start: list[str] | None = None) -> Column:
        """Whether a row's a-bits (or those named, from 0 hops on) and b-bits show a way of at most h hops over a hub."""
        a = start or self.a
        return _any([(F.col(a[i]), F.col(f"b{h - i}")) for i in range(h)])

    def ways(self, k: int, weights: DataFrame | None = None, final: bool = False) -> DataFrame:
        """(src, dst, hops, _w, b1 to bk) in numbers: ways of at most k hops over no hub, where none over a hub is as short.

        final: where none over a hub has at most k hops. weights: (code, _w) of sources, else 1."""
        plain = self.nodes.filter("a0 = 0")
        start = plain.select(F.col("node").alias("_s"), F.col("code").alias("_src"), *self.a)
        if weights is not None:
            # a source without weight still passes weight on
            start = start.join(weights.select(F.col("code").alias("_src"), "_w"), "_src", "left")
        end = plain.select(F.col("node").alias("_d"), F.col("code").alias("_dst"), *self.b, F.col("n_out").alias("_on"))
        w = F.col("_w") if weights is not None else F.lit(1.0).alias("_w")
        e = self.edges.join(start, F.col("src") == F.col("_s")).join(end, F.col("dst") == F.col("_d"))
        e = e.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), F.lit(1).alias("hops"), w, *self.a, *self.b, "_on")
        e = kept(e) if k > 1 else e.dropDuplicates(["src", "dst"])
        first = e.filter("_on > 0").select("src", F.col("dst").alias("_mid"), "_w", *self.a)
        seen = front = e
        for h in range(2, k + 1):
            step = first.join(front.select(F.col("src").alias("_mid"), "dst", *self.b, "_on"), "_mid").filter("src <> dst")
            step = step.filter(~self.over_hub(k if final and h == k else h)).select("src", "dst", F.lit(h).alias("hops"), "_w", *self.a, *self.b, "_on")
            if h == k and final:
                seen = seen.filter(~self.over_hub(k))
            same = [F.first(c).alias(c) for c in ["_w", *self.b] + ([*self.a, "_on"] if h < k else [])]
            seen = seen.unionByName(step).groupBy("src", "dst").agg(F.min("hops").alias("hops"), *same)
            if h < k:
                # one round is written once: a lost executor costs a round
                seen = kept(seen)
                front = seen.filter(F.col("hops") == h)
        out = seen if k > 1 or not final else seen.filter(~self.over_hub(k))
        return (out.filter("_w is not null") if weights is not None else out).select("src", "dst", "hops", "_w", *self.b)

    def by_class(self, held: DataFrame, start: list[str]) -> DataFrame:
        """(code, got): by node that is no hub, the weight _w of held rows whose bits show a way over a hub; few classes of bits meet."""
        have = held.filter(" or ".join(f"{c} <> 0" for c in start)).groupBy(*start).agg(F.sum("_w").alias("_w"))
        want = self.nodes.filter("a0 = 0").select("code", *self.b)
        met = want.select(*self.b).distinct().crossJoin(F.broadcast(have)).filter(self.over_hub(self.k, start)).groupBy(*self.b).agg(F.sum("_w").alias("got"))
        return want.join(F.broadcast(met), self.b).select("code", "got")

    def named(self, *parts: DataFrame) -> DataFrame:
        """(node, got): the sum of the parts' (code, got)."""
        all_ = reduce(DataFrame.unionByName, [p.select("code", "got") for p in parts]).groupBy("code").agg(F.sum("got").alias("got"))
        return all_.join(self.nodes.select("node", "code"), "code").select("node", "got")


def _by_target(held: DataFrame, bits: str, own: str, targets: list) -> DataFrame:
    """(node, got): by target, the weight _w of the rows that have its bit and are not its own."""
    total = lambda i, t: F.sum(F.when((F.col(bits).bitwiseAND(F.lit(1 << i).cast("long")) != 0) & ~F.col(own).eqNullSafe(F.lit(t)), F.col("_w")))
    one = held.agg(*[total(i, t).alias(f"t{i}") for i, t in enumerate(targets)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("node"), F.col(f"t{i}").alias("got")) for i, t in enumerate(targets)]))).filter("got is not null")


def reach(edges: DataFrame, k: int, targets: DataFrame | None = None) -> DataFrame:
    """(src, dst, hops): the fewest hops from src to dst, 1 to k, each pair listed; entity_exposure counts pairs without listing them.

    targets: where given, only paths that end there are followed, from the end backwards; a few of them as bits, one row a node."""
    e = edges.select("src", "dst").filter("src <> dst").distinct()
    if targets is not None:
        few = [r.node for r in targets.filter("node is not null").distinct().limit(FEW + 1).collect()]
        if not few:
            return e.limit(0).withColumn("hops", F.lit(1))
        if len(few) <= FEW:
            at = lambda i: F.coalesce(*[F.when(F.col(f"a{h}").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(h)) for h in range(1, k + 1)])
            rows = _hub_hops(e, k, few).select(F.col("node").alias("src"), F.inline(F.array(*[F.struct(F.lit(t).alias("dst"), at(i).alias("hops")) for i, t in enumerate(few)])))
            return rows.filter("hops is not null and src <> dst")
    if k > 1:
        e = kept(e)
    seen = (e.join(targets.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst") if targets is not None else e).withColumn("hops", F.lit(1))
    for h in range(2, k + 1):
        front = seen.filter(F.col("hops") == h - 1).select(F.col("src").alias("mid"), "dst")
        step = e.select("src", F.col("dst").alias("mid")).join(front, "mid").filter("src <> dst").select("src", "dst", F.lit(h).alias("hops"))
        seen = seen.unionByName(step).groupBy("src", "dst").agg(F.min("hops").alias("hops"))
        if h < k:
            # one round is written once: a lost executor costs a round
            seen = kept(seen)
    return seen


def _shares(nodes: DataFrame, got: DataFrame, name: str, size: DataFrame) -> DataFrame:
    """(node, name, exposure): the sum of got by node, 0 where there is none, and its share of the size."""
    out = nodes.join(got.groupBy("node").agg(F.sum("got").alias(name)), "node", "left").na.fill(0.0, [name]).crossJoin(F.broadcast(size))
    return out.select("node", name, F.coalesce(F.try_divide(name, "_size"), F.lit(0.0)).alias("exposure"))


def entity_exposure(edges: DataFrame, nodes: DataFrame, k: int, weights: DataFrame | None = None, heavy: int | None = None) -> DataFrame:
    """(node, dependents, exposure): the share of other nodes (or of all weight) that reach the node within k hops."""
    if k == 1:
        e = edges.select("src", "dst").filter("src <> dst").distinct()
        w = None if weights is None else nodes.join(weights, "node", "left").select("node", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("_w"))
        size = nodes.agg((F.count("*") - 1).cast("double").alias("_size")) if w is None else w.agg(F.sum("_w").alias("_size"))
        e = e.withColumn("_w", F.lit(1.0)) if w is None else e.join(w.withColumnRenamed("node", "src"), "src")
        return _shares(nodes, e.groupBy(F.col("dst").alias("node")).agg(F.sum("_w").alias("got")), "dependents", size)
    g = _Walk(edges, k, heavy=heavy)
    if weights is None:
        by_code, sources = None, g.nodes.filter("n_out > 0").withColumn("_w", F.lit(1.0))
        size = nodes.agg((F.count("*") - 1).cast("double").alias("_size"))
    else:
        w = kept(nodes.join(weights, "node", "left").select("node", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight")))
        sources = g.nodes.filter("n_out > 0").join(w.select("node", F.col("weight").alias("_w")).filter("_w > 0"), "node")
        by_code, sources = sources.select("code", "_w"), sources
        size = w.agg(F.sum("weight").alias("_size"))
    got = g.named(g.ways(k, by_code, final=True).groupBy(F.col("dst").alias("code")).agg(F.sum("_w").alias("got")))
    if g.hubs:
        start = g.a[:-1]
        itself = sources.filter("a0 = 0").filter(g.over_hub(k)).select("code", (-F.col("_w")).alias("got"))
        got = got.unionByName(g.named(g.by_class(sources, start), itself)).unionByName(_by_target(sources, f"a{k}", "node", g.hubs))
    return _shares(nodes, got, "dependents", size)


def _weighed(population: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(contract_id, own, _w)."""
    pop = population.select("contract_id", F.col("performing_node").alias("own"))
    if weights is None:
        return pop.withColumn("_w", F.lit(1.0))
    return pop.join(weights.select("contract_id", F.col("weight").alias("_w")), "contract_id", "left").withColumn("_w", F.greatest(F.coalesce("_w", F.lit(0.0)), F.lit(0.0)))


def _tiers(pop: DataFrame, seeds: DataFrame, hops: DataFrame, hubs: list, k: int, permissive: bool) -> DataFrame:
    """Adds t0 to tk to pop: bits of the hubs that a contract reaches within so many tiers. seeds: contract_id, src, tier; hops: node, a1 to ak."""
    zero = F.lit(0).cast("long")

    def bits(node: str, t: int, tier: Column) -> Column:
        here = F.when(tier <= t, _bit(node, hubs)).otherwise(zero)
        return reduce(Column.bitwiseOR, [F.when(tier == t - h, F.coalesce(f"a{h}", zero)).otherwise(zero) for h in range(1, t + 1)], here)

    names = [f"t{t}" for t in range(k + 1)]
    s = seeds.filter(F.col("tier").between(0, k)).join(hops.withColumnRenamed("node", "src"), "src", "left")
    s = s.select("contract_id", *[bits("src", t, F.col("tier")).alias(f"t{t}") for t in range(k + 1)]).filter(f"t{k} <> 0")
    out = pop.join(s.groupBy("contract_id").agg(*[F.bit_or(c).alias(c) for c in names]), "contract_id", "left").na.fill(0, names)
    if permissive:
        out = out.join(hops.withColumnRenamed("node", "own"), "own", "left")
        out = out.select(*pop.columns, *[F.col(f"t{t}").bitwiseOR(bits("own", t, F.lit(0))).alias(f"t{t}") for t in range(k + 1)])
    return out


def _seeds(deps: DataFrame, clouded: bool) -> DataFrame:
    d = deps if clouded else deps.filter("kind <> 'cloud'")
    return d.select("contract_id", F.col("dep_node").alias("src"), "tier")


def few_nodes(nodes: DataFrame) -> list | None:
    """The nodes, if they are few enough to be bits of one number."""
    few = [r.node for r in nodes.select("node").filter("node is not null").distinct().limit(FEW + 1).collect()]
    return few if len(few) <= FEW else None


def contract_depths(population: DataFrame, deps: DataFrame, hops: DataFrame, targets: list, depths: list[int], permissive: bool = False, clouded: bool = True, weights: DataFrame | None = None) -> DataFrame:
    """(k, node, contracts, exposure) of a few nodes at every depth, sought backwards. hops: target_hops() up to the greatest depth."""
    t = _tiers(_weighed(population, weights), _seeds(deps, clouded), hops, targets, max(depths), permissive)
    total = lambda k, i, n: F.sum(F.when((F.col(f"t{k}").bitwiseAND(F.lit(1 << i).cast("long")) != 0) & ~F.col("own").eqNullSafe(F.lit(n)), F.col("_w")))
    sums = {(k, i): total(k, i, n).alias(f"s{k}_{i}") for k in depths for i, n in enumerate(targets)}
    one = t.agg(F.sum("_w").alias("_size"), *sums.values())
    got = one.select("_size", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(targets[i]).alias("node"), F.coalesce(f"s{k}_{i}", F.lit(0.0)).alias("contracts")) for k, i in sums])))
    return got.select("k", "node", "contracts", F.coalesce(F.try_divide("contracts", "_size"), F.lit(0.0)).alias("exposure"))


def target_hops(edges: DataFrame, targets: list, k: int) -> DataFrame:
    """(node, a1 to ak): bits of the targets that a node reaches within 1 to k hops."""
    return _hub_hops(edges.select("src", "dst").filter("src <> dst").distinct(), k, targets)


def contract_exposure(population: DataFrame, deps: DataFrame, edges: DataFrame, nodes: DataFrame, k: int, permissive: bool = False, clouded: bool = True, weights: DataFrame | None = None,
                      heavy: int | None = None) -> DataFrame:
    """(node, contracts, exposure): contracts that depend on the node within k tiers, without those it performs itself.

    A dependency of tier t reaches nodes t + hops tiers away. permissive: the performing node starts at tier 0 as well.
    Without clouded, dependencies of kind cloud don't count. What a contract reaches over hubs is counted by class of contracts, the
    rest by contract; what its performer reaches, by performer. A few nodes are sought backwards, unless heavy is given."""
    few = few_nodes(nodes) if heavy is None else None
    if few:
        got = contract_depths(population, deps, target_hops(edges, few, k), few, [k], permissive, clouded, weights)
        return nodes.join(F.broadcast(got), "node").select("node", "contracts", "exposure")
    seeds = _seeds(deps, clouded).groupBy("contract_id", "src").agg(F.min("tier").alias("tier")).filter(F.col("tier").between(0, k))
    pop = _weighed(population, weights)
    g = _Walk(edges, k, seeds.select("src"), pop.select("own"), heavy=heavy)
    held = _tiers(pop, seeds, g.nodes.select("node", *g.a[1:]), g.hubs, k, permissive)
    mine = g.nodes.select(F.col("node").alias("own"), F.col("code").alias("_own"), F.col("a0").alias("_hub"), *g.b)
    held = kept(held.join(mine, "own", "left"))
    tiers = [f"t{t}" for t in range(k)]
    first = seeds.agg(F.min("tier")).first()[0]
    far = 0 if first is None else k - first
    own_ways = kept(g.ways(k)) if permissive else None
    near = own_ways if permissive else g.ways(far) if far > 0 else None
    bits = g.nodes.filter("a0 = 0").select(F.col("node").alias("src"), F.col("code").alias("_src"), *g.b)
    s = seeds.join(bits, "src").join(held.select("contract_id", "_own", "_w", *tiers), "contract_id").drop("src")
    if permissive:
        # what the performer reaches by then, leads to nothing that the performer doesn't reach
        own = own_ways.select(F.col("src").alias("_o"), F.col("dst").alias("_x"), F.col("hops").alias("_h"))
        s = s.join(own, (F.col("_own") == F.col("_o")) & (F.col("_src") == F.col("_x")) & (F.col("_h") <= F.col("tier")), "left_anti")
        s = kept(s)
    cols = ["contract_id", "_own", "_w", *tiers]
    exposed = s.select(*cols, F.col("_src").alias("code"), *g.b)
    if near is not None and far > 0:
        on = near.select(F.col("src").alias("_src"), F.col("dst").alias("code"), "hops", *g.b)
        exposed = exposed.unionByName(s.drop(*g.b).join(on, "_src").filter(F.col("tier") + F.col("hops") <= k).select(*cols, "code", *g.b))
    exposed = exposed.filter(~F.col("code").eqNullSafe(F.col("_own"))).filter(~g.over_hub(k, tiers))
    if permissive:
        exposed = exposed.join(own_ways.select(F.col("src").alias("_own"), F.col("dst").alias("code")), ["_own", "code"], "left_anti")
    parts = [exposed.groupBy("contract_id", "code").agg(F.first("_w").alias("_w")).groupBy("code").agg(F.sum("_w").alias("got"))]
    if permissive:
        # what a performer reaches, all its contracts reach: counted by performer and class, not by contract
        by = held.filter("_own is not null").groupBy(F.col("_own").alias("src"), *tiers).agg(F.sum("_w").alias("_w"))
        parts.append(own_ways.drop("_w").join(by, "src").filter(~g.over_hub(k, tiers)).groupBy(F.col("dst").alias("code")).agg(F.sum("_w").alias("got")))
    if g.hubs:
        parts.append(g.by_class(held, tiers))
        parts.append(held.filter("_hub = 0").filter(g.over_hub(k, tiers)).groupBy(F.col("_own").alias("code")).agg((-F.sum("_w")).alias("got")))
    got = g.named(*parts)
    if g.hubs:
        got = got.unionByName(_by_target(held, f"t{k}", "own", g.hubs))
    return _shares(nodes, got, "contracts", held.agg(F.sum("_w").alias("_size")))


def _rank_among(view: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, rank) of chosen (node, exposure) rows, few and gathered into one row: one more than the view's greater exposures."""
    marks = chosen.agg(F.sort_array(F.collect_set("exposure")).alias("_marks"))
    below = view.crossJoin(F.broadcast(marks)).select(F.explode(F.filter("_marks", lambda m: m < F.col("exposure"))).alias("exposure"))
    return chosen.join(below.groupBy("exposure").agg(F.count("*").alias("_above")), "exposure", "left").select("node", (F.coalesce("_above", F.lit(0)) + 1).cast("int").alias("rank"))


def barbell(normal: DataFrame, clouded: DataFrame, top: int) -> DataFrame:
    """Nodes in the top of either view with both values, their difference and ratio, and ranks over the full views.

    At most 2 * top nodes are chosen, so what ranks them is small; the views themselves are never sorted whole."""
    first = lambda v: v.orderBy(F.desc("exposure"), "node").limit(top).select("node")
    chosen = first(normal).unionByName(first(clouded)).distinct()
    ranked = lambda v, n: (lambda own: own.join(_rank_among(v, own), "node").select("node", F.col("exposure").alias(n), F.col("rank").alias(f"{n}_rank")))(v.select("node", "exposure").join(chosen, "node", "left_semi"))
    both = ranked(normal, "normal").join(ranked(clouded, "clouded"), "node", "outer")
    return both.select("node", "normal", "clouded", (F.col("clouded") - F.col("normal")).alias("delta"), F.try_divide("clouded", "normal").alias("ratio"), "normal_rank", "clouded_rank")


def leaderboard(view: DataFrame, top: int) -> DataFrame:
    """(place, node, exposure) of the top nodes; ties by node."""
    first = view.orderBy(F.desc("exposure"), "node").limit(top)
    return first.select(F.row_number().over(Window.orderBy(F.desc("exposure"), "node")).alias("place"), "node", "exposure")


def exposure_summary(view: DataFrame, edges: DataFrame) -> DataFrame:
    """Over nodes that something depends on: n, max, 95th percentile, mean, Gini of positive values, nodes above 10 %; zeros over all nodes.

    The Gini coefficient needs no order of nodes: equal values are counted first, and only distinct values are sorted."""
    v = view.select("node", "exposure").join(edges.select(F.col("dst").alias("node")).distinct().withColumn("_in", F.lit(True)), "node", "left")
    inside = F.col("_in").isNotNull()
    value = F.when(inside, F.col("exposure"))
    by = v.filter(inside & (F.col("exposure") > 0)).groupBy("exposure").agg(F.count("*").alias("m"))
    run = Window.orderBy("exposure").rowsBetween(Window.unboundedPreceding, -1)
    placed = by.withColumn("_places", F.col("m") * F.coalesce(F.sum("m").over(run), F.lit(0)) + F.col("m") * (F.col("m") + 1) / 2)
    n, total = F.sum("m"), F.sum(F.col("m") * F.col("exposure"))
    gini = placed.agg(F.coalesce(2 * F.sum(F.col("_places") * F.col("exposure")) / (n * total) - (n + 1) / n, F.lit(0.0)).alias("gini"))
    out = v.agg(
        F.count(value).alias("n"), F.sum((F.col("exposure") == 0).cast("long")).alias("zeros"), F.max(value).alias("max"), F.percentile(value, F.lit(0.95)).alias("p95"),
        F.avg(value).alias("mean"), F.coalesce(F.sum((value > 0.1).cast("long")), F.lit(0)).alias("above_10_pct"),
    )
    return out.crossJoin(F.broadcast(gini))


def ego(edges_normal: DataFrame, edges_clouded: DataFrame, target: str, k: int) -> DataFrame:
    """(node, hops, in_normal): who depends on the target within k hops, and whether the normal view shows it."""
    spark = edges_clouded.sparkSession
    t = spark.range(1).select(F.lit(target).alias("node"))
    full = reach(edges_clouded, k, t).select(F.col("src").alias("node"), "hops")
    seen = reach(edges_normal, k, t).select(F.col("src").alias("node"), F.lit(True).alias("in_normal"))
    return full.join(seen, "node", "left").na.fill(False, ["in_normal"])


def annulus_layout(members: DataFrame, node: str, distance: str, visible: str, by: tuple[str, ...] = (), hole: float = 0.52, density: float = 27.4) -> DataFrame:
    """Adds x and y: visible nodes inside, nearer ones first, at one density outside a hole, each a golden angle on.

    Bands at one density that start where the last one ends are one spiral, so that a node's place alone gives its radius.
    """
    golden = math.pi * (3 - math.sqrt(5))
    w = Window.partitionBy(*[F.col(c) for c in by]).orderBy(F.coalesce(F.col(visible), F.lit(False)).cast("int").desc(), distance, F.col(node).cast("string"))
    place = F.row_number().over(w) - 1
    radius, angle = F.sqrt(F.lit(hole * hole) + (F.col("_place") + 0.5) / (math.pi * density)), F.col("_place") * golden
    return members.withColumn("_place", place).withColumn("x", radius * F.cos(angle)).withColumn("y", radius * F.sin(angle)).drop("_place")
