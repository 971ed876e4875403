"""Exposure with hubs against plain Python: the same results, but ways over hubs are never listed in pairs."""

import random

import pytest

from undertow.operators import exposure as ex
from undertow.session import kept

TWO_HUBS = [("p", "h"), ("q", "h"), ("h", "x"), ("q", "g"), ("g", "x"), ("g", "q"), ("x", "h"), ("p", "x")]


def graph(seed, n=14, m=34):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((f"n{rng.randrange(n)}", f"n{min(rng.randrange(n), rng.randrange(n))}") for _ in range(m)) if a != b})


def hops(edges, k):
    out = {}
    for start in {x for e in edges for x in e}:
        front, seen = {start}, {start}
        for h in range(1, k + 1):
            front = {b for a, b in edges if a in front} - seen
            seen |= front
            out |= {(start, b): h for b in front}
    return out


@pytest.mark.parametrize(("edges", "k"), [(TWO_HUBS, 2), (graph(1), 2), (graph(2), 3)])
def test_entities(spark, edges, k):
    e, nodes = spark.createDataFrame(edges, "src string, dst string"), sorted({x for p in edges for x in p} | {"alone"})
    v = spark.createDataFrame([(n,) for n in nodes], "node string")
    weights = {n: float(i % 4) for i, n in enumerate(nodes)}
    w = spark.createDataFrame(sorted(weights.items()), "node string, weight double")
    want = hops(edges, k)
    for heavy in (0, 12, 10**9):
        got = {r.node: r.dependents for r in ex.entity_exposure(e, v, k, heavy=heavy).collect()}
        assert got == {n: sum(d == n for _, d in want) for n in nodes}
        got = {r.node: r.dependents for r in ex.entity_exposure(e, v, k, w, heavy=heavy).collect()}
        assert got == {n: sum(weights[s] for s, d in want if d == n) for n in nodes}


@pytest.mark.parametrize(("seed", "k"), [(3, 2), (4, 3)])
def test_contracts(spark, seed, k):
    rng, edges = random.Random(seed), graph(seed)
    names = sorted({x for p in edges for x in p})
    pop = [(f"c{i}", rng.choice([*names, None, "alone"]), float(i % 3)) for i in range(25)]
    deps = [(f"c{rng.randrange(27)}", rng.choice([*names, "out"]), rng.randrange(4), rng.choice(["sub", "cloud"])) for _ in range(50)]
    p = spark.createDataFrame(pop, "contract_id string, performing_node string, weight double")
    d, e = spark.createDataFrame(deps, "contract_id string, dep_node string, tier int, kind string"), spark.createDataFrame(edges, "src string, dst string")
    v = spark.createDataFrame([(n,) for n in [*names, "out", "alone"]], "node string")
    far = hops(edges, k) | {(n, n): 0 for n in [*names, "out", "alone"]}
    for permissive, clouded, weights in ((False, True, None), (True, True, None), (True, False, p), (False, True, p)):
        want = dict.fromkeys([*names, "out", "alone"], 0.0)
        for c, own, w in pop:
            seeds = {(s, t) for c2, s, t, kind in deps if c2 == c and (clouded or kind != "cloud")} | ({(own, 0)} if permissive and own else set())
            for n in {b for (a, b), h in far.items() for s, t in seeds if a == s and t + h <= k} - {own}:
                want[n] += 1.0 if weights is None else w
        for heavy in (None, 0, 12, 10**9):  # None: the few nodes backwards
            got = {r.node: r.contracts for r in ex.contract_exposure(p, d, e, v, k, permissive, clouded, weights, heavy=heavy).collect()}
            assert got == want, (permissive, clouded, heavy)


def test_ways_over_a_hub_are_not_listed(spark):
    """400 sources and 400 ends of one hub: 160,000 pairs, none of them a row."""
    e = kept(spark.range(400).selectExpr("concat('s', id) AS src", "'hub' AS dst").unionByName(spark.range(400).selectExpr("'hub' AS src", "concat('d', id) AS dst")))
    assert ex._Walk(e, 2).ways(2, final=True).count() == 0
    got = {r.node: r.dependents for r in ex.entity_exposure(e, ex.nodes_of(e.select("src"), e.select("dst")), 2).collect()}
    assert got["hub"] == 400 and got["d7"] == 401 and got["s7"] == 0


def test_target_backwards(spark):
    e = spark.createDataFrame(graph(5), "src string, dst string")
    t = spark.createDataFrame([("n1",), ("n3",)], "node string")
    want = {(a, b): h for (a, b), h in hops(graph(5), 3).items() if b in ("n1", "n3")}
    assert {(r.src, r.dst): r.hops for r in ex.reach(e, 3, t).collect()} == want
    assert {(r.src, r.dst): r.hops for r in ex.reach(e, 3).collect()} == hops(graph(5), 3)
