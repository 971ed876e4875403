"""The graph operators and their registered queries against plain Python over small tables of our own."""

import random

from undertow.operators import exposure as ex
from undertow.operators import graph as gr
from undertow.plans import graph_queries as gq

PLATFORM = gr.PREFIX


def tables(spark, folder):
    rng = random.Random(5)
    orders = [(k, rng.randrange(120), 10.0 * k) for k in range(1, 61)]
    items = [(rng.randrange(1, 61), rng.randrange(1, 4), rng.choice([0, 1, 2, 3, 20, 40, 60]), rng.randrange(40), 5.0, rng.choice("ANR"), float(rng.randrange(1, 50))) for _ in range(90)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    names = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double, l_returnflag string, l_quantity double"
    spark.createDataFrame(items, names).write.parquet(f"{folder}/lineitem.parquet")
    return orders, items


def reached(edges, k):
    """{(src, dst): hops} by breadth-first search from every node."""
    out = {}
    for start in {a for a, _ in edges}:
        front, seen = {start}, {start}
        for h in range(1, k + 1):
            front = {b for a, b in edges if a in front} - seen
            seen |= front
            out |= {(start, b): h for b in front}
    return out


def test_exposure_queries_read_every_row(spark, tmp_path):
    orders, items = tables(spark, tmp_path)
    sf = str(tmp_path)
    supplier = {1: "Azure", 2: "AWS"}
    sub = lambda s: f"S{s}" if s % 20 else f"E{s}"
    alias = {sub(s): supplier[s % 19] for _, _, s, *_ in items if s % 19 in supplier}
    entity = {}
    for k, c, _ in orders:
        entity[k] = f"E{c // 2}" if c % 13 else f"E{c}"
    for c in {c for _, c, _ in orders if c % 101 == 1}:
        for e in {f"E{c}", *([f"E{c // 2}"] if c % 13 else [])}:
            alias[e] = "Oracle Cloud"
    node = lambda e: PLATFORM + alias[e] if e in alias else e
    normal = {(node(entity[o]), node(sub(s))) for o, _, s, *_ in items}
    normal = {(a, b) for a, b in normal if a != b}
    deps, cloud = set(), set()
    for o, line, s, part, _, flag, quantity in items:
        who = node(sub(s)) if line > 1 else node(entity[o])
        if line > 1:
            deps.add((o, who, 1))
        found = ({"AWS"} if part % 4 == 0 else {"Azure"} if part % 4 == 1 else set()) | ({"AWS", "Google Cloud"} if quantity > 40 else set())
        for p in found if flag != "N" else ():
            deps.add((o, PLATFORM + p, 2 if line > 1 else 1))
            if who != PLATFORM + p:
                cloud.add((who, PLATFORM + p))
    full = normal | cloud
    nodes = {node(e) for e in entity.values()} | {x for e in normal for x in e} | {d for _, d, _ in deps} | {PLATFORM + p for p in gr.PLATFORMS}

    got = {(r.src, r.dst) for r in gq.clouded_graph(spark, sf).collect()}
    assert got == full
    hops = reached(full, 2)
    want = {n: sum(d == n for _, d in hops) for n in nodes}
    got = {r.node: (r.dependents, r.exposure) for r in gq.entity_exposure(spark, sf).collect()}
    assert got == {n: (c, round(c / (len(nodes) - 1), 6)) for n, c in want.items()}

    seen = dict.fromkeys(nodes, 0)
    for o, _, _ in orders:
        own = node(entity[o])
        seeds = {(d, t) for c, d, t in deps if c == o} | {(own, 0)}
        hit = {s for s, t in seeds if t <= 2} | {d for (a, d), h in hops.items() for s, t in seeds if a == s and t + h <= 2}
        for n in hit - {own}:
            seen[n] += 1
    got = {r.node: r.contracts for r in gq.contract_exposure(spark, sf).collect()}
    assert got == seen

    two = reached(normal, 2)
    target = PLATFORM + "AWS"
    want = {str(o) for o, d, t in deps if node(entity[o]) != target and ((d == target and t <= 2) or t + two.get((d, target), 9) <= 2)}
    assert {r.contract_id for r in gq.target_contracts(spark, sf).collect()} == want


def test_reports(spark):
    n = spark.createDataFrame([("u", 0.2), ("v", 0.2), (PLATFORM + "AWS", 0.05), ("w", 0.0)], "node string, exposure double")
    c = spark.createDataFrame([("u", 0.2), ("v", 0.3), (PLATFORM + "AWS", 0.6), ("w", 0.0)], "node string, exposure double")
    labels = spark.createDataFrame([("v", "Vee Inc")], "node string, label string")
    size = spark.createDataFrame([(20,)], "n long")
    b = {r.node: r for r in gr.barbell_table(n, c, labels, size, 1).collect()}
    assert set(b) == {"u", PLATFORM + "AWS"}
    assert (b["u"].normal_rank, b["u"].clouded_rank, b["u"].label, b["u"].in_top_normal, b["u"].in_top_clouded) == (1, 3, "u", True, False)
    a = b[PLATFORM + "AWS"]
    assert (a.label, a.is_platform, a.normal_count, a.clouded_count, a.delta_count, a.normal_rank) == ("AWS", True, 1, 12, 11, 3) and abs(a.ratio - 12) < 1e-9
    t = gr.platform_table(n, c, size).collect()
    assert [(r.platform, r.normal_count, r.clouded_count) for r in t] == [("AWS", 1, 12)]
    board = [(r.view, r.place, r.label) for r in gr.leaderboards(n, c, labels, 2).orderBy("view", "place").collect()]
    assert board == [("clouded", 1, "AWS"), ("clouded", 2, "Vee Inc"), ("normal", 1, "u"), ("normal", 2, "Vee Inc")]
    assert {r.node for r in gr.unlabelled(n, labels).collect()} == {"u", "w"}


def test_summary(spark):
    view = spark.createDataFrame([(str(i), float(e)) for i, e in enumerate([0, 0, 0.1, 0.2, 0.2, 0.5])], "node string, exposure double")
    edges = spark.createDataFrame([("x", str(i)) for i in (1, 2, 3, 4, 5)], "src string, dst string")
    s = ex.exposure_summary(view, edges).first()
    values = [0.1, 0.2, 0.2, 0.5]
    gini = 2 * sum(i * v for i, v in enumerate(values, 1)) / (4 * sum(values)) - 5 / 4
    assert (s.n, s.zeros, s.max, s.above_10_pct) == (5, 2, 0.5, 3) and abs(s.gini - gini) < 1e-12 and abs(s["mean"] - 0.2) < 1e-12


def test_nulls_and_repeats(spark):
    primes = spark.createDataFrame([("a", "X", "X", None, "Ex", 5.0), ("a", "X", "X", None, "Ex", -1.0), ("b", None, None, None, None, None), (None, "Y", "Y", "Y", "Ypsilon", 1.0)],
                                   "award_id string, entity string, uei string, parent_uei string, contractor_name string, dollars double")
    subs = spark.createDataFrame([("Z", None, None, None, None), (None, "Zed", "X", None, "Ex Corporation")], "sub_uei string, sub_name string, prime_uei string, prime_parent_uei string, prime_name string")
    pairs = gr.name_pairs(primes, subs)
    alias = gr.platform_alias(pairs)
    assert alias.count() == 0 and {(r.node, r.label) for r in gr.entity_labels(pairs, alias).collect()} == {("X", "Ex Corporation"), ("Y", "Ypsilon")}
    assert gr.subaward_edges(subs, alias).count() == 0
    assert sorted((r.contract_id, r.performing_node, r.weight) for r in gr.contract_population(primes, alias).collect()) == [("a", "X", 5.0), ("b", None, 0.0)]
