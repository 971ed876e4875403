from undertow.operators import exposure as ex

HUB = "PLATFORM:AWS"


def setup(spark):
    """p1 and p2 buy from m, which runs on the hub; p2's second contract names the hub itself, p3's runs on it."""
    pop = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k3", "p2"), ("k4", "p3"), ("k5", "m")], "contract_id string, performing_node string")
    deps = spark.createDataFrame([("k1", "m", 1, "sub"), ("k2", "m", 1, "sub"), ("k3", HUB, 1, "sub"), ("k4", HUB, 2, "cloud")], "contract_id string, dep_node string, tier int, kind string")
    nodes = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("m",), (HUB,)], "node string")
    edges = spark.createDataFrame([("p1", "m"), ("p2", "m"), ("m", HUB)], "src string, dst string")
    return pop, deps, nodes, edges


def by_node(df, c):
    return {r.node: r[c] for r in df.collect()}


def test_contracts(spark):
    pop, deps, nodes, edges = setup(spark)
    # tier 1: k3; tier 2: k1 and k2 by way of m, k4 through its platform
    assert [by_node(ex.contract_exposure(pop, deps, edges, nodes, k), "contracts")[HUB] for k in (1, 2)] == [1, 4]
    assert by_node(ex.contract_exposure(pop, deps, edges, nodes, 2, clouded=False), "contracts")[HUB] == 3
    # a performer's own reach: m's contract counts for the hub, not for m
    wide = by_node(ex.contract_exposure(pop, deps, edges, nodes, 2, permissive=True), "contracts")
    assert wide[HUB] == 5 and wide["m"] == 3 and wide["p1"] == 0
    w = spark.createDataFrame([("k1", 1.0), ("k2", 1.0), ("k3", 6.0), ("k4", -3.0)], "contract_id string, weight double")
    assert by_node(ex.contract_exposure(pop, deps, edges, nodes, 1, weights=w), "exposure")[HUB] == 0.75


def test_entities_rings_and_double_ways(spark):
    _, _, nodes, edges = setup(spark)
    assert [by_node(ex.entity_exposure(edges, nodes, k), "exposure")[HUB] for k in (1, 2)] == [1 / 4, 3 / 4]
    ring = spark.createDataFrame([(str(i), str((i + 1) % 4)) for i in range(4)], "src string, dst string")
    four = ex.nodes_of(ring.select("src"))
    assert [by_node(ex.entity_exposure(ring, four, k), "dependents")["0"] for k in (1, 2, 3, 7)] == [1, 2, 3, 3]
    ways = spark.createDataFrame([("s", x) for x in "abc"] + [(x, "t") for x in "abc"], "src string, dst string")
    assert by_node(ex.entity_exposure(ways, ex.nodes_of(ways.select("src"), ways.select("dst")), 2), "dependents")["t"] == 4


def test_barbell(spark):
    n = spark.createDataFrame([("g", 0.6), ("h", 0.3), ("i", 0.3), ("j", 0.0)], "node string, exposure double")
    c = spark.createDataFrame([("g", 0.6), ("h", 0.3), ("i", 0.7), ("j", 0.9)], "node string, exposure double")
    got = {r.node: r for r in ex.barbell(n, c, 1).collect()}
    assert set(got) == {"g", "j"} and got["j"].normal_rank == 4 and got["j"].clouded_rank == 1 and got["j"].ratio is None and got["g"].clouded_rank == 3 and got["g"].ratio == 1
    tied = {r.node: r.normal_rank for r in ex.barbell(n, c, 3).collect()}
    assert tied["h"] == tied["i"] == 2
