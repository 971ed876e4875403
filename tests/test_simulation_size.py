"""The registered simulations are as large as the reference's."""

from undertow.plans import registry


def test_power_simulation_has_every_run(spark):
    rows = registry.power_simulation(spark, "").collect()
    assert {r.true_alpha for r in rows} == {0.5, 0.7, 0.8, 0.9} and len(rows) == 60
    assert min(r.n_items for r in rows) == 10 and max(r.n_items for r in rows) == 300
    assert all(1900 < r.n_defined <= 2000 for r in rows)


def test_bootstrap_persistence_has_every_draw(spark, tmp_path):
    d = str(tmp_path)
    spark.sql("SELECT id AS o_orderkey, id % 7 AS o_custkey, make_date(int(1995 + id % 4), 1, 1) AS o_orderdate FROM range(1, 60)").write.parquet(f"{d}/orders.parquet")
    spark.sql("SELECT id AS l_orderkey, id % 3 AS l_suppkey FROM range(1, 60)").write.parquet(f"{d}/lineitem.parquet")
    spark.sql("SELECT id AS s_suppkey, id % 2 AS s_nationkey FROM range(3)").write.parquet(f"{d}/supplier.parquet")
    draws = registry.bootstrap_persistence(spark, d).select("draw").distinct().count()
    assert 19_900 < draws <= 20_000
