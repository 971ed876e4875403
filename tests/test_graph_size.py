from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from undertow.operators import graph as gr
from undertow.plans import graph_queries as gq
from undertow.session import kept


def test_kept_computes_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    df = kept(spark.range(40).select(F.udf(count, LongType())("id").alias("id")))
    assert seen.value == 40 and df.agg(F.sum("id")).first()[0] == 780


def test_aliases_are_not_shuffled(spark):
    alias = spark.createDataFrame([("a", "PLATFORM:AWS")], "uei string, node string")
    df = gr.fuse(spark.createDataFrame([("a", "b"), ("b", "a"), (None, "a")], "src string, dst string"), ["src", "dst"], alias)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert {tuple(r) for r in df.collect()} == {("PLATFORM:AWS", "b"), ("b", "PLATFORM:AWS"), (None, "PLATFORM:AWS")}


def test_records_and_subawards_share_one_join(spark, tmp_path):
    spark.range(9).selectExpr("id AS o_orderkey", "id AS o_custkey", "1D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(12).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id AS l_suppkey", "id AS l_partkey", "1D AS l_extendedprice", "'A' AS l_returnflag", "1D AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    g = gq.Graph(spark, str(tmp_path))
    assert all("Join" not in d._jdf.queryExecution().optimizedPlan().toString() for d in (g.subs, g.records))
    assert g.subs.count() == g.records.count() == 9
