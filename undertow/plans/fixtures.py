"""Projection of the test tables onto award-style records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.session import prepare


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prime award per order."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("CONT_AWD_"), F.col("o_orderkey").cast("string"), F.lit("_X_Y_Z")).alias("award_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("uei"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("contractor_name"),
        F.when(F.col("o_custkey") % 13 != 0, F.concat(F.lit("P"), (F.col("o_custkey") % 200).cast("string"))).alias("parent_uei"),
        F.col("o_totalprice").alias("dollars"),
        F.col("o_orderdate").cast("date").alias("effective_date"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("description"),
        F.col("o_orderpriority").alias("department"),
        F.when(F.col("o_custkey") % 17 != 0, F.concat(F.lit("OFFICE "), (F.col("o_custkey") % 50).cast("string"))).alias("office"),
        F.col("o_orderkey").alias("_ord"),
    )


def subawards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subaward per line item, named by its prime's id and more parts."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("CONT_AWD_"), F.col("l_orderkey").cast("string"), F.lit("_X_Y_Z_"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("subaward_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sub_uei"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("sub_name"),
        F.col("l_extendedprice").alias("dollars"),
        F.when(F.col("l_partkey") % 11 != 0, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("description"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a contractor and a platform: line items with supplier and brand."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).select(
        F.col("l_orderkey").cast("string").alias("original_prime_id"),
        F.col("l_suppkey").cast("string").alias("contractor"),
        F.col("p_brand").alias("platform"),
        F.col("s_nationkey").cast("string").alias("parent"),
        F.col("l_extendedprice").alias("dollars"),
        F.year("l_shipdate").alias("fiscal_year"),
        F.concat_ws(" ", "p_type", "p_name").alias("description"),
        (F.col("l_returnflag") != "N").alias("is_cloud"),
    )


RECORDS_SQL = """records AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS original_prime_id, CAST(l_suppkey AS VARCHAR) AS contractor, p_brand AS platform,
         CAST(s_nationkey AS VARCHAR) AS parent, l_extendedprice AS dollars, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year,
         p_type || ' ' || p_name AS description, l_returnflag <> 'N' AS is_cloud
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

PRIMES_SQL = """primes AS (
  SELECT 'CONT_AWD_' || o_orderkey || '_X_Y_Z' AS award_id, 'C' || o_custkey AS uei, 'Customer ' || o_custkey AS contractor_name,
         CASE WHEN o_custkey % 13 <> 0 THEN 'P' || (o_custkey % 200) END AS parent_uei, o_totalprice AS dollars,
         CAST(o_orderdate AS DATE) AS effective_date, o_orderpriority || ' ' || o_orderstatus AS description,
         o_orderpriority AS department, CASE WHEN o_custkey % 17 <> 0 THEN 'OFFICE ' || (o_custkey % 50) END AS office, o_orderkey AS _ord
  FROM orders)"""

SUBS_SQL = """subs AS (
  SELECT 'CONT_AWD_' || l_orderkey || '_X_Y_Z_' || l_linenumber || '_' || l_partkey AS subaward_id, 'CONT_AWD_' || l_orderkey || '_X_Y_Z' AS prime_id,
         'S' || l_suppkey AS sub_uei, 'Supplier ' || l_suppkey AS sub_name, l_extendedprice AS dollars,
         CASE WHEN l_partkey % 11 <> 0 THEN 'part ' || l_partkey END AS description
  FROM lineitem)"""
