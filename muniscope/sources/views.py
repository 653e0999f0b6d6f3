"""The driver's tables seen as works, so that every operator has data to run on.

orders stand for sanctioned works, lineitem (by order) for completed ones, customers for the
officials that recommend works, suppliers for implementing agencies, nations and regions for
jurisdictions, events for the review log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sanctioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("record_id"),
        F.col("o_custkey").alias("mp_id"),
        F.col("o_orderpriority").alias("activity"),
        F.col("o_orderstatus").alias("stage"),
        F.col("o_totalprice").alias("sanction_amount"),
        F.to_date("o_orderdate").alias("sanction_date"),
    )


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").cast("string").alias("record_id"))
        .agg(
            F.round(F.sum("l_extendedprice"), 2).alias("actual_amount"),
            F.to_date(F.max("l_shipdate")).alias("end_date"),
            F.count(F.lit(1)).alias("image_count"),
        )
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mp_id with constituency (nation) and state (region): two small dimensions joined once."""
    nation = load(spark, sf_dir, "nation").join(
        load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("mp_id"),
        F.col("c_name").alias("mp_name"),
        F.col("n_name").alias("constituency"),
        F.col("r_name").alias("state"),
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed works with their sanction and place."""
    done = completed(spark, sf_dir).join(sanctioned(spark, sf_dir), "record_id")
    return done.join(places(spark, sf_dir), "mp_id")


SANCTIONED_SQL = """sanctioned AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_custkey AS mp_id, o_orderpriority AS activity, o_orderstatus AS stage,
    o_totalprice AS sanction_amount, CAST(o_orderdate AS DATE) AS sanction_date FROM orders)"""
COMPLETED_SQL = """completed AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS record_id, round(sum(l_extendedprice), 2) AS actual_amount,
    CAST(max(l_shipdate) AS DATE) AS end_date, count(*) AS image_count FROM lineitem GROUP BY l_orderkey)"""
PLACES_SQL = """places AS (
  SELECT c_custkey AS mp_id, c_name AS mp_name, n_name AS constituency, r_name AS state
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
WORKS_SQL = f"""{SANCTIONED_SQL}, {COMPLETED_SQL}, {PLACES_SQL}, works AS (
  SELECT * FROM completed JOIN sanctioned USING (record_id) JOIN places USING (mp_id))"""
