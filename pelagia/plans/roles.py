"""Survey roles of the benchmark tables: one view per role, in Spark and in SQL.

The operators take column names as parameters; these views only rename.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SEX = {"A": "female", "N": "male", "R": "unsexed"}


def specimen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aged fish: haul, sex, age, length, weight, stratum."""
    sex = F.when(F.col("l_returnflag") == "A", "female").when(F.col("l_returnflag") == "N", "male").otherwise("unsexed")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("haul_num"), sex.alias("sex"), F.col("l_linenumber").alias("age"), F.col("l_quantity").alias("length"), (F.col("l_extendedprice") / 1000).alias("weight"), F.col("l_linestatus").alias("stratum"), F.col("l_orderkey").alias("fish")
    )


SPECIMEN = """specimen AS (SELECT l_suppkey AS haul_num, CASE l_returnflag WHEN 'A' THEN 'female' WHEN 'N' THEN 'male' ELSE 'unsexed' END AS sex,
 l_linenumber AS age, l_quantity AS length, l_extendedprice / 1000 AS weight, l_linestatus AS stratum, l_orderkey AS fish FROM lineitem)"""


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unaged fish: length counts by haul, sex, stratum; their lengths lie between the aged ones'."""
    return specimen(spark, sf_dir).select("haul_num", "sex", (F.col("length") + 0.5).alias("length"), F.col("age").alias("length_count"), "stratum")


LENGTHS = "lengths AS (SELECT haul_num, sex, length + 0.5 AS length, age AS length_count, stratum FROM specimen)"


def catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catch weight by haul, with its stratum."""
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("haul_num"), F.col("o_totalprice").alias("weight"), F.when(F.col("o_custkey") % 2 == 0, "O").otherwise("F").alias("stratum"))


CATCH = "catch AS (SELECT o_custkey % 100 AS haul_num, o_totalprice AS weight, CASE WHEN o_custkey % 2 = 0 THEN 'O' ELSE 'F' END AS stratum FROM orders)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Echo-integration intervals: transect, order within it, position, NASC."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 40).alias("transect_num"), F.col("event_id").alias("interval"), F.col("value").alias("nasc"), (F.col("event_id") * 0.5).alias("distance_s"), (F.col("event_id") * 0.5 + 0.5).alias("distance_e"),
        (30 + (F.col("user_id") % 40) * 0.5 + (F.col("event_id") % 7) * 0.01).alias("latitude"), (-120 - (F.col("event_id") % 100) * 0.05).alias("longitude"), F.when(F.col("event_id") % 2 == 0, "O").otherwise("F").alias("stratum"),
    )


INTERVALS = """intervals AS (SELECT user_id % 40 AS transect_num, event_id AS interval, value AS nasc, event_id * CAST(0.5 AS DOUBLE) AS distance_s, event_id * CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS distance_e,
 30 + (user_id % 40) * CAST(0.5 AS DOUBLE) + (event_id % 7) * CAST(0.01 AS DOUBLE) AS latitude, -120 - (event_id % 100) * CAST(0.05 AS DOUBLE) AS longitude, CASE WHEN event_id % 2 = 0 THEN 'O' ELSE 'F' END AS stratum FROM events)"""


def hauls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haul to stratum."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("haul_num"), F.col("s_nationkey").alias("stratum_num"))


HAULS = "hauls AS (SELECT s_suppkey AS haul_num, s_nationkey AS stratum_num FROM supplier)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with a value, in a stable order: a strip that grows with the table, each key at a place of its own."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 1.0).alias("x"), (F.col("p_partkey") / 37).alias("y"), F.col("p_retailprice").alias("z"))


POINTS = "points AS (SELECT p_partkey AS id, p_size * CAST(1 AS DOUBLE) AS x, p_partkey / CAST(37 AS DOUBLE) AS y, p_retailprice AS z FROM part)"


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values on a lattice of 50 by 37 places, so that more and more of them share one as the table grows."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 1.0).alias("x"), (F.col("p_partkey") % 37 * 1.0).alias("y"), F.col("p_retailprice").alias("z"))


LATTICE = "points AS (SELECT p_partkey AS id, p_size * CAST(1 AS DOUBLE) AS x, p_partkey % 37 * CAST(1 AS DOUBLE) AS y, p_retailprice AS z FROM part)"
