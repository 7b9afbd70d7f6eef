"""Graphs as edge tables (src, dst), derived from the star-schema tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scale_dir(root: str, scale: str) -> str:
    """Folder of a scale factor: 0.001, 0.01 or 0.1."""
    if scale not in ("0.001", "0.01", "0.1"):
        raise ValueError(f"no data for scale factor {scale}")
    return f"{root}/sf{scale}"


def co_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of neighbouring lines of one order; a multigraph, ids from 1."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + 1).alias("part"))
    a = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("part").alias("src"))
    b = lines.withColumnRenamed("part", "dst")
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("src", "dst")


def co_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("id"))


def apart(key: str) -> Column:
    """Ids that aren't consecutive."""
    return F.col(key) * 7 + 13


def knows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one order and the next, by order key.

    The next key is the next higher one: each order meets the least key above its own.  Orders are cut
    into ranges of keys, so that no window holds them all; the last order of a range looks ahead to the
    first of the next range that has any.
    """
    width = 1 << 16
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.floor(F.col("o_orderkey") / width).alias("g")
    )
    heads = orders.groupBy("g").agg(F.min(F.struct("o", "c")).alias("first"))
    # One row per range of 65536 keys.
    ahead = heads.select("g", F.lead("first").over(Window.orderBy("g")).alias("ahead"))
    inside = orders.withColumn("next", F.lead("c").over(Window.partitionBy("g").orderBy("o")))
    whole = inside.join(ahead, "g").select(
        apart("c").alias("src"), (F.coalesce("next", F.col("ahead.c")) * 7 + 13).alias("dst")
    )
    return whole.where("dst is not null")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(apart("c_custkey").alias("id"), F.col("c_name").alias("name"))


def geo_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree in both directions: root 1, regions from 2, nations from 7, customers from 32."""
    region = table(spark, sf_dir, "region").select(F.lit(1).cast("bigint").alias("up"), (F.col("r_regionkey") + 2).cast("bigint").alias("down"))
    nation = table(spark, sf_dir, "nation").select(
        (F.col("n_regionkey") + 2).cast("bigint").alias("up"), (F.col("n_nationkey") + 7).cast("bigint").alias("down")
    )
    customer = table(spark, sf_dir, "customer").select(
        (F.col("c_nationkey") + 7).cast("bigint").alias("up"), (F.col("c_custkey") + 32).cast("bigint").alias("down")
    )
    down = region.unionByName(nation).unionByName(customer)
    return down.select(F.col("up").alias("src"), F.col("down").alias("dst")).unionAll(down.select("down", "up"))
