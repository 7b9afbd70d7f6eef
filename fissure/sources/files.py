"""Delimited files in and out: persons, friendships, benchmark results, graph drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names and order of the files.
PERSON_FIELDS = ("id", "firstName", "lastName", "gender", "birthday", "creationDate", "locationIP", "browserUsed")
BENCH_VARIANTS = (
    "unoptimised", "preclustered", "preclusteredRLE", "decomposed", "recognitive", "compactive", "underswapRLE", "overswapRLE",
)

PERSON = T.StructType([T.StructField(n, T.LongType() if n == "id" else T.StringType()) for n in PERSON_FIELDS])
FRIENDSHIP = T.StructType(
    [T.StructField("p1id", T.LongType()), T.StructField("p2id", T.LongType()), T.StructField("creationDate", T.StringType())]
)
BENCH = T.StructType(
    [T.StructField("nodes", T.LongType()), T.StructField("edges", T.LongType()), T.StructField("density", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in BENCH_VARIANTS]
)


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """(id, first_name, last_name); a bad row fails the read."""
    rows = spark.read.schema(PERSON).option("sep", "|").option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.select("id", F.col("firstName").alias("first_name"), F.col("lastName").alias("last_name"))


def read_friendships(spark: SparkSession, path: str) -> DataFrame:
    """(p1id, p2id); the header has one name twice, so it is read as a comment."""
    rows = spark.read.schema(FRIENDSHIP).option("sep", "|").option("comment", "P").option("mode", "FAILFAST").csv(path)
    return rows.select("p1id", "p2id")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_friendships(spark, path).select(F.col("p1id").alias("src"), F.col("p2id").alias("dst"))


def write_people(people: DataFrame, path: str) -> None:
    """From (id, name): the other fields are constants."""
    empty = {n: F.lit("-") for n in PERSON_FIELDS[2:]}
    rows = people.select("id", F.col("name").alias("firstName"), *(v.alias(n) for n, v in empty.items()))
    rows.write.mode("overwrite").option("sep", "|").option("header", True).csv(path)


def write_friendships(edges: DataFrame, path: str) -> None:
    line = F.concat_ws("|", "src", "dst", F.lit("-"))
    files = edges.select(line.alias("value"))
    files.write.mode("overwrite").text(path)


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCH).option("header", True).option("mode", "FAILFAST").csv(path)


def write_bench(rows: DataFrame, path: str) -> None:
    rows.select(*BENCH.fieldNames()).write.mode("overwrite").option("header", True).csv(path)


def upsert(rows: DataFrame, path: str) -> None:
    """Tables have no key, so an upsert appends; a missing table is created."""
    rows.write.mode("append").parquet(path)


def graphviz_lines(edges: DataFrame) -> DataFrame:
    """The lines of a digraph's body."""
    return edges.select(F.concat(F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"), F.lit(";")).alias("line"))


def write_graphviz(edges: DataFrame, path: str) -> None:
    """A text folder: the head, the body's lines, the foot; files in that order."""
    spark = edges.sparkSession
    body = graphviz_lines(edges).select(F.lit(1).alias("part"), F.col("line").alias("value"))
    ends = spark.createDataFrame([(0, "digraph {"), (2, "}")], "part int, value string")
    body.unionByName(ends).repartitionByRange("part").sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)
