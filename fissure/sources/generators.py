"""Seeded random graphs and columns.  Growth by degree is sequential, so it runs on the driver; sizes are
those of test graphs."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fissure.operators.tables import with_place

EDGE = "src bigint, dst bigint"


def random_tree(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A connected tree over 1..n, each edge in both directions; nodes attach by degree."""
    if n < 1:
        raise ValueError("a tree needs a node")
    rng = random.Random(seed)
    ends: list[int] = [1]  # every node as often as it has edges
    rows: list[tuple[int, int]] = []
    for node in range(2, n + 1):
        to = rng.choice(ends)
        rows += [(node, to), (to, node)]
        ends += [node, to]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, EDGE)


def random_graph(spark: SparkSession, n: int, density: float, seed: int = 0) -> DataFrame:
    """A weakly connected directed multigraph over 0..n-1 without self loops; edges come in pairs, one in
    and one out of a node, until there are ``density`` per node."""
    if n < 2:
        raise ValueError("a graph needs two nodes")
    rng = random.Random(seed)
    rows = [(0, 1), (1, 0)]
    ends = [0, 1, 1, 0]

    def other_than(node: int) -> int:
        while (pick := rng.choice(ends)) == node:
            pass
        return pick

    grown = 2
    while grown < n or len(rows) < density * n:
        node = grown if grown < n else rng.randrange(n)
        grown = min(n, grown + 1)
        pair = [(node, other_than(node)), (other_than(node), node)]
        rows += pair
        for edge in pair:
            ends += edge
    rng.shuffle(rows)
    return spark.createDataFrame(rows, EDGE)


def uniform_column(spark: SparkSession, rows: int, selectivity: float, seed: int = 0) -> DataFrame:
    """(value): uniform over 0 to ceil(1 / selectivity) - 1, made on the executors."""
    return spark.range(rows).select(F.floor(F.rand(seed) * F.ceil(F.lit(1.0 / selectivity))).cast("bigint").alias("value"))


def deal(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(pos, value): a permutation of 0 to n - 1, set by the seed."""
    return with_place(spark.range(n).select(F.col("id").alias("value")), [F.xxhash64(F.col("value"), F.lit(seed)), F.col("value")]).select("pos", "value")


def shuffled_pairs(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(pos, src, dst): the same rows, dealt places in an order that the seed sets; equal rows keep apart."""
    return with_place(edges.select("src", "dst"), [F.xxhash64("src", "dst", F.lit(seed)), "src", "dst"]).select("pos", "src", "dst")
