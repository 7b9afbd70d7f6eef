"""Breadth-first search by levels over a path of any access variant.

Paths without a cracked table run in one task if the graph is of bounded size (``in_task``).  All others take
one join per level, checkpointed; a cracked path reads the pieces that hold the frontier's keys.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fissure.plans import in_task
from fissure.plans.access import AccessPath
from fissure.plans.lineage import cut


def frontier_step(edges: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Nodes (node) one edge from the frontier that are not visited."""
    reached = edges.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi")
    return reached.select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti")


def _start(spark: SparkSession, starts: list[int]) -> DataFrame:
    return spark.createDataFrame([(s, 0) for s in starts], "node bigint, level int")


def _in_task(path: AccessPath, starts: list[int]) -> DataFrame | None:
    """(start, node, level), if the path is a plain one of a graph that fits a task."""
    if path.table is not None or not in_task.fits(path.size()):
        return None
    rows = path.edges()
    none = rows.sparkSession.createDataFrame([], "id bigint")
    found = cut(in_task.run(rows, none, in_task.levels(starts), "start bigint, node bigint, level int"))
    path.close()
    if path.size():
        return found
    return rows.sparkSession.createDataFrame([(s, s, 0) for s in starts], found.schema)  # no group, so no task


def bfs_levels(edges: DataFrame, start: int, variant: str = "preclustered", max_levels: int | None = None) -> DataFrame:
    """(node, level) of all nodes reachable from start, itself at level 0."""
    spark = edges.sparkSession
    path = AccessPath(edges, variant)
    found = _in_task(path, [start])
    if found is not None:
        return found.where(F.lit(max_levels is None) | (F.col("level") <= (max_levels or 0))).select("node", "level")
    visited = frontier = _start(spark, [start])
    level = 0
    while max_levels is None or level < max_levels:
        level += 1
        near = path.neighbours(frontier.select("node")).select(F.col("dst").alias("node")).distinct()
        new = cut(near.join(visited.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        if new.isEmpty():
            break
        visited = visited.unionAll(new)
        if level % 8 == 0:  # deep graphs: one table instead of a long union
            visited = cut(visited)
        frontier = new
    path.close()
    return visited


def bfs_reach(edges: DataFrame, start: int, variant: str = "preclustered") -> DataFrame:
    return bfs_levels(edges, start, variant).select("node")


def bfs_multi(edges: DataFrame, starts: list[int], variant: str = "preclustered") -> DataFrame:
    """(start, node) reached from each start, all starts in one dataflow."""
    spark = edges.sparkSession
    path = AccessPath(edges, variant)
    found = _in_task(path, sorted(set(starts)))
    if found is not None:
        return found.select("start", "node")
    visited = frontier = spark.createDataFrame([(s, s) for s in sorted(set(starts))], "start bigint, node bigint")
    level = 0
    while True:
        level += 1
        near = path.neighbours(frontier.select("node").distinct())
        new = frontier.withColumnRenamed("node", "src").join(near, "src").select("start", F.col("dst").alias("node")).distinct()
        new = cut(new.join(visited, ["start", "node"], "left_anti"))
        if new.isEmpty():
            break
        visited = visited.unionAll(new)
        if level % 8 == 0:
            visited = cut(visited)
        frontier = new
    path.close()
    return visited


def bfs_until(edges: DataFrame, start: int, seconds: float, variant: str = "recognitive") -> int:
    """Selects answered (a node expanded is one) before the time is over, level by level."""
    spark = edges.sparkSession
    path = AccessPath(edges, variant)
    deadline = time.monotonic() + seconds
    visited = frontier = _start(spark, [start]).select("node")
    selects = 0
    while time.monotonic() < deadline:
        near = path.neighbours(frontier).select(F.col("dst").alias("node")).distinct()
        new = cut(near.join(visited, "node", "left_anti"))
        selects += frontier.count()
        if new.isEmpty():
            break
        visited = visited.unionAll(new)
        frontier = new
    path.close()
    return selects
