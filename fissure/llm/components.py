"""Connected components by alternating large-star and small-star rounds.

Every round is a grouped minimum and a join on the node, so a hub with very many neighbours costs its
own edges only; rounds grow with the logarithm of the longest path.  Each round ends in a checkpoint and
deletes the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissure.llm import common as C


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """Large: the greater neighbours of a node move to its least one; small: the lesser ones do.

    A round makes no more edges than it had.
    """
    if large:
        near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = C.few_parts(near.where("b > a").join(least, "a"), n_edges)
        return C.few_parts(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), n_edges)
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = C.few_parts(down.join(least, "a"), n_edges).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = C.few_parts(least, n_edges).select("a", F.col("m").alias("b"))
    return C.few_parts(moved.unionAll(kept).where("a <> b").distinct(), n_edges)


def components(edges: DataFrame, n_edges: int | None = None) -> DataFrame:
    """(node, label): the least node of each component, for nodes of edges (a, b) with a <> b.

    ``n_edges`` is their number, if it is known; edges that repeat count once.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    n_edges = edges.count() if n_edges is None else n_edges
    now, seen = C.cut(C.few_parts(C.few_parts(pairs, n_edges).distinct(), n_edges)), None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == seen or size[0] == 0:
            break
        seen, old = size, now
        now = C.cut(_star(_star(old, True, size[0]), False, size[0]))
        C.drop_cut(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
