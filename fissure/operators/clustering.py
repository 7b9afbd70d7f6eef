"""Up-front layouts: sorted edges and adjacency lists, and lookups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fissure.operators.tables import with_place


def precluster(edges: DataFrame, by: str) -> DataFrame:
    """(pos, src, dst) sorted by one end, then the other."""
    other = "dst" if by == "src" else "src"
    return with_place(edges, [by, other]).select("pos", "src", "dst")


def clustered(edges: DataFrame, by: str) -> DataFrame:
    """The layout only: range partitions, sorted within; a filter on the key skips row groups once written."""
    return edges.repartitionByRange(by).sortWithinPartitions(by)


def sort_values(rows: DataFrame, column: str) -> DataFrame:
    return with_place(rows.select(column), [column]).select("pos", column)


def sort_by(rows: DataFrame, column: str, *order: Column) -> DataFrame:
    """(pos, value) in the order of the given expressions, ties by value: a comparator is what they say."""
    return with_place(rows.select(column), [*order, F.col(column)]).select("pos", column)


def equal_range(sorted_rows: DataFrame, key: str, x: int, column: str) -> DataFrame:
    return sorted_rows.where(F.col(key) == x).select(column)


def adjacency_list(edges: DataFrame, by: str = "src") -> DataFrame:
    """(key, array of the other ends, sorted); a hub's array is as long as its degree."""
    other = "dst" if by == "src" else "src"
    return edges.groupBy(by).agg(F.sort_array(F.collect_list(other)).alias(f"{other}s"))


def adjacency_lookup(lists: DataFrame, x: int, by: str = "src") -> DataFrame:
    other = "dst" if by == "src" else "src"
    return lists.where(F.col(by) == x).select(F.explode(f"{other}s").alias(other))
