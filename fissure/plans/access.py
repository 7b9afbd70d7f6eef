"""Access paths: how an algorithm gets the edges of a set of nodes.  All give one bag of edges."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissure.operators.clustering import adjacency_list, clustered
from fissure.operators.cracking import CrackedTable

VARIANTS = ("unoptimised", "preclustered", "preclustered_rle", "decracked", "recognitive", "compactive", "underswap", "overswap")
POLICY = {"decracked": "plain", "recognitive": "recognitive", "compactive": "compactive", "underswap": "underswap", "overswap": "overswap"}


class AccessPath:
    """Edges by one end (``key``); the layout is made once and reused by every step."""

    def __init__(self, edges: DataFrame, variant: str, key: str = "src"):
        if variant not in VARIANTS:
            raise ValueError(f"no variant {variant}")
        self.variant, self.key, self.other = variant, key, "dst" if key == "src" else "src"
        self.table, self._size = None, None
        if variant == "unoptimised":
            self._edges = edges
        elif variant == "preclustered":
            self._edges = clustered(edges, key)
        elif variant == "preclustered_rle":
            self._edges = adjacency_list(edges, key)
        else:
            self.table = CrackedTable(edges, key, POLICY[variant])
            self.table.crack_at_quantiles(edges.select(key))
            self._edges = None
        if self._edges is not None and variant != "unoptimised":
            self._edges = self._edges.persist(StorageLevel.MEMORY_AND_DISK)

    def neighbours(self, nodes: DataFrame) -> DataFrame:
        """(key, other) of the edges at the given nodes (node)."""
        wanted = nodes.select(F.col("node").alias(self.key))
        if self.table is not None:
            return self.table.select_many(wanted, self.other).withColumnRenamed("key", self.key)
        found = self._edges.join(wanted, self.key)
        if self.variant == "preclustered_rle":
            return found.select(self.key, F.explode(f"{self.other}s").alias(self.other))
        return found.select(self.key, self.other)

    def edges(self) -> DataFrame:
        """The whole bag of edges, from the path's own layout."""
        if self.table is not None:
            return self.table.rows().select("src", "dst")
        if self.variant == "preclustered_rle":
            return self._edges.select(self.key, F.explode(f"{self.other}s").alias(self.other)).select("src", "dst")
        return self._edges.select("src", "dst")

    def size(self) -> int:
        """How many edges there are, counted once; a layout that is kept is made then."""
        if self._size is None:
            self._size = self.edges().count()
        return self._size

    def close(self) -> None:
        if self.table is not None:
            self.table.close()
        if self._edges is not None and self.variant != "unoptimised":
            self._edges.unpersist()
