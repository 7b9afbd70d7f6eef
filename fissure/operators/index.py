"""The ordered index of a cracked column: key -> number of values below it."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CrackerIndex:
    """Driver-side catalogue; its size is the number of boundaries, not of rows."""

    def __init__(self, entries: dict[int, int] | None = None):
        self._pos = dict(entries or {})
        self._keys = sorted(self._pos)

    def __len__(self) -> int:
        return len(self._keys)

    def __contains__(self, key: int) -> bool:
        return key in self._pos

    def keys(self) -> list[int]:
        return list(self._keys)

    def insert(self, key: int, pos: int) -> None:
        if key not in self._pos:
            insort(self._keys, key)
        self._pos[key] = pos

    def get(self, key: int, default: int | None = None) -> int | None:
        return self._pos.get(key, default)

    def delete(self, key: int) -> None:
        if self._pos.pop(key, None) is not None:
            self._keys.remove(key)

    def lower_bound(self, key: int) -> int | None:
        """Position of the greatest key up to ``key``."""
        i = bisect_right(self._keys, key)
        return self._pos[self._keys[i - 1]] if i else None

    def upper_bound(self, key: int) -> int | None:
        """Position of the least key from ``key`` on."""
        i = bisect_left(self._keys, key)
        return self._pos[self._keys[i]] if i < len(self._keys) else None

    def shift_above(self, key: int, by: int) -> None:
        for k in self._keys[bisect_right(self._keys, key) :]:
            self._pos[k] -= by

    def min_pair(self) -> tuple[int, int] | None:
        return (self._keys[0], self._pos[self._keys[0]]) if self._keys else None

    def max_pair(self) -> tuple[int, int] | None:
        return (self._keys[-1], self._pos[self._keys[-1]]) if self._keys else None

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, self._pos[k]) for k in self._keys], "key bigint, pos bigint")


def index_of(rows: DataFrame, column: str, keys: list[int]) -> DataFrame:
    """(key, pos) for the given keys, in one pass: pos counts values below the key."""
    counts = rows.agg(*(F.count_if(F.col(column) < k).alias(f"k{i}") for i, k in enumerate(keys)))
    pairs = F.array(*(F.struct(F.lit(k).cast("bigint").alias("key"), F.col(f"k{i}").alias("pos")) for i, k in enumerate(keys)))
    return counts.select(F.inline(pairs))


def get_or(index: DataFrame, wanted: DataFrame, default: int) -> DataFrame:
    return wanted.join(index, "key", "left").select("key", F.coalesce("pos", F.lit(default).cast("bigint")).alias("pos"))


def delete(index: DataFrame, wanted: DataFrame) -> DataFrame:
    return index.join(wanted.select("key"), "key", "left_anti")


def _bound(index: DataFrame, wanted: DataFrame, below: bool) -> DataFrame:
    """As-of lookup of (x): a range join with the catalogue, grouped by x.

    The catalogue holds the boundaries only; it is small beside the column it describes.
    """
    fits = F.col("key") <= F.col("x") if below else F.col("key") >= F.col("x")
    near = F.max_by("pos", "key") if below else F.min_by("pos", "key")
    return wanted.join(index, fits, "left").groupBy("x").agg(near.alias("pos"))


def lower_bound(index: DataFrame, wanted: DataFrame) -> DataFrame:
    return _bound(index, wanted, True)


def upper_bound(index: DataFrame, wanted: DataFrame) -> DataFrame:
    return _bound(index, wanted, False)


def shift_above(index: DataFrame, key: int, by: int) -> DataFrame:
    return index.select("key", F.when(F.col("key") > key, F.col("pos") - by).otherwise(F.col("pos")).alias("pos"))


def min_max(index: DataFrame) -> DataFrame:
    return index.agg(
        F.min("key").alias("kmin"), F.min_by("pos", "key").alias("pmin"), F.max("key").alias("kmax"), F.max_by("pos", "key").alias("pmax")
    )
