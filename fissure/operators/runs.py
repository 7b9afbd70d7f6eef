"""Runs of equal neighbours and their two encodings: run tables and compacted dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SLICE = 1 << 20


def rle_runs(rows: DataFrame, column: str) -> DataFrame:
    """(value, start, len) of the runs of a column in the order of pos.

    Runs are found within slices of positions, whatever their values are, so no value and no table lands
    in one window; a second pass over the runs that touch a slice's edge joins them.
    """
    sliced = rows.select("pos", F.col(column).alias("value"), F.floor(F.col("pos") / SLICE).alias("_s"))
    near = Window.partitionBy("_s").orderBy("pos")
    new = F.coalesce(F.lag("value").over(near) != F.col("value"), F.lit(True)).cast("int")
    runs = sliced.withColumn("_new", new).withColumn("_run", F.sum("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("_s", "_run").agg(F.first("value").alias("value"), F.min("pos").alias("start"), F.count("*").alias("len"))
    at_edge = (F.col("start") % SLICE == 0) | ((F.col("start") + F.col("len")) % SLICE == 0)
    inner = runs.where(~at_edge).select("value", "start", "len")
    by_start = Window.orderBy("start")  # at most two runs per slice
    fresh = (F.lag("value").over(by_start) != F.col("value")) | (
        F.lag(F.col("start") + F.col("len")).over(by_start) != F.col("start")
    )
    joined = runs.where(at_edge).withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int"))
    joined = joined.withColumn("_g", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("_g", "value").agg(F.min("start").alias("start"), F.sum("len").alias("len")).drop("_g")
    return inner.unionByName(joined)


def rle_markers(rows: DataFrame, column: str) -> DataFrame:
    """(pos, value, run_length) at both ends of each run."""
    runs = rle_runs(rows, column)
    ends = F.array_distinct(F.array("start", F.col("start") + F.col("len") - 1))
    return runs.select(F.explode(ends).alias("pos"), "value", F.col("len").alias("run_length"))


def split_runs(runs: DataFrame, longest: int) -> DataFrame:
    """The same runs, cut so that none is longer."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1, F.lit(longest).cast("bigint")))
    cut = runs.select("value", "start", "len", starts.alias("_at"))
    return cut.select("value", (F.col("start") + F.col("_at")).alias("start"), F.least(F.lit(longest), F.col("len") - F.col("_at")).alias("len"))


def compact(rows: DataFrame, column: str) -> DataFrame:
    """(key, ofs, len): a sorted column's distinct values with their first position."""
    return rows.groupBy(F.col(column).alias("key")).agg(F.min("pos").alias("ofs"), F.count("*").alias("len"))


def positions(entries: DataFrame, start: str = "ofs") -> DataFrame:
    """One row per position that the entries stand for."""
    every = F.explode(F.sequence(F.col(start), F.col(start) + F.col("len") - 1))
    return entries.where("len > 0").select("*", every.alias("pos")).drop(start, "len")


def decompress(entries: DataFrame, base: DataFrame, columns: Sequence[str], start: str = "ofs") -> DataFrame:
    """Base values of all positions that the entries stand for."""
    return positions(entries, start).select("pos").join(base, "pos").select(*columns)
