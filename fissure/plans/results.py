"""Tables of benchmark results: parse, merge, trim."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fissure.functions.scalars import runtime_seconds
from fissure.sources.files import BENCH_VARIANTS


def parse_runtimes(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Runtime texts as seconds; with ``names``, all columns renamed."""
    out = rows.withColumns({c: runtime_seconds(F.col(c)) for c in BENCH_VARIANTS if c in rows.columns})
    return out.toDF(*names) if names else out


def merge(left: DataFrame, right: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Left join; where a row matches, the right side's value wins for shared columns.

    The right side counts with its first row per key, by all its columns.
    """
    others = [c for c in right.columns if c not in keys]
    ranked = right.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(others or keys)))).where("_n = 1")
    side = ranked.select(*keys, *(F.col(c).alias(f"_r_{c}") for c in others), F.lit(True).alias("_hit"))
    both = left.join(side, keys, "left")
    columns = [c for c in left.columns if c not in keys] + [c for c in others if c not in left.columns]
    wins = {c: F.col(f"_r_{c}") for c in others}
    wins |= {c: F.when(F.col("_hit"), wins[c]).otherwise(F.col(c)) for c in others if c in left.columns}
    picked = both.select(*keys, *(wins[c].alias(c) if c in wins else F.col(c) for c in columns))
    return picked.select(*(order or picked.columns))


def bench_rows(spark: SparkSession, line: str) -> DataFrame:
    """(sf, name, seconds) of the JSON line that a bench run prints."""
    found = json.loads(line)
    return spark.createDataFrame([(found["sf"], n, float(v)) for n, v in sorted(found["queries"].items())], "sf string, name string, seconds double")


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Result tables that were kept under their names."""
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names}


def mean_of(rows: DataFrame, *columns: str) -> DataFrame:
    """One row with the mean of each column."""
    return rows.agg(*(F.avg(c).alias(c) for c in columns))


def drop_columns(rows: DataFrame, *names: str) -> DataFrame:
    return rows.drop(*names)


def in_range(rows: DataFrame, column: str, low: float, high: float, drop: tuple[str, ...] = ()) -> DataFrame:
    """Both ends included."""
    return rows.where(F.col(column).between(low, high)).drop(*drop)
