"""Edge tables: typed columns, positions, appends, gathers.

DataFrames have no order, so positions are a column: the place of a row when sorted by all columns.
Positions are dealt without gathering rows in one task: rows are range-partitioned and sorted, and each
partition adds the sizes of those before it (one number per partition is all that is broadcast).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fissure.plans.lineage import cut

EDGE = "src bigint, dst bigint"


def empty(spark: SparkSession, schema: str = EDGE) -> DataFrame:
    return spark.createDataFrame([], schema)


def edge_table(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return df.select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst"))


def with_place(df: DataFrame, order: Sequence, name: str = "pos") -> DataFrame:
    """Rows with their place, from 0, in the given order; ties take any order."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Partition and row within it, fixed by a checkpoint before they are counted.
    rows = cut(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))  # a row per partition
    first = F.shiftleft(F.col("_part").cast("bigint"), 33)
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_row") - first).drop("_part", "_row", "_offset")


def with_pos(edges: DataFrame) -> DataFrame:
    return with_place(edges, edges.columns)


def append(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Bag union by name; columns must be the same."""
    if set(rows.columns) != set(more.columns):
        raise ValueError(f"append needs the columns {rows.columns}, got {more.columns}")
    return rows.unionByName(more)


def add_column(rows: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Adds a full-length column: ``values`` has pos and the column, one row for each of ``rows``' pos."""
    if name in rows.columns:
        raise ValueError(f"column {name} is there already")
    n, m = rows.count(), values.count()
    if n != m:
        raise ValueError(f"a new column needs {n} values, got {m}")
    return rows.join(values.select("pos", name), "pos")


def declare(rows: DataFrame, **types: str) -> DataFrame:
    """An empty table's columns and new ones of the given types; a name that is there already is an error."""
    if again := sorted(set(types) & set(rows.columns)):
        raise ValueError(f"columns {again} are there already")
    if not rows.isEmpty():
        raise ValueError("columns can be declared for an empty table only")
    return rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in types.items()))


def insert(rows: DataFrame, more: DataFrame | None = None, new: dict[str, DataFrame] | None = None) -> DataFrame:
    """Appends rows and adds columns at once.  ``rows`` and ``more`` have pos (``more`` from 0 on); each new column
    is a table (pos, value) as long as all rows together, or as ``rows`` if nothing is appended."""
    n, m = rows.count(), more.count() if more is not None else 0
    if more is not None:
        if set(more.columns) != set(rows.columns):
            raise ValueError(f"insert needs the columns {rows.columns}, got {more.columns}")
        rows = rows.unionByName(more.withColumn("pos", F.col("pos") + n))
    for name, values in (new or {}).items():
        if name in rows.columns:
            raise ValueError(f"column {name} is there already")
        if (k := values.count()) != n + m:
            raise ValueError(f"new column {name} needs {n + m} values, got {k}")
        rows = rows.join(values.select("pos", F.col("value").alias(name)), "pos")
    return rows


def gather(rows: DataFrame, wanted: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows at the wanted positions (ord, pos), in the order of ord, repeats kept."""
    columns = list(columns or (c for c in rows.columns if c != "pos"))
    return wanted.join(rows, "pos").select("ord", *columns)


def rearrange(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The gathered rows as a table: ord becomes pos."""
    return gather(rows, wanted).select(F.col("ord").cast("bigint").alias("pos"), *(c for c in rows.columns if c != "pos"))


def count_equal(rows: DataFrame, column: str, x: int) -> DataFrame:
    return rows.where(F.col(column) == x).agg(F.count("*").alias("n"))


def value_at(rows: DataFrame, column: str, pos: int) -> DataFrame:
    return rows.where(F.col("pos") == pos).select(column)
