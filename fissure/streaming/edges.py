"""Edges that arrive as a stream: appended to a table, with running out-degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EDGE = "src bigint, dst bigint"


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of edges as they come."""
    return spark.readStream.schema(EDGE).parquet(path)


def append_edges(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to a Parquet table, each edge once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_degrees(stream: DataFrame) -> DataFrame:
    """(src, degree) so far; parallel edges count."""
    return stream.groupBy("src").agg(F.count("*").alias("degree"))
