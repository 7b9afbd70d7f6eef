"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def runtime_seconds(text: Column) -> Column:
    """PT12.25S as 12.25: two characters go in front, one behind."""
    return F.substr(text, F.lit(3), F.length(text) - 3).cast("double")


def density(n_edges: Column, n_nodes: Column) -> Column:
    """Edges over n (n - 1)."""
    return n_edges.cast("double") / (n_nodes * (n_nodes - 1))


def vector_text(values: Column) -> Column:
    """An array of numbers as one line: the first as it is, the others with four places."""
    rest = F.transform(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda v: F.format_string("%.4f", v))
    return F.concat_ws(" ", F.concat(F.transform(F.slice(values, 1, 1), lambda v: v.cast("string")), rest))


def granule(value: Column, size: int | float) -> Column:
    """The bucket of a value, where values within one count as equal."""
    return F.floor(value / size)
