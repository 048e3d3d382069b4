"""Plan-shaping helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def settled(df: DataFrame) -> DataFrame:
    """The same rows with every column evaluated exactly once.

    A filter on a derived column is otherwise rewritten in terms of the inputs, so the whole derivation
    runs again inside the filter. Filters do not move below the one-element outer explode.
    """
    return df.select(F.explode_outer(F.array(F.struct(*df.columns))).alias("__row")).select("__row.*")
