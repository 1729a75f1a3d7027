"""Small building blocks for row-wise plans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_value(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a column whose expression runs once per row.

    A filter on a plain projected column is moved below the projection and
    computes the expression a second time; it cannot move below a generator.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def small_table(spark: SparkSession, **columns: list) -> DataFrame:
    """Literal lists as a table whose size the optimizer knows."""
    return spark.createDataFrame(pa.table(columns))
