"""The two sample functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_column(df: DataFrame) -> DataFrame:
    """One row: metric 'total_columns' and the number of columns. The table counts as one batch."""
    return df.sparkSession.range(1).select(F.lit("total_columns").alias("metric"), F.lit(len(df.columns)).cast("bigint").alias("column_count"))


def error_producer(df: DataFrame) -> DataFrame:
    """Raises for the first row that is read, and at the end of an empty table too."""
    failing = df.sparkSession.range(1).select(F.raise_error(F.lit("error_producer always fails")).cast("string").alias("error"))
    return failing
