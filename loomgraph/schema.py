"""Column helpers of the tables a code property graph is stored in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endpoint texts that name nothing.
NAMELESS = ["", "null", "None"]


def names_something(end: Column) -> Column:
    """False for an endpoint that is null, empty, ``null`` or ``None``; ids are otherwise exact."""
    return end.isNotNull() & ~end.isin(*NAMELESS)


def rel_type(col: Column) -> Column:
    """Relationship type without outer spaces and letter case."""
    return F.upper(F.trim(col))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; columns reach the scan as they are used."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
