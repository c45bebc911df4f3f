"""The reduce: SQL over the union of the map's rows, which it reads under the map step's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from splitfold.errors import planning
from splitfold.operators.views import over, viewed


def reduce_over(mapped: DataFrame, name: str, sql: str) -> DataFrame:
    with planning(f"reduce step over {name}"), viewed(mapped, "map") as view:
        return mapped.sparkSession.sql(over(name, view, sql))


def reduce_schema(spark, schema: T.StructType, name: str, sql: str) -> T.StructType:
    """The reduce query's columns over a map output of this schema."""
    return reduce_over(spark.createDataFrame([], schema), name, sql).schema
