"""A catalog over any DataFrame: rows that agree in some string expressions are a virtual file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitfold.sources.base import CatalogTable

#: Virtual files up to which the file table is kept on the driver; a longer one stays a query over the rows.
MOST_LISTED = 10_000


class VirtualCatalog(CatalogTable):
    """partitions maps each partition column to its SQL expression. A virtual file's key is its values, joined by '/', with a
    backslash before each slash and backslash of a value and __null__ for a null; its length is its number of rows."""

    def __init__(self, df: DataFrame, partitions: dict[str, str]):
        super().__init__(df.sparkSession)
        self.df, self.partitions = df, dict(partitions)
        self._listed: DataFrame | None = None

    @property
    def data_schema(self) -> T.StructType:
        return self.df.schema

    @property
    def partition_columns(self) -> list[str]:
        return list(self.partitions)

    def _values(self) -> list[Column]:
        return [F.expr(e).cast("string").alias(c) for c, e in self.partitions.items()]

    def _key(self) -> Column:
        """The key, from the partitions' expressions."""
        escaped = lambda v: F.when(v == "__null__", r"\__null__").otherwise(F.regexp_replace(v, r"([/\\])", r"\\$1"))
        return F.concat_ws("/", *(F.coalesce(escaped(F.expr(e).cast("string")), F.lit("__null__")) for e in self.partitions.values()))

    def files(self) -> DataFrame:
        if self._listed is None:
            rows = self.df.select(self._key().alias("key"), *self._values())
            table = rows.groupBy("key", *self.partitions).agg(F.count("*").alias("length")).select("key", "length", *self.partitions)
            few = table.limit(MOST_LISTED + 1).collect()
            self._listed = self.spark.createDataFrame(few, table.schema) if len(few) <= MOST_LISTED else table
        return self._listed

    def read(self, kept: DataFrame, sid: str, partitions: bool = True) -> DataFrame:
        added = [v for c, v in zip(self.partitions, self._values(), strict=True) if partitions and c not in self.df.columns]
        rows = self.df.select("*", *added, self._key().alias(sid))
        return rows if kept is self._listed else rows.join(kept.select(F.col("key").alias(sid)), sid, "left_semi").select(*rows.columns)
