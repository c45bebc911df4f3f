"""A catalog whose files are listed by hand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from splitfold.errors import CatalogError
from splitfold.sources.base import CatalogTable, read_parquet


@dataclass(frozen=True)
class CatalogFile:
    """A file's key below the catalog's root, its bytes, its partition values, and the split it belongs to (by default its own)."""

    key: str
    length: int
    partitions: tuple[str, ...] = ()
    split: str | None = None


class StaticCatalog(CatalogTable):
    """strict: each file's schema is checked before its first read."""

    def __init__(self, spark: SparkSession, schema: T.StructType, root: str, partition_columns: list[str], files: list[CatalogFile], strict: bool = True):
        super().__init__(spark)
        for f in files:
            if len(f.partitions) != len(partition_columns):
                raise CatalogError(f"file {f.key} has {len(f.partitions)} partition values for {len(partition_columns)} partition columns")
            if f.length < 0:
                raise CatalogError(f"file {f.key} has a negative length")
        self._schema, self.root, self._columns, self._files = schema, root.rstrip("/"), list(partition_columns), list(files)
        self._checked: set[str] | None = set() if strict else None
        self._split = {f.key: f.split or f.key for f in files}

    @property
    def data_schema(self) -> T.StructType:
        return self._schema

    @property
    def partition_columns(self) -> list[str]:
        return self._columns

    def files(self) -> DataFrame:
        fields = [T.StructField("key", T.StringType(), False), T.StructField("length", T.LongType(), False), *(T.StructField(c, T.StringType(), False) for c in self._columns)]
        return self.spark.createDataFrame([(f.key, f.length, *f.partitions) for f in self._files], T.StructType(fields))

    def path(self, key: str) -> str:
        return key if "://" in key or key.startswith("/") or not self.root else f"{self.root}/{key}"

    def split_ids(self, kept: DataFrame, sid: str) -> DataFrame:
        ids = sorted({self._split[r.key] for r in kept.select("key").collect()})
        return self.spark.createDataFrame([(x,) for x in ids], T.StructType([T.StructField(sid, T.StringType())]))

    def read(self, kept: DataFrame, sid: str, partitions: bool = True) -> DataFrame:
        return read_parquet(self.spark, kept, lambda r: self.path(r["key"]), self._schema, self._columns, sid, lambda r: self._split[r["key"]], partitions, self._checked)
