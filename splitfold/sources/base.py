"""The contract of a catalog, and reading the files that pruning kept."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitfold.errors import PlanError, planning

#: The file table's bytes up to which it is broadcast to attach partition values; beyond, Spark chooses the join.
BROADCAST_BYTES = 32 << 20


class CatalogTable(ABC):
    """A relation of files. A subclass gives its file table, its schemas and how to read kept files."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @property
    @abstractmethod
    def data_schema(self) -> T.StructType:
        """Columns that the files hold."""

    @property
    @abstractmethod
    def partition_columns(self) -> list[str]:
        """Columns that hold for a whole file, as strings, in order."""

    @abstractmethod
    def files(self) -> DataFrame:
        """(key, length, partition columns...), a row for each file."""

    @abstractmethod
    def read(self, kept: DataFrame, sid: str, partitions: bool = True) -> DataFrame:
        """Rows of the kept files with their split's id in column sid; partition columns only if asked for."""

    @property
    def schema(self) -> T.StructType:
        """All columns that SQL may name: data, then partition columns."""
        names = set(self.data_schema.names)
        return T.StructType([*self.data_schema.fields, *(T.StructField(c, T.StringType()) for c in self.partition_columns if c not in names)])

    def split_ids(self, kept: DataFrame, sid: str) -> DataFrame:
        """A row for each split of the kept files, empty files included."""
        return kept.select(F.col("key").alias(sid)).distinct()

    def prune(self, partition_filter: str | None) -> DataFrame:
        """The file table's rows for which the filter, an expression over its columns, is true."""
        if partition_filter is None:
            return self.files()
        with planning("partition filter"):
            return self.files().where(F.expr(partition_filter))


def file_uris(spark: SparkSession, paths: list[str]) -> list[str]:
    """Each path as a URI; of a local file, with one slash after the scheme, as in file_uri()."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        out.append(re.sub("^file:/+", "file:/", path.getFileSystem(conf).makeQualified(path).toUri().toString()))
    return out


def file_uri():
    """The URI of the file that a row was read from."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")


#: Footers that are read at a time, each by a job of its own.
CHECKS = 16


def check_footers(spark: SparkSession, paths: list[str], expected: T.StructType, known: set[str]) -> None:
    """check_footer() of each path that isn't known to pass, several at a time."""
    new = [p for p in dict.fromkeys(paths) if p not in known]
    with ThreadPoolExecutor(CHECKS) as pool:
        list(pool.map(lambda p: check_footer(spark, p, expected), new))
    known.update(new)


def check_footer(spark: SparkSession, path: str, expected: T.StructType) -> None:
    """Compares a file's fields with the expected ones by position: name and type. Extra trailing fields of either side pass."""
    found = spark.read.parquet(path).schema
    for have, want in zip(found.fields, expected.fields, strict=False):
        if have.name != want.name or have.dataType != want.dataType:
            raise PlanError(f"file {path} has field {have.name} {have.dataType.simpleString()} where {want.name} {want.dataType.simpleString()} is expected")


def read_parquet(spark: SparkSession, kept: DataFrame, path_of, schema: T.StructType, partition_columns: list[str], sid: str, split_of, partitions: bool, checked: set[str] | None) -> DataFrame:
    """The rows of kept Parquet files. path_of and split_of give a row's path and split. Splits are told by each row's file;
    only where partition columns or splits of several files are asked for, the file table is joined on. checked holds the
    files whose schema is known to be right; None leaves schemas unchecked."""
    rows = kept.collect()
    paths = [path_of(r) for r in rows]
    fields = [T.StructField(c, T.StringType()) for c in partition_columns]
    if not rows:
        wanted = [*schema.fields, *(f for f in fields if partitions), T.StructField(sid, T.StringType())]
        return spark.createDataFrame([], T.StructType(wanted))
    if checked is not None:
        check_footers(spark, paths, schema, checked)
    uris = file_uris(spark, paths)
    data = spark.read.schema(schema).parquet(*paths).select(*(F.col(f"`{c}`") for c in schema.names), file_uri().alias("__uri"))
    splits = [split_of(r) for r in rows]
    listed = [(u, s, *(r[c] for c in partition_columns)) for u, s, r in zip(uris, splits, rows, strict=True)]
    table = spark.createDataFrame(listed, T.StructType([T.StructField("__uri", T.StringType()), T.StructField(sid, T.StringType()), *fields]))
    if sum(len(u) + len(s) + 16 * len(fields) for u, s, *_ in listed) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    kept_columns = [sid, *(partition_columns if partitions else [])]
    return data.join(table, "__uri").select(*(F.col(f"`{c}`") for c in schema.names), *kept_columns)
