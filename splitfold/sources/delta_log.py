"""A catalog whose files are the live ones of a Delta-style transaction log, at its latest version.

The log is replayed with DataFrame operations: of the actions on a path, the one of the highest version counts. A Parquet
checkpoint named by _last_checkpoint stands for the versions up to its own.
"""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitfold.errors import CatalogError
from splitfold.sources.base import CatalogTable, read_parquet

ACTIONS = "add struct<path:string,size:bigint,partitionValues:map<string,string>>, remove struct<path:string>, metaData struct<schemaString:string,partitionColumns:array<string>>, protocol struct<minReaderVersion:int>"
READER_VERSION = 1


class DeltaCatalog(CatalogTable):
    def __init__(self, spark: SparkSession, root: str, strict: bool = True):
        super().__init__(spark)
        self.root = root.rstrip("/")
        self._checked: set[str] | None = set() if strict else None
        if self.root.startswith("s3://"):
            self.root = "s3a://" + self.root[5:]
        actions = self._actions()
        newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c)
        head = actions.agg(newest("metaData"), newest("protocol")).first()
        if head.metaData is None:
            raise CatalogError(f"no metadata in the log of {root}")
        if head.protocol and head.protocol.minReaderVersion > READER_VERSION:
            raise CatalogError(f"{root} needs reader version {head.protocol.minReaderVersion}")
        whole = T.StructType.fromJson(json.loads(head.metaData.schemaString))
        self._columns = list(head.metaData.partitionColumns or [])
        self._schema = T.StructType([f for f in whole.fields if f.name not in self._columns])
        self._live = self._replay(actions)

    def _actions(self) -> DataFrame:
        log = f"{self.root}/_delta_log"
        version = F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("long")
        try:
            commits = self.spark.read.schema(ACTIONS).json(f"{log}/*.json").withColumn("version", version)
        except AnalysisException as e:
            raise CatalogError(f"no log at {log}") from e
        last = self._last_checkpoint(log)
        if last is None:
            return commits
        at, parts = last
        names = [f"{log}/{at:020d}.checkpoint.parquet"] if not parts else [f"{log}/{at:020d}.checkpoint.{k:010d}.{parts:010d}.parquet" for k in range(1, parts + 1)]
        snapshot = self.spark.read.schema(T.StructType.fromDDL(ACTIONS)).parquet(*names).withColumn("version", F.lit(at).cast("long"))
        return snapshot.unionByName(commits.where(F.col("version") > at))

    def _last_checkpoint(self, log: str) -> tuple[int, int] | None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{log}/_last_checkpoint")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return None
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(path)))  # Spark's readers skip names that start with _
        row = json.loads(lines.readLine())
        lines.close()
        return row["version"], row.get("parts") or 0

    def _replay(self, actions: DataFrame) -> DataFrame:
        path = F.coalesce("add.path", "remove.path")
        latest = actions.where("add IS NOT NULL OR remove IS NOT NULL").groupBy(path.alias("path")).agg(F.max_by("add", F.struct("version", F.col("add").isNotNull())).alias("add"))
        values = [F.col("add.partitionValues")[c].alias(c) for c in self._columns]
        return latest.where("add IS NOT NULL").select(F.col("path").alias("key"), F.col("add.size").alias("length"), *values)

    @property
    def data_schema(self) -> T.StructType:
        return self._schema

    @property
    def partition_columns(self) -> list[str]:
        return self._columns

    def files(self) -> DataFrame:
        return self._live

    def read(self, kept: DataFrame, sid: str, partitions: bool = True) -> DataFrame:
        def path(r) -> str:
            key = unquote(r["key"])
            return key if ":/" in key or key.startswith("/") else f"{self.root}/{key}"

        return read_parquet(self.spark, kept, path, self._schema, self._columns, sid, lambda r: r["key"], partitions, self._checked)
