"""Runs staged queries."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from splitfold.errors import BadRequest, PlanError, running
from splitfold.operators import MapStep, reduce_over, reduce_schema
from splitfold.operators.views import fresh
from splitfold.plans.guards import check_step
from splitfold.request import StagedQuery, Step, StepType, parse, parse_steps
from splitfold.sources import CatalogTable, DeltaCatalog, named
from splitfold.stats import QueryStats


@dataclass
class StagedPlan:
    """A checked query: the kept files, the analysed map, and the reduce."""

    query_id: str
    catalog: CatalogTable
    kept: DataFrame
    splits: DataFrame
    sid: str
    mapper: MapStep
    map_name: str
    reduce_sql: str
    stats: QueryStats = field(repr=False)

    @property
    def empty(self) -> bool:
        return self.stats.splits_kept == 0


class Engine:
    """Catalogs by name, and the queries over them. Results are lazy DataFrames."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.catalogs: dict[str, CatalogTable] = {}
        self.last: QueryStats | None = None

    def add_catalog(self, name: str, catalog: CatalogTable) -> Engine:
        self.catalogs[name] = catalog
        return self

    def resolve(self, query: StagedQuery) -> None:
        """Adds the catalogs that a request names."""
        for ref in query.catalogs:
            self.add_catalog(ref.name, DeltaCatalog(self.spark, ref.uri) if ref.type == "DeltaLake" else named(self.spark, ref.uri))

    def _catalog(self, name: str) -> CatalogTable:
        for known, catalog in self.catalogs.items():
            if known.lower() == name.lower():
                return catalog
        raise PlanError(f"no table {name} is registered")

    def _map(self, step: Step) -> tuple[CatalogTable, MapStep]:
        name = check_step(self.spark, step.sql, None, f"map step {step.name}")
        catalog = self._catalog(name)
        return catalog, MapStep(self.spark, step.sql, name, catalog.schema)

    def plan(self, query: StagedQuery) -> StagedPlan:
        """Checks both steps, prunes files and analyses the map; runs nothing but the pruning."""
        began, query_id = time.perf_counter(), f"query-{uuid.uuid4()}"
        catalog, mapper = self._map(query.map)
        sid = fresh("split")
        kept = catalog.prune(query.map.partition_filter)
        splits = catalog.split_ids(kept, sid)
        size = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
        total = size.n if query.map.partition_filter is None else catalog.files().count()
        stats = QueryStats(query_id, splits_kept=size.n, splits_total=total, bytes_kept=size.bytes, warnings=list(query.warnings))
        if size.n:
            # The reduce of an empty selection is neither checked nor run.
            check_step(self.spark, query.reduce.sql, query.map.name, f"reduce step {query.reduce.name}")
            reduce_schema(self.spark, mapper.schema, query.map.name, query.reduce.sql)
        stats.plan_ms = 1000 * (time.perf_counter() - began)
        self.last = stats
        return StagedPlan(query_id, catalog, kept, splits, sid, mapper, query.map.name, query.reduce.sql, stats)

    def _source(self, plan: StagedPlan) -> DataFrame:
        extra = [c for c in plan.catalog.partition_columns if c not in plan.catalog.data_schema.names]
        asked = any(c in plan.mapper.columns for c in extra)
        df = plan.catalog.read(plan.kept, plan.sid, partitions=asked)
        return df if asked or not extra else df.withColumns({c: F.lit(None).cast("string") for c in extra})

    def mapped(self, plan: StagedPlan, strategy: str | None = None) -> DataFrame:
        """The union of the map's rows over all kept splits."""
        if plan.empty:
            return self.spark.createDataFrame([], plan.mapper.schema)
        out, plan.stats.strategy = plan.mapper.run(self._source(plan), plan.splits, plan.sid, strategy)
        return out

    def execute(self, plan: StagedPlan, strategy: str | None = None) -> DataFrame:
        """The reduce's rows. Without a kept file there are none, even for a global aggregate."""
        if plan.empty:
            try:
                schema = reduce_schema(self.spark, plan.mapper.schema, plan.map_name, plan.reduce_sql)
            except PlanError:
                schema = plan.mapper.schema
            return self.spark.createDataFrame([], schema)
        return reduce_over(self.mapped(plan, strategy), plan.map_name, plan.reduce_sql)

    def run(self, request: StagedQuery | str | bytes | dict, strategy: str | None = None) -> DataFrame:
        """The result of a request."""
        query = request if isinstance(request, StagedQuery) else parse(request)
        self.resolve(query)
        return self.execute(self.plan(query), strategy)

    def query(self, map_sql: str, reduce_sql: str, partition_filter: str | None = None, map_name: str = "mapped", strategy: str | None = None) -> DataFrame:
        """A query over catalogs that are already added."""
        steps = (Step(map_sql, map_name, StepType.MAP, partition_filter), Step(reduce_sql, "reduced", StepType.REDUCE))
        return self.run(StagedQuery(steps), strategy)

    def collect(self, request: StagedQuery | str | bytes | dict, strategy: str | None = None) -> list[Row]:
        """The rows of a request, computed now under its query's id; a job that fails is an ExecutionError."""
        result = self.run(request, strategy)
        began, context = time.perf_counter(), self.spark.sparkContext
        context.setJobGroup(self.last.query_id, "staged query")
        try:
            with running(self.last.query_id):
                return result.collect()
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
            self.last.run_ms = 1000 * (time.perf_counter() - began)

    def run_map(self, steps: list | str, splits: int | None = None, partition_filter: str | None = None) -> DataFrame:
        """The map step's rows alone, from the first ``splits`` splits by key, or all."""
        parsed = parse_steps(steps) if isinstance(steps, list) else (Step(steps, "mapped", StepType.MAP, partition_filter),)
        maps = [s for s in parsed if s.step_type is StepType.MAP]
        if not maps:
            raise BadRequest("there is no map step")
        catalog, mapper = self._map(maps[0])
        kept = catalog.prune(maps[0].partition_filter)
        if splits is not None:
            kept = kept.orderBy("key").limit(splits)
        sid = fresh("split")
        stats = QueryStats(f"query-{uuid.uuid4()}", splits_kept=kept.count())
        return self.mapped(StagedPlan(stats.query_id, catalog, kept, catalog.split_ids(kept, sid), sid, mapper, maps[0].name, "", stats))
