"""The map: SQL that is evaluated on each split by itself.

Three strategies give the same rows. ``direct`` runs a stateless query (projections and filters) once over all splits.
``lateral`` correlates the query with the table of splits; Catalyst decorrelates that into one plan in which the split is one
more grouping key. ``per_split`` runs the query on each split and unions the results, for queries that Catalyst can't
decorrelate; its plan grows with the splits, so of more than BATCH splits, each batch's rows are written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitfold.errors import PlanError, planning
from splitfold.operators.views import fresh, over, quoted, viewed
from splitfold.shipping import shared_folder

DIRECT, LATERAL, PER_SPLIT = "direct", "lateral", "per_split"
BATCH = 200
#: Analysed nodes of a query without state.
STATELESS = {"Project", "Filter", "SubqueryAlias", "CTERelationDef"}
UNSUPPORTED = "UNSUPPORTED_SUBQUERY_EXPRESSION_CATEGORY"


class MapStep:
    """A map query over a catalog's schema; analysed, not run."""

    def __init__(self, spark, sql: str, name: str, schema: T.StructType):
        self.spark, self.sql, self.name = spark, sql, name
        with planning(f"map step over {name}"), viewed(spark.createDataFrame([], schema), "empty") as view:
            analysed = spark.sql(over(name, view, sql))
        self.schema = analysed.schema
        self.stateless = self._stateless(analysed._jdf.queryExecution().analyzed())
        text = sql.lower()
        #: Columns that the query may read: those its text names, or all for a star.
        self.columns = {f.name for f in schema.fields if "*" in sql or f.name.lower() in text}

    def _stateless(self, node) -> bool:
        """Whether the query, its common table expressions included, is made of projections and filters only."""
        kind, children = node.getClass().getSimpleName(), node.children()
        if kind == "WithCTE":
            return all(self._stateless(children.apply(i)) for i in range(children.size()))
        if kind in ("View", "LogicalRDD", "LocalRelation", "CTERelationRef"):
            return True
        return kind in STATELESS and children.size() == 1 and self._stateless(children.apply(0))

    def strategy(self, wanted: str | None = None) -> str:
        if wanted == DIRECT and not self.stateless:
            raise PlanError("the direct strategy needs a map query of projections and filters only")
        return wanted or (DIRECT if self.stateless else LATERAL)

    def run(self, source: DataFrame, splits: DataFrame, sid: str, wanted: str | None = None) -> tuple[DataFrame, str]:
        """The union of the map's rows over all splits, and the strategy that was used."""
        how = self.strategy(wanted)
        columns = ", ".join(quoted(c) for c in source.columns if c != sid)
        if how == DIRECT:
            with planning("map step"), viewed(source, "src") as view:
                return self.spark.sql(over(self.name, view, self.sql, columns)), DIRECT
        if how == LATERAL:
            try:
                return self._lateral(source, splits, sid, columns), LATERAL
            except AnalysisException as e:
                if UNSUPPORTED not in str(e) or wanted:
                    raise PlanError(f"map step: {str(e).splitlines()[0]}") from e
        return self._per_split(source, splits, sid, columns), PER_SPLIT

    def _lateral(self, source: DataFrame, splits: DataFrame, sid: str, columns: str) -> DataFrame:
        own, each = fresh("sid"), fresh("split")
        with viewed(source, "src") as src, viewed(splits.select(F.col(sid).alias(own)), "splits") as ids:
            # The source's column sid is hidden from the query by the select list, and the split's by its fresh name.
            body = f"WITH {quoted(self.name)} AS (SELECT {columns} FROM {src} WHERE {src}.{quoted(sid)} = {each}.{own}) SELECT * FROM (\n{self.sql}\n)"
            return self.spark.sql(f"SELECT m.* FROM {ids} {each}, LATERAL ({body}) m")

    def _per_split(self, source: DataFrame, splits: DataFrame, sid: str, columns: str) -> DataFrame:
        ids = sorted(r[0] for r in splits.select(sid).collect())
        batches = []
        for at in range(0, len(ids), BATCH):
            parts = []
            for x in ids[at : at + BATCH]:
                with planning("map step"), viewed(source.where(F.col(sid) == F.lit(x)), "src") as view:
                    parts.append(self.spark.sql(over(self.name, view, self.sql, columns)))
            batches.append(reduce(DataFrame.unionAll, parts))
            if len(ids) > BATCH:
                shared_folder(self.spark)
                batches[-1] = batches[-1].checkpoint()
        return reduce(DataFrame.unionAll, batches)
