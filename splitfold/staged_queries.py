"""The engine's own queries on the driver's tables, with the SQL that DuckDB must agree with.

Rows of a table are dealt into virtual splits by a string expression (the year of a date, the day of an event), so that what a
map does for each split shows in the result.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitfold.engine import Engine
from splitfold.shipping import scratch_folder
from splitfold.sources import CatalogFile, DeltaCatalog, StaticCatalog, VirtualCatalog

#: Virtual splits: table, partition column, its expression in Spark and in DuckDB.
SPLITS = {
    "lineitem": ("yr", "CAST(year(l_shipdate) AS STRING)", "CAST(year(l_shipdate) AS VARCHAR)"),
    "orders": ("yr", "CAST(year(o_orderdate) AS STRING)", "CAST(year(o_orderdate) AS VARCHAR)"),
    "events": ("dy", "date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')"),
    "part": ("brand", "p_brand", "p_brand"),
    "embeddings": ("lab", "CAST(label AS STRING)", "CAST(label AS VARCHAR)"),
}


@dataclass(frozen=True)
class Staged:
    table: str
    map_sql: str  # over t
    reduce_sql: str  # over m
    oracle: str  # over src: the table with its split in column sid
    partition_filter: str | None = None
    strategy: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        column, expression, _ = SPLITS[self.table]
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        engine = Engine(spark).add_catalog("t", VirtualCatalog(df, {column: expression}))
        return engine.query(self.map_sql, self.reduce_sql, self.partition_filter, "m", self.strategy)

    def sql(self) -> str:
        column, _, expression = SPLITS[self.table]
        return f"WITH src AS (SELECT *, {expression} AS sid, {expression} AS {column} FROM {self.table}) {self.oracle}"


def _m(map_sql: str, reduce_sql: str) -> str:
    """DuckDB SQL of a grouped map and its reduce: the map also groups by the split."""
    return f", m AS ({map_sql}) {reduce_sql}"


STAGED: dict[str, Staged] = {}


def _add(name: str, *args, **more) -> None:
    STAGED[name] = Staged(*args, **more)


_add(
    "staged_count_sum", "lineitem",
    "SELECT l_returnflag, count(l_returnflag) AS cnt FROM t GROUP BY l_returnflag",
    "SELECT l_returnflag, sum(cnt) AS total FROM m GROUP BY l_returnflag",
    "SELECT l_returnflag, CAST(count(l_returnflag) AS BIGINT) AS total FROM src GROUP BY l_returnflag",
)
_add(
    "staged_sum_sum", "lineitem",
    "SELECT l_returnflag, count(l_quantity) AS n, sum(l_quantity) AS s FROM t GROUP BY l_returnflag",
    "SELECT l_returnflag, sum(n) AS n, round(sum(s), 2) AS s FROM m GROUP BY l_returnflag",
    "SELECT l_returnflag, CAST(count(l_quantity) AS BIGINT) AS n, round(sum(l_quantity), 2) AS s FROM src GROUP BY l_returnflag",
)
_add(
    "staged_group_occurrence", "lineitem",
    "SELECT l_suppkey, count(*) AS cnt FROM t GROUP BY l_suppkey",
    "SELECT l_suppkey, count(cnt) AS n_splits FROM m GROUP BY l_suppkey",
    "SELECT l_suppkey, CAST(count(DISTINCT sid) AS BIGINT) AS n_splits FROM src GROUP BY l_suppkey",
)
_add(
    "staged_avg_decomposed", "orders",
    "SELECT o_orderpriority, sum(o_totalprice) AS s, count(o_totalprice) AS n FROM t GROUP BY o_orderpriority",
    "SELECT o_orderpriority, round(sum(s) / sum(n), 2) AS mean FROM m GROUP BY o_orderpriority",
    "SELECT o_orderpriority, round(sum(o_totalprice) / count(o_totalprice), 2) AS mean FROM src GROUP BY o_orderpriority",
)
_add(
    "staged_avg_of_avg", "orders",
    "SELECT o_orderpriority, avg(o_totalprice) AS a FROM t GROUP BY o_orderpriority",
    "SELECT o_orderpriority, round(avg(a), 2) AS mean FROM m GROUP BY o_orderpriority",
    _m("SELECT sid, o_orderpriority, avg(o_totalprice) AS a FROM src GROUP BY sid, o_orderpriority", "SELECT o_orderpriority, round(avg(a), 2) AS mean FROM m GROUP BY o_orderpriority"),
)
_add(
    "staged_min_max", "lineitem",
    "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_shipdate) AS first FROM t",
    "SELECT min(lo) AS lo, max(hi) AS hi, min(first) AS first, count(*) AS n_splits FROM m",
    "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_shipdate) AS first, CAST(count(DISTINCT sid) AS BIGINT) AS n_splits FROM src",
)
_add(
    "staged_topk_per_split", "orders",
    "SELECT yr, o_orderkey, o_totalprice FROM t ORDER BY o_totalprice DESC, o_orderkey LIMIT 3",
    "SELECT yr, o_orderkey, o_totalprice FROM m",
    "SELECT yr, o_orderkey, o_totalprice FROM src QUALIFY row_number() OVER (PARTITION BY sid ORDER BY o_totalprice DESC, o_orderkey) <= 3",
)
_add(
    "staged_offset_per_split", "orders",
    "SELECT yr, o_orderkey FROM t ORDER BY o_orderkey LIMIT 2 OFFSET 3",
    "SELECT yr, o_orderkey FROM m",
    "SELECT yr, o_orderkey FROM src QUALIFY row_number() OVER (PARTITION BY sid ORDER BY o_orderkey) BETWEEN 4 AND 5",
)
_add(
    "staged_topk_global", "orders",
    "SELECT o_orderkey, o_totalprice FROM t ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "SELECT o_orderkey, o_totalprice FROM m ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "SELECT o_orderkey, o_totalprice FROM src ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
_add(
    "staged_distinct_per_split", "events",
    "SELECT DISTINCT event_type FROM t",
    "SELECT event_type, count(*) AS n_splits FROM m GROUP BY event_type",
    "SELECT event_type, CAST(count(DISTINCT sid) AS BIGINT) AS n_splits FROM src GROUP BY event_type",
)
_add(
    "staged_count_distinct_per_split", "events",
    "SELECT dy, count(DISTINCT user_id) AS users FROM t GROUP BY dy",
    "SELECT dy, users FROM m",
    "SELECT dy, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM src GROUP BY dy",
)
_add(
    "staged_having", "events",
    "SELECT user_id, count(*) AS n FROM t GROUP BY user_id HAVING count(*) > 2",
    "SELECT user_id, sum(n) AS n, count(*) AS days FROM m GROUP BY user_id HAVING count(*) >= 1",
    _m("SELECT sid, user_id, count(*) AS n FROM src GROUP BY sid, user_id HAVING count(*) > 2", "SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS days FROM m GROUP BY user_id"),
)
_add(
    "staged_multi_key", "lineitem",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n FROM t GROUP BY l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, sum(q) AS q, sum(n) AS n FROM m GROUP BY l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, CAST(count(*) AS BIGINT) AS n FROM src GROUP BY l_returnflag, l_linestatus",
)
_add(
    "staged_global_agg_empty_split", "orders",
    "SELECT count(o_orderkey) AS n, coalesce(sum(o_totalprice), -1) AS s FROM t WHERE yr = '1995' AND o_totalprice > 0",
    "SELECT n, count(*) AS n_splits FROM m GROUP BY n",
    _m("SELECT sid, count(o_orderkey) FILTER (yr = '1995' AND o_totalprice > 0) AS n FROM src GROUP BY sid", "SELECT CAST(n AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_splits FROM m GROUP BY n"),
)
_add(
    "staged_window_rank", "orders",
    "SELECT yr, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM t",
    "SELECT yr, rn, count(*) AS n, max(o_orderkey) AS last FROM m GROUP BY yr, rn",
    _m("SELECT yr, o_orderkey, row_number() OVER (PARTITION BY sid, o_custkey ORDER BY o_orderkey) AS rn FROM src", "SELECT yr, CAST(rn AS INTEGER) AS rn, CAST(count(*) AS BIGINT) AS n, max(o_orderkey) AS last FROM m GROUP BY yr, rn"),
)
_add(
    "staged_window_frame", "events",
    "SELECT dy, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM t",
    "SELECT dy, n, count(*) AS rows FROM m GROUP BY dy, n",
    _m("SELECT dy, count(*) OVER (PARTITION BY sid, user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM src", "SELECT dy, CAST(n AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS rows FROM m GROUP BY dy, n"),
)
for _name, _groups in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    _add(
        f"staged_{_name}", "lineitem",
        f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM t GROUP BY {_groups}",
        "SELECT l_returnflag, l_linestatus, sum(n) AS n, count(*) AS n_splits FROM m GROUP BY l_returnflag, l_linestatus",
        f", ids AS (SELECT DISTINCT sid FROM src), m AS (SELECT sid, l_returnflag, l_linestatus, count(*) AS n FROM src GROUP BY sid, {_groups}) SELECT l_returnflag, l_linestatus, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_splits FROM m GROUP BY l_returnflag, l_linestatus",
    )
_add("staged_select_star", "part", "SELECT * FROM t", "SELECT * FROM m", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, brand FROM src")
_add("staged_projection_alias", "part", "SELECT p_partkey AS id, p_size AS size, p_retailprice * 2 AS twice FROM t", "SELECT id, size, round(twice, 2) AS twice FROM m", "SELECT p_partkey AS id, p_size AS size, round(p_retailprice * 2, 2) AS twice FROM src")
_add("staged_where_int", "part", "SELECT p_partkey FROM t WHERE p_size = 7", "SELECT count(*) AS n FROM m", "SELECT CAST(count(*) AS BIGINT) AS n FROM src WHERE p_size = 7")
_add("staged_where_string_range", "orders", "SELECT o_orderkey FROM t WHERE o_orderpriority >= '2' AND o_orderpriority <= '4-Z' AND o_orderstatus = 'F'", "SELECT count(*) AS n FROM m", "SELECT CAST(count(*) AS BIGINT) AS n FROM src WHERE o_orderpriority >= '2' AND o_orderpriority <= '4-Z' AND o_orderstatus = 'F'")
_add("staged_predicates", "part", "SELECT p_partkey FROM t WHERE (p_size BETWEEN 3 AND 9 OR p_type LIKE '%A%') AND NOT p_brand IN ('Brand#11', 'Brand#12') AND p_name IS NOT NULL", "SELECT count(*) AS n FROM m", "SELECT CAST(count(*) AS BIGINT) AS n FROM src WHERE (p_size BETWEEN 3 AND 9 OR p_type LIKE '%A%') AND NOT p_brand IN ('Brand#11', 'Brand#12') AND p_name IS NOT NULL")
_add("staged_nested_with", "orders", "WITH big AS (SELECT * FROM t WHERE o_totalprice > 1000) SELECT o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus FROM big) x GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(n) AS n FROM m GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM src WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
_add("staged_stddev_corr", "lineitem", "SELECT l_returnflag, stddev_samp(l_quantity) AS d, corr(l_quantity, l_extendedprice) AS c FROM t GROUP BY l_returnflag", "SELECT l_returnflag, round(avg(d), 6) AS d, round(avg(c), 6) AS c FROM m GROUP BY l_returnflag", _m("SELECT sid, l_returnflag, stddev_samp(l_quantity) AS d, corr(l_quantity, l_extendedprice) AS c FROM src GROUP BY sid, l_returnflag", "SELECT l_returnflag, round(avg(d), 6) AS d, round(avg(c), 6) AS c FROM m GROUP BY l_returnflag"))
_add("prune_direct", "orders", "SELECT o_orderkey, yr FROM t WHERE o_totalprice > 1000", "SELECT o_orderkey, yr FROM m", "SELECT o_orderkey, yr FROM src WHERE o_totalprice > 1000 AND yr = '1996'", partition_filter="yr = '1996'")
_add("prune_eq", "orders", "SELECT o_orderstatus, count(*) AS n FROM t GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(n) AS n FROM m GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM src WHERE yr = '1996' GROUP BY o_orderstatus", partition_filter="yr = '1996'")
_add("prune_range", "lineitem", "SELECT l_returnflag, sum(l_quantity) AS q FROM t GROUP BY l_returnflag", "SELECT l_returnflag, sum(q) AS q FROM m GROUP BY l_returnflag", "SELECT l_returnflag, sum(l_quantity) AS q FROM src WHERE yr >= '1996' AND yr <= '1998' GROUP BY l_returnflag", partition_filter="yr >= '1996' AND yr <= '1998'")
_add("prune_in_or_like", "orders", "SELECT yr, count(*) AS n FROM t GROUP BY yr", "SELECT yr, n FROM m", "SELECT yr, CAST(count(*) AS BIGINT) AS n FROM src WHERE yr IN ('1996', '1999') OR yr LIKE '%7' GROUP BY yr", partition_filter="yr IN ('1996', '1999') OR yr LIKE '%7'")
_add("prune_by_length", "part", "SELECT brand, count(*) AS n FROM t GROUP BY brand", "SELECT brand, n FROM m", ", m AS (SELECT brand, count(*) AS n FROM src GROUP BY brand) SELECT brand, CAST(n AS BIGINT) AS n FROM m WHERE n >= 80", partition_filter="length >= 80")
_add("prune_by_key", "orders", "SELECT yr, count(*) AS n FROM t GROUP BY yr", "SELECT yr, n FROM m", "SELECT yr, CAST(count(*) AS BIGINT) AS n FROM src WHERE yr = '1997' GROUP BY yr", partition_filter="key = '1997'")
_add("prune_to_empty", "orders", "SELECT count(*) AS n FROM t", "SELECT sum(n) AS n FROM m", "SELECT CAST(count(*) AS BIGINT) AS n FROM src WHERE false HAVING false", partition_filter="yr = 'none'")
_add("prune_then_group", "orders", "SELECT o_orderpriority, yr, count(*) AS n FROM t WHERE o_totalprice > 50000 GROUP BY o_orderpriority, yr", "SELECT o_orderpriority, sum(n) AS n, count(*) AS years FROM m GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT yr) AS BIGINT) AS years FROM src WHERE o_totalprice > 50000 AND yr > '1997' GROUP BY o_orderpriority", partition_filter="yr > '1997'")
_add("fn_string", "part", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, trim(concat('  ', p_brand, ' ')) AS b, length(p_name) AS n, substring(p_name, 2, 3) AS s, replace(p_brand, '#', '-') AS r, split_part(p_brand, '#', 2) AS sp, lpad(CAST(p_size AS STRING), 4, '0') AS pad, regexp_replace(p_brand, '[0-9]+', 'N') AS rx, startswith(p_name, 'a') AS st FROM t", "SELECT * FROM m", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, trim(concat('  ', p_brand, ' ')) AS b, CAST(length(p_name) AS INTEGER) AS n, substring(p_name, 2, 3) AS s, replace(p_brand, '#', '-') AS r, split_part(p_brand, '#', 2) AS sp, lpad(CAST(p_size AS VARCHAR), 4, '0') AS pad, regexp_replace(p_brand, '[0-9]+', 'N') AS rx, starts_with(p_name, 'a') AS st FROM src")
_add("fn_date", "orders", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS mon, extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate) AS mo, date_add(to_date(o_orderdate), 10) AS later, datediff(to_date(o_orderdate), DATE '1992-01-01') AS days FROM t", "SELECT o_orderkey, CAST(mon AS STRING) AS mon, y, mo, CAST(later AS STRING) AS later, days FROM m", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS mon, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo, strftime(CAST(o_orderdate AS DATE) + 10, '%Y-%m-%d') AS later, CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS INTEGER) AS days FROM src")
_add("fn_math", "part", "SELECT p_partkey, abs(10 - p_size) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(sqrt(p_retailprice), 6) AS s, round(exp(p_size / 50), 6) AS e, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS g, round(power(p_size, 2), 3) AS p, round(sin(p_size), 6) AS sn, p_size % 7 AS md FROM t", "SELECT * FROM m", "SELECT p_partkey, abs(10 - p_size) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(sqrt(p_retailprice), 6) AS s, round(exp(p_size / 50), 6) AS e, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS g, round(power(p_size, 2), 3) AS p, round(sin(p_size), 6) AS sn, p_size % 7 AS md FROM src")
_add("fn_conditional", "part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS k, coalesce(nullif(p_size, 7), -1) AS z, greatest(p_size, 20) AS g, least(p_size, 20) AS l FROM t", "SELECT k, count(*) AS n, sum(z) AS z, sum(g) AS g, sum(l) AS l FROM m GROUP BY k", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS k, CAST(count(*) AS BIGINT) AS n, CAST(sum(coalesce(nullif(p_size, 7), -1)) AS BIGINT) AS z, CAST(sum(greatest(p_size, 20)) AS BIGINT) AS g, CAST(sum(least(p_size, 20)) AS BIGINT) AS l FROM src GROUP BY k")
_add("fn_cast", "part", "SELECT p_partkey, CAST(p_size AS STRING) AS s, CAST(p_size AS DOUBLE) AS d, try_cast(p_name AS INT) AS i, CAST(p_partkey AS INT) AS k FROM t", "SELECT * FROM m", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS DOUBLE) AS d, try_cast(p_name AS INTEGER) AS i, CAST(p_partkey AS INTEGER) AS k FROM src")
_add("fn_hash", "part", "SELECT p_partkey, md5(p_name) AS h, sha2(p_name, 256) AS s FROM t", "SELECT * FROM m", "SELECT p_partkey, md5(p_name) AS h, sha256(p_name) AS s FROM src")
_add("fn_json", "events", "SELECT event_id, get_json_object(props, '$.k') AS k, length(props) AS n FROM t", "SELECT k, count(*) AS n, sum(n) AS chars FROM m GROUP BY k", "SELECT json_extract_string(props, '$.k') AS k, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(props)) AS BIGINT) AS chars FROM src GROUP BY 1")
_add("fn_array", "embeddings", "SELECT lab, size(embedding) AS n, CAST(element_at(embedding, 1) AS DOUBLE) AS x FROM t", "SELECT lab, max(n) AS n, round(max(x), 5) AS x FROM m GROUP BY lab", "SELECT lab, CAST(max(len(embedding)) AS INTEGER) AS n, round(max(CAST(embedding[1] AS DOUBLE)), 5) AS x FROM src GROUP BY lab")
_add("approx_distinct", "events", "SELECT dy, approx_count_distinct(user_id, 0.01) AS n, count(DISTINCT user_id) AS exact FROM t GROUP BY dy", "SELECT dy, exact, abs(n - exact) <= 1 + 0.05 * exact AS near FROM m", "SELECT dy, CAST(count(DISTINCT user_id) AS BIGINT) AS exact, true AS near FROM src GROUP BY dy")
_add("percentile_bounds", "events", "SELECT dy, percentile_approx(value, 0.5, 100000) AS mid, percentile(value, 0.25) AS low FROM t GROUP BY dy", "SELECT dy, mid, round(low, 6) AS low FROM m", "SELECT dy, list_sort(list(value))[CAST(ceil(0.5 * count(value)) AS BIGINT)] AS mid, round(quantile_cont(value, 0.25), 6) AS low FROM src GROUP BY dy")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The data files of a table, with their bytes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(at)]
    return [x for x in found if x[0].endswith(".parquet")]


def _static(spark: SparkSession, sf_dir: str, table: str, split: str | None = None) -> Engine:
    path = f"{sf_dir}/{table}.parquet"
    files = [CatalogFile(p, n, (table,), split) for p, n in _files(spark, path)]
    return Engine(spark).add_catalog("t", StaticCatalog(spark, spark.read.parquet(path).schema, "", ["origin"], files, strict=True))


def static_catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _static(spark, sf_dir, "supplier").query("SELECT origin, s_nationkey, count(*) AS n FROM t GROUP BY origin, s_nationkey", "SELECT origin, s_nationkey, sum(n) AS n FROM m GROUP BY origin, s_nationkey", "origin = 'supplier' AND length > 0", "m")


def static_multi_file_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _static(spark, sf_dir, "customer", "all").query("SELECT count(DISTINCT c_mktsegment) AS n, count(*) AS rows FROM t", "SELECT n, rows FROM m", None, "m")


def file_table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    column, expression, _ = SPLITS["orders"]
    return VirtualCatalog(spark.read.parquet(f"{sf_dir}/orders.parquet"), {column: expression}).files()


def map_only_first_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    column, expression, _ = SPLITS["orders"]
    engine = Engine(spark).add_catalog("t", VirtualCatalog(spark.read.parquet(f"{sf_dir}/orders.parquet"), {column: expression}))
    return engine.run_map("SELECT yr, o_orderstatus, count(*) AS n FROM t GROUP BY yr, o_orderstatus", splits=1)


def map_only_stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    column, expression, _ = SPLITS["orders"]
    engine = Engine(spark).add_catalog("t", VirtualCatalog(spark.read.parquet(f"{sf_dir}/orders.parquet"), {column: expression}))
    return engine.run_map("SELECT yr, o_orderkey FROM t WHERE o_orderstatus = 'F'", splits=2, partition_filter="yr > '1996'")


def _by_year(spark: SparkSession, sf_dir: str) -> tuple[str, list[tuple[str, int, str]]]:
    """orders in the shared folder with a file or more for each year: the folder, and each file's key, bytes and year."""
    root = scratch_folder(spark, "orders")
    column, expression, _ = SPLITS["orders"]
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("*", f"{expression} AS {column}").repartition(3, "o_custkey").write.mode("overwrite").partitionBy(column).parquet(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(path, True)
    files = []
    while found.hasNext():
        status = found.next()
        at = status.getPath().toString()
        if at.endswith(".parquet"):
            year = at.split(f"/{column}=")[1].split("/")[0]
            files.append((f"{column}={year}/{status.getPath().getName()}", status.getLen(), year))
    return root, sorted(files)


def static_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static catalog of several files a year, which a split holds together; the filter prunes years."""
    root, files = _by_year(spark, sf_dir)
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    catalog = StaticCatalog(spark, schema, root, ["yr"], [CatalogFile(k, n, (y,), y) for k, n, y in files])
    return Engine(spark).add_catalog("t", catalog).query("SELECT yr, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM t GROUP BY yr", "SELECT yr, customers, n FROM m", "yr >= '1996' AND yr <> '1998'", "m")


def _log(spark: SparkSession, root: str, schema, partition: str, versions: list[list[dict]]) -> DeltaCatalog:
    """A catalog of a log under root; the first version also gets the metadata."""
    fields = [{"name": f.name, "type": f.dataType.typeName(), "nullable": True, "metadata": {}} for f in schema]
    meta = {"metaData": {"schemaString": json.dumps({"type": "struct", "fields": [*fields, {"name": partition, "type": "string", "nullable": True, "metadata": {}}]}), "partitionColumns": [partition]}}
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for k, actions in enumerate(versions):
        out = fs.create(path(f"{root}/_delta_log/{k:020d}.json"))
        out.write(bytearray("".join(json.dumps(a) + "\n" for a in ([{"protocol": {"minReaderVersion": 1}}, meta, *actions] if k == 0 else actions)).encode()))
        out.close()
    return DeltaCatalog(spark, root)


def _delta(spark: SparkSession, sf_dir: str) -> DeltaCatalog:
    """A log of orders by year in three versions: the second removes 1996 and 1997, the third adds 1997 again."""
    root, files = _by_year(spark, sf_dir)
    add = [{"add": {"path": k, "size": n, "partitionValues": {"yr": y}}} for k, n, y in files]
    gone = [{"remove": {"path": k}} for k, _, y in files if y in ("1996", "1997")]
    again = [a for a in add if a["add"]["partitionValues"]["yr"] == "1997"]
    return _log(spark, root, spark.read.parquet(f"{sf_dir}/orders.parquet").schema, "yr", [add, gone, again])


def delta_latest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir).files().groupBy("yr").agg(F.min(F.col("length") > 0).alias("filled"))


def delta_partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).add_catalog("t", _delta(spark, sf_dir)).query("SELECT yr, o_orderstatus, count(*) AS n FROM t GROUP BY yr, o_orderstatus", "SELECT yr, o_orderstatus, sum(n) AS n FROM m GROUP BY yr, o_orderstatus", "yr BETWEEN '1996' AND '1999'", "m")


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "static_catalog_scan": (static_catalog_scan, "SELECT 'supplier' AS origin, s_nationkey, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY s_nationkey"),
    "static_multi_file_split": (static_multi_file_split, "SELECT CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS rows FROM customer"),
    "file_table_listing": (file_table_listing, "SELECT CAST(year(o_orderdate) AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS length, CAST(year(o_orderdate) AS VARCHAR) AS yr FROM orders GROUP BY 1"),
    "map_only_first_split": (map_only_first_split, "WITH o AS (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS yr FROM orders) SELECT yr, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM o WHERE yr = (SELECT min(yr) FROM o) GROUP BY yr, o_orderstatus"),
    "map_only_stateless": (map_only_stateless, "WITH o AS (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS yr FROM orders) SELECT yr, o_orderkey FROM o WHERE o_orderstatus = 'F' AND yr IN (SELECT DISTINCT yr FROM o WHERE yr > '1996' ORDER BY yr LIMIT 2)"),
    "static_by_year": (static_by_year, "SELECT CAST(year(o_orderdate) AS VARCHAR) AS yr, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(*) AS BIGINT) AS n FROM orders WHERE year(o_orderdate) >= 1996 AND year(o_orderdate) <> 1998 GROUP BY 1"),
    "delta_latest_listing": (delta_latest_listing, "SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS yr, true AS filled FROM orders WHERE year(o_orderdate) <> 1996"),
    "delta_partitioned_scan": (delta_partitioned_scan, "SELECT CAST(year(o_orderdate) AS VARCHAR) AS yr, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1999 GROUP BY 1, 2"),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q.run for k, q in STAGED.items()} | {k: f for k, (f, _) in OTHERS.items()}
ORACLE: dict[str, str] = {k: q.sql() for k, q in STAGED.items() if q.oracle} | {k: sql for k, (_, sql) in OTHERS.items()}
