import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitfold import Engine
from splitfold.errors import BadRequest, CatalogError, NotImplementedQuery, PlanError
from splitfold.sources import CatalogFile, DeltaCatalog, StaticCatalog, VirtualCatalog, named, register
from splitfold.sources.base import check_footer


@pytest.fixture(scope="module")
def orders(spark, sf_dir, tmp_path_factory):
    """orders with a file for each year, and an empty file."""
    root = tmp_path_factory.mktemp("orders by year")
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("yr", F.year("o_orderdate").cast("string"))
    files, years = [], sorted(r.yr for r in df.select("yr").distinct().collect())
    for k, y in enumerate([*years, "empty"]):
        at = root / f"{y}.parquet"
        df.where(F.col("yr") == y).drop("yr").toPandas().to_parquet(at, index=False, coerce_timestamps="us", schema=None)
        files.append(CatalogFile(f"{y}.parquet", at.stat().st_size, (y, str(k % 2))))
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    return StaticCatalog(spark, schema, str(root), ["yr", "odd"], [f for f in files if not f.key.startswith("empty")])


@pytest.fixture
def engine(spark, orders):
    return Engine(spark).add_catalog("t", orders)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_splits_and_pruning(engine, orders):
    n = orders.files().count()
    assert n == 7
    engine.query("SELECT * FROM t", "SELECT * FROM mapped")
    assert engine.last.splits_kept == n
    engine.query("SELECT o_orderkey FROM t WHERE o_orderstatus = 'F'", "SELECT * FROM mapped", "yr >= '1996' AND yr <= '1998'")
    assert engine.last.splits_kept == 3 and engine.last.bytes_kept > 0
    for text, kept in (("key LIKE '%1997%'", 1), ("length > 0 AND odd = '1'", 3), ("NOT (yr IN ('1995')) OR yr IS NULL", 6)):
        engine.query("SELECT * FROM t", "SELECT * FROM mapped", text)
        assert engine.last.splits_kept == kept


def test_partition_columns_are_readable(engine):
    out = engine.query("SELECT yr, count(*) AS n FROM t GROUP BY yr", "SELECT yr, n FROM mapped", "odd = '0'").collect()
    assert sorted(r.yr for r in out) == ["1995", "1997", "1999", "2001"]


def test_map_runs_on_each_file(engine):
    assert engine.query("SELECT count(*) AS n FROM t", "SELECT count(n) AS files FROM mapped").first().files == 7
    assert engine.query("SELECT o_orderkey FROM t ORDER BY o_orderkey LIMIT 2", "SELECT count(*) AS n FROM mapped").first().n == 14


STRATEGIES = [
    "SELECT o_orderstatus, count(*) AS n, avg(o_totalprice) AS a FROM t GROUP BY o_orderstatus",
    "SELECT count(DISTINCT o_custkey) AS n FROM t WHERE o_totalprice < 0",
    "SELECT DISTINCT o_orderpriority FROM t",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM t WHERE o_orderkey < 100",
    "SELECT o_orderkey, o_totalprice + 1 AS p FROM t WHERE o_totalprice > 1000 AND yr <> '1996'",
    "WITH x AS (SELECT o_custkey AS c FROM t) SELECT c, count(*) AS n FROM x GROUP BY c HAVING count(*) > 1 ORDER BY c LIMIT 5",
]


@pytest.mark.parametrize("sql", STRATEGIES)
def test_strategies_agree(engine, sql):
    ways = {s: got(engine.query(sql, "SELECT * FROM mapped", strategy=s)) for s in ("lateral", "per_split", None)}
    assert ways["lateral"] == ways["per_split"] == ways[None]


@pytest.fixture(scope="module")
def kinds(spark, sf_dir, orders, tmp_path_factory):
    """The three kinds of catalogs over the same rows and years."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    fields = [{"name": f.name, "type": f.dataType.typeName(), "nullable": True, "metadata": {}} for f in orders.data_schema] + [{"name": "yr", "type": "string", "nullable": True, "metadata": {}}]
    root = tmp_path_factory.mktemp("log")
    import json

    _log(root, [[{"metaData": {"schemaString": json.dumps({"type": "struct", "fields": fields}), "partitionColumns": ["yr"]}}, *(_add(orders.path(f.key).replace(" ", "%20"), f.length, None) | {"add": {"path": orders.path(f.key).replace(" ", "%20"), "size": f.length, "partitionValues": {"yr": f.partitions[0]}}} for f in orders._files)]])
    return {"static": orders, "delta": DeltaCatalog(spark, str(root)), "virtual": VirtualCatalog(df, {"yr": "CAST(year(o_orderdate) AS STRING)"})}


@pytest.mark.parametrize("kind", ["static", "delta", "virtual"])
@pytest.mark.parametrize("sql", ["SELECT o_orderkey FROM t WHERE o_totalprice > 1000", "SELECT yr, o_orderkey FROM t", "SELECT o_orderstatus, count(*) AS n FROM t GROUP BY o_orderstatus"])
def test_filters_hold_under_each_strategy_and_catalog(spark, kinds, kind, sql):
    e = Engine(spark).add_catalog("t", kinds[kind])
    ways = ["lateral", "per_split", None] + (["direct"] if "GROUP" not in sql else [])
    got_by = [got(e.query(sql, "SELECT * FROM mapped", "yr IN ('1996', '1998')", strategy=s)) for s in ways]
    assert all(g == got_by[0] for g in got_by) and (e.last.splits_kept, e.last.splits_total) == (2, 7)
    years = "SELECT yr, count(*) AS n FROM t GROUP BY yr"
    assert [r.yr for r in sorted(e.query(years, "SELECT * FROM mapped", "yr IN ('1996', '1998')").collect())] == ["1996", "1998"]


def test_stateless_map_of_some_splits_only(spark):
    df = spark.createDataFrame([("1995", 1), ("1996", 2), ("1997", 3)], "y string, v int")
    e = Engine(spark).add_catalog("t", VirtualCatalog(df, {"yr": "y"}))
    assert got(e.query("SELECT v FROM t", "SELECT v FROM mapped", "yr = '1996'")) == [(2,)]
    assert got(e.run_map("SELECT v FROM t", splits=1)) == [(1,)]


def test_odd_keys_and_names_of_virtual_files(spark):
    rows = [("a/b", "c", 1), ("a", "b/c", 2), (None, "x", 3), ("__null__", "x", 4), ("a\\", "/c", 5), ("a\\/", "c", 6)]
    df = spark.createDataFrame(rows, "p string, q string, m int")
    e = Engine(spark).add_catalog("t", VirtualCatalog(df, {"one": "p", "two": "q"}))
    assert got(e.query("SELECT count(*) AS n FROM t", "SELECT n, count(*) AS splits FROM mapped GROUP BY n")) == [(1, 6)]
    assert got(e.query("SELECT p, m, count(*) AS n FROM t GROUP BY p, m", "SELECT m, n FROM mapped", "one IS NULL")) == [(3, 1)]


def test_grouping_sets_over_many_splits(spark, monkeypatch):
    from splitfold.operators import mapper

    monkeypatch.setattr(mapper, "BATCH", 3)
    df = spark.createDataFrame([(k % 7, k % 2, k) for k in range(70)], "s int, g int, v int")
    e = Engine(spark).add_catalog("t", VirtualCatalog(df, {"sid": "s"}))
    out = e.query("SELECT g, sum(v) AS v FROM t GROUP BY ROLLUP (g)", "SELECT g, sum(v) AS v, count(*) AS n FROM mapped GROUP BY g")
    assert e.last.strategy == "per_split" and got(out) == sorted([(0, sum(range(0, 70, 2)), 7), (1, sum(range(1, 70, 2)), 7), (None, sum(range(70)), 7)], key=str)


def test_failing_jobs_are_execution_errors(engine):
    from splitfold.errors import ExecutionError
    from splitfold.request import StagedQuery, Step, StepType

    steps = lambda sql: StagedQuery((Step(sql, "m", StepType.MAP, None), Step("SELECT * FROM m", "r", StepType.REDUCE)))
    with pytest.raises(ExecutionError):
        engine.collect(steps("SELECT raise_error('no') AS x FROM t"))
    assert len(engine.collect(steps("SELECT yr, count(*) AS n FROM t GROUP BY yr"))) == 7 and engine.last.run_ms > 0


def test_schemas_are_checked_by_default(spark, orders):
    wrong = T.StructType([T.StructField("o_orderkey", T.StringType()), *orders.data_schema.fields[1:]])
    e = Engine(spark).add_catalog("t", StaticCatalog(spark, wrong, orders.root, ["yr", "odd"], orders._files))
    with pytest.raises(PlanError):
        e.query("SELECT o_orderkey FROM t", "SELECT * FROM mapped")


def test_strategy_is_reported_and_checked(engine):
    engine.query("SELECT o_orderkey FROM t", "SELECT * FROM mapped")
    assert engine.last.strategy == "direct"
    engine.query("SELECT o_orderstatus, count(*) AS n FROM t GROUP BY ROLLUP (o_orderstatus)", "SELECT * FROM mapped")
    assert engine.last.strategy == "per_split"
    with pytest.raises(PlanError):
        engine.query("SELECT count(*) AS n FROM t", "SELECT * FROM mapped", strategy="direct")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.integers(-50, 50)), max_size=30))
def test_decomposable_pairs_equal_a_single_pass(spark, rows):
    df = spark.createDataFrame(rows, "s long, k long, v long")
    e = Engine(spark).add_catalog("t", VirtualCatalog(df, {"sid": "s"}))
    pair = ("SELECT k, count(*) AS n, sum(v) AS v FROM t GROUP BY k", "SELECT k, sum(n) AS n, sum(v) AS v FROM mapped GROUP BY k")
    want = got(df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("v")))
    assert got(e.query(*pair, strategy="lateral")) == want
    assert got(e.query(*pair, strategy="per_split")) == want


def test_empty_selection_gives_no_rows_and_no_reduce_check(engine):
    out = engine.query("SELECT count(*) AS n FROM t", "SELECT sum(n) AS n FROM mapped", "yr = 'none'")
    assert out.columns == ["n"] and out.count() == 0
    assert engine.query("SELECT count(*) AS n FROM t", "SELECT wrong FROM nowhere", "yr = 'none'").count() == 0


@pytest.mark.parametrize(
    "sql, error",
    [
        ("SELECT a.* FROM t a JOIN t b ON a.o_orderkey = b.o_orderkey", NotImplementedQuery),
        ("SELECT * FROM t, t x", NotImplementedQuery),
        ("SELECT o_orderkey FROM t UNION ALL SELECT o_orderkey FROM t", NotImplementedQuery),
        ("SELECT o_orderkey FROM t INTERSECT SELECT o_orderkey FROM t", NotImplementedQuery),
        ("SELECT o_orderkey FROM t EXCEPT SELECT o_orderkey FROM t", NotImplementedQuery),
        ("SELECT * FROM t WHERE o_orderkey IN (SELECT o_orderkey FROM t)", NotImplementedQuery),
        ("SELECT (SELECT max(o_orderkey) FROM t) AS m FROM t", NotImplementedQuery),
        ("SELECT * FROM t WHERE EXISTS (SELECT 1 FROM t)", NotImplementedQuery),
        ("SELECT * FROM t LEFT SEMI JOIN t b ON t.o_orderkey = b.o_orderkey", NotImplementedQuery),
        ("SELECT 1 AS one", BadRequest),
        ("SELECT * FROM range(3)", BadRequest),
        ("DROP TABLE t", BadRequest),
        ("CREATE TEMP VIEW v AS SELECT * FROM t", BadRequest),
        ("SET x = 1", BadRequest),
        ("EXPLAIN SELECT * FROM t", BadRequest),
        ("SELECT * FROM parquet.`/tmp/x`", PlanError),
        ("SELECT * FROM unknown", PlanError),
        ("SELECT wrong FROM t", PlanError),
        ("SELEC * FROM t", PlanError),
        ("SELECT * FROM t; SELECT * FROM t", PlanError),
    ],
)
def test_refused_map_steps(engine, sql, error):
    with pytest.raises(error):
        engine.query(sql, "SELECT * FROM mapped")


@pytest.mark.parametrize("sql, error", [("SELECT * FROM t", BadRequest), ("SELECT wrong FROM mapped", PlanError), ("SELECT * FROM mapped, mapped x", NotImplementedQuery)])
def test_refused_reduce_steps(engine, sql, error):
    with pytest.raises(error):
        engine.query("SELECT o_orderkey FROM t", sql)


@pytest.mark.parametrize("text", ["wrong = 1", "t.yr = '1997'", "yr = '1997' ORDER BY yr", "yr = '1997'; DROP TABLE t"])
def test_refused_filters(engine, text):
    with pytest.raises(PlanError):
        engine.query("SELECT * FROM t", "SELECT * FROM mapped", text)


def test_split_column_does_not_leak(engine, spark):
    with pytest.raises(PlanError):
        engine.query("SELECT __uri FROM t", "SELECT * FROM mapped")
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("__sf_")]


def test_run_map_of_the_first_split(engine):
    steps = [{"sql": "SELECT yr, count(*) AS n FROM t GROUP BY yr", "name": "m", "step_type": "HBee", "partition_filter": "yr > '1996'"}, {"sql": "SELECT * FROM m", "name": "r", "step_type": "HComb"}]
    assert [r.yr for r in engine.run_map(steps, splits=1).collect()] == ["1997"]


def test_files_of_one_split_are_mapped_together(spark, orders):
    files = [CatalogFile(f.key, f.length, f.partitions, "a" if f.partitions[1] == "0" else "b") for f in orders._files]
    e = Engine(spark).add_catalog("t", StaticCatalog(spark, orders.data_schema, orders.root, ["yr", "odd"], files))
    assert e.query("SELECT count(*) AS n FROM t", "SELECT count(*) AS n FROM mapped").first().n == 2


def test_static_catalog_checks(spark, orders):
    schema = orders.data_schema
    with pytest.raises(CatalogError):
        StaticCatalog(spark, schema, "", ["a"], [CatalogFile("x", 1)])
    with pytest.raises(CatalogError):
        StaticCatalog(spark, schema, "", [], [CatalogFile("x", -1)])
    path = orders.path(orders._files[0].key)
    check_footer(spark, path, schema)
    check_footer(spark, path, T.StructType(schema.fields[:3]))  # extra trailing fields pass
    check_footer(spark, path, T.StructType([*schema.fields, T.StructField("more", T.LongType())]))
    for wrong in (T.StructField("other", T.LongType()), T.StructField(schema.fields[0].name, T.StringType())):
        with pytest.raises(PlanError):
            check_footer(spark, path, T.StructType([wrong, *schema.fields[1:]]))


def test_registry(spark, orders):
    with pytest.raises(BadRequest):
        named(spark, "nothing")
    taxi = named(spark, "nyc_taxi_ursa")
    assert taxi.files().count() == 12 and taxi.partition_columns == ["month"] and len(taxi.data_schema) == 18
    assert taxi.prune("month <= '2009/03'").count() == 3
    register("mine", lambda s: orders)
    request = {"steps": [{"sql": "SELECT count(*) AS n FROM o", "name": "m", "step_type": "map"}, {"sql": "SELECT sum(n) AS n FROM m", "name": "r", "step_type": "reduce"}], "capacity": {"zones": 1}, "catalogs": [{"name": "o", "uri": "mine", "type": "Static"}]}
    assert Engine(spark).run(request).first().n == 1500


def _log(root, versions):
    import json

    (root / "_delta_log").mkdir(parents=True)
    for k, actions in enumerate(versions):
        (root / "_delta_log" / f"{k:020d}.json").write_text("\n".join(json.dumps(a) for a in actions))


def _meta(partitions):
    fields = [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("year", "string"), ("dept_name", "string"), ("dept_staff", "long"))]
    import json

    return {"metaData": {"schemaString": json.dumps({"type": "struct", "fields": fields}), "partitionColumns": partitions}}


def _add(path, size, year=None):
    return {"add": {"path": path, "size": size, "partitionValues": {} if year is None else {"year": year}, "modificationTime": 1, "dataChange": True}}


def test_delta_overwrite_and_readd(spark, tmp_path):
    _log(tmp_path / "a", [[{"protocol": {"minReaderVersion": 1}}, _meta([]), _add("p0", 977)], [_add("p1", 1006), {"remove": {"path": "p0"}}]])
    assert got(DeltaCatalog(spark, str(tmp_path / "a")).files()) == [("p1", 1006)]
    _log(tmp_path / "b", [[_meta([]), _add("p0", 1)], [{"remove": {"path": "p0"}}], [_add("p0", 2)]])
    assert got(DeltaCatalog(spark, str(tmp_path / "b")).files()) == [("p0", 2)]
    _log(tmp_path / "c", [[{"protocol": {"minReaderVersion": 2}}, _meta([])]])
    for root in ("c", "missing"):
        with pytest.raises(CatalogError):
            DeltaCatalog(spark, str(tmp_path / root))


def test_delta_partitioned_scan(spark, tmp_path):
    for y, rows in (("2020", [("a", 1), ("b", 2)]), ("2021", [("a", 3)])):
        (tmp_path / f"year={y}").mkdir()
        spark.createDataFrame(rows, "dept_name string, dept_staff long").toPandas().to_parquet(tmp_path / f"year={y}" / "x%20y.parquet".replace("%20", " "), index=False)
    _log(tmp_path, [[_meta(["year"]), _add("year=2020/x%20y.parquet", 744, "2020"), _add("year=2021/x%20y.parquet", 744, "2021")]])
    e = Engine(spark).add_catalog("d", DeltaCatalog(spark, str(tmp_path)))
    out = e.query("SELECT year, sum(dept_staff) AS s FROM d GROUP BY year", "SELECT year, s FROM mapped")
    assert got(out) == [("2020", 3), ("2021", 3)]
    assert got(e.query("SELECT dept_name, dept_staff FROM d", "SELECT * FROM mapped", "year = '2021'")) == [("a", 3)]


def test_delta_checkpoint(spark, tmp_path):
    _log(tmp_path, [[_meta([]), _add("p0", 1)], [_add("p1", 2)], [{"remove": {"path": "p0"}}]])
    actions = spark.read.schema("add struct<path:string,size:bigint,partitionValues:map<string,string>>, remove struct<path:string>, metaData struct<schemaString:string,partitionColumns:array<string>>, protocol struct<minReaderVersion:int>")
    actions.json([str(tmp_path / "_delta_log" / f"{k:020d}.json") for k in (0, 1)]).coalesce(1).write.parquet(str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("*.parquet"))
    part.rename(tmp_path / "_delta_log" / f"{1:020d}.checkpoint.parquet")
    (tmp_path / "_delta_log" / "_last_checkpoint").write_text('{"version": 1}')
    (tmp_path / "_delta_log" / f"{0:020d}.json").unlink()
    assert got(DeltaCatalog(spark, str(tmp_path)).files()) == [("p1", 2)]


def test_filters_and_columns_reach_the_scan(engine):
    df = engine.query("SELECT o_orderstatus, count(*) AS n FROM t WHERE o_totalprice > 100 GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(n) AS n FROM mapped GROUP BY o_orderstatus")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100.0)" in plan and "o_orderdate" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_cli(spark, tmp_path, orders, capsys):
    import json

    from splitfold.cli import main

    register("mine", lambda s: orders)
    request = {"steps": [{"sql": "SELECT count(*) AS n FROM o", "name": "m", "step_type": "map"}, {"sql": "SELECT sum(n) AS n FROM m", "name": "r", "step_type": "reduce"}], "capacity": {"zones": 1}, "catalogs": [{"name": "o", "uri": "mine", "type": "Static"}]}
    (tmp_path / "q.json").write_text(json.dumps(request))
    assert main(["run", str(tmp_path / "q.json")]) == 0 and "1500" in capsys.readouterr().out
    (tmp_path / "steps.json").write_text(json.dumps(request["steps"]))
    assert main(["map", str(tmp_path / "steps.json"), "--catalog", "o=mine", "--splits", "1"]) == 0 and "|n " in capsys.readouterr().out
    (tmp_path / "bad.json").write_text("{}")
    assert main(["run", str(tmp_path / "bad.json")]) == 1
