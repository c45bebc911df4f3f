"""python -m splitfold: "run" a request and show its rows, "explain" its plan, or run the "map" of bare steps alone."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from splitfold.engine import Engine
from splitfold.errors import EngineError, running
from splitfold.sources import DeltaCatalog, named


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="splitfold", description=__doc__)
    parser.add_argument("command", choices=["run", "explain", "map"])
    parser.add_argument("request", help="a JSON file: a request, or for map a list of steps")
    parser.add_argument("--rows", type=int, default=100)
    parser.add_argument("--splits", type=int, help="for map: only so many splits, in order of their keys")
    parser.add_argument("--catalog", action="append", default=[], metavar="NAME=URI", help="for map: a table's name, and a named catalog or the folder of a log")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(spark)
    try:
        with open(asked.request, encoding="utf-8") as f:
            text = f.read()
        for name, uri in (x.split("=", 1) for x in asked.catalog):
            engine.add_catalog(name, DeltaCatalog(spark, uri) if "/" in uri else named(spark, uri))
        result = engine.run_map(json.loads(text), asked.splits) if asked.command == "map" else engine.run(text)
        began = time.perf_counter()
        with running("query"):
            result.explain("formatted") if asked.command == "explain" else result.show(asked.rows, truncate=False)
        if engine.last:
            engine.last.run_ms = 1000 * (time.perf_counter() - began)
            print(engine.last)
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    return 0
