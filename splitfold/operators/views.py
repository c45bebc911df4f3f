"""Temporary views with names of their own, so that no view of the session is replaced."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(what: str) -> str:
    return f"__sf_{what}_{uuid.uuid4().hex}"


@contextmanager
def viewed(df: DataFrame, what: str) -> Iterator[str]:
    """The name of a view of df; DataFrames made from it outlive it."""
    name = fresh(what)
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)


def over(name: str, view: str, sql: str, columns: str = "*") -> str:
    """sql with ``name`` standing for a view."""
    return f"WITH {quoted(name)} AS (SELECT {columns} FROM {view}) SELECT * FROM (\n{sql}\n)"
