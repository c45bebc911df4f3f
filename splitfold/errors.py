"""Errors of the engine; each has the prefix that its text starts with."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class EngineError(Exception):
    prefix = "Error"

    def __init__(self, what: str):
        super().__init__(f"{self.prefix}: {what}")


class BadRequest(EngineError):
    prefix = "Bad request"


class NotImplementedQuery(EngineError):
    prefix = "This feature is not implemented"


class PlanError(EngineError):
    prefix = "Error during planning"


class ExecutionError(EngineError):
    prefix = "Execution error"


class CatalogError(EngineError):
    prefix = "Catalog error"


@contextmanager
def planning(what: str) -> Iterator[None]:
    """Turns Spark's parse and analysis errors into PlanError."""
    from pyspark.errors import AnalysisException, ParseException

    try:
        yield
    except (AnalysisException, ParseException) as e:
        raise PlanError(f"{what}: {str(e).splitlines()[0]}") from e


@contextmanager
def running(what: str) -> Iterator[None]:
    """Turns failures of Spark jobs into ExecutionError."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        raise ExecutionError(f"{what}: {str(e).splitlines()[0]}") from e
