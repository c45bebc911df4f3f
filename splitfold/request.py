"""Requests: a map step, a reduce step, and the catalogs they read."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import Enum

from splitfold.errors import BadRequest


class StepType(Enum):
    MAP = "map"
    REDUCE = "reduce"


# The spellings of the request format.
STEP_TYPES = {"map": StepType.MAP, "HBee": StepType.MAP, "reduce": StepType.REDUCE, "HComb": StepType.REDUCE}
CATALOG_TYPES = ("Static", "DeltaLake")


@dataclass(frozen=True)
class Step:
    sql: str
    name: str
    step_type: StepType
    partition_filter: str | None = None


@dataclass(frozen=True)
class CatalogRef:
    name: str
    uri: str
    type: str


@dataclass(frozen=True)
class StagedQuery:
    """One request. Exactly a map step and then a reduce step; one zone."""

    steps: tuple[Step, ...]
    catalogs: tuple[CatalogRef, ...] = ()
    zones: int = 1
    warnings: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.zones != 1:
            raise BadRequest(f"only one zone is supported, not {self.zones}")
        if [s.step_type for s in self.steps] != [StepType.MAP, StepType.REDUCE]:
            raise BadRequest("a query has exactly two steps: a map step, then a reduce step")
        if self.map.name == self.reduce.name:
            raise BadRequest(f"both steps are named {self.map.name}")

    @property
    def map(self) -> Step:
        return self.steps[0]

    @property
    def reduce(self) -> Step:
        return self.steps[1]


def _text(of: dict, key: str, what: str, optional: bool = False) -> str | None:
    value = of.get(key)
    if value is None and optional:
        return None
    if not isinstance(value, str) or not value:
        raise BadRequest(f"{what} needs a text {key!r}")
    return value


def parse_steps(steps: object) -> tuple[Step, ...]:
    if not isinstance(steps, list):
        raise BadRequest("steps must be a list")
    out = []
    for s in steps:
        if not isinstance(s, dict):
            raise BadRequest("a step must be an object")
        kind = s.get("step_type")
        if kind not in STEP_TYPES:
            raise BadRequest(f"unknown step type {kind!r}")
        out.append(Step(_text(s, "sql", "a step"), _text(s, "name", "a step"), STEP_TYPES[kind], _text(s, "partition_filter", "a step", optional=True)))
    return tuple(out)


def parse(request: str | bytes | dict) -> StagedQuery:
    """A request from JSON or a dict."""
    if isinstance(request, (str, bytes)):
        try:
            request = json.loads(request)
        except ValueError as e:
            raise BadRequest(f"the request is not JSON: {e}") from e
    if not isinstance(request, dict):
        raise BadRequest("the request must be an object")
    steps = parse_steps(request.get("steps"))
    capacity = request.get("capacity")
    zones = capacity.get("zones") if isinstance(capacity, dict) else None
    if not isinstance(zones, int) or isinstance(zones, bool):
        raise BadRequest("the request needs capacity.zones, a whole number")
    catalogs = request.get("catalogs")
    if not isinstance(catalogs, list):
        raise BadRequest("catalogs must be a list")
    refs = []
    for c in catalogs:
        if not isinstance(c, dict) or c.get("type") not in CATALOG_TYPES:
            raise BadRequest(f"a catalog needs a type, one of {', '.join(CATALOG_TYPES)}")
        refs.append(CatalogRef(_text(c, "name", "a catalog"), _text(c, "uri", "a catalog"), c["type"]))
    warnings = ("the reduce step's partition_filter is ignored",) if len(steps) > 1 and steps[1].partition_filter else ()
    return StagedQuery(steps, tuple(refs), zones, warnings)
