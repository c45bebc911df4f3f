"""Two-stage analytics on Spark: a map statement for each split, a reduce statement over their union."""

from splitfold.engine import Engine, StagedPlan
from splitfold.request import StagedQuery, Step, StepType, parse

__all__ = ["Engine", "StagedPlan", "StagedQuery", "Step", "StepType", "parse"]
