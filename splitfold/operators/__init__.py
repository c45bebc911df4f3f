"""The dataflow operators: the map of each split, and the reduce over the union of what the maps give."""

from splitfold.operators.mapper import BATCH, DIRECT, LATERAL, PER_SPLIT, MapStep
from splitfold.operators.reducer import reduce_over, reduce_schema

__all__ = ["BATCH", "DIRECT", "LATERAL", "PER_SPLIT", "MapStep", "reduce_over", "reduce_schema"]
