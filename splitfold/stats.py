"""What a query did."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class QueryStats:
    query_id: str
    strategy: str = ""
    splits_kept: int = 0
    splits_total: int | None = None
    bytes_kept: int = 0
    plan_ms: float = 0.0
    run_ms: float | None = None
    warnings: list[str] = field(default_factory=list)
