"""All registered queries."""

from __future__ import annotations

from perimeter.plans import checks as _views  # noqa: F401  (registers the check views)
from perimeter.plans.queries import fields, fitted, forecasts, samples, scores, segments, tiles  # noqa: F401
from perimeter.plans.registry import checks, runnable

FLAGSHIP = "v07_ring_baseline"

__all__ = ["FLAGSHIP", "checks", "runnable"]
