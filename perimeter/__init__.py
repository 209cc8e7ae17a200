"""Spark-first analytics for spatio-temporal detection events."""

from perimeter.config import Settings
from perimeter.plans.study import Study

__all__ = ["Settings", "Study"]
