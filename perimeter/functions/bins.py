"""Binning conventions and score ratios."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def left_closed(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value: left-closed bins, 0 below the first edge."""
    return reduce(lambda a, b: a + b, [(value >= e).cast("int") for e in edges])


def right_closed(value: Column, edges: Column) -> Column:
    """Bin number 0.. of a sorted array of distinct edges; right-closed, the first edge included."""
    above = F.size(F.filter(edges, lambda e: e < value))
    return F.when(value == F.element_at(edges, 1), 0).otherwise(above - 1).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """num / max(den, 1)."""
    return num / F.greatest(den, F.lit(1)).cast("double")


def csi(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fp + fn)


def skill(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    """csi, far, pod and iou columns from counts."""
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return [csi(t, p, n).alias("csi"), ratio(p, t + p).alias("far"),
            ratio(t, t + n).alias("pod"), csi(t, p, n).alias("iou")]
