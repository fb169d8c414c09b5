"""Numeric expressions of scoring and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Stable for large arguments of either sign."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def smoothed_f1(tp: Column, fp: Column, fn: Column, alpha: float = 1.0) -> Column:
    return (2 * tp + alpha) / (2 * tp + fp + fn + alpha)


def pos_weight(pos: Column, neg: Column, low: float = 1.0, high: float = 20.0) -> Column:
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), ratio(neg, pos)))
    return F.when(pos == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), clipped))


def close_to(a: Column, b: Column, tol: float = 1e-5) -> Column:
    return F.abs(a - b) <= tol + tol * F.abs(b)


def at_least(prob: Column, threshold: Column) -> Column:
    """Compared as 32-bit floats, as scores and thresholds are stored."""
    return prob.cast("float") >= threshold.cast("float")


def bucket(c: Column, edges: list[tuple[float, str]], last: str, inclusive: bool = True) -> Column:
    """Name of the first edge that c does not exceed (or is below, if not inclusive)."""
    e, name = edges[0]
    out = F.when(c <= e if inclusive else c < e, name)
    for e, name in edges[1:]:
        out = out.when(c <= e if inclusive else c < e, name)
    return out.otherwise(last)
