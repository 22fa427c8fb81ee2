"""Soft comparison of a measured value with a threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column, clip: float = 60.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))))


def lab_score(op: Column, x: Column, value: Column, max_value: Column, flavour: str, delta: float = 1.0) -> Column:
    """Match of a measured lab value against a bound, one flavour per scoring rule.

    L: missing upper bound falls back to the lower one. A: missing upper bound scores 0 and the
    inclusive operators carry a 1e-6 nudge. B: only GT, LT and a sigmoid-shaped EQ exist.
    """
    above, below = delta * (x - value), delta * (value - x)
    closeness = F.exp(-delta * F.abs(x - value))
    zero = F.lit(0.0)
    if flavour == "L":
        upper = F.coalesce(max_value, value)
        score = (
            F.when(op.isin("GT", "GTE"), sigmoid(above))
            .when(op.isin("LT", "LTE"), sigmoid(below))
            .when(op == "EQ", closeness)
            .when(op == "BETWEEN", sigmoid(above) * sigmoid(delta * (upper - x)))
        )
    elif flavour == "A":
        nudge = F.lit(1e-6)
        score = (
            F.when(op == "GT", sigmoid(above)).when(op == "GTE", sigmoid(above + nudge))
            .when(op == "LT", sigmoid(below)).when(op == "LTE", sigmoid(below + nudge))
            .when(op == "EQ", closeness)
            .when((op == "BETWEEN") & max_value.isNotNull(), sigmoid(above) * sigmoid(delta * (max_value - x)))
        )
    elif flavour == "B":
        score = (
            F.when(op == "GT", sigmoid(above)).when(op == "LT", sigmoid(below))
            .when(op == "EQ", sigmoid(1 - F.abs(x - value)))
        )
    else:
        raise ValueError(f"unknown flavour {flavour}")
    return F.coalesce(score, zero)
