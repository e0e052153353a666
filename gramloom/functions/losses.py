"""Losses, their weights and penalties as column expressions of ``y`` (1 or -1) and ``score``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGISTIC, SQUARED_HINGE = 0, 2


def _known(objective: int) -> None:
    if objective not in (LOGISTIC, SQUARED_HINGE):
        raise ValueError(f"objective {objective}: only 0 (logistic) and 2 (squared hinge) exist")


def loss(y: Column, score: Column, objective: int = LOGISTIC) -> Column:
    """log(1 + exp(-ys)), in a form that can't overflow, or max(0, 1 - ys)^2."""
    _known(objective)
    margin = -y * score
    if objective == LOGISTIC:
        return F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    return F.pow(F.greatest(1 + margin, F.lit(0.0)), F.lit(2.0))


def slope(y: Column, score: Column, objective: int = LOGISTIC) -> Column:
    """What a document adds to the gradient of every pattern it holds."""
    _known(objective)
    if objective == LOGISTIC:
        return -y / (1 + F.exp(y * score))
    return F.when(1 - y * score > 0, -2 * y * (1 - y * score)).otherwise(F.lit(0.0))


def penalty(weights: Column, cost: float, alpha: float) -> Column:
    """Elastic net over a column of coefficients, as an aggregate: cost * (alpha * L1 + (1 - alpha) / 2 * L2)."""
    return cost * (alpha * F.sum(F.abs(weights)) + (1 - alpha) * 0.5 * F.sum(weights * weights))


def penalty_slope(weight: Column, cost: float, alpha: float) -> Column:
    """The penalty's derivative at a coefficient that isn't zero; 0 at zero."""
    return cost * (alpha * F.signum(weight) + (1 - alpha) * weight)


def probability(score: Column) -> Column:
    """1 / (1 + exp(-score)); 0 below -8000."""
    return F.when(score < -8000, 0.0).otherwise(1 / (1 + F.exp(-F.greatest(score, F.lit(-700.0)))))
