"""Self-influence of training rows from their gradients at several checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot, doubles


def self_influence(gradients: DataFrame, id_col: str, gradient: str, rate: float | Column = 1.0, length: str | None = None) -> DataFrame:
    """Rows (id, score): the mean over a row's checkpoints of rate x squared norm of its gradient. ``rate`` may be a column of each
    checkpoint's learning rate; with ``length`` the score is a token of a sequence."""
    g = doubles(F.col(gradient))
    score = (rate if isinstance(rate, Column) else F.lit(float(rate))) * dot(g, g)
    score = score / F.col(length) if length else score
    return gradients.groupBy(id_col).agg(F.avg(score).alias("score"))


def least_influential(scores: DataFrame, share: float, id_col: str) -> DataFrame:
    """Rows without the share of the highest scores (ties: larger ids go first)."""
    from .rows import rank_by

    n = scores.count()
    return rank_by(scores, F.col("score"), F.col(id_col)).where(F.col("_rank") < n - round(share * n)).drop("_rank")
