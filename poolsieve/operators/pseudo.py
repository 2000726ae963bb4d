"""Pseudo-labels: keep the rows a model is sure of, label them by its output, join them to the labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.proba import mnlp, one_hot, smoothed
from .rows import rank_by


def trimmed(df: DataFrame, score: Column, left: float, id_col: str, right: float = 0.0) -> DataFrame:
    """Drops round(N x left) rows of the lowest score and round(N x right) of the highest (nothing for 0)."""
    n = df.count()
    lo, hi = round(n * left), round(n * right)
    return rank_by(df.withColumn("_score", score), F.col("_score"), F.col(id_col)).where((F.col("_rank") >= lo) & (F.col("_rank") < n - hi)).drop("_rank", "_score")


def sure(df: DataFrame, score: Column, threshold: float | tuple[float, float], id_col: str, by_quantile: bool = False) -> DataFrame:
    """Rows whose score is above a threshold, or not among the lowest share (and, of two shares, the highest)."""
    if not by_quantile:
        return df.where(score > threshold)
    left, right = threshold if isinstance(threshold, tuple) else (threshold, 0.0)
    return trimmed(df, score, left, id_col, right)


def label_classes(df: DataFrame, probas: str, label: str, threshold: float, id_col: str, by_quantile: bool = False, smoothing: float | str | bool = False) -> DataFrame:
    p = F.col(probas)
    return sure(df, F.array_max(p), threshold, id_col, by_quantile).withColumn(label, smoothed(p, smoothing))


def label_tokens(df: DataFrame, probas: str, label: str, threshold: float, id_col: str, by_quantile: bool = False) -> DataFrame:
    from ..functions.proba import argmax

    return sure(df, 1 - mnlp(F.col(probas)), threshold, id_col, by_quantile).withColumn(label, F.transform(F.col(probas), argmax))


def label_texts(df: DataFrame, generated: str, score: str, label: str, threshold: float | tuple[float, float], id_col: str, by_quantile: bool = False) -> DataFrame:
    return sure(df, F.col(score), threshold, id_col, by_quantile).withColumn(label, F.col(generated))


def weighted_union(labelled: DataFrame, pseudo: DataFrame, weight: float, label: str, classes: int | None = None) -> DataFrame:
    """Labelled rows of weight 1 and pseudo-labelled rows of ``weight``; where labels are arrays of shares (``classes``), labelled rows
    are made one-hot first."""
    if classes is not None:
        labelled = labelled.withColumn(label, one_hot(F.col(label), classes))
    return labelled.withColumn("weight", F.lit(1.0)).unionByName(pseudo.select(labelled.columns).withColumn("weight", F.lit(float(weight))))


def last_metric(metrics: DataFrame, metric: str) -> float | None:
    """The value of a metric at its last iteration."""
    return metrics.where(F.col("metric") == metric).agg(F.max_by("value", "iteration")).first()[0]
