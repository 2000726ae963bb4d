"""Acquisition: which rows of the pool to label next. Scores are columns; each strategy returns rows with ``ord``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.proba import let, mean
from ..session import hash01
from .rows import rank_by, sample, top

def _variance(a: Column) -> Column:
    return let(a, lambda v: let(mean(v), lambda m: mean(F.transform(v, lambda x: (x - m) * (x - m)))))


def _median(a: Column) -> Column:
    middle = lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2
    return let(F.array_sort(a), middle)


REDUCERS = {"var": _variance, "std": lambda a: F.sqrt(_variance(a)), "mean": mean, "median": _median, "max": F.array_max, "min": F.array_min}


def by_uncertainty(pool: DataFrame, score: Column, n: int, id_col: str) -> DataFrame:
    """The n rows with the largest uncertainty = -score."""
    return top(pool.withColumn("uncertainty", -score), n, F.col("uncertainty").desc(), F.col(id_col))


def stochastic_scores(pool: DataFrame, scores: str, aggregation: str = "var", use_log: bool = False) -> DataFrame:
    """Adds ``score``: a reducer over the passes' log scores, exponentiated first unless ``use_log``."""
    passes = F.col(scores).cast("array<double>")
    passes = passes if use_log else F.transform(passes, F.exp)
    return pool.withColumn("score", REDUCERS[aggregation](passes))


def stochastic(pool: DataFrame, scores: str, n: int, id_col: str, aggregation: str = "var", use_log: bool = False, divisor: float | None = None, seed: int = 0) -> DataFrame:
    """n rows by a reduced score over passes: for mean, median, max and min the smallest first, else the largest; with
    a ``divisor``, among a sample of N / divisor rows."""
    if divisor:
        pool = sample(pool, round(pool.count() / divisor), id_col, seed)
    scored = stochastic_scores(pool, scores, aggregation, use_log)
    order = F.col("score").asc() if aggregation in ("mean", "median", "max", "min") else F.col("score").desc()
    return top(scored, n, order, F.col(id_col))


def scatter_scores(pool: DataFrame, scored: DataFrame, id_col: str, score: str = "score") -> DataFrame:
    """Scores of a sample written back to the whole pool; rows that were not scored get infinity."""
    return pool.join(scored.select(id_col, score), id_col, "left").withColumn(score, F.coalesce(score, F.lit(float("inf"))))


def outliers(total: int, above: int, threshold: float, mode: str, n: int) -> int:
    """How many rows to skip: those past the threshold, or a share rounded up, N - n at most."""
    c = above if mode == "absolute" else math.ceil(total * threshold)
    return max(0, min(c, total - n))


def filtered_by_uncertainty(pool: DataFrame, uncertainty: str, threshold: float, n: int, id_col: str, mode: str = "absolute") -> DataFrame:
    """Skips the most uncertain rows as outliers, takes the next n."""
    total, above = pool.agg(F.count("*"), F.count_if(F.col(uncertainty) >= threshold)).first()
    return top(pool, n, F.col(uncertainty).desc(), F.col(id_col), offset=outliers(total, above, threshold, mode, n))


def filtered_by_metric(pool: DataFrame, metric: str, uncertainty: str, threshold: float, n: int, id_col: str, mode: str = "absolute") -> DataFrame:
    """Leaves out the rows of the lowest metric, takes n by uncertainty. The last row left out is found by a limit,
    and compared with; nothing is ranked as a whole."""
    total, below = pool.agg(F.count("*"), F.count_if(F.col(metric) <= threshold)).first()
    c = outliers(total, below, threshold, mode, n)
    if c:
        m, i = pool.orderBy(metric, id_col).offset(c - 1).limit(1).select(metric, id_col).first()
        pool = pool.where((F.col(metric) > m) | ((F.col(metric) == m) & (F.col(id_col) > i)))
    return top(pool, n, F.col(uncertainty).desc(), F.col(id_col))


def ranked(pool: DataFrame, uncertainty: str, id_col: str) -> DataFrame:
    """Adds ``rank_share`` in [0, 1): place by falling uncertainty over the number of rows."""
    return rank_by(pool, F.col(uncertainty).desc(), F.col(id_col)).withColumn("rank_share", F.col("_rank") / F.lit(max(1, pool.count()))).drop("_rank")


def ups_probability(rank_share: Column, gamma: float, temperature: float) -> Column:
    """Chance to be rescored: 1 up to rank gamma, then falling exponentially."""
    return F.exp(-F.greatest(F.lit(0.0), rank_share - gamma) / max(temperature, 1e-8))


def ups_subsample(pool: DataFrame, uncertainty: str, gamma: int | float, temperature: float, id_col: str, seed: int) -> DataFrame:
    """Rows drawn each with its own chance; an integer gamma is a number of rows."""
    share = gamma / max(1, pool.count()) if isinstance(gamma, int) else gamma
    return ranked(pool, uncertainty, id_col).withColumn("probability", ups_probability(F.col("rank_share"), share, temperature)).where(hash01(seed, id_col) < F.col("probability"))


def _size(k: int | float, total: int) -> int:
    return int(k * total) if isinstance(k, float) else k


def random_subsample(pool: DataFrame, k: int | float, id_col: str, seed: int) -> DataFrame:
    """k rows, or a share, at random; all if there are not so many."""
    return sample(pool, _size(k, pool.count()), id_col, seed)


def naive_subsample(pool: DataFrame, uncertainty: str, k: int | float, id_col: str) -> DataFrame:
    """The k most uncertain rows."""
    return top(pool, _size(k, pool.count()), F.col(uncertainty).desc(), F.col(id_col))


def cluster_round_robin(pool: DataFrame, cluster: str, score: Column, n: int, id_col: str) -> DataFrame:
    """One row after the other from each cluster, clusters in order of size, then label, rows by ``score`` rising: a sort by (round, size,
    label) gives the same, and each round's rows are limited before the shuffle."""
    within = Window.partitionBy(cluster).orderBy(score, F.col(id_col))
    rounds = pool.withColumn("round", F.row_number().over(within)).where(F.col("round") <= n)
    sizes = pool.groupBy(cluster).agg(F.count("*").alias("size"))
    return top(rounds.join(sizes, cluster), n, F.col("round"), F.col("size"), F.col(cluster), F.col(id_col))


def minmax(pool: DataFrame, score: str, out: str = "normalised") -> DataFrame:
    """(x - min) / (max - min) over the pool; 0 where all are equal."""
    low, high = pool.agg(F.min(score), F.max(score)).first()
    if low is None or low == high:
        return pool.withColumn(out, F.lit(0.0))
    return pool.withColumn(out, (F.col(score) - F.lit(float(low))) / F.lit(float(high - low)))


def bleu_variance(pool: DataFrame, generations: str, id_col: str) -> DataFrame:
    """Rows (id, score): mean over ordered pairs of a row's generations of (1 - BLEU / 100)^2; an empty generation is ``CLS``, a null one
    is left out. Null where there are fewer than two. Ids are different."""
    from .overlap import group_bleu

    known = F.filter(F.col(generations), lambda t: t.isNotNull())
    texts = pool.select(id_col, F.transform(known, lambda t: F.when(F.length(F.trim(t)) == 0, "CLS").otherwise(t)).alias("g"))
    off = 1 - F.round("bleu", 4) / 100
    found = group_bleu(texts, id_col, "g").groupBy(id_col).agg(F.sum(off * off - 1).alias("less"))
    pairs = F.size("g") * (F.size("g") - 1)
    return texts.join(found, id_col, "left").select(id_col, F.when(pairs > 0, 1 + F.coalesce("less", F.lit(0.0)) / pairs).alias("score"))
