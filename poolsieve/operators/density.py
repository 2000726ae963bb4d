"""Class centroids, covariances and Mahalanobis distances. Only d-vectors and d x d matrices reach the driver, each fit by one scan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import doubles, group_means
from ..session import kept
from .greedy import Picks
from .moments import ALL, JITTER, OWN, Running, inverse, moments, whitener


def centroids(df: DataFrame, label: str, vector: str, classes: list | None = None) -> DataFrame:
    """Rows (label, n, centroid, empty): class means; a class of ``classes`` without members has a zero vector and is marked."""
    found = group_means(df, label, vector).withColumn("empty", F.lit(False))
    if classes is None:
        return found
    width = df.select(F.size(vector)).first()
    spark = df.sparkSession
    every = spark.createDataFrame([(c,) for c in classes], spark.createDataFrame([], found.select(label).schema).schema)
    zero = F.array_repeat(F.lit(0.0), width[0] if width else 0)
    return every.join(found, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("centroid", zero).alias("centroid"), F.col("n").isNull().alias("empty"))


def covariance(df: DataFrame, label: str | None, vector: str, ddof: int = 1) -> np.ndarray:
    """Pooled covariance within classes, or of all rows without a label, over N - ddof."""
    return moments(df, label, vector).covariance(ddof)


def class_covariances(df: DataFrame, label: str, vector: str, ddof: int = 0) -> dict:
    """Covariance of each class, over n - ddof."""
    fit = moments(df, label, vector, OWN)
    return dict(zip(fit.labels, fit.covariances(ddof), strict=True))


def squared_distances(vector: Column, centres: list[tuple[np.ndarray, np.ndarray] | None]) -> Column:
    """Array of the squared distances to each centre (whitener, centre), infinite for None; null for a null vector. Matrices go to
    tasks with the function: as literals, d x d for each centre, they would swell the plan."""

    @F.pandas_udf("array<double>")
    def far(vectors: pd.Series) -> pd.Series:
        known = vectors.notna().to_numpy()
        out: list = [None] * len(vectors)
        if known.any():
            x = np.stack(vectors[known].to_list()).astype(float)
            d = np.stack([np.full(len(x), np.inf) if c is None else (((x - c[1]) @ c[0].T) ** 2).sum(1) for c in centres], 1)
            for i, row in zip(np.flatnonzero(known).tolist(), d, strict=True):
                out[i] = row
        return pd.Series(out, dtype=object)

    return far(doubles(vector))


def whitened(df: DataFrame, vector: str, white: np.ndarray, name: str) -> DataFrame:
    """Adds ``name``: the vectors after a matrix that goes to tasks with the function."""

    @F.pandas_udf("array<double>")
    def after(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_list()).astype(float) if len(vectors) else np.empty((0, len(white)))
        return pd.Series(list(x @ white.T), dtype=object)

    return df.withColumn(name, after(doubles(F.col(vector))))


def distances(df: DataFrame, centres: list[tuple], vector: str, inverses: np.ndarray | dict) -> DataFrame:
    """Adds ``distances``, an array of (key, distance), and ``distance``, the smallest: Mahalanobis distances to the centres (key,
    centroid, empty); those of empty classes are infinite. ``inverses``: one for all, or by key."""
    white = {} if isinstance(inverses, dict) else whitener(inverses)
    given = [None if empty else (whitener(inverses[key]) if isinstance(inverses, dict) else white, np.array(centre)) for key, centre, empty in centres]
    far = squared_distances(F.col(vector), given)
    keys = F.array(*[F.lit(key) for key, _, _ in centres])
    pairs = F.zip_with(keys, F.col("_far"), lambda k, f: F.struct(k.alias("key"), F.sqrt(f).alias("distance")))
    df = df.withColumn("_far", far).withColumn("distances", pairs).drop("_far")
    return df.withColumn("distance", F.array_min(F.transform("distances", lambda s: s["distance"])))


def mahalanobis(train: DataFrame, pool: DataFrame, label: str, vector: str, per_class: bool = False) -> DataFrame:
    """The pool with distances to the training classes, under their pooled covariance or each class's own."""
    fit = moments(train, label, vector, OWN if per_class else ALL)
    centres = [(k, m, False) for k, m in zip(fit.labels, fit.mean, strict=True)]
    inv = {k: inverse(c) for k, c in zip(fit.labels, fit.covariances(), strict=True)} if per_class else inverse(fit.covariance())
    return distances(pool, centres, vector, inv)


def single_centre(train: DataFrame, pool: DataFrame, vector: str) -> DataFrame:
    """The pool with the distance to the mean of all training rows."""
    fit = moments(train, None, vector)
    return distances(pool, [(0, m, False) for m in fit.mean], vector, inverse(fit.covariance()))


def triplet(train: DataFrame, pool: DataFrame, label: str, vector: str, lam: float = 0.25) -> DataFrame:
    """Adds ``score``: lam x distance to the nearest class - (1 - lam) x distance to the single centre."""
    a = mahalanobis(train, pool, label, vector).withColumnRenamed("distance", "_class").drop("distances")
    b = single_centre(train, a, vector).drop("distances")
    return b.withColumn("score", lam * F.col("_class") - (1 - lam) * F.col("distance")).drop("_class", "distance")


def batched_picks(train: DataFrame, pool: DataFrame, n: int, label: str, id_col: str, vector: str, lam: float | None = None, outliers: list | None = None) -> Picks:
    """Farthest first from the class centres; each pick joins its class before the next, which moves the centre and the covariance (see ``Running``): one scan
    for the fit, one a pick. A pick's class is its own label where the pool has one, else the nearest class. With ``lam`` the score is lam x distance - (1 - lam) x
    distance to the single centre of the training rows, which stays. Ids in ``outliers`` are never picked. Ties go to the smaller id.

    Null vectors are never picked; without training rows there are no centres and no picks."""
    fit = moments(train, label, vector)
    picks = Picks()
    if not fit.labels:
        return picks
    run = Running(fit)
    own = F.col(label) if label in pool.columns else F.lit(None).cast(train.schema[label].dataType)
    rows = pool.where(F.col(vector).isNotNull()).select(id_col, doubles(F.col(vector)).alias("_x"), own.alias("_own"))
    if outliers:
        rows = rows.where(~F.col(id_col).isin(list(outliers)))
    if lam is not None:
        rows = single_centre(train.select(F.col(vector).alias("_x")), rows, "_x").drop("distances").withColumnRenamed("distance", "_one")
    rows = kept(rows.withColumn("_q", run.forms(F.col("_x"))))
    for _ in range(n):
        near = F.array_min(F.transform("_q", lambda q, i: F.struct(q.alias("q"), i.alias("i"))))
        score = F.sqrt(near["q"] * F.lit(run.weight))
        score = score if lam is None else lam * score - (1 - lam) * F.col("_one")
        left = rows.where(~F.col(id_col).isin(picks.ids)) if picks.ids else rows
        best = left.agg(F.max(F.struct(score.alias("s"), (-F.col(id_col)).alias("i"), F.col("_own"), near["i"].alias("k"), F.col("_x"))).alias("b")).first()["b"]
        if best is None:
            break
        picks.ids.append(-best["i"])
        picks.scores.append(best["s"])
        changed = run.add(run.labels[best["k"]] if best["_own"] is None else best["_own"], np.array(best["_x"]))
        rows = rows.withColumn("_q", changed(F.col("_q"), F.col("_x")) if changed else run.forms(F.col("_x")))
        if len(picks.ids) % 8 == 0:
            rows = kept(rows)
    return picks


def batched(train: DataFrame, pool: DataFrame, n: int, label: str, id_col: str, vector: str) -> list[int]:
    """The ids of ``batched_picks``, in order."""
    return batched_picks(train, pool, n, label, id_col, vector).ids


def without_farthest(scored: DataFrame, distance: str, c: int, id_col: str) -> DataFrame:
    """Leaves out the c rows of the largest distance; of equal ones, those with the smaller id."""
    from .rows import nth_largest

    if not c:
        return scored
    last = nth_largest(scored, F.col(distance), id_col, c)
    if last is None:
        return scored.limit(0)
    d, i = last
    return scored.where((F.col(distance) < d) | ((F.col(distance) == d) & (F.col(id_col) > i)))


def filtered_scores(train: DataFrame, pool: DataFrame, n: int, id_col: str, label: str, vector: str, score: Column | str = "lc", share: float = 0.01, probas: str = "probas") -> DataFrame:
    """The n best rows by ``score`` after the share of the pool that is farthest from the single centre of the training rows is left out; none for a
    share of 0. ``score``: an expression, or lc, entropy or margin of class probabilities, or mahalanobis, the distance to the nearest class."""
    from ..functions import proba
    from .rows import top

    if not 0 <= share < 1:
        raise ValueError(f"a share lies in [0, 1): {share}")
    scored = single_centre(train, pool, vector).drop("distances").withColumnRenamed("distance", "_far")
    scored = without_farthest(scored, "_far", round(share * scored.count()), id_col)
    if isinstance(score, str) and score == "mahalanobis":
        scored = mahalanobis(train, scored, label, vector).drop("distances").withColumnRenamed("distance", "score")
    else:
        named = {"lc": proba.least_confidence, "entropy": proba.entropy, "margin": proba.margin}
        scored = scored.withColumn("score", named[score](F.col(probas)) if isinstance(score, str) else score)
    return top(scored.drop("_far"), n, F.col("score").desc(), F.col(id_col))


def gaussian_density(train: DataFrame, pool: DataFrame, label: str, vector: str, scale: float | None = 768.0) -> DataFrame:
    """Adds ``density``: sum over classes of exp(log N(x; mean, covariance) / scale) x share of the class; without a scale, the logarithm
    of the sum of the classes' densities."""
    fit = moments(train, label, vector, OWN)
    given, parts = [], []
    for cov, mean, n in zip(fit.covariances(1), fit.mean, fit.n, strict=True):
        for j in JITTER:
            m = cov + j * np.eye(len(cov))
            if np.linalg.eigvalsh(m).min() > 0:
                break
        given.append((whitener(np.linalg.inv(m)), mean))
        log_p = -0.5 * F.col("_far")[len(parts)] - F.lit(0.5 * (len(cov) * np.log(2 * np.pi) + np.linalg.slogdet(m)[1]).item())
        parts.append(log_p if scale is None else F.exp(log_p / scale) * F.lit(float(n / fit.n.sum())))
    far = pool.withColumn("_far", squared_distances(F.col(vector), given))
    if scale is None:
        # the largest term goes before the exponential, which would vanish
        high = F.greatest(*parts) if len(parts) > 1 else parts[0]
        total_ = sum((F.exp(p - F.col("_high")) for p in parts[1:]), F.exp(parts[0] - F.col("_high")))
        return far.withColumn("_high", high).withColumn("density", F.col("_high") + F.log(total_)).drop("_far", "_high")
    return far.withColumn("density", sum(parts[1:], parts[0])).drop("_far")
