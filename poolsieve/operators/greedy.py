"""Greedy selection. The driver holds the picks and vectors of d components; the pool stays in the cluster, and
every pick is one pass of partial maxima over it.

Mean similarities under a dot product are linear: the mean over a set is the product with the set's mean
vector. So a pick needs two vector sums, not an n x n matrix, and taking a row out of one set into the other changes
the sums by its vector.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot, doubles, normalised, squared_distance
from ..session import hash01, kept, literal_vector


@dataclass
class Picks:
    """Picked ids in order, with the score each was picked at; ``last`` scores every row as of the last pick."""

    ids: list[int] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    last: Column | None = None

    def frame(self, spark, id_col: str) -> DataFrame:  # noqa: ANN001
        return spark.createDataFrame([(i, x, s) for i, (x, s) in enumerate(zip(self.ids, self.scores, strict=True))], f"ord long, {id_col} long, score double")


def vector_sum(df: DataFrame, vector: str) -> list[float]:
    rows = df.select(F.posexplode(doubles(F.col(vector))).alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("s")).collect()
    return [r["s"] for r in sorted(rows, key=lambda r: r["pos"])]


def unique(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """One row, of the smallest id, for each different vector."""
    return df.groupBy(vector).agg(F.min(id_col).alias(id_col))


# fixed values: names of similarities
SIMILARITIES = ("scalar_product", "cosine_similarity", "euclidean_distance", "euclidean_normalized_distance", "mahalanobis_similarity", "mahalanobis_distance")


def _sides(pool: DataFrame, labelled: DataFrame, id_col: str, vector: str, similarity: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``_q`` and ``_x``, so that the similarity of a and b is the product of a's _q and b's _x, whichever it is: negative
    squared distances are 2 q x - |q|^2 - |x|^2, Mahalanobis ones plain ones after whitening by the covariance of all different rows."""
    from .density import covariance, inverse, whitened, whitener

    if similarity not in SIMILARITIES:
        raise ValueError(f"unknown similarity {similarity}; known are {SIMILARITIES}")
    vec = doubles(F.col(vector))
    vec = normalised(vec) if similarity in ("cosine_similarity", "euclidean_normalized_distance") else vec
    pool, labelled = pool.withColumn("_x", vec), labelled.withColumn("_x", vec)
    if similarity.startswith("mahalanobis"):
        white = whitener(inverse(covariance(pool.select("_x").distinct().union(labelled.select("_x")), None, "_x")))
        pool, labelled = (whitened(f, "_x", white, "_x") for f in (pool, labelled))
    if similarity in ("scalar_product", "cosine_similarity", "mahalanobis_similarity"):
        return pool.withColumn("_q", F.col("_x")), labelled.withColumn("_q", F.col("_x"))
    square = dot(F.col("_x"), F.col("_x"))
    q = F.concat(F.transform("_x", lambda v: 2 * v), F.array(-square, F.lit(-1.0)))
    x = F.concat("_x", F.array(F.lit(1.0), square))
    return tuple(f.withColumns({"_q": q, "_x": x}) for f in (pool, labelled))


def idds(pool: DataFrame, labelled: DataFrame, n: int, id_col: str, vector: str, lam: float = 0.667, cosine: bool = False, uncertainty: str | None = None, digits: int = 9, similarity: str | None = None, outliers: float | None = None) -> Picks:
    """In-domain diversity: lam x mean similarity to the rest of the pool - (1 - lam) x mean similarity to what is labelled or picked.

    Similarity of a row with itself counts as 1 and is taken off. With ``uncertainty`` the first term is that column.
    Ties, after rounding to ``digits``, go to the smaller id; equal vectors are one row. ``similarity``: one of SIMILARITIES. From the third pick on,
    the share ``outliers`` of all rows that is farthest from the single centre of the labelled and picked ones can't be picked. The covariance is fitted once and
    each pick updates inverse, centre and kept distances (``moments.Running``); where the last outlier lies is found by counts (``rows.nth_largest``).
    """
    similarity = similarity or ("cosine_similarity" if cosine else "scalar_product")
    pool, labelled = _sides(pool, labelled, id_col, vector, similarity)
    first = lambda c: F.min_by(c, id_col).alias(c)
    more = [F.max(uncertainty).alias("_u")] if uncertainty else []
    pool = pool.withColumn("_v", doubles(F.col(vector)))
    pool = pool.groupBy("_x").agg(F.min(id_col).alias(id_col), first("_q"), first("_v"), *more).persist()
    inside, others = vector_sum(pool, "_x"), vector_sum(labelled, "_x")
    size, known = pool.count(), labelled.count()
    total = size + known
    others = others or [0.0] * len(inside)
    picks = Picks()
    far_off = Outliers(pool, labelled, id_col, vector, round(outliers * total)) if outliers else None
    for step in range(min(n, size)):
        near = F.col("_u") if uncertainty else (dot(F.col("_q"), literal_vector(inside)) - 1) / F.lit(float(max(1, size - 1)))
        far = dot(F.col("_q"), literal_vector(others)) / F.lit(float(known)) if known else F.lit(0.0)
        picks.last = F.round(lam * near - (1 - lam) * far, digits)
        rows = far_off.inliers() if far_off and step > 1 else pool
        left = rows.where(~F.col(id_col).isin(picks.ids)) if picks.ids else rows
        best = left.select(id_col, "_x", "_v", picks.last.alias("s")).agg(F.max(F.struct(F.col("s"), (-F.col(id_col)).alias("i"), F.col("_x"), F.col("_v"))).alias("b")).first()["b"]
        if best is None:
            break
        picks.ids.append(-best["i"])
        picks.scores.append(best["s"])
        if far_off:
            far_off.add(best["_v"])
        inside = [a - b for a, b in zip(inside, best["_x"], strict=True)]
        others = [a + b for a, b in zip(others, best["_x"], strict=True)]
        size, known = size - 1, known + 1
    pool.unpersist()
    return picks


class Outliers:
    """Squared Mahalanobis forms of all rows to the single centre of the labelled and picked ones, kept by row while rows are picked."""

    def __init__(self, pool: DataFrame, labelled: DataFrame, id_col: str, vector: str, count: int) -> None:
        from .moments import Running, moments

        self.id, self.count, self.added, self.run = id_col, count, 0, None
        fit = moments(labelled, None, vector)
        if fit.labels:
            self.run = Running(fit)
        known = labelled.select(id_col, doubles(F.col(vector)).alias("_v"), F.lit(False).alias("_pool"))
        self.rows = pool.withColumn("_pool", F.lit(True)).unionByName(known, allowMissingColumns=True).where("_v is not null")
        if self.run:
            self.rows = kept(self.rows.withColumn("_far", self.run.forms(F.col("_v"))))

    def add(self, x: list[float]) -> None:
        """A picked row joins the labelled ones."""
        import numpy as np

        from .moments import Moments, Running

        x = np.array(x, float)
        if self.run is None:
            self.run, change = Running(Moments([0], np.ones(1), x[None], np.zeros((len(x), len(x))))), None
        else:
            change = self.run.add(self.run.labels[0], x)
        self.added += 1
        self.rows = self.rows.withColumn("_far", change(F.col("_far"), F.col("_v")) if change else self.run.forms(F.col("_v")))
        if self.added % 8 == 0:
            self.rows = kept(self.rows)

    def inliers(self) -> DataFrame:
        """Rows of the pool that are not among the ``count`` farthest of all; of equally far ones those with the smaller id are farther."""
        from .rows import nth_largest

        far, pool = F.col("_far")[0], self.rows.where("_pool")
        last = nth_largest(self.rows, far, self.id, self.count)
        if self.count and last is None:
            return pool.limit(0)
        return pool if last is None else pool.where((far < last[0]) | ((far == last[0]) & (F.col(self.id) > last[1])))


def idds_top(pool: DataFrame, labelled: DataFrame, n: int, id_col: str, vector: str, u_top: int, l_top: int, lam: float = 0.667, digits: int = 9) -> Picks:
    """As ``idds``, with means over the u_top most similar rows of the pool, and the l_top of the labelled and picked ones.

    Each row's nearest u_top + n + 1 rows of the pool, and l_top of the labelled, are found once, in blocks; picks are then
    taken out of, or added to, these lists.
    """
    from .neighbours import nearest

    pool = unique(pool.select(id_col, doubles(F.col(vector)).alias("_x")), id_col, "_x").persist()
    labelled = labelled.select(id_col, doubles(F.col(vector)).alias("_x"))
    u = nearest(pool, pool, id_col, "_x", u_top + n + 1).select("id", F.col("near").alias("_near"))
    found = nearest(pool, labelled, id_col, "_x", l_top).select("id", F.col("near").alias("_known"))
    rows = pool.withColumnRenamed(id_col, "id").join(u, "id").join(found, "id", "left").persist()
    picks, vectors = Picks(), []
    for _ in range(min(n, pool.count())):
        near = F.filter("_near", lambda x: ~x["other"].isin(picks.ids)) if picks.ids else F.col("_near")
        near = F.slice(F.reverse(F.array_sort(F.transform(near, lambda x: x["sim"]))), 1, u_top + 1)
        first = (F.aggregate(near, F.lit(0.0), lambda s, x: s + x) - 1) / F.lit(float(u_top))
        own = F.coalesce(F.transform("_known", lambda x: x["sim"]), F.array().cast("array<double>"))
        own = F.concat(own, *[F.array(dot(F.col("_x"), literal_vector(v))) for v in vectors])
        own = F.slice(F.reverse(F.array_sort(own)), 1, l_top)
        second = F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own)).otherwise(0.0)
        picks.last = F.round(lam * first - (1 - lam) * second, digits)
        left = rows.where(~F.col("id").isin(picks.ids)) if picks.ids else rows
        best = left.select("id", "_x", picks.last.alias("s")).agg(F.max(F.struct(F.col("s"), (-F.col("id")).alias("i"), F.col("_x"))).alias("b")).first()["b"]
        picks.ids.append(-best["i"])
        picks.scores.append(best["s"])
        vectors.append(best["_x"])
    rows.unpersist()
    pool.unpersist()
    return picks


def k_center(pool: DataFrame, centres: DataFrame, n: int, id_col: str, vector: str, digits: int = 9) -> Picks:
    """Farthest first: each pick is the row farthest from all centres and picks. Every row keeps its distance to the
    nearest centre, so a pick costs one distance a row; the column is checkpointed where the session can."""
    from .neighbours import centre_distance

    vectors = pool.select(id_col, doubles(F.col(vector)).alias("_x"))
    far = centre_distance(vectors, centres.select(id_col, F.col(vector).alias("_x")), id_col, "_x")
    rows = kept(far.select(id_col, "_x", (F.col("distance") * F.col("distance")).alias("_d")))
    picks = Picks()
    for _ in range(n):
        left = rows.where(~F.col(id_col).isin(picks.ids)) if picks.ids else rows
        best = left.agg(F.max(F.struct(F.round("_d", digits).alias("d"), (-F.col(id_col)).alias("i"), F.col("_x"))).alias("b")).first()["b"]
        if best is None:
            break
        picks.ids.append(-best["i"])
        picks.scores.append(best["d"])
        rows = rows.withColumn("_d", F.least("_d", squared_distance(F.col("_x"), literal_vector(best["_x"]))))
        if len(picks.ids) % 8 == 0:
            rows = kept(rows)
    return picks


def k_means_pp(vectors: DataFrame, n: int, id_col: str, vector: str, seed: int) -> Picks:
    """k-means++ seeding: each pick is drawn with a chance in proportion to its squared distance to the nearest pick.
    A draw is the largest of d^2-weighted exponential races, log(u) / d^2, u a seeded hash: one pass, no running sums."""
    rows = kept(vectors.select(id_col, doubles(F.col(vector)).alias("_x"), F.lit(1.0).alias("_d")))
    picks = Picks()
    for step in range(n):
        race = F.log(F.greatest(hash01(seed + step, id_col), F.lit(1e-12))) / F.col("_d")
        left = rows.where("_d > 0")
        best = left.agg(F.max(F.struct(race.alias("r"), (-F.col(id_col)).alias("i"), F.col("_x"), F.col("_d"))).alias("b")).first()["b"]
        if best is None:
            break
        picks.ids.append(-best["i"])
        picks.scores.append(best["_d"])
        d = squared_distance(F.col("_x"), literal_vector(best["_x"]))
        rows = kept(rows.withColumn("_d", d if step == 0 else F.least("_d", d)))
    return picks


def badge(gradients: DataFrame, n: int, id_col: str, vector: str, seed: int) -> Picks:
    """k-means++ seeding over gradient vectors."""
    return k_means_pp(gradients, n, id_col, vector, seed)


def mmr(overlap: DataFrame, counts: DataFrame, n: int, lam: float = 0.5, digits: int = 9, f1: bool = False) -> Picks:
    """Maximal marginal relevance on shared n-grams. ``overlap``: (n, i, j, common) for pairs with something in common,
    i = j included, both directions; ``counts``: (n, i, total).

    For each order: out(i) = (sum over j not picked of common / total(j) - 1) / (left - 1), in(i) = largest common / total(i) over
    picked j; s = lam out - (1 - lam) in. With ``f1`` both shares are 2 common / (total(i) + total(j)). Orders combine by geometric mean, shifted by 1 if
    any is negative. A row without n-grams has 0 for its share. Sums change only where a pick has something in common, so a pick joins
    the pairs of one row.
    """
    sizes = counts.withColumnRenamed("i", "j").withColumnRenamed("total", "total_j")
    shares = overlap.join(sizes, ["n", "j"]).join(counts, ["n", "i"])
    both = 2 * F.col("common") / (F.col("total") + F.col("total_j"))
    out, inner = (both, both) if f1 else (F.col("common") / F.col("total_j"), F.col("common") / F.col("total"))
    shares = shares.withColumns({"share": out, "back": inner}).drop("total", "total_j").persist()
    base = counts.join(shares.groupBy("n", "i").agg(F.sum("share").alias("out")), ["n", "i"], "left")
    state = base.select("n", "i", "total", F.coalesce("out", F.lit(0.0)).alias("out"), F.lit(0.0).alias("in"))
    state = kept(state)
    orders = max(1, counts.select("n").distinct().count())
    left = counts.select("i").distinct().count()
    picks = Picks()
    for _ in range(min(n, left)):
        s = lam * (F.col("out") - 1) / F.lit(float(max(1, left - 1))) - (1 - lam) * F.col("in")
        scored = state.where(~F.col("i").isin(picks.ids)) if picks.ids else state
        rows = scored.groupBy("i").agg(F.min(s).alias("low"), F.product(F.greatest(s, F.lit(0.0))).alias("p"), F.product(F.greatest(s + 1, F.lit(0.0))).alias("q"))
        score = F.round(F.when(F.col("low") >= 0, F.pow("p", F.lit(1.0 / orders))).otherwise(F.pow("q", F.lit(1.0 / orders)) - 1), digits)
        best = rows.agg(F.max(F.struct(score.alias("s"), (-F.col("i")).alias("i"))).alias("b")).first()["b"]
        pick = -best["i"]
        picks.ids.append(pick)
        picks.scores.append(best["s"])
        mine = shares.where(F.col("j") == pick).select("n", "i", F.col("share").alias("gone"), "back")
        state = state.join(mine, ["n", "i"], "left")
        state = state.select("n", "i", "total", (F.col("out") - F.coalesce("gone", F.lit(0.0))).alias("out"), F.greatest("in", F.coalesce("back", F.lit(0.0))).alias("in"))
        state = kept(state)
        left -= 1
    shares.unpersist()
    return picks
