"""Vector expressions over arrays of doubles, and sums of vectors by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .proba import let


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return let(a, lambda v: let(b, lambda w: dot(v, w) / (norm(v) * norm(w))))


def normalised(a: Column) -> Column:
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def quadratic(a: Column, matrix: list[list[float]]) -> Column:
    """a' M a for a matrix known on the driver, as one sum over its rows."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])
    return F.aggregate(F.zip_with(a, F.transform(rows, lambda r: dot(r, a)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of those vectors of an array whose ``mask`` is 1, as the vector of a text from those of its tokens; null where none is."""

    def mean(kept: Column) -> Column:
        total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), F.get(kept, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
        return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))

    held = F.filter(F.arrays_zip(vectors.cast("array<array<double>>").alias("v"), mask.alias("m")), lambda z: (z["m"] == 1) & z["v"].isNotNull())
    return let(F.transform(held, lambda z: z["v"]), mean)


def group_means(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (key, n, centroid): mean vector by key. Partial sums by (key, position) combine before the shuffle."""
    flat = df.select(key, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    sums = flat.groupBy(key, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    packed = sums.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p"))
    return packed.select(key, "n", F.transform("p", lambda s: s["m"]).alias("centroid"))
