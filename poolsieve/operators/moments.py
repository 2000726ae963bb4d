"""Counts, means and sums of outer products by class, in one scan; and Mahalanobis distances that follow rows added one at a time.

Each task adds up its rows in Arrow batches: for a class its count, its sum and, if asked, a d x d sum of outer products. These go out as rows of the
matrix, (class, row number), are dealt out by that key and added as they arrive, so a task holds sums and never a group of rows. The driver reads d
numbers a class, and one d x d matrix, or one a class where each class has a covariance of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.proba import let
from ..functions.vector import dot, doubles
from ..session import literal_vector

# fixed values: what is added to the diagonal until no eigenvalue is negative
JITTER = [0.0, *[10.0**e for e in range(-15, 0)]]
#: What a row of sums is: a class's count and sum; row ``i`` of a class's matrix; row ``i`` of the matrix of all.
SUM, OWN, ALL = 0, 1, 2


def _added(found: dict[tuple, list], key: tuple, n: int, v: np.ndarray) -> None:
    if key in found:
        found[key][0] += n
        found[key][1] += v
    else:
        found[key] = [n, v.astype(float)]


def sums(df: DataFrame, label: Column, vector: Column, shift: np.ndarray, matrices: int | None) -> DataFrame:
    """Rows (kind, label, i, n, v): sums over ``vector`` less ``shift`` by class; ``matrices``: OWN, ALL, or None for sums only. Null
    vectors are left out; a null label is a class. Vectors of another width than ``shift`` are an error."""
    cols = df.select(label.alias("label"), doubles(vector).alias("v")).where("v is not null")
    kind = cols.schema["label"].dataType.simpleString()
    schema = f"kind int, label {kind}, i int, n long, v array<double>"

    def out(found: dict[tuple, list], target: pa.DataType) -> pa.RecordBatch:
        keys = list(found)
        column = lambda j, t: pa.array([k[j] for k in keys], t)
        values = [pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1] for k in keys], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([column(0, pa.int32()), column(1, target), column(2, pa.int32()), *values], ["kind", "label", "i", "n", "v"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        whole: dict = {}
        target = None
        for batch in batches:
            target = batch.schema.field(0).type
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode("encode")
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1) - shift
            code = codes.indices.to_numpy()
            for c, name in enumerate(codes.dictionary.to_pylist()):
                own = x[code == c]
                _added(found, (SUM, name, -1), len(own), own.sum(0))
                if matrices == OWN:
                    whole[name] = whole.get(name, 0) + own.T @ own
            if matrices == ALL:
                whole[None] = whole.get(None, 0) + x.T @ x
        for name, m in whole.items():
            for i, row in enumerate(m):
                found[matrices, name, i] = [0, row]
        if target is not None:
            yield out(found, target)

    def of_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        target = None
        for batch in batches:
            target = batch.schema.field(1).type
            for k, name, i, n, v in zip(*[c.to_pylist() if j < 4 else [x.values.to_numpy(zero_copy_only=False) for x in c] for j, c in enumerate(batch.columns)], strict=True):
                _added(found, (k, name, i), n, v)
        if target is not None:
            yield out(found, target)

    return cols.mapInArrow(of_rows, schema).repartition("kind", "label", "i").mapInArrow(of_sums, schema)


@dataclass
class Moments:
    """Of each class, in the order of labels, nulls first: count, mean; and scatter, the sum of outer products of rows less their class's mean: of all
    classes together, or of each."""

    labels: list
    n: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray | list[np.ndarray] | None

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return self.scatter / max(1, int(self.n.sum()) - ddof)

    def covariances(self, ddof: int = 0) -> list[np.ndarray]:
        return [s / max(1, int(n) - ddof) for s, n in zip(self.scatter, self.n, strict=True)]


def moments(df: DataFrame, label: str | None, vector: str, matrices: int | None = ALL) -> Moments:
    """One scan, after a look at one row: sums are of vectors less that row's, so that little is lost where the mean is far from 0."""
    one = df.where(F.col(vector).isNotNull()).select(doubles(F.col(vector))).first()
    if one is None:
        return Moments([], np.zeros(0), np.zeros((0, 0)), None if matrices is None else [] if matrices == OWN else np.zeros((0, 0)))
    shift = np.array(one[0], float)
    rows = sums(df, F.col(label) if label else F.lit(0), F.col(vector), shift, matrices).collect()
    by = sorted((r for r in rows if r["kind"] == SUM), key=lambda r: (r["label"] is not None, r["label"] if r["label"] is not None else 0))
    labels, n = [r["label"] for r in by], np.array([r["n"] for r in by], float)
    mean = np.stack([np.array(r["v"]) for r in by]) / n[:, None]
    place = {x: i for i, x in enumerate(labels)}
    d = len(shift)
    parts = [np.zeros((d, d)) for _ in (labels if matrices == OWN else [0])]
    for r in rows:
        if r["kind"] != SUM:
            parts[place[r["label"]] if matrices == OWN else 0][r["i"]] = r["v"]
    if matrices == OWN:
        parts = [p - k * np.outer(m, m) for p, k, m in zip(parts, n, mean, strict=True)]
    elif matrices == ALL:
        parts = parts[0] - (mean * n[:, None]).T @ mean
    return Moments(labels, n, mean + shift, None if matrices is None else parts)


def inverse(cov: np.ndarray) -> np.ndarray:
    """Inverse, after the smallest jitter that leaves no negative eigenvalue; the pseudo-inverse of a singular matrix."""
    for j in JITTER:
        m = cov + j * np.eye(len(cov))
        if np.linalg.eigvalsh(m).min() >= 0:
            break
    try:
        return np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(m)


def whitener(inv: np.ndarray) -> np.ndarray:
    """W with W'W = inv: a distance under ``inv`` is a plain one after W."""
    values, vectors = np.linalg.eigh((inv + inv.T) / 2)
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


class Running:
    """Mahalanobis distances to class centres under the pooled covariance, kept by row while rows join classes.

    With A the inverse of the scatter matrix, a row x joins class c (n rows, mean m): the scatter grows by w (x - m)(x - m)', w = n / (n + 1), so with u = A (x - m) its
    inverse shrinks by w' u u', w' = w / (1 + w (x - m)'u), and the mean moves by (x - m) / (n + 1). The squared form of every other
    row y to each centre then changes by terms of y'u alone: a pick costs one product a row, not a fit. A new class costs one product more. Where the scatter has
    no plain inverse the update doesn't hold, and the forms are worked out anew; so they are every ``REFRESH`` rows, against rounding."""

    REFRESH = 64

    def __init__(self, fit: Moments, ddof: int = 1) -> None:
        self.labels, self.n, self.mean, self.scatter, self.ddof, self.added = list(fit.labels), fit.n.copy(), fit.mean.copy(), fit.scatter.copy(), ddof, 0
        self._invert()

    def _invert(self) -> None:
        cov = self.scatter / self.weight
        values = np.linalg.eigvalsh(cov)
        self.plain = bool(values.min() > 1e-10 * max(values.max(), 1e-300))
        self.a = inverse(cov) / self.weight

    @property
    def weight(self) -> float:
        return max(1.0, float(self.n.sum()) - self.ddof)

    def forms(self, vector: Column) -> Column:
        """Squared forms of ``vector`` to each centre: squared distances over ``weight``."""
        from .density import squared_distances

        white = whitener(self.a)
        return squared_distances(vector, [(white, m) for m in self.mean])

    def add(self, label: object, x: np.ndarray) -> Callable[[Column, Column], Column] | None:
        """Takes a row in. Gives the function of (forms, vector) that are now right, or None where ``forms`` has to be taken again."""
        self.added += 1
        if label not in self.labels:
            base, a_base, a_x = self.mean[0], self.a @ self.mean[0], self.a @ x
            by, constant = 2 * (a_base - a_x), float(x @ a_x - base @ a_base)
            self.labels.append(label)
            self.n, self.mean = np.append(self.n, 1.0), np.vstack([self.mean, x])
            if not self.plain:
                self._invert()
                return None
            return lambda forms, vector: F.concat(forms, F.array(forms[0] + dot(doubles(vector), literal_vector(by)) + F.lit(constant)))
        c = self.labels.index(label)
        n, diff = float(self.n[c]), x - self.mean[c]
        w = n / (n + 1)
        u = self.a @ diff
        du = float(diff @ u)
        shrink = w / (1 + w * du)
        at = self.mean @ u
        self.scatter = self.scatter + w * np.outer(diff, diff)
        self.n[c] += 1
        self.mean[c] = self.mean[c] + diff / (n + 1)
        if not self.plain or self.added % self.REFRESH == 0:
            self._invert()
            return None
        self.a = self.a - shrink * np.outer(u, u)
        kept = 1 - shrink * du

        def changed(forms: Column, vector: Column) -> Column:
            def with_product(t: Column) -> Column:
                new = F.zip_with(forms, literal_vector(at), lambda q, m: q - shrink * (t - m) * (t - m))
                moved = 2 * kept / (n + 1) * (t - float(at[c])) - kept * du / (n + 1) ** 2
                return F.transform(new, lambda q, i: F.greatest(F.when(i == c, q - moved).otherwise(q), F.lit(0.0)))

            return let(dot(doubles(vector), literal_vector(u)), with_product)

        return changed
