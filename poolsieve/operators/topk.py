"""The k most similar rows of another table, exactly, without meeting all of it.

Rows of the right side lie in cells about pivots, drawn by hash from the whole side; a cell knows its number of rows and its radius. A left row x first meets the cell
it is most similar to the pivot of (or as many as hold k rows), which gives it a k-th best similarity. No row of a cell of pivot c and radius r can be more similar
to x than x'c + |x| r, or, for distances, than -(|x - c| - r)^2 where that is outside: cells that stay below are skipped, all others are met.
Cells that lie together form a region of some BLOCK rows. A left row goes once to each region of which it meets a cell, so that it is copied at most as often as there are
regions, not cells; a larger cell is a region by itself and dealt into blocks. A task holds a block of each side and works similarities out by TILE; the driver has a row a cell, CELLS at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import doubles, normalised
from ..session import kept

#: Most rows of a block, about; similarities a task holds at once; and rows for each of which there is a cell.
BLOCK = 16384
TILE = 1 << 22
CELL = 256
#: Most rows of a block where all its pairs are written, and most bytes of its vectors, about.
PAIRED = 512
PACK = 1 << 18
#: Most of these blocks in a part, and tasks below which parts have fewer.
PART = 8
TASKS = 256
#: Most cells: their pivots go to every task.
CELLS = 4096
#: Bounds are held to be higher by this share, against rounding.
SLACK = 1e-9
# fixed values: names of similarities
MEASURES = ("dot", "cosine", "euclid")


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def regions(pivots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The region of each cell: halves along the widest component of the pivots, by rows, until a region has at most BLOCK rows or one cell."""
    out, number, todo = np.zeros(len(counts), np.int64), 0, [np.arange(len(counts))]
    while todo:
        cells = todo.pop()
        rows = int(counts[cells].sum())
        if rows <= BLOCK or len(cells) == 1:
            out[cells] = number
            number += 1
            continue
        order = cells[np.argsort(pivots[cells, pivots[cells].var(0).argmax()], kind="stable")]
        # a whole number of blocks on the left
        blocks = -(-rows // BLOCK) // 2 * BLOCK
        cut = min(max(1, int(np.searchsorted(np.cumsum(counts[order]), blocks, "right"))), len(order) - 1)
        todo += [order[cut:], order[:cut]]
    return out


def best_of(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, of equal ones those of the first columns; rows in order."""
    n, m = sim.shape
    if k >= m:
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    if np.isnan(sim.sum()):
        sim = np.where(np.isnan(sim), -np.inf, sim)
    worst = np.partition(sim, m - k, axis=1)[:, m - k]
    row, column = np.nonzero(sim >= worst[:, None])
    above = sim[row, column] > worst[row]
    # of those equal to the k-th as many as are missing
    missing = k - np.bincount(row[above], minlength=n)
    equal = np.flatnonzero(~above)
    starts = np.searchsorted(row[equal], np.arange(n))
    place = np.arange(len(equal)) - starts[row[equal]]
    take = above
    take[equal] = place < missing[row[equal]]
    return row[take], column[take]


class Cells:
    def __init__(self, pivots: np.ndarray, counts: np.ndarray, radius: np.ndarray, measure: str, k: int) -> None:
        self.pivots, self.counts, self.radius, self.distance, self.k = pivots, counts, radius, measure == "euclid", k
        self.region = regions(pivots, counts)
        self.sizes = np.bincount(self.region, counts).astype(np.int64)

    def likeness(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.pivots.T
        if self.distance:
            s = 2 * s - (x * x).sum(1)[:, None] - (self.pivots * self.pivots).sum(1)[None, :]
        return s

    def first(self, like: np.ndarray) -> np.ndarray:
        """Which cells rows meet first."""
        chosen = np.zeros(like.shape, bool)
        best = like.argmax(1)
        chosen[np.arange(len(like)), best] = True
        for r in np.flatnonzero(self.counts[best] < self.k):
            order = np.argsort(-like[r], kind="stable")
            chosen[r, order[: 1 + np.searchsorted(np.cumsum(self.counts[order]), self.k)]] = True
        return chosen

    def open(self, x: np.ndarray, like: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Which cells can have a row more similar than ``worst``."""
        length = np.sqrt((x * x).sum(1))[:, None]
        if self.distance:
            bound = -np.maximum(0, np.sqrt(np.maximum(0, -like)) - self.radius[None, :]) ** 2
        else:
            bound = like + length * self.radius[None, :]
        return bound >= worst[:, None] - SLACK * (1 + length * length + np.abs(worst)[:, None])


def _routed(left: DataFrame, cells: Cells, second: bool) -> DataFrame:
    """Rows (id, x, worst, region) of the left side for each region they meet: at first, or, with ``worst``, after that."""
    which = np.zeros((len(cells.counts), len(cells.sizes)), np.float32)
    which[np.arange(len(cells.counts)), cells.region] = 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = _rows(batch, "x")
                like = cells.likeness(x)
                meets = cells.first(like) @ which > 0
                if second:
                    meets = (cells.open(x, like, batch.column("worst").to_numpy()) @ which > 0) & ~meets
                row, region = np.nonzero(meets)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("x"), taken.column("worst"), pa.array(region, pa.int32())], ["id", "x", "worst", "region"])

    return left.mapInArrow(route, "id long, x array<double>, worst double, region int")


def _of(values: np.ndarray, region: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), region + 1)


def _blocks(left: DataFrame, right: DataFrame, lefts: np.ndarray, rights: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Both sides, by region in as many parts, each copied for all parts of the other side: blocks are the rows of one (region, p, q)."""
    a = left.withColumn("p", F.pmod(F.xxhash64("id"), _of(lefts, F.col("region"))).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), _of(rights - 1, F.col("region")))))
    b = right.withColumn("q", F.pmod(F.xxhash64("id"), _of(rights, F.col("region"))).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), _of(lefts - 1, F.col("region")))))
    return a, b


def _similar(x: np.ndarray, y: np.ndarray, distance: bool) -> np.ndarray:
    sim = x @ y.T
    return 2 * sim - (x * x).sum(1)[:, None] - (y * y).sum(1)[None, :] if distance else sim


def _parts(rows: np.ndarray, all_: int) -> np.ndarray:
    """Parts of at most BLOCK rows, and, of all, enough of them for some dozens of tasks."""
    return np.maximum(1, -(-rows // min(BLOCK, max(2048, all_ // 32))))


def _met(routed: DataFrame, right: DataFrame, cells: Cells, report: dict | None) -> DataFrame:
    """Rows (id, other, sim): the k best of each block that a left row meets, those below its ``worst`` left out."""
    k, distance = cells.k, cells.distance
    here = {r[0]: r[1] for r in routed.groupBy("region").count().collect()}  # CELLS rows at most
    met = np.array([here.get(c, 0) for c in range(len(cells.sizes))])
    if report is not None:
        report["met"] = report.get("met", 0) + int(met @ cells.sizes)
        report["copies"] = report.get("copies", 0) + int(met.sum())
    a, b = _blocks(routed, right, _parts(met, int(met.sum())), np.maximum(1, -(-cells.sizes // BLOCK)))

    def pair(p: pa.Table, q: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if p.num_rows and q.num_rows:
            p, q = p.combine_chunks().to_batches()[0], q.sort_by("id").combine_chunks().to_batches()[0]
            x, y, ids, others = _rows(p, "x"), _rows(q, "x"), p.column("id").to_numpy(), q.column("id").to_numpy()
            worst, step = p.column("worst").to_numpy(), max(1, TILE // q.num_rows)
            # a row is held to its worst with room for rounding
            low = worst - SLACK * (1 + np.abs(np.where(np.isfinite(worst), worst, 0)) + (x * x).sum(1) + (y * y).sum(1).max())
            known = np.isfinite(low).all()
            for at in range(0, len(x), step):
                sim, least = _similar(x[at : at + step], y, distance), low[at : at + step]
                near = sim >= least[:, None] if known else None
                if known and np.count_nonzero(near) <= 2 * k * len(sim):
                    row, column = np.nonzero(near)
                else:
                    row, column = best_of(sim, k)
                    near = ~(sim[row, column] < least[row])
                    row, column = row[near], column[near]
                out.append((ids[at + row], others[column], sim[row, column]))
        return pa.table(dict(zip(("id", "other", "sim"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return a.groupBy("region", "p", "q").cogroup(b.groupBy("region", "p", "q")).applyInArrow(pair, "id long, other long, sim double")


def _packed(rows: DataFrame) -> DataFrame:
    """Rows (ids, xs) of blocks: at most PAIRED rows and about PACK bytes of vectors each."""
    most, pack = PAIRED, PACK

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, min(most, pack * whole.num_rows // max(1, whole.column("x").nbytes)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (batch.column("id").to_numpy(), _rows(batch, "x"))], ["ids", "xs"])

    return kept(rows.mapInArrow(work, "ids binary, xs binary"))


def pairs(left: DataFrame, right: DataFrame, id_col: str, vector: str, measure: str = "dot") -> DataFrame:
    """Rows (id, other, sim) of all pairs, written by the tasks that work them out. Vectors are packed into blocks and dealt to parts once; a task reads a part of each side
    where it lies, so that what is shuffled and kept grows with the rows and not with their blocks' pairs."""
    a, b = (_packed(f) for f in _vectors(left, right, id_col, vector, measure))
    blocks = a.count(), b.count()
    # blocks of a part: one where tasks would be few, and not more where these are many enough
    each = max(1, min(PART, math.isqrt(blocks[0] * blocks[1] // TASKS)))
    a, b = (f.select(F.col("ids").alias(ids), F.col("xs").alias(xs)).repartition(max(1, -(-n // each))) for f, n, ids, xs in ((a, blocks[0], "i", "x"), (b, blocks[1], "j", "y")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, j, y in zip(*batch.columns, strict=True):
                i, j = (np.frombuffer(v.as_buffer(), np.int64) for v in (i, j))
                x, y = (np.frombuffer(v.as_buffer(), float).reshape(n, -1) for v, n in ((x, len(i)), (y, len(j))))
                sim = _similar(x, y, measure == "euclid").ravel()
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.repeat(i, len(j)), np.tile(j, len(i)), sim)], ["id", "other", "sim"])

    # by the hint each task meets a part of one side with a part of the other; neither is sent to all
    return a.crossJoin(b.hint("shuffle_replicate_nl")).mapInArrow(work, "id long, other long, sim double")


def _vectors(left: DataFrame, right: DataFrame, id_col: str, vector: str, measure: str) -> Iterator[DataFrame]:
    if measure not in MEASURES:
        raise ValueError(f"unknown similarity {measure}; known are {MEASURES}")
    x = normalised(doubles(F.col(vector))) if measure == "cosine" else doubles(F.col(vector))
    return (f.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x")) for f in (left, right))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), F.col("other"))))
    return found.groupBy("id").agg(F.slice(order, 1, k).alias("o"))


def nearest(left: DataFrame, right: DataFrame, id_col: str, vector: str, k: int, measure: str = "dot", report: dict | None = None) -> DataFrame:
    """Rows (id, near): the k rows of ``right`` most similar to each row of ``left``, best first, ties by id, a row
    itself included. ``measure``: dot, cosine, or euclid (negative squared distance). Rows without a vector are left out on both sides. ``report`` gets ``pairs``, of
    rows, ``met``, how many of these were worked out, and ``copies``, how often left rows were shuffled."""
    a, b = _vectors(left, right, id_col, vector, measure)
    number = b.count()
    n = max(1, min(CELLS, -(-number // CELL)))
    none = F.lit(float("-inf")).alias("worst")
    if n == 1:
        cells, placed = Cells(np.zeros((1, 1)), np.array([number]), np.zeros(1), measure, k), b.withColumn("region", F.lit(0))
        if report is not None:
            report["pairs"] = a.count() * number
        met = _met(a.select("id", "x", none, F.lit(0).alias("region")), placed, cells, report)
        return _best(met, k).select("id", F.transform("o", lambda s: F.struct(s["other"].alias("other"), (-s["far"]).alias("sim"))).alias("near"))
    pivots = np.array([r["x"] for r in b.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(n).collect()])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                y = _rows(batch, "x")
                s = (pivots * pivots).sum(1)[None, :] - 2 * y @ pivots.T
                cell = s.argmin(1)
                far = np.sqrt(((y - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(cell, pa.int32()), pa.array(far)], ["id", "x", "cell", "far"])

    placed = kept(b.mapInArrow(place, "id long, x array<double>, cell int, far double"))
    counts, radius = np.zeros(n, np.int64), np.zeros(n)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    cells = Cells(pivots, counts, radius, measure, k)
    placed = placed.select("id", "x", _of(cells.region, F.col("cell")).alias("region"))
    if report is not None:
        report["pairs"] = a.count() * number
    first = kept(_best(_met(_routed(a.select("id", "x", none), cells, False), placed, cells, report), k))
    worst = first.select("id", F.when(F.size("o") == k, -F.element_at("o", -1)["far"]).otherwise(F.lit(float("-inf"))).alias("worst"))
    more = _met(_routed(a.join(worst, "id"), cells, True), placed, cells, report)
    every = first.select("id", F.explode("o").alias("s")).select("id", F.col("s.other").alias("other"), (-F.col("s.far")).alias("sim")).unionByName(more)
    return _best(every, k).select("id", F.transform("o", lambda s: F.struct(s["other"].alias("other"), (-s["far"]).alias("sim"))).alias("near"))
