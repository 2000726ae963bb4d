"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are a sample of the vectors, the first in order of a hash; vectors of each width have
2 sqrt(n) of their own, 64 at least, which is all that reaches the driver and is broadcast. Of pivots with a cosine of APART or more only the first
stays: else a dense group, which holds many pivots, would be scattered over their lists. A vector is described by its NEAREST nearest pivots in
order, and is entered in the inverted lists of the first ENTERED of them. Two vectors are candidates when they meet in a list and share at least
SHARED pivots; their cosine in double precision decides. Every vector is indexed; only pivots are a sample.

Equal vectors are one entry that weighs its number of copies. A list longer than BLOCK is cut into blocks, each
pair of blocks a task of its own, so no list meets in one task; a pair of vectors counts in the first list
both are entered in. Tasks return the number of links of each vector and a spanning forest of the links
they found, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.9
NEAREST, ENTERED = 8, 4
SHARED = 2
APART = 0.7
BLOCK = 2048


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number connected with each of 0 to n - 1 by links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: A count of links of an entry (id, mark), or its connection with another.
FOUND = "kind int, id long, mark long, id2 long, mark2 long, n long"
FOUND_ARROW = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("id", "mark", "id2", "mark2", "n"))])
COUNT, CONNECTION = 0, 1


def compare(pivot: int, rows: pa.Table, kind: str, threshold: float, shared: int, entered: int) -> pa.Table:
    """What is found within a block, or between two blocks, of a pivot's list."""
    side, ids, marks = (rows.column(c).to_numpy() for c in ("side", "id", "mark"))
    order = np.lexsort((marks, ids, side))
    side, ids, marks = side[order], ids[order], marks[order]
    half, n = int(np.searchsorted(side, 1)), len(order)
    copies = rows.column("copies").to_numpy()[order]
    x = unit(np.stack([np.frombuffer(v, kind) for v in rows.column("x").take(pa.array(order)).to_pylist()]))
    code = np.stack([np.frombuffer(v, np.int32) for v in rows.column("pivots").take(pa.array(order)).to_pylist()])
    shared = min(shared, code.shape[1])
    apart = half < n
    links = [np.empty((2, 0), np.int64)]
    for at in range(0, half if apart else n, 256):
        to = min(at + 256, half if apart else n)
        first = half if apart else at
        a, b = np.nonzero(x[at:to] @ x[first:].T >= threshold)
        a, b = a + at, b + first
        if not apart:
            a, b = a[a < b], b[a < b]
        for some in range(0, len(a), 1 << 16):
            i, j = a[some : some + (1 << 16)], b[some : some + (1 << 16)]
            both = code[i][:, :, None] == code[j][:, None, :]
            lists = np.where(both[:, :entered, :entered].any(2), code[i][:, :entered], np.iinfo(np.int32).max)
            keep = (both.any(2).sum(1) >= shared) & (lists.min(1) == pivot)
            links.append(np.stack([i[keep], j[keep]]))
    a, b = np.concatenate(links, axis=1)
    count = np.bincount(a, copies[b], n).astype(np.int64) + np.bincount(b, copies[a], n).astype(np.int64)
    some = np.flatnonzero(count)
    label = _labels(n, a, b)
    joined = np.flatnonzero(label != np.arange(n))
    nothing = np.zeros(len(some), np.int64)
    out = np.concatenate([
        np.stack([np.full(len(some), COUNT), ids[some], marks[some], nothing, nothing, count[some]]),
        np.stack([np.full(len(joined), CONNECTION), ids[joined], marks[joined], ids[label[joined]], marks[label[joined]], np.zeros(len(joined), np.int64)]),
    ], axis=1)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, FOUND_ARROW, strict=True)], schema=FOUND_ARROW)


def spread(points: np.ndarray, apart: float = APART) -> np.ndarray:
    """The unit vectors that have no cosine of ``apart`` or more with an earlier one that stays."""
    kept = points[:0]
    for at in range(0, len(points), 512):
        some = points[at : at + 512]
        some = some[(some @ kept.T).max(1, initial=-1) < apart]
        near, stay = some @ some.T >= apart, []
        for i in range(len(some)):
            if not near[i, stay].any():
                stay.append(i)
        kept = np.concatenate([kept, some[stay]])
    return kept


def choose_pivots(entries: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """{width: unit vectors}: of each width the first 2 sqrt(n), 64 at least, in order of a hash, spread."""
    mark = F.xxhash64("h", F.lit(5), "g")
    many = {r[0]: r[1] for r in entries.groupBy("width").count().collect()}
    want = {w: int(min(n, max(64, 2 * n**0.5))) for w, n in many.items()}
    # the share of marks, uniform, that holds a little more than these
    share = {w: min(1.0, (m + 6 * m**0.5 + 8) / many[w]) for w, m in want.items()}
    limit = [F.lit(v) for w, t in share.items() for v in (w, int(-(2**63) + t * (2**64 - 1)) if t < 1 else 2**63 - 1)]
    rows = entries.where(mark <= F.create_map(*limit)[F.col("width")]).select("width", mark.alias("mark"), "id", "x").collect() if limit else []
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["mark"], r["id"])):
        by.setdefault(r["width"], []).append(r["x"])
    return {w: spread(unit(np.array(by[w][: want[w]], kind))) for w in sorted(by)}


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, nearest: int = NEAREST, entered: int = ENTERED, shared: int = SHARED
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one a row of ``vectors``.

    Vectors that are not ``usable``, and rows without an id, link with nothing; neither do vectors of different widths. Equal vectors link
    with each other. Rows with one id are vectors of their own: each has its links and component. Other columns are not read; an empty table gives none.
    """
    spark = vectors.sparkSession
    kind = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    if kind == "<f8":
        given = given.withColumn("x", F.col("x").cast("array<double>"))
    fine = usable(F.col("x")) & F.col("id").isNotNull()
    keyed = given.where(fine).select("id", "x", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(9), "x").alias("g"))
    entries = keyed.groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("x").alias("x")).withColumn("width", F.size("x"))
    entries = common.stored(entries, "entries")
    pivots = choose_pivots(entries, kind)
    begins = dict(zip(pivots, np.cumsum([0] + [len(p) for p in pivots.values()]).tolist(), strict=False))
    shared_pivots = spark.sparkContext.broadcast((pivots, begins))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, begins = shared_pivots.value
        for batch in batches:
            widths, vectors_ = batch.column("width").to_numpy(), batch.column("x")
            for width in np.unique(widths).tolist():
                own = pa.array(np.flatnonzero(widths == width))
                x = vectors_.take(own).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)
                p = pivots[width]
                k = min(nearest, len(p))
                near = unit(x) @ p.T
                few = np.argpartition(-near, k - 1, axis=1)[:, :k]
                few = np.take_along_axis(few, np.argsort(-np.take_along_axis(near, few, 1), axis=1, kind="stable"), 1).astype(np.int32) + np.int32(begins[width])
                arrays = [*(batch.column(c).take(own) for c in ("id", "h", "copies")), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in few], pa.binary()), pa.array(few[:, :entered].tolist(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "mark", "copies", "x", "pivots", "lists"])
            common.trim()

    index = entries.select("id", "h", "copies", "x", "width").mapInArrow(enter, "id long, mark long, copies long, x binary, pivots binary, lists array<int>")
    index = common.stored(index, "index")
    lengths = index.select(F.explode("lists").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    postings = index.select("id", "mark", "copies", "x", "pivots", F.explode("lists").alias("pivot")).join(F.broadcast(lengths), "pivot")  # a row for each pivot
    postings = postings.withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.col("blocks")).cast("int"))
    postings = postings.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = postings.select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "mark", "copies", "x", "pivots")

    def run(key, rows):  # noqa: ANN001, ANN202
        common.trim()
        if key[1] != key[2] and len(np.unique(rows.column("side").to_numpy())) < 2:
            return FOUND_ARROW.empty_table()
        return compare(key[0].as_py(), rows, kind, threshold, shared, entered)

    found = common.stored(tasks.groupBy("pivot", "i", "j").applyInArrow(run, FOUND), "links")
    links = found.where(F.col("kind") == COUNT).groupBy("id", "mark").agg(F.sum("n").alias("links"))
    node = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("mark"))
    roots = common.components(found.where(F.col("kind") == CONNECTION).select(node("id", "mark").alias("a"), node("id2", "mark2").alias("b")))
    roots = roots.select(F.col("id.id").alias("id"), F.col("id.mark").alias("mark"), F.col("root.id").alias("root"))
    known = entries.select("h", "g", "id", "copies", F.col("h").alias("mark")).join(links, ["id", "mark"], "left").join(roots, ["id", "mark"], "left")
    known = known.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    ok = keyed.select("id", "h", "g").join(known, ["h", "g"]).select("id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    alone = given.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return ok.union(alone)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP9_SQL = """
with recursive v as (select vec_id, embedding::double[] as x from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
links as materialized (select p.vec_id as a, q.vec_id as b from v p join v q on p.vec_id <> q.vec_id where list_cosine_similarity(p.x, q.x) >= 0.9),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a)
select a as vec_id, (select count(*) from links l where l.a = r.a) as n_links, min(b) as component_id, a = min(b) as kept from reach r group by a
"""
