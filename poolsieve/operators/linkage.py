"""Average linkage without a matrix of all distances.

Average linkage is reducible: two clusters that are each other's nearest are merged sooner or later, whatever else is merged first. So every round finds each
cluster's nearest one, merges all pairs that are mutual, and goes on with what is left, until FEW clusters remain; the driver finishes
with their matrix. The tree is the one that merging one pair at a time gives; cutting it undoes its highest merges.

What a cluster is to others follows from its size, mean and mean squared deviation for the average of squared distances and of cosine distances. The average of plain distances
is summed over rows: rows of a cluster lie in one block, and each round meets all pairs of blocks, so that a round's work is the square of the rows and its memory that of two blocks.
Clusters meet in pairs of blocks, each pair of blocks once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot, doubles
from ..session import kept

#: Rows of a block.
BLOCK = 2048
#: Clusters whose matrix the driver holds.
FEW = 4096
#: Rows of a block that meet those of another at once, about.
CHUNK = 128
#: Least number of blocks that rows lie in.
SPREAD = 8
#: Rows whose squared distance is less than this share of their squares are subtracted.
CLOSE = 1e-6
# fixed values: names of distances
METRICS = ("euclidean", "sqeuclidean", "cosine")


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten(), float).reshape(n, -1) if n else np.zeros((0, 0))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    p, q = (x * x).sum(1), (y * y).sum(1)
    s = p[:, None] + q - 2 * x @ y.T
    # of close rows the difference itself: the sum above has few digits left
    i, j = np.nonzero(s < CLOSE * (p[:, None] + q))
    for k in range(0, len(i), 1 << 14):
        at = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
        s[at] = ((x[at[0]] - y[at[1]]) ** 2).sum(1)
    return s


def _distances(x: np.ndarray, y: np.ndarray, v: np.ndarray, w: np.ndarray, metric: str) -> np.ndarray:
    """The average distance of clusters of means x and y and mean squares v and w; of plain distances only where a cluster is a row."""
    if metric == "cosine":
        return 1 - x @ y.T
    s = _squares(x, y) + v[:, None] + w[None, :]
    return np.sqrt(s) if metric == "euclidean" else s


def _block_pairs(rows: DataFrame, blocks: int, work, schema: str) -> DataFrame:  # noqa: ANN001
    """``work`` on each pair of blocks i <= j of rows (blk, ...), as two Arrow tables."""
    left = rows.withColumn("i", F.col("blk")).withColumn("j", F.explode(F.sequence("blk", F.lit(blocks - 1))))
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own, as Spark joins a table with itself here
    right = rows.withColumn("j", F.col("blk")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blk"))))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(work, schema)


def _candidates(state: DataFrame, m: int, metric: str) -> DataFrame:
    """Rows (c, other, d): of each cluster and block the clusters that are its nearest there, where means and mean squares give the distance."""
    blocks = -(-m // BLOCK)
    rows = state.select(F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("blk"), "c", "v", "mean")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            a, b = left["c"].to_numpy(), right["c"].to_numpy()
            d = _distances(_matrix(left["mean"], len(a)), _matrix(right["mean"], len(b)), left["v"].to_numpy(), right["v"].to_numpy(), metric)
            same = a[:, None] == b[None, :]
            if left["i"][0].as_py() == left["j"][0].as_py():  # the same both ways, to the last bit
                a, d, b = np.sort(a), d[np.argsort(a)], np.sort(b)
                d = np.triu(d[:, np.argsort(right["c"].to_numpy())], 1)
                d, same = d + d.T, np.eye(len(a), dtype=bool)
            d = np.where(same, np.inf, d)
            for one, other, far in ((a, b, d), (b, a, d.T)):
                r, c = np.nonzero((far <= far.min(1, keepdims=True)) & np.isfinite(far))
                for o, got in zip(out, (one[r], other[c], far[r, c]), strict=True):
                    o.append(got)
                if left["i"][0].as_py() == left["j"][0].as_py():
                    break
        return pa.table(dict(zip(("c", "other", "d"), map(np.concatenate, out), strict=True)))

    return _block_pairs(rows, blocks, work, "c long, other long, d double")


def _averages(members: DataFrame, state: DataFrame, whole: int) -> DataFrame:
    """Rows (c, other, d): of each cluster and block its nearest there by the average distance of rows, and for a cluster beyond a block all others.

    Rows lie in blocks by cluster, so a pair of blocks has all rows of its clusters and keeps a row a cluster; the work is each pair of rows once, whatever the clusters are.
    The rows of a large cluster are dealt over all blocks, and its distances are added up over these."""
    blocks, large, chunk = max(SPREAD, -(-whole // (4 * BLOCK))), BLOCK, CHUNK
    sizes = state.select("c", "n")
    block = F.pmod(F.xxhash64(F.when(F.col("n") > large, F.col("id")).otherwise(F.col("c"))), F.lit(blocks)).cast("int")
    rows = members.join(sizes, "c").select(block.alias("blk"), "c", "n", "x")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]]

        def put(c: np.ndarray, other: np.ndarray, d: np.ndarray, part: bool) -> None:
            for o, got in zip(out, (c, other, d, np.full(len(c), part)), strict=True):
                o.append(got)

        if left.num_rows and right.num_rows:
            one = left["i"][0].as_py() == left["j"][0].as_py()
            left, right = left.sort_by("c"), right.sort_by("c")
            (a, p), (b, q) = (np.unique(t["c"].to_numpy(), return_index=True) for t in (left, right))
            x, y = _matrix(left["x"], left.num_rows), _matrix(right["x"], right.num_rows)
            na, nb = left["n"].to_numpy()[p], right["n"].to_numpy()[q]
            p = np.append(p, len(x))
            best, at = np.full(len(b), np.inf), np.zeros(len(b), np.int64)
            lo = 0
            while lo < len(a):  # clusters of some ``chunk`` rows, or one
                hi = max(lo + 1, int(np.searchsorted(p, p[lo] + chunk, "right")) - 1)
                s = np.zeros((hi - lo, len(b)))
                for r in range(p[lo], p[hi], chunk):
                    far = np.add.reduceat(np.sqrt(_squares(x[r : min(r + chunk, p[hi])], y)), q, axis=1)
                    s += np.add.reduceat(far, p[lo:hi] - r, axis=0) if p[hi] - p[lo] <= chunk else far.sum(0)
                # each pair once, so that its distance is the same both ways
                met = a[lo:hi, None] < b if one else a[lo:hi, None] != b
                parts = met & ((na[lo:hi, None] > large) | (nb > large))
                r, c = np.nonzero(parts)
                put(np.minimum(a[lo + r], b[c]), np.maximum(a[lo + r], b[c]), s[r, c], True)
                d = np.where(met & ~parts, s / (na[lo:hi, None] * nb), np.inf)
                k = d.argmin(1)
                least = d[np.arange(hi - lo), k]
                got = np.isfinite(least)
                put(a[lo:hi][got], b[k][got], least[got], False)
                k = d.argmin(0)
                least = d[k, np.arange(len(b))]
                got = least < best
                best[got], at[got] = least[got], a[lo + k[got]]
                lo = hi
            got = np.isfinite(best)
            put(b[got], at[got], best[got], False)
        return pa.table(dict(zip(("c", "other", "d", "part"), map(np.concatenate, out), strict=True)))

    found = kept(_block_pairs(rows, blocks, work, "c long, other long, d double, part boolean"))
    sums = found.where("part").groupBy("c", "other").agg(F.sum("d").alias("s"))
    sums = sums.join(sizes, "c").join(sizes.select(F.col("c").alias("other"), F.col("n").alias("m")), "other").select("c", "other", (F.col("s") / (F.col("n") * F.col("m"))).alias("d"))
    return found.where("not part").select("c", "other", "d").union(sums).union(sums.select("other", "c", "d"))


def _nearest(state: DataFrame, members: DataFrame, m: int, whole: int, metric: str) -> DataFrame:
    """Rows (c, other, d): each cluster's nearest, ties by the smaller id."""
    if metric == "euclidean":
        found = _averages(members, state, whole)
    else:
        found = _candidates(state, m, metric)
    nearest = found.groupBy("c").agg(F.min(F.struct("d", "other")).alias("s"))
    return nearest.select("c", "s.other", "s.d")


def _merged(state: DataFrame, merges: DataFrame) -> DataFrame:
    """The clusters after merges (a, b, h); a keeps its number."""
    into = merges.select(F.col("a").alias("c"), F.col("a").alias("into"), F.col("h").alias("d")).union(merges.select("b", "a", "h"))
    parts = state.join(into, "c", "left").groupBy(F.coalesce("into", "c").alias("c")).agg(F.collect_list(F.struct("n", "mean", "v", "h", "d")).alias("p"))
    p, q = F.col("p")[0], F.get("p", F.lit(1))
    n = p["n"] + q["n"]
    mean = F.zip_with(p["mean"], q["mean"], lambda x, y: (x * p["n"] + y * q["n"]) / n)
    apart = F.aggregate(F.zip_with(p["mean"], q["mean"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    v = (p["n"] * p["v"] + q["n"] * q["v"]) / n + p["n"] * q["n"] * apart / n / n
    two = F.struct(n.alias("n"), mean.alias("mean"), v.alias("v"), p["d"].alias("h"))
    one = F.struct(p["n"].alias("n"), p["mean"].alias("mean"), p["v"].alias("v"), p["h"].alias("h"))
    return parts.select("c", F.when(F.size("p") == 2, two).otherwise(one).alias("s")).select("c", "s.*")


def _matrix_of_few(members: DataFrame, c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Average plain distances of few clusters, over all pairs of their rows: rows lie in blocks by cluster, so a pair of blocks sends a sum a pair of
    clusters; a cluster beyond a block is dealt over several."""
    spark = members.sparkSession
    at, place = 0, []
    for k, size in zip(c.tolist(), n.tolist(), strict=True):
        parts = -(-int(size) // BLOCK)
        place.append((k, at // BLOCK, parts))
        at += int(size) if parts == 1 else parts * BLOCK
    blocks = max(p + q for _, p, q in place)
    where = F.broadcast(spark.createDataFrame(place, "c long, first int, parts int"))  # FEW rows at most
    rows = members.join(where, "c").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("blk"), "c", "x")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        left, right = left.sort_by("c"), right.sort_by("c")
        (a, p), (b, q) = (np.unique(t["c"].to_numpy(), return_index=True) for t in (left, right))
        far = np.sqrt(_squares(_matrix(left["x"], left.num_rows), _matrix(right["x"], right.num_rows)))
        far = np.add.reduceat(np.add.reduceat(far, p, axis=0), q, axis=1)
        i, j = np.meshgrid(a, b, indexing="ij")
        keep = (i < j) if left["i"][0].as_py() == left["j"][0].as_py() else (i != j)
        return pa.table({"a": np.minimum(i, j)[keep], "b": np.maximum(i, j)[keep], "s": far[keep]})

    sums = _block_pairs(rows, blocks, work, "a long, b long, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).toArrow()
    d = np.zeros((len(c), len(c)))
    i, j = np.searchsorted(c, sums["a"].to_numpy()), np.searchsorted(c, sums["b"].to_numpy())
    d[i, j] = sums["s"].to_numpy() / (n[i] * n[j])
    return d + d.T


def finish(d: np.ndarray, n: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (i, j, height) of clusters 0, 1, ... of sizes n with average distances d, until one is left; i < j goes on. h: their heights."""
    d, n, h, merges = d.copy(), n.astype(float), h.copy(), []
    np.fill_diagonal(d, np.inf)
    every = np.arange(len(n))
    at = d.argmin(1)
    least = d[every, at]
    for _ in range(len(n) - 1):
        i = int(least.argmin())
        i, j = sorted((i, int(at[i])))
        h[i] = max(d[i, j], h[i], h[j])
        merges.append((i, j, float(h[i])))
        row = (n[i] * d[i] + n[j] * d[j]) / (n[i] + n[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        n[i] += n[j]
        # an average is never below the smaller of the two, so only rows whose nearest was merged look again
        again = np.union1d(np.flatnonzero((at == i) | (at == j)), [i, j])
        at[again] = d[again].argmin(1)
        least[again] = d[again, at[again]]
    return merges


def average_linkage(df: DataFrame, clusters: int, id_col: str, vector: str, metric: str = "euclidean") -> DataFrame:
    """Rows (id, cluster): the clusters left when ``clusters`` are, each named by its smallest id. ``metric``: one of METRICS; under cosine
    the zero vector is at distance 1 from all. Ids are different longs; rows without a vector are left out. Fewer rows than ``clusters`` are a cluster
    each; no rows give none. The driver holds FEW x FEW distances and ``clusters`` merges."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; known are {METRICS}")
    spark = df.sparkSession
    x = doubles(F.col(vector))
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    if metric == "cosine":
        rows = rows.withColumn("l", F.sqrt(dot(F.col("x"), F.col("x")))).select("id", F.transform("x", lambda v: F.when(F.col("l") > 0, v / F.col("l")).otherwise(0.0)).alias("x"))
    members = kept(rows.select("id", "x", F.col("id").alias("c")))
    state = members.select("c", F.lit(1).cast("long").alias("n"), F.col("x").alias("mean"), F.lit(0.0).alias("v"), F.lit(0.0).alias("h"))
    whole = m = members.count()
    rounds: list[DataFrame] = []
    while m > FEW:
        near = kept(_nearest(state, members, m, whole, metric).join(state.select("c", "h"), "c"))
        back = near.select(F.col("c").alias("other"), F.col("other").alias("c"), F.col("h").alias("g"))
        # a cluster is never lower than its parts, whatever was rounded
        mutual = near.where("c < other").join(back, ["c", "other"]).select(F.col("c").alias("a"), F.col("other").alias("b"), F.greatest("d", "h", "g").alias("h"))
        rounds.append(kept(mutual))
        m -= rounds[-1].count()
        state, members = kept(_merged(state, rounds[-1])), kept(_moved(members, rounds[-1]))
    last = sorted(state.collect(), key=lambda r: r["c"])  # FEW rows at most
    if not last:
        return members.select(F.col("id").alias(id_col), F.col("c").alias("cluster"))
    c, n = np.array([r["c"] for r in last]), np.array([r["n"] for r in last], float)
    mean, v = np.array([r["mean"] for r in last]), np.array([r["v"] for r in last])
    d = _matrix_of_few(members, c, n) if metric == "euclidean" and m < whole else _distances(mean, mean, v, v, metric)
    tail = [(len(rounds) + t, i, j, h) for t, (i, j, h) in enumerate(finish(d, n, np.array([r["h"] for r in last])))]
    undo = max(0, min(clusters, whole) - 1)
    early = [r.select(F.lit(t).alias("t"), "a", "b", "h").orderBy(F.col("h").desc(), F.col("a").desc()).limit(undo) for t, r in enumerate(rounds)] if undo else []
    early = sorted((tuple(x) for r in early for x in r.collect()), key=lambda x: (-x[3], -x[0], -x[1]))[:undo]
    undone = sorted([*early, *tail], key=lambda x: (-x[3], -x[0], -x[1]))[:undo]
    split = [x for x in undone if x[0] < len(rounds)]
    if split:  # merges of the rounds are undone: rows are moved again without them
        members = members.withColumn("c", F.col("id"))
        for t, r in enumerate(rounds):
            gone = [x[1] for x in split if x[0] == t]
            members = _moved(members, r.where(~F.col("a").isin(gone)) if gone else r)
        members = kept(members)
    root = list(range(len(c)))
    for merge in tail:
        if merge not in undone:
            root = [merge[1] if x == merge[2] else x for x in root]
    names = F.broadcast(spark.createDataFrame([(int(k), int(c[r])) for k, r in zip(c, root, strict=True)], "c long, cluster long"))
    return members.join(names, "c", "left").select(F.col("id").alias(id_col), F.coalesce("cluster", "c").alias("cluster"))


def _moved(members: DataFrame, merges: DataFrame) -> DataFrame:
    return members.join(merges.select(F.col("b").alias("c"), "a"), "c", "left").select("id", "x", F.coalesce("a", "c").alias("c"))
