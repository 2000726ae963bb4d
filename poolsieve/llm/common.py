"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import time
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each; tens of megabytes.
ROWS_A_FILE = 1_000_000
_trimmed = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary folder is set if
    driver and executors are one process (``local`` masters); on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="poolsieve-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def trim(every: float = 0.25) -> None:
    """Gives memory that this Python process has freed back to the system, at most once in ``every`` seconds: workers
    outlive their tasks. Arrow's buffers come from the system's allocator, which can give them back."""
    if (now := time.monotonic()) - _trimmed[0] < every:
        return
    if not _trimmed[0]:
        pa.set_memory_pool(pa.system_memory_pool())
    _trimmed[0] = now
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def modest_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Texts reach Python in batches of ``rows`` and of some ``size`` bytes at most, for the rest of the session: the default
    of 10,000 rows holds tens of megabytes several times over. Results do not depend on it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key)).strip().lower().rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends in files of the shared folder, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back. With ``rows``, about how many it has, it is written in two
    files for each core of the cluster, or more where a file would have over ROWS_A_FILE: thousands of tiny files cost more than they hold."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    out = df if rows is None else df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df`` but some, whatever characters are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in but]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: rows (id, root), root the smallest id of the component.

    Ids are of any type that has an order. Those without a link are not in the result; null ids and self-links are ignored. Every pass connects the
    neighbours of each id to the smallest id near it (a shuffle that combines on the map side, then a join that adaptive execution
    can split where one id has most links), until all links are stars about the smallest id. Passes grow with the logarithm of a
    component's diameter; links that are stars already take one aggregation.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    n = edges.count()
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        near = both.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"))
        # a centre has larger neighbours only, any other id has one, smaller
        star = (F.col("least") > F.col("u")) | ((F.col("most") < F.col("u")) & (F.col("least") == F.col("most")))
        odd = Observation()
        near = near.observe(odd, F.count(F.when(~star, 1)).alias("n"))
        # written: both sides of the join are then shuffled for it, and a hot id can be split
        near = stored(near.select("u", F.least("u", "least").alias("m")), "near", 2 * n)
        if not odd.get["n"]:
            return near.select(F.col("u").alias("id"), F.col("m").alias("root"))
        joined = both.join(near, "u")
        # each neighbour of u, and u itself, hangs on the smallest id near u
        grown = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(
            near.select("u", F.col("m").alias("v"))
        )
        edges = stored(grown.where("u <> v").distinct(), "edges", 2 * n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
