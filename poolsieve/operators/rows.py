"""Row selection and reshaping: every selection has a total order (a score or a seeded hash, then the id)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hash01


def gather(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` for a list of ids (ord, id), in that order, repeated where the list repeats."""
    return df.join(ids.withColumnRenamed("id", id_col), id_col)


def without(df: DataFrame, other: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id ``other`` has not."""
    return df.join(other.select(id_col).distinct(), id_col, "left_anti")


def within(df: DataFrame, other: DataFrame, id_col: str) -> DataFrame:
    return df.join(other.select(id_col), id_col, "left_semi")


def union(*frames: DataFrame) -> DataFrame:
    """All rows of tables with the same column names."""
    for f in frames[1:]:
        if {*f.columns} != {*frames[0].columns}:
            raise ValueError(f"columns differ: {frames[0].columns} and {f.columns}")
    return reduce(DataFrame.unionByName, frames)


def top(df: DataFrame, n: int, *order: Column, offset: int = 0) -> DataFrame:
    """The first n rows after ``offset``, with their place ``ord`` from 0. The limit runs in each task first; only n +
    offset rows meet."""
    best = df.orderBy(*order).limit(n + offset)
    numbered = best.withColumn("ord", F.row_number().over(Window.orderBy(*order)) - 1 - offset)
    return numbered.where(F.col("ord") >= 0)


def sample(df: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    """n rows drawn by a seeded hash."""
    return df.orderBy(hash01(seed, id_col), F.col(id_col)).limit(n)


def subsample(df: DataFrame, divisor: float, id_col: str, seed: int) -> DataFrame:
    """round(N / divisor) rows (half to even)."""
    return sample(df, round(df.count() / divisor), id_col, seed)


def stratified(df: DataFrame, quotas: dict, label: str, id_col: str, seed: int) -> DataFrame:
    """For each label its quota of rows by a seeded hash; labels without a quota go."""
    order = Window.partitionBy(label).orderBy(hash01(seed, id_col), F.col(id_col))
    quota = reduce(lambda c, kv: c.when(F.col(label).eqNullSafe(F.lit(kv[0])), F.lit(kv[1])), quotas.items(), F.when(F.lit(False), F.lit(0)))
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= quota).drop("_rank")


def balanced(df: DataFrame, each: int, label: str, id_col: str, seed: int) -> DataFrame:
    """``each`` rows of every label; Spark limits each label's rows before they are shuffled."""
    order = Window.partitionBy(label).orderBy(hash01(seed, id_col), F.col(id_col))
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).drop("_rank")


def fixed_length(df: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    """Exactly n rows: enough copies of the table, of which the last copy in seeded order is cut. Column ``copy``."""
    size = df.count()
    copies = math.ceil(n / size) if size else 0
    made = replicate(df, copies)
    return made.orderBy("copy", hash01(seed, id_col, "copy"), id_col).limit(n)


def nth_largest(df: DataFrame, value: Column, id_col: str, n: int, few: int = 1 << 16, accuracy: int = 10_000, by_id: bool = True) -> tuple | None:
    """(value, id) of the n-th row by falling ``value`` and, of equal ones, rising id; None if there are fewer or n is 0. Nulls are left out.

    Approximate quantiles enclose the row, and exact counts tell whether they do; what they enclose shrinks by some thousand times a scan, until ``few`` rows or
    rows of one value are left, which are told apart by their ids in the same way (``by_id``, whole numbers), so that no task sorts a share of the table."""
    rows = df.select(value.cast("double").alias("v"), F.col(id_col).alias("i")).where("v is not null")
    size, low, high = rows.count(), None, None
    if not 0 < n <= size:
        return None
    while size > few:
        share, slack = 1 - n / size, 2 / accuracy
        at = [max(0.0, share - slack), min(1.0, share + slack)]
        low, high = rows.agg(F.percentile_approx("v", F.array(*map(F.lit, at)), F.lit(accuracy)).alias("q")).first()["q"]
        above, within = rows.agg(F.count_if(F.col("v") > high), F.count_if(F.col("v").between(low, high))).first()
        if n <= above:
            rows, left = rows.where(F.col("v") > high), above
        elif n <= above + within:
            rows, left, n = rows.where(F.col("v").between(low, high)), within, n - above
        else:
            rows, left, n = rows.where(F.col("v") < low), size - above - within, n - above - within
        if left == size:
            break
        size = left
    if by_id and size > few and low == high and isinstance(df.schema[id_col].dataType, T.IntegralType):
        return (low, nth_largest(rows, -F.col("i"), "i", n, few, accuracy, False)[1])
    found = rows.orderBy(F.col("v").desc(), "i").offset(n - 1).limit(1).first()
    return (found["v"], found["i"])


def replicate(df: DataFrame, times: int) -> DataFrame:
    """Each row ``times`` times, column ``copy`` from 0."""
    if times <= 0:
        return df.withColumn("copy", F.lit(0)).limit(0)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def within_quantiles(df: DataFrame, length: Column, low: float, high: float) -> DataFrame:
    """Rows whose length lies between two quantiles, both included; quantiles interpolate linearly. The bounds
    are two numbers from one aggregation."""
    bounds = df.agg(F.percentile(length.cast("double"), F.array(F.lit(low), F.lit(high))).alias("q")).first()["q"]
    if bounds is None:
        return df
    return df.where(length.cast("double").between(bounds[0], bounds[1]))


def numbered(splits: list[DataFrame], order: str, id_col: str = "id") -> list[DataFrame]:
    """Contiguous ids over several tables, each in the order of a column, ranks counted by range (no single task sorts all)."""
    out, offset = [], 0
    for df in splits:
        ranked = rank_by(df, F.col(order))
        out.append(ranked.withColumn(id_col, F.col("_rank") + F.lit(offset)).drop("_rank"))
        offset += df.count()
    return out


def rank_by(df: DataFrame, *order: Column, name: str = "_rank") -> DataFrame:
    """Row number from 0 in a total order, without one task sorting all rows: rows are range-partitioned, numbered within
    their partition, and partitions' sizes (one row each) are added up. The ranged rows are checkpointed where
    the session has a checkpoint folder, so that numbers and sizes are of one partitioning."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.checkpoint() if spark.sparkContext.getCheckpointDir() else ranged.persist()
    inside = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return inside.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in") - 1).drop("_part", "_in", "_start")


def split(df: DataFrame, size: int | float, id_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rest, part): a part of ``size`` rows, or of round(share x N), drawn by a seeded hash. The part ends at a place in the hashes' order that counts find
    (``nth_largest``), so that both parts are filters: nothing is sorted or joined. Rows that share an id go to the same part."""
    n = size if isinstance(size, int) else round(size * df.count())
    drawn = hash01(seed, id_col)
    if n <= 0:
        return df, df.limit(0)
    last = nth_largest(df, -drawn, id_col, n)
    if last is None:
        return df.limit(0), df
    tie = F.col(id_col).isNull() if last[1] is None else F.col(id_col).isNull() | (F.col(id_col) <= F.lit(last[1]))
    part = (drawn < -last[0]) | ((drawn == -last[0]) & tie)
    return df.where(~part), df.where(part)


def token_budget(df: DataFrame, tokens: Column, budget: int, *order: Column, include_last: bool = True, buckets: int = 1024) -> DataFrame:
    """The prefix of an order whose tokens stay within the budget; with ``include_last`` also the row that
    crosses it. All rows if the budget is never reached. Adds ``cum``, the running sum.

    Running sums are taken within ranges of the order; the ranges' sums, ``buckets`` rows at most, are added up.
    """
    spark = df.sparkSession
    parts = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumn("_tok", tokens.cast("long")).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.checkpoint() if spark.sparkContext.getCheckpointDir() else ranged.persist()
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.sum("_tok").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    summed = ranged.join(F.broadcast(starts), "_part").withColumn("cum", F.col("_start") + F.sum("_tok").over(upto))
    bound = F.col("cum") - F.col("_tok") if include_last else F.col("cum")
    return summed.where(bound <= budget).drop("_part", "_start", "_tok")


def query_size(step: int | float, total: int) -> int:
    """A count as it is, or a share of the total, rounded half to even."""
    return step if isinstance(step, int) else round(step * total)


def initial_split(df: DataFrame, size: int | float, id_col: str, seed: int, label: str | None = None, balanced_each: int | None = None, tokens: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(labelled, pool): by a token budget, a number of rows of each label, or at random (stratified by label if given). A share
    is truncated."""
    if tokens is not None:
        chosen = token_budget(df, tokens, int(size), hash01(seed, id_col), F.col(id_col)).drop("cum")
    elif balanced_each:
        chosen = balanced(df, balanced_each, label, id_col, seed)
    else:
        total = df.count()
        n = size if isinstance(size, int) else int(size * total)
        if label:
            counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
            chosen = stratified(df, {k: round(n * c / total) for k, c in counts.items()}, label, id_col, seed)
        else:
            chosen = sample(df, n, id_col, seed)
    return chosen, without(df, chosen, id_col)


def normalised_image(pixels: Column, mean: float = 0.1307, deviation: float = 0.3081) -> Column:
    """Rows of pixels from 0 to 255 as standardised values."""
    return F.transform(pixels, lambda row: F.transform(row, lambda x: (x / 255.0 - mean) / deviation))


def batched_map(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str, size: int = 1000) -> DataFrame:
    """``function`` from columns to columns, over batches of ``size`` rows at most (fewer at the end of a partition). For what no
    built-in function expresses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield pa.RecordBatch.from_pydict(function(batch.slice(at, size).to_pydict()))

    return df.mapInArrow(run, schema)
