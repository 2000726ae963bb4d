"""Vocabularies, language-model blocks and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hash01
from .rows import rank_by


def vocabulary(df: DataFrame, id_col: str, tokens: Column, first: int = 0) -> DataFrame:
    """Rows (token, token_id): tokens numbered in order of their first occurrence. Only each token's first place is shuffled."""
    flat = df.select(F.col(id_col).alias("doc"), F.posexplode(tokens).alias("pos", "token"))
    seen = flat.groupBy("token").agg(F.min(F.struct("doc", "pos")).alias("at"))
    return rank_by(seen, F.col("at"), name="token_id").select("token", (F.col("token_id") + first).alias("token_id"))


def encoded(df: DataFrame, id_col: str, tokens: Column, vocab: DataFrame, unknown: int = -1) -> DataFrame:
    """Rows (id, ids): each text's token ids, in order."""
    flat = df.select(F.col(id_col), F.posexplode(tokens).alias("pos", "token")).join(vocab, "token", "left")
    packed = flat.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(unknown)).alias("t")))).alias("s"))
    return packed.select(id_col, F.transform("s", lambda x: x["t"]).alias("ids"))


def blocks(df: DataFrame, id_col: str, tokens: Column, size: int) -> DataFrame:
    """Rows (block, tokens): the texts end to end in order of id, cut into blocks of ``size``; what is left over goes.

    A text's first position is the sum of the lengths before it, from ranges of ids and their sums; each text
    is then cut by itself, and pieces of a block meet.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("id"), tokens.alias("t")).withColumn("n", F.size("t").cast("long"))
    ranged = base.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").withColumn("part", F.spark_partition_id())
    ranged = ranged.checkpoint() if spark.sparkContext.getCheckpointDir() else ranged.persist()
    sums = ranged.groupBy("part").agg(F.sum("n").alias("s"))
    start = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("inside", inside).join(F.broadcast(start), "part").withColumn("at", F.col("start") + F.col("inside")).where("n > 0")
    number = F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size)))
    cut = placed.withColumn("block", number).withColumn("from", F.greatest(F.lit(0), F.col("block") * size - F.col("at")))
    cut = cut.withColumn("to", F.least(F.col("n"), (F.col("block") + 1) * size - F.col("at")))
    piece = F.slice("t", (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
    packed = cut.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("p")))).alias("s"))
    return packed.select("block", F.flatten(F.transform("s", lambda x: x["p"])).alias("tokens")).where(F.size("tokens") == size)


def lines(df: DataFrame, id_col: str, text: Column, size: int) -> DataFrame:
    """Rows (id, line, tokens): lines that aren't blank, ``size`` white-space tokens at most."""
    flat = df.select(F.col(id_col), F.posexplode(F.split(text, "\n")).alias("line", "s")).where(F.length(F.trim("s")) > 0)
    return flat.select(id_col, "line", F.slice(F.filter(F.split("s", r"\s+"), lambda w: w != ""), 1, size).alias("tokens"))


def masked(df: DataFrame, id_col: str, tokens: Column, vocabulary_size: int, mask_id: int, seed: int, share: float = 0.15, special: Column | None = None) -> DataFrame:
    """Adds ``inputs`` and ``targets`` for masked language models: a share of positions is chosen; of these 80 % become the mask, 10 %
    a random id, 10 % stay. Targets elsewhere are -100. ``special``: array of booleans, positions never chosen."""
    doc = F.col(id_col).cast("string")
    draw = lambda name, i: hash01(seed, F.lit(name), doc, i)
    never = (lambda i: F.get(special, i)) if special is not None else (lambda i: F.lit(False))
    chosen = lambda i: (draw("choose", i) < share) & ~never(i)

    def inputs(t: Column, i: Column) -> Column:
        u = draw("how", i)
        other = F.floor(draw("id", i) * vocabulary_size).cast("long")
        return F.when(~chosen(i) | (u >= 0.9), t.cast("long")).when(u < 0.8, F.lit(mask_id).cast("long")).otherwise(other)

    out = df.withColumn("inputs", F.transform(tokens, inputs))
    return out.withColumn("targets", F.transform(tokens, lambda t, i: F.when(chosen(i), t.cast("long")).otherwise(F.lit(-100).cast("long"))))
