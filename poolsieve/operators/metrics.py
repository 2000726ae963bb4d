"""Evaluation of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import novel_share, uncopied_share, words
from . import overlap


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("c"))


def classification(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: accuracy, f1_micro, f1_macro, f1_weighted; from the confusion counts, a row for each pair of classes."""
    c = confusion(df, label, pred)
    sides = c.select(F.col("label").alias("k"), F.col("c").alias("support"), F.lit(0).alias("said"), F.when(F.col("label") == F.col("pred"), F.col("c")).otherwise(0).alias("hit"))
    said = c.select(F.col("pred").alias("k"), F.lit(0).alias("support"), F.col("c").alias("said"), F.lit(0).alias("hit"))
    by = sides.unionByName(said).groupBy("k").agg(*[F.sum(x).alias(x) for x in ("support", "said", "hit")])
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("support") + F.col("said")), F.lit(0.0))
    n = F.sum("support")
    accuracy = F.sum("hit") / n
    return by.agg(accuracy.alias("accuracy"), accuracy.alias("f1_micro"), F.avg(f1).alias("f1_macro"), (F.sum(f1 * F.col("support")) / n).alias("f1_weighted"))


def entity_spans(df: DataFrame, id_col: str, tags: str) -> DataFrame:
    """Rows (id, type, first, last) of BIO tags: a span begins at B-, or at I- after another type or outside."""
    flat = df.select(id_col, F.posexplode(tags).alias("pos", "tag")).withColumn("kind", F.get(F.split("tag", "-", 2), F.lit(0))).withColumn("type", F.get(F.split("tag", "-", 2), F.lit(1)))
    order = Window.partitionBy(id_col).orderBy("pos")
    before = F.lag("type").over(order)
    inside = flat.withColumn("head", ((F.col("kind") == "B") | ~F.col("type").eqNullSafe(before)).cast("int"))
    inside = inside.withColumn("span", F.sum("head").over(order)).where("kind in ('B', 'I')")
    return inside.groupBy(id_col, "span", "type").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("span")


def entity_f1(df: DataFrame, id_col: str, labels: str, preds: str) -> DataFrame:
    """Rows (type, precision, recall, f1, support), exact spans; type ``overall`` for all."""
    a, b = entity_spans(df, id_col, labels), entity_spans(df, id_col, preds)
    hit = a.join(b, [id_col, "type", "first", "last"], "left_semi")
    count = lambda d, n: d.groupBy("type").agg(F.count("*").alias(n))
    by = count(a, "support").join(count(b, "said"), "type", "full").join(count(hit, "hit"), "type", "full").fillna(0)
    by = by.unionByName(by.agg(F.lit("overall").alias("type"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("support", "said", "hit")]))
    div = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return by.select("type", div(F.col("hit"), F.col("said")).alias("precision"), div(F.col("hit"), F.col("support")).alias("recall"), div(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")


def generated_length(df: DataFrame, ids: Column, padding: int = 0) -> DataFrame:
    """One row: mean number of ids that are no padding."""
    return df.agg(F.avg(F.size(F.filter(ids, lambda x: x != padding))).alias("gen_len"))


def novelty(df: DataFrame, text: str, pred: str, label: str, orders: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """One row: mean novel and uncopied shares of predictions and labels by order; -1 where no row has one."""
    t, out = words(F.col(text)), []
    for name, c in (("pred", pred), ("label", label)):
        for n in orders:
            out.append(F.coalesce(F.avg(novel_share(words(F.col(c)), t, n)), F.lit(-1.0)).alias(f"{name}_novel_ngrams_{n}"))
            out.append(F.coalesce(F.avg(uncopied_share(words(F.col(c)), t, n)), F.lit(-1.0)).alias(f"{name}_ngram_overlap_{n}"))
    return df.agg(*out)


def perplexity(df: DataFrame, loss: str) -> DataFrame:
    return df.agg(F.exp(F.avg(loss)).alias("perplexity"))


def batch_loss(df: DataFrame, loss: str, rows: str) -> DataFrame:
    """Mean loss of batches, weighted by their rows."""
    return df.agg(F.try_divide(F.sum(F.col(loss) * F.col(rows)), F.sum(rows)).alias("loss"))


MAIN_METRIC = {"cls": "accuracy", "ner": "overall_f1", "abs-sum": "rouge1", "nmt": "bleu"}


def evaluate(task: str, df: DataFrame, id_col: str, label: str, pred: str, text: str | None = None) -> dict[str, float]:
    """All metrics of a task, by name."""
    if task == "cls":
        return classification(df, label, pred).first().asDict()
    if task == "ner":
        rows = entity_f1(df, id_col, label, pred).collect()
        return {f"{r['type']}_{m}": r[m] for r in rows for m in ("precision", "recall", "f1")}
    if task == "abs-sum":
        out = overlap.rouge_scores(df, id_col, pred, label, stem=True).first().asDict()
        out["bleu"] = overlap.corpus_bleu(df, id_col, pred, label)
        return out | (novelty(df, text, pred, label).first().asDict() if text else {})
    if task == "nmt":
        return {"bleu": round(overlap.corpus_bleu(df, id_col, pred, label), 4)}
    raise ValueError(f"unknown task: {task}")
