"""Shared n-grams of pairs of texts: ROUGE and BLEU parts, corpus scores, and all pairs by an inverted index."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.proba import let
from ..functions.text import lcs_length, ngrams, stemmed, tokens
from ..session import kept


def gram_counts(df: DataFrame, id_col: str, items: Column, orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Rows (n, i, gram, c)."""
    by_order = F.array(*[F.struct(F.lit(n).alias("n"), ngrams(items, n).alias("g")) for n in orders])
    flat = df.select(F.col(id_col).alias("i"), F.explode(by_order).alias("o")).select("i", "o.n", F.explode("o.g").alias("gram"))
    return flat.groupBy("n", "i", "gram").agg(F.count("*").alias("c"))


def gram_totals(df: DataFrame, id_col: str, items: Column, orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Rows (n, i, total, different): how many grams a text has, and how many different ones; texts without grams of an order have no row for it. Grams of an id with one row are
    counted where it is read; only rows that share an id are taken apart and shuffled."""
    # nulls are one id, as in a grouping
    shared = kept(df.groupBy(F.col(id_col).alias("_i")).agg(F.count("*").alias("_n")).where("_n > 1").select("_i"))

    def sizes(w: Column, n: int) -> Column:
        return let(ngrams(w, n), lambda g: F.struct(F.lit(n).alias("n"), F.size(g).cast("long").alias("t"), F.size(F.array_distinct(g)).cast("long").alias("u")))

    def counted(rows: DataFrame) -> DataFrame:
        by_order = let(items, lambda w: F.array(*[sizes(w, n) for n in orders]))
        flat = rows.select(F.col(id_col).alias("i"), F.explode(by_order).alias("o"))
        return flat.where("o.t > 0").select("o.n", "i", F.col("o.t").alias("total"), F.col("o.u").alias("different"))

    if shared.isEmpty():
        return counted(df)
    same = F.col(id_col).eqNullSafe(F.col("_i"))
    several = gram_counts(df.join(shared, same, "left_semi"), id_col, items, orders).groupBy("n", "i").agg(F.sum("c").alias("total"), F.count("*").alias("different"))
    return counted(df.join(shared, same, "left_anti")).unionByName(several)


def placed(df: DataFrame, id_col: str) -> DataFrame:
    """Rows dealt by id: all that is grouped by id and more after this stays in its task, so that texts are shuffled and not their grams."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)


def pair_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (n, i, j, common, recall, precision, f1) of pairs of texts with a gram in common, from two ``gram_counts``.

    An equi-join on the gram: pairs without one never arise, and each pair is summed up as it is shuffled. recall = common / grams of i, precision =
    common / grams of j. A gram that most texts have makes a row for each pair of them: here these pairs are the result.
    """
    a, b = left, right.select("n", F.col("i").alias("j"), "gram", F.col("c").alias("d"))
    common = a.join(b, ["n", "gram"]).groupBy("n", "i", "j").agg(F.sum(F.least("c", "d")).alias("common"))
    total = a.groupBy("n", "i").agg(F.sum("c").alias("ti"))
    other = b.groupBy("n", "j").agg(F.sum("d").alias("tj"))
    both = common.join(total, ["n", "i"]).join(other, ["n", "j"])
    r, p = F.col("common") / F.col("ti"), F.col("common") / F.col("tj")
    return both.select("n", "i", "j", "common", r.alias("recall"), p.alias("precision"), (2 * r * p / (r + p + 1e-15)).alias("f1"))


def pairs_above(left: DataFrame, right: DataFrame, bound: float) -> DataFrame:
    """Rows (n, i, j, common, f1) of pairs with f1 = 2 common / (grams of i + grams of j) of at least ``bound`` (above 0), from two ``gram_counts``: those rows of
    ``pair_overlap``, without its pairs below the bound.

    As common is at most the grams of either text, such a pair shares bound / (2 - bound) of the grams of each. So, with grams in any one order, it shares one among the
    first t - ceil(that share of t) + 1 of each text's t. The order is by how many texts have the gram, rare ones first: a gram that most texts have is hardly ever among the first,
    and the only pairs that arise are those that share a rare one and have sizes that allow the bound. These alone are counted out.
    """
    if not 0 < bound <= 1:
        raise ValueError(f"a bound lies in (0, 1]: {bound}")
    share = bound / (2 - bound)
    texts = left.select("n", "gram").union(right.select("n", "gram")).groupBy("n", "gram").agg(F.count("*").alias("df"))

    def firsts(counts: DataFrame, id_: str, size: str, own: str) -> DataFrame:
        order = Window.partitionBy("n", "i").orderBy("df", "gram")
        whole = Window.partitionBy("n", "i")
        rows = counts.join(texts, ["n", "gram"]).withColumn(size, F.sum("c").over(whole))
        before = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
        # a little below, so that no rounding leaves a pair out
        rows = rows.withColumn("before", before).where(F.col("before") < F.col(size) - F.ceil(F.col(size) * share - 1e-9) + 1)
        return rows.select("n", "gram", F.col("i").alias(id_), size)

    a, b = firsts(left, "i", "ti", "c"), firsts(right, "j", "tj", "d")
    fits = (F.col("tj") >= share * F.col("ti") - 1e-9) & (F.col("ti") >= share * F.col("tj") - 1e-9)
    found = a.join(b, ["n", "gram"]).where(fits).select("n", "i", "j", "ti", "tj").distinct()
    other = right.select("n", F.col("i").alias("j"), "gram", F.col("c").alias("d"))
    common = found.join(left, ["n", "i"]).join(other, ["n", "j", "gram"])
    common = common.groupBy("n", "i", "j").agg(F.sum(F.least("c", "d")).alias("common"), F.any_value("ti").alias("ti"), F.any_value("tj").alias("tj"))
    f1 = 2 * F.col("common") / (F.col("ti") + F.col("tj"))
    return common.select("n", "i", "j", "common", f1.alias("f1")).where(F.col("f1") >= bound)


def rouge_parts(df: DataFrame, id_col: str, pred: str, label: str, stem: bool = False) -> DataFrame:
    """Rows (id, n, common, n_pred, n_label) for n = 1, 2: exploded grams joined on (id, gram), no pair of texts but the own."""
    own = lambda c: stemmed(tokens(F.col(c))) if stem else tokens(F.col(c))
    p, q = gram_counts(df, id_col, own(pred)), gram_counts(df, id_col, own(label))
    both = p.join(q.withColumnRenamed("c", "d"), ["n", "i", "gram"], "full")
    return both.groupBy("i", "n").agg(
        F.coalesce(F.sum(F.least(F.when(F.col("d").isNotNull(), F.col("c")), F.when(F.col("c").isNotNull(), F.col("d")))), F.lit(0)).alias("common"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_pred"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("n_label"),
    ).withColumnRenamed("i", id_col)


def f_measure(common: Column, n_pred: Column, n_label: Column) -> Column:
    p, r = F.try_divide(common, n_pred), F.try_divide(common, n_label)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def rouge_scores(df: DataFrame, id_col: str, pred: str, label: str, stem: bool = False) -> DataFrame:
    """One row: rouge1, rouge2, rougeL, F-measures x 100. Texts whose label has no token don't count; for ROUGE-2, those of one
    token neither."""
    parts = rouge_parts(df, id_col, pred, label, stem).withColumn("f", f_measure(F.col("common"), F.col("n_pred"), F.col("n_label")))
    own = lambda c: stemmed(tokens(F.col(c))) if stem else tokens(F.col(c))
    long = df.select(id_col, own(pred).alias("p"), own(label).alias("q"))
    long = long.withColumn("l", f_measure(lcs_length("p", "q"), F.size("p"), F.size("q")))
    n = long.agg(F.count_if(F.size("q") > 0).alias("n1"), F.count_if(F.size("q") > 1).alias("n2"), F.sum("l").alias("l"))
    sums = parts.groupBy().agg(F.sum(F.when(F.col("n") == 1, F.col("f"))).alias("f1"), F.sum(F.when(F.col("n") == 2, F.col("f"))).alias("f2"))
    return sums.crossJoin(n).select(*[(100 * F.try_divide(F.col(a), F.col(b))).alias(c) for a, b, c in (("f1", "n1", "rouge1"), ("f2", "n2", "rouge2"), ("l", "n1", "rougeL"))])


def summary_lcs(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Adds ``rouge_lsum``: ROUGE-L over lines, each label line with the union of its matches in the predicted lines."""

    @F.pandas_udf(T.DoubleType())
    def union_f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_lsum(x, y) for x, y in zip(a, b, strict=True)])

    return df.withColumn("rouge_lsum", union_f(F.col(pred), F.col(label)))


def _cut(text: str | None) -> list[list[str]]:
    import re

    lines = [[t for t in re.split("[^a-z0-9]+", line.lower()) if t] for line in (text or "").split("\n")]
    return [line for line in lines if line]


def _matches(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, those of the table of suffixes read from the start.

    Bit q of the p-th row is 0 where the longest common subsequence of the last p items of ``a`` and the last q + 1 of ``b`` is longer than that of the last q. A row follows from
    the one before by an addition of whole integers; rows are kept, and lengths are counts of bits."""
    n, m = len(a), len(b)
    where: dict[str, int] = {}
    for q, item in enumerate(reversed(b)):
        where[item] = where.get(item, 0) | 1 << q
    row = full = (1 << m) - 1
    rows = [row]
    for item in reversed(a):
        hit = row & where.get(item, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    length = lambda p, q: q - (rows[p] & (1 << q) - 1).bit_count()
    out, i, j = set(), 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif length(n - i - 1, m - j) >= length(n - i, m - j - 1):
            i += 1
        else:
            j += 1
    return out


def _lsum(pred: str | None, label: str | None) -> float:
    p, q = _cut(pred), _cut(label)
    n, m = sum(map(len, p)), sum(map(len, q))
    if not n or not m:
        return 0.0
    left_p, left_q, hits = Counter(t for x in p for t in x), Counter(t for x in q for t in x), 0
    for line in q:
        for i in sorted(set().union(*[_matches(line, x) for x in p])):
            if left_p[line[i]] > 0 and left_q[line[i]] > 0:
                left_p[line[i]] -= 1
                left_q[line[i]] -= 1
                hits += 1
    precision, recall = hits / n, hits / m
    return 2 * precision * recall / (precision + recall) if hits else 0.0


def bleu(matches: list[int], possible: list[int], hyp: int, ref: int, smooth: bool) -> float:
    """Geometric mean of precisions times the brevity penalty, x 100; with ``smooth``, orders without a match count
    1 / 2, 1 / 4, ... of one."""
    if not hyp or not matches[0]:
        return 0.0
    logs, half = [], 1.0
    for m, n in zip(matches, possible, strict=True):
        if not n:
            break
        if not m:
            if not smooth:
                return 0.0
            half *= 2
        logs.append(math.log((m or 1 / half) / n))
    return 100 * min(1.0, math.exp(1 - ref / hyp)) * math.exp(sum(logs) / len(logs))


def group_bleu(groups: DataFrame, id_col: str, texts: str) -> DataFrame:
    """Rows (id, i, j, bleu): smoothed BLEU, 0 to 100, of white-space tokens, orders 1 to 4, of text i of a row against text j of the same row, for each pair that has a
    token in common; all others have 0. Grams of all texts of a row are counted at once; a gram then brings together the few texts of its row that have it. Texts are shuffled,
    by their row's id, their grams are not."""
    split = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    flat = placed(groups.select(F.col(id_col).alias("g"), F.col(texts).alias("ts")), "g").select("g", F.posexplode("ts").alias("i", "t")).where("t is not null").select("g", "i", split(F.col("t")).alias("w"))
    by_order = F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col("w"), n).alias("x")) for n in (1, 2, 3, 4)])
    flat = flat.select("g", "i", F.size("w").alias("l"), F.explode(by_order).alias("o")).select("g", "i", "l", "o.n", F.explode("o.x").alias("gram"))
    counts = flat.groupBy("g", "n", "gram", "i", "l").agg(F.count("*").alias("c"))
    having = counts.groupBy("g", "n", "gram").agg(F.collect_list(F.struct("i", "l", "c")).alias("h"))
    pairs = having.select("g", "n", "h", F.explode("h").alias("p")).select("g", "n", "p", F.explode("h").alias("q")).where("p.i <> q.i")
    match = [F.sum(F.when(F.col("n") == n, F.least("p.c", "q.c")).otherwise(0)).alias(f"m{n}") for n in (1, 2, 3, 4)]
    sums = pairs.groupBy("g", F.col("p.i").alias("i"), F.col("q.i").alias("j"), F.col("p.l").alias("hyp"), F.col("q.l").alias("ref")).agg(*match)
    logs, orders, none = F.lit(0.0), F.lit(0), F.lit(0)
    for n in (1, 2, 3, 4):
        m, possible = F.col(f"m{n}"), F.col("hyp") - (n - 1)
        none = none + F.when(m == 0, 1).otherwise(0)  # orders without a match count 1 / 2, 1 / 4, ... of one
        logs = logs + F.when(possible > 0, F.log(F.when(m > 0, m.cast("double")).otherwise(F.pow(F.lit(2.0), -none)) / possible)).otherwise(0.0)
        orders = orders + F.when(possible > 0, 1).otherwise(0)
    short = F.least(F.lit(1.0), F.exp(1 - F.col("ref") / F.col("hyp")))
    return sums.where("m1 > 0").select(F.col("g").alias(id_col), "i", "j", (100 * short * F.exp(logs / orders)).alias("bleu"))


def corpus_bleu(df: DataFrame, id_col: str, pred: str, label: str) -> float:
    """BLEU of a corpus: clipped matches are summed up by order in the cluster, ten numbers reach the driver. Pairs of texts are shuffled once, by id, their grams are not."""
    split = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")
    orders = (1, 2, 3, 4)
    texts = placed(df.select(F.col(id_col).alias("i"), split(pred).alias("p"), split(label).alias("q")), "i")
    grams = [F.struct(F.lit(n).alias("n"), F.lit(own).alias("own"), ngrams(F.col(c), n).alias("g")) for n in orders for c, own in (("p", 1), ("q", 0))]
    sizes = [F.struct(F.lit(0).alias("n"), F.lit(own).alias("own"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("g")) for c, own in (("p", 1), ("q", 0))]
    flat = texts.select("i", F.explode(F.array(*sizes, *grams)).alias("o")).select("i", "o.n", "o.own", F.explode("o.g").alias("gram"))
    counts = flat.groupBy("i", "n", "gram").agg(F.sum("own").alias("c"), F.sum(1 - F.col("own")).alias("d"))
    # order 0: all words, for the lengths
    sums = {r["n"]: r for r in counts.groupBy("n").agg(F.sum("c").alias("c"), F.sum("d").alias("d"), F.sum(F.when(F.col("i").isNotNull(), F.least("c", "d")).otherwise(0)).alias("m")).collect()}
    of = lambda n, x: sums[n][x] if n in sums else 0
    # a null id is no key: its texts count in lengths and possible grams, and match nothing
    return bleu([of(n, "m") for n in orders], [of(n, "c") for n in orders], of(0, "c"), of(0, "d"), smooth=False)
