"""What each of five filters removes from a corpus, alone, in every order, and by Shapley value, from one pass over the texts.

A document has a mask: the set of filters it fails. Let n(M) count a part's documents with mask M. The part's removal polynomial

    f(x) = sum over M of n(M) (1 - product over i in M of (1 - x_i)) = sum over T of c(T) product over i in T of x_i,
    c(T) = (-1)^(|T| + 1) sum over M that contain T of n(M)  (T not empty)

is the multilinear extension of "documents removed by a set of filters": at a corner of the cube it is what that set removes. Filter i's
Shapley value is the integral over t of its partial derivative at (t, ..., t), the sum over T with i of c(T) / |T|: an exact fraction, times the number of orders.

Texts are read once, in Spark expressions, and shuffled as digests. Counts by (part, mask) are summed on the map side; a part then has at most 32 rows.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
#: Counts that a part has for each mask: all documents, good ones, toxic ones.
KINDS = ("n", "good", "toxic")


def failures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, digest, mask): bits 0 to 3 of the mask tell which of A to D the whole text fails. A null text is empty, a
    null language the part ''. A, B: words are runs of anything but space and \\t to \\r; an empty text has none, fails A and passes B."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    docs = docs.select("*", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    docs = docs.select("doc_id", "part", "text", F.size("words").alias("words"), F.size(F.array_distinct("words")).alias("different"))
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = [F.col("words") < 100, 100 * F.col("different") < 80 * F.col("words"), 100 * upper > 10 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return docs.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), mask.alias("mask"))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents by part and mask. E (bit 4) fails where a smaller doc_id has the text; rows
    without an id never do. A document is good or toxic if any of its labels says so.

    Copies meet by digest: first rows of equal (text, part, id) are one, then those of equal (text, part), of which only
    the count at the smallest id and the count of the rest matter. So a text with any number of copies sends a row a part."""
    of = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    of = of.where("doc_id is not null and (good or toxic)").groupBy("doc_id").agg(*[F.max(F.coalesce(k, F.lit(False))).alias(k) for k in KINDS[1:]])
    ids = docs.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")).join(of, "doc_id", "left")
    ids = ids.select("digest", "part", "mask", "doc_id", "n", *[F.when(F.col(k), F.col("n")).otherwise(0).alias(k) for k in KINDS[1:]])
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *KINDS))).alias("first")
    nameless = [F.sum(F.when(F.col("doc_id").isNull(), F.col(k)).otherwise(0)).alias(f"{k}_free") for k in KINDS]
    parts = ids.groupBy("digest", "part", "mask").agg(first, *[F.sum(k).alias(k) for k in KINDS], *nameless)
    least = parts.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    parts = parts.join(least, "digest")
    is_first = F.coalesce(F.col("first.doc_id") == F.col("least"), F.lit(False))
    kept = {k: F.col(f"{k}_free") + F.when(is_first, F.col(f"first.{k}")).otherwise(0) for k in KINDS}
    sides = F.array(
        F.struct(F.col("mask"), *[kept[k].alias(k) for k in KINDS]),
        F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(k) - kept[k]).alias(k) for k in KINDS]),
    )
    return parts.select("part", F.explode(sides).alias("s")).select("part", "s.*").groupBy("part", "mask").agg(*[F.sum(k).alias(k) for k in KINDS])


class Polynomial:
    """A removal polynomial of counts by mask: its coefficients by set of filters."""

    def __init__(self, counts: dict[int, int], filters: int) -> None:
        self.filters = filters
        above = {t: sum(n for m, n in counts.items() if m & t == t) for t in range(1 << filters)}
        self.coefficients = {t: (1 if t.bit_count() % 2 else -1) * n for t, n in above.items() if t and n}

    def corner(self, chosen: int) -> int:
        """Its value where the chosen filters are 1, the others 0: what they remove together."""
        return sum(c for t, c in self.coefficients.items() if t & chosen == t)

    def diagonal(self, i: int) -> dict[int, int]:
        """The partial derivative by filter i at (t, ..., t): coefficients by power of t."""
        out: dict[int, int] = {}
        for t, c in self.coefficients.items():
            if t >> i & 1:
                out[t.bit_count() - 1] = out.get(t.bit_count() - 1, 0) + c
        return out

    def shapley(self, i: int) -> Fraction:
        """The integral of ``diagonal`` from 0 to 1."""
        return sum((Fraction(c, power + 1) for power, c in self.diagonal(i).items()), Fraction(0))


def report(counts: dict[str, dict[int, int]], filters: str = FILTERS) -> list[dict]:
    """Rows of one part: for every order of the filters and every step what is kept and what is removed.
    ``counts``: for each of KINDS, documents by mask."""
    n = len(filters)
    all_, good, toxic = (Polynomial(counts[k], n) for k in KINDS)
    total, orders = sum(counts["n"].values()), factorial(n)
    shapley = [int(orders * all_.shapley(i)) for i in range(n)]
    corners = [[p.corner(s) for s in range(1 << n)] for p in (all_, good, toxic)]
    rows = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good_lost, toxic_lost = (c[after] - c[before] for c in corners)
            rows.append({
                "filter_order": "".join(filters[j] for j in order), "step": step, "kept": total - corners[0][after], "removed": removed,
                "redundant": corners[0][1 << i] - removed, "unique_fails": corners[0][-1] - corners[0][(1 << n) - 1 - (1 << i)],
                "good_lost": good_lost, "toxic_lost": toxic_lost, "shapley": shapley[i],
            })
            before = after
    return rows


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 for each language of ``docs``
    (doc_id, text, lang), whatever other columns there are. Repeated rows count as documents of their own. No documents give no rows."""

    def of_part(masks: pa.Table) -> pa.Table:
        by = {k: dict(zip(masks["mask"].to_pylist(), masks[k].to_pylist(), strict=True)) for k in KINDS}
        rows = report(by)
        return pa.table({"part": [masks["part"][0].as_py()] * len(rows)} | {k: pa.array([r[k] for r in rows], pa.int32() if k == "step" else None) for k in rows[0]})

    return marked(failures(docs), labels).groupBy("part").applyInArrow(of_part, REPORT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


OP12_SQL = r"""
with words as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
d as (
  select part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * len(text),
      regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by text), false)] as fails,
    exists (select 1 from labels l where l.doc_id = words.doc_id and l.quality = 1) as good,
    exists (select 1 from labels l where l.doc_id = words.doc_id and l.toxic = 1) as toxic
  from words),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as o from f a, f b, f c, f d, f e
  where b.x <> a.x and c.x not in (a.x, b.x) and d.x not in (a.x, b.x, c.x) and e.x not in (a.x, b.x, c.x, d.x)),
steps as (
  select o as filter_order, s as step, ascii(substr(o, s, 1)) - 64 as own,
    list_transform(range(1, s), lambda i: ascii(substr(o, i, 1)) - 64) as earlier
  from orders, (select unnest([1, 2, 3, 4, 5]) as s)),
masks as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from d group by part, fails),
hits as (
  select part, filter_order, step, own, n, good, toxic, fails[own] as now, len(list_filter(earlier, lambda i: fails[i])) > 0 as gone,
    len(list_filter(fails, lambda x: x)) = 1 as alone
  from masks, steps),
r as (
  select part, filter_order, step, own, sum(n) filter (not now and not gone) as kept, sum(n) filter (now and not gone) as removed, sum(n) filter (now and gone) as redundant,
    sum(n) filter (now and alone) as unique_fails, sum(good) filter (now and not gone) as good_lost, sum(toxic) filter (now and not gone) as toxic_lost
  from hits group by all),
sh as (select part, own, sum(removed) as shapley from r group by all)
select part, filter_order, cast(step as integer) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
  cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost, cast(coalesce(shapley, 0) as bigint) as shapley
from r join sh using (part, own)
"""
