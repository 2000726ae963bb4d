"""The best k places of each group, ties and all, by order-preserving packed integer keys and distributed MSD radix partitioning.

Columns of a key are packed into as few 64-bit words as their ranges need, so that words compare as the columns do: descending
columns are inverted, nulls take the code after the largest. The words of the score (its digits from the most significant on)
are counted by (group, digits so far); of each group only the k first digit buckets that have rows can hold places up to k, and only these are
refined by the next digit, until a bucket is one score: its number is the place. Lines of kept scores get the number of lines before them from these counts.
A score with more lines than a bucket may have is partitioned on by the digits of the remaining key, equal lines counted together.
Buckets are sorted inside tasks by a numpy radix sort.

Counts are summed on the map side and stay distributed: no group, score or value is gathered in one task, on the driver or in a broadcast; a group sends at most 2^DIGIT
counts to a window. The driver reads one row of ranges and one of totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bits of a digit: a bucket has at most 2^DIGIT children.
DIGIT = 10
#: Most lines of a bucket that is sorted in one piece, and about how many are sorted at once.
BUCKET = 1 << 14
#: Copies of a line that are written from one row.
COPIES = 1 << 16
#: Bits of a word: words are never negative.
WORD = 62
#: Columns of a wider range are split in two.
WIDE = 1 << 60


@dataclass
class Field:
    """A column, or its upper or lower 32 bits, in a packed key: codes 0 to ``null``, the last for null."""

    name: str
    down: bool
    half: str
    least: int
    null: int
    word: int = 0
    shift: int = 0

    @property
    def bits(self) -> int:
        return self.null.bit_length()

    def code(self) -> Column:
        v = F.col(f"`{self.name}`")
        v = F.bitwise_not(v) if self.down else v
        if self.half:
            v = F.shiftright(v, 32) if self.half == "upper" else v.bitwiseAND(0xFFFFFFFF)
        return F.coalesce(v - F.lit(self.least), F.lit(self.null).cast("long"))

    def value(self, words: list[str]) -> Column:
        code = F.shiftright(F.col(words[self.word]), self.shift).bitwiseAND((1 << self.bits) - 1)
        return F.when(code != self.null, code + F.lit(self.least))


class Key:
    """Long columns packed into words that compare as the columns do, nulls last."""

    def __init__(self, columns: Sequence[tuple[str, bool]], ranges: dict[str, tuple[int | None, int | None]], prefix: str) -> None:
        self.fields: list[Field] = []
        for name, down in columns:
            low, high = ranges[name]
            if low is None:  # nulls only
                low, high = 0, -1
            elif down:
                low, high = ~high, ~low
            if high - low < WIDE:
                self.fields.append(Field(name, down, "", low, high - low + 1))
            else:
                self.fields.append(Field(name, down, "upper", low >> 32, (high >> 32) - (low >> 32) + 1))
                self.fields.append(Field(name, down, "lower", 0, 1 << 32))
        self.widths = [0]
        for f in self.fields:
            if self.widths[-1] + f.bits > WORD:
                self.widths.append(0)
            f.word = len(self.widths) - 1
            self.widths[-1] += f.bits
        room = list(self.widths)
        for f in self.fields:
            room[f.word] -= f.bits
            f.shift = room[f.word]
        self.words = [f"{prefix}{i}" for i in range(len(self.widths))]

    def pack(self) -> list[Column]:
        out = []
        for i, word in enumerate(self.words):
            codes = [F.shiftleft(f.code(), f.shift) for f in self.fields if f.word == i and f.bits]
            out.append(sum(codes[1:], codes[0]).alias(word) if codes else F.lit(0).cast("long").alias(word))
        return out

    def unpack(self) -> list[Column]:
        out, halves = [], {}
        for f in self.fields:
            v = f.value(self.words)
            if f.half == "upper":
                halves[f.name] = F.shiftleft(v, 32)
                continue
            v = halves[f.name].bitwiseOR(v) if f.half else v
            out.append((F.bitwise_not(v) if f.down else v).cast("long").alias(f.name))
        return out

    def digits(self) -> list[list[Column]]:
        """The prefixes of the key, each a digit longer: expressions d0, d1, ... The last is the key itself."""
        out = []
        for i, width in enumerate(self.widths):
            for shift in range(max(0, width - DIGIT), -DIGIT, -DIGIT):
                shift = max(0, shift)
                out.append([F.col(w).alias(f"d{j}") for j, w in enumerate(self.words[:i])] + [F.shiftright(self.words[i], shift).alias(f"d{i}")])
                if not shift:
                    break
        return out


def _names(prefix: list[Column]) -> list[str]:
    return [f"d{i}" for i in range(len(prefix))]


def first_scores(counts: DataFrame, group: Key, score: Key, k: int) -> DataFrame:
    """``counts`` (lines by group and score) of the k first scores of each group, with ``place`` and ``before``, the lines of earlier scores."""
    levels = score.digits()
    for prefix in levels:
        if prefix is not levels[-1]:
            counts = common.stored(counts, "scores")
        names = _names(prefix)
        w = Window.partitionBy(*group.words).orderBy(*names)
        buckets = counts.select(*group.words, *prefix, "tied").groupBy(*group.words, *names).agg(F.sum("tied").alias("tied"))
        buckets = buckets.withColumn("place", F.row_number().over(w).cast("long"))
        if prefix is levels[-1]:
            sofar = F.sum("tied").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            found = buckets.withColumn("before", sofar - F.col("tied")).where(F.col("place") <= k)
            return found.withColumnsRenamed(dict(zip(names, score.words, strict=True)))
        open_ = buckets.where(F.col("place") <= k).select(*group.words, *names)
        counts = counts.withColumns({n: c for n, c in zip(names, prefix, strict=True)}).join(open_, [*group.words, *names], "left_semi").drop(*names)
    raise AssertionError


def refined(lines: DataFrame, parent: list[str], rest: Key) -> tuple[list[DataFrame], int]:
    """Lines of scores that have more than BUCKET, equal ones as one row with their number ``copies``, dealt into leaves of at
    most BUCKET lines or of equal ones: ``before`` counts the lines before the leaf, ``leaf`` is a hash of it. Also the most copies."""
    own = [c for c in lines.columns if c not in parent and c not in rest.words]
    seen = Observation()
    equal = lines.groupBy(*parent, *rest.words).agg(*[F.first(c).alias(c) for c in own], F.count("*").alias("copies"))
    open_ = common.stored(equal.observe(seen, F.max("copies").alias("most")), "equal")
    most = seen.get["most"] or 1
    leaves, above = [], []
    for level, prefix in enumerate(rest.digits()):
        names = _names(prefix)
        w = Window.partitionBy(*parent, *above).orderBy(*names)
        sizes = open_.select(*parent, *prefix, *[F.col(f"u{i}") for i in range(len(above))], "copies")
        sizes = sizes.groupBy(*parent, *above, *names).agg(F.sum("copies").alias("n"), F.count("*").alias("kinds"))
        sofar = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sizes = sizes.withColumn("ahead", sofar - F.col("n")).drop(*above)
        open_ = open_.drop(*above).withColumns({n: c for n, c in zip(names, prefix, strict=True)}).join(sizes, [*parent, *names])
        left = Observation()
        done = (F.col("n") <= BUCKET) | (F.col("kinds") == 1)
        open_ = open_.withColumn("before", F.col("before") + F.col("ahead")).withColumn("done", done).withColumn("leaf", F.xxhash64(*parent, *names, F.lit(level)))
        open_ = common.stored(open_.observe(left, F.count(F.when(~F.col("done"), 1)).alias("n")).drop("n", "kinds", "ahead"), "open")
        leaves.append(open_.where("done").drop("done", *names))
        if not left.get["n"]:
            break
        above = [f"u{i}" for i in range(len(names))]
        open_ = open_.where("not done").drop("done", "leaf").withColumnsRenamed(dict(zip(names, above, strict=True)))
    return leaves, most


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by non-negative words, the first most significant: a counting sort for every 16 bits that differ."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        differ = int(np.bitwise_or.reduce(word ^ word[0])) if len(word) else 0
        for shift in range(0, WORD + 1, 16):
            if differ >> shift & 0xFFFF:
                digit = (word >> shift & 0xFFFF).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16 bits by counting
    return order


def placed(lines: DataFrame, parent: list[str], rest: Key, buckets: int) -> DataFrame:
    """Adds ``pos`` (of the first copy) to lines of leaves, each leaf whole in one of ``buckets``."""
    keys, out = [*parent, *rest.words], [*parent, *rest.words, "place", "tied", "pos", "copies"]

    def order(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        by = radix_order([col[c] for c in keys])
        col = {c: v[by] for c, v in col.items()}
        first = np.ones(len(by), bool)  # of a leaf
        first[1:] = np.logical_or.reduce([col[c][1:] != col[c][:-1] for c in (*parent, "before")])
        ahead = np.cumsum(col["copies"]) - col["copies"]
        start = np.flatnonzero(first)
        col["pos"] = 1 + col["before"] + ahead - np.repeat(ahead[start], np.diff([*start, len(by)]))
        return pa.table({c: col[c] for c in out})

    dealt = lines.select(*keys, "place", "tied", "before", "copies", F.pmod("leaf", F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(order, ", ".join(f"{c} long" for c in out))


def copied(lines: DataFrame, most: int) -> DataFrame:
    """A row for each copy, at ``pos``, ``pos`` + 1, ...; where there are many, they are first dealt out to tasks in runs of COPIES."""
    if most > COPIES:
        runs = lines.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
        runs = runs.withColumn("pos", F.col("pos") + F.col("run") * COPIES).withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("run") * COPIES))
        lines = runs.repartition("pos", "run", *[c for c in lines.columns if c not in ("pos", "copies")]).drop("run")
    return lines.withColumn("pos", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("copies") - 1)))


def rank_ties(lines: DataFrame, group: Sequence[str], score: Sequence[tuple[str, bool]], then: Sequence[str], k: int) -> DataFrame:
    """Lines whose place is at most ``k``: the named columns as longs, and ``pos``, ``place``, ``tied``.

    Within a group of equal ``group`` columns (nulls are equal), lines are ordered by ``score`` (name, whether larger comes first), then
    by ``then``, ascending; nulls come last and are equal. ``place`` is one more than the number of different earlier scores, ``pos`` counts lines from 1, ``tied`` counts the lines
    of the group with that score. Named columns hold integers; others are not read, so clashing names of theirs do no harm. Equal
    lines are lines of their own, with positions next to each other. An empty table gives no rows; with ``k`` below 1 there are none either.
    """
    spark = lines.sparkSession
    named = [*group, *[n for n, _ in score], *then]
    if set(named) & {"pos", "place", "tied"} or len(set(named)) < len(named):
        raise ValueError(f"columns must be different, and not named pos, place or tied: {named}")
    lines = lines.select(*[F.col(f"`{c}`").cast("long").alias(c) for c in named])
    ends = lines.agg(*[f(f"`{c}`").alias(f"{i}{f.__name__}") for i, c in enumerate(named) for f in (F.min, F.max)]).first()
    ranges = {c: (ends[f"{i}min"], ends[f"{i}max"]) for i, c in enumerate(named)}
    by, points, rest = Key([(c, False) for c in group], ranges, "g"), Key(list(score), ranges, "p"), Key([(c, False) for c in then], ranges, "r")
    parent = [*by.words, *points.words]
    packed = lines.select(*by.pack(), *points.pack(), *rest.pack())

    seen = Observation()
    counts = packed.groupBy(*parent).agg(F.count("*").alias("tied"))
    scores = first_scores(counts, by, points, k).observe(seen, F.sum("tied").alias("lines"), F.max("tied").alias("most"))
    scores = common.stored(scores, "places")
    buckets, hot = max(1, -(-(seen.get["lines"] or 0) // BUCKET)), (seen.get["most"] or 0) > BUCKET
    found = packed.join(scores, parent)
    leaves = [found.where(F.col("tied") <= BUCKET).withColumns({"copies": F.lit(1).cast("long"), "leaf": F.xxhash64(*parent)})]
    most = 1
    if hot:
        more, most = refined(found.where(F.col("tied") > BUCKET), parent, rest)
        leaves += more
    out = placed(common.union_all(leaves), parent, rest, buckets)
    out = copied(out, most) if most > 1 else out
    return out.select(*by.unpack(), *points.unpack(), *rest.unpack(), "pos", "place", "tied")


def whole(x: Column) -> Column:
    """floor(x + 0.5) as a long; null where that is no number or beyond a long."""
    return F.when(F.abs(x) < 9e18, F.floor(x + 0.5))


def op11_ranked_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best places of ``sale_lines`` by vendor, part and month, with ties.

    Null vendors are a group; null percent and null amounts come last, as null quantities do."""
    lines = common.table(spark, sf_dir, "sale_lines")
    month = F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))
    part = F.coalesce(F.col("item_id") % 2, F.lit(-1))
    mixed = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    of = lambda c: F.when(mixed, F.lit(-1)).otherwise(c).cast("long")
    rows = lines.select(
        of(F.col("vendor_id")).alias("vendor_id"), of(part).alias("part"), of(month).alias("month"),
        F.floor(F.col("quantity") / 10).alias("tens"), whole(100 * F.col("discount")).alias("percent"),
        "sale_id", "line_no", "quantity", whole(100 * F.col("amount")).alias("amount_cents"),
    )
    ranked = rank_ties(rows, ["vendor_id", "part", "month"], [("tens", True), ("percent", False)], ["sale_id", "line_no", "quantity", "amount_cents"], 5)
    return ranked.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


OP11_SQL = """
with bytes as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when (a & 1) = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
mixed as (
  select sale_id from (select distinct sale_id from sale_lines where sale_id is not null), bytes
  where xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(sale_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda a, b: xor(a >> 8, t[cast((xor(a, b) & 255) + 1 as integer)])), 4294967295) % 5 = 0),
l as (
  select case when m.sale_id is null then vendor_id else -1 end as vendor_id,
    case when m.sale_id is null then coalesce(item_id % 2, -1) else -1 end as part,
    case when m.sale_id is null then coalesce(100 * year(shipped_at) + month(shipped_at), -1) else -1 end as month,
    cast(floor(quantity / 10) as bigint) as tens, cast(floor(100 * discount + 0.5) as bigint) as percent, s.sale_id, cast(line_no as bigint) as line_no,
    cast(quantity as bigint) as quantity, cast(floor(100 * amount + 0.5) as bigint) as amount_cents
  from sale_lines s left join mixed m on s.sale_id = m.sale_id),
r as (
  select *, row_number() over (partition by vendor_id, part, month order by tens desc nulls last, percent asc nulls last, sale_id asc nulls last, line_no asc nulls last, quantity asc nulls last, amount_cents asc nulls last) as pos,
    dense_rank() over (partition by vendor_id, part, month order by tens desc nulls last, percent asc nulls last) as place,
    count(*) over (partition by vendor_id, part, month, tens, percent) as tied
  from l)
select vendor_id, cast(part as bigint) as part, cast(month as bigint) as month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied from r where place <= 5
"""
