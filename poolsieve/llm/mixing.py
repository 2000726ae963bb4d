"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents with the same membership pattern are one node: its
size is the capacity of a first copy, of a second, and so on up to ``max_copies``, each copy dearer than
the one before (cost 1, 2, 3, ...), so text is repeated only where quotas ask for it. Each pattern is
joined to its sources, each source has a quota. The cheapest flow of the largest value says how many
words of each pattern go to each source; documents are then selected in a seeded order until a pattern's
words are reached. Reruns agree: order and ties depend on document ids and the seed only.

Only the table of patterns reaches the driver, one row for each distinct membership, whatever the number of documents: flows
are found for 100,000 patterns in seconds. Documents stay in the cluster.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_COPIES = 3
#: Hash ranges that a pattern's documents are counted in; only the range that a selection ends in is sorted.
RANGES = 1024
SEED = 20


def size_of(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float] | None = None, most: float = MAX_COPIES) -> dict[str | None, float]:
    """Targets that share all of ``sizes`` by weight; none above ``most`` times its source's size, the
    excess going to the others by weight until none is above. Without weights, sources by code point,
    null last, weigh 1, 2, 3, repeating."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = weights or {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), dict.fromkeys(order, 0.0)
    while free:
        total = sum(weights[s] for s in free)
        full = [s for s in free if total and left * weights[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weights[s] / total if total else 0.0 for s in free}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in full]
    return out


class Network:
    """A flow network whose flow grows: ``augment`` adds the largest further flow that its arcs have room for, by blocking
    flows on the levels of shortest paths."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        """Number of a new arc; the flow on arc e is ``room[e ^ 1]``."""
        e = len(self.to)
        self.to += [b, a]
        self.room += [room, 0]
        self.out[a].append(e)
        self.out[b].append(e + 1)
        return e

    def _levels(self, source: int, sink: int) -> list[int]:
        level, at = [-1] * len(self.out), [source]
        level[source] = 0
        while at and level[sink] < 0:
            after = []
            for a in at:
                for e in self.out[a]:
                    if self.room[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        after.append(self.to[e])
            at = after
        return level

    def augment(self, source: int, sink: int) -> None:
        while (level := self._levels(source, sink))[sink] >= 0:
            nth, path = [0] * len(self.out), []
            at = source
            while True:
                if at == sink:
                    amount = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                    # back to before the first arc without room
                    keep = next(i for i, e in enumerate(path) if not self.room[e])
                    at = self.to[path[keep] ^ 1]
                    del path[keep:]
                    continue
                arcs = self.out[at]
                while nth[at] < len(arcs) and not (self.room[e := arcs[nth[at]]] and level[self.to[e]] == level[at] + 1):
                    nth[at] += 1
                if nth[at] < len(arcs):
                    path.append(arcs[nth[at]])
                    at = self.to[path[-1]]
                elif path:
                    at = self.to[path.pop() ^ 1]
                    nth[at] += 1
                else:
                    break


def route(patterns: list[tuple[tuple, int]], quotas: dict[str | None, float], most: int = MAX_COPIES) -> list[dict]:
    """For each (membership, size), the words it gives to each of its sources: the cheapest flow of the largest value.

    Only copies cost, and a path that begins with an n-th copy costs n, so shortest paths come in order of n: the flow is first made as
    large as first copies allow, then second copies are added to the room of each pattern, and so on."""
    place = {s: len(patterns) + 2 + i for i, s in enumerate(quotas)}
    net = Network(len(patterns) + len(quotas) + 2)
    source, sink = len(patterns), len(patterns) + 1
    for s, quota in quotas.items():
        net.arc(place[s], sink, round(quota))
    links = [[(s, net.arc(p, place[s], most * size)) for s in members] for p, (members, size) in enumerate(patterns)]
    gives = [net.arc(source, p, 0) for p in range(len(patterns))]
    for _ in range(most):
        for e, (_, size) in zip(gives, patterns, strict=True):
            net.room[e] += size
        net.augment(source, sink)
    return [{s: net.room[e ^ 1] for s, e in own} for own in links]


RESULTS = ("source_size", "target", "copies", "taken")


def mix(sized: DataFrame, weights: dict[str | None, float] | None = None, most: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """Rows of ``sized`` (doc_id, size, members: array of source names, one of them may be null, any others) with
    ``source_size``, ``target`` (of the first member by code point), ``copies`` and ``taken`` = copies x size.

    Documents of size 0 are taken 0 times. A pattern that gives f of its z words has f div z copies of all
    its documents; the rest is filled by documents in order of a seeded hash, the last of them where this
    comes nearer. Hash ranges are summed first, so no pattern's documents meet in one task.
    A null ``members`` is the null source; the order of members does not matter; equal rows are documents of their own; other columns stay as
    they are, whatever their names, but for those named like the results, which are replaced; an empty table gives none.
    """
    spark = sized.sparkSession
    members = F.array_sort(F.array_distinct(F.coalesce("members", F.array(F.lit(None).cast("string")))))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    own = F.struct(*common.columns(sized, RESULTS)).alias("row")
    rows = sized.select(own, F.to_json(members).alias("pattern"), order.alias("mark"), F.shiftrightunsigned(order, 54).cast("int").alias("range"), F.col("size").cast("long").alias("size"), F.col("doc_id").alias("doc"))
    ranges = common.stored(rows.groupBy("pattern", "range").agg(F.sum("size").alias("z")), "ranges", 0)
    found = ranges.groupBy("pattern").agg(F.sum("z").alias("z")).collect()
    # the key of a pattern is as Spark spells it
    read = lambda key: tuple(json.loads(key))
    patterns = sorted(((read(r["pattern"]), r["z"] or 0, r["pattern"]) for r in found), key=lambda x: [(s is None, s or "") for s in x[0]])
    sizes: dict[str | None, int] = {}
    for names, z, _ in patterns:
        for s in names:
            sizes[s] = sizes.get(s, 0) + z
    quotas = targets(sizes, weights, most)
    if sum(sizes.values()) > (whole := sum(z for _, z, _ in patterns)):  # shared text counts once
        quotas = {s: q * whole / sum(sizes.values()) for s, q in quotas.items()}
    plan_rows = []
    for (names, z, key), g in zip(patterns, route([x[:2] for x in patterns], quotas, most), strict=True):
        copies, rest = divmod(sum(g.values()), z) if z else (0, 0)
        plan_rows.append((key, sizes[names[0]], float(quotas[names[0]]), copies, rest))
    plan = spark.createDataFrame(plan_rows, "pattern string, source_size long, target double, base long, rest long")
    # the range in which the selection ends: ranges before it are taken, later ones are not, it is sorted
    before = Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    ends = ranges.withColumn("before", F.coalesce(F.sum("z").over(before), F.lit(0))).join(plan.select("pattern", "rest"), "pattern")
    ends = ends.where("before < rest").groupBy("pattern").agg(F.max(F.struct("range", "before")).alias("end"))
    plan = plan.join(ends, "pattern", "left").select("pattern", "source_size", "target", "base", "rest", F.col("end.range").alias("last"), F.col("end.before").alias("before"))
    # written, so that its size is known: Spark broadcasts it where it is small, else it shuffles and splits hot patterns
    planned = rows.join(common.stored(plan, "plan", 0), "pattern")
    inside = Window.partitionBy("pattern", "range").orderBy("mark", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    sorted_ = planned.where("range = last").withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sorted_ = sorted_.withColumn("more", (F.col("at") + F.col("size") / 2 <= F.col("rest")).cast("int")).drop("at")
    others = planned.where("last is null or range <> last").withColumn("more", F.coalesce(F.col("range") < F.col("last"), F.lit(False)).cast("int"))
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("more")).otherwise(F.lit(0)).cast("int")
    out = sorted_.unionByName(others).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("row.*", *RESULTS)


def sized_documents(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, size, members), each document a member of its source; counted once, kept in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long"), size_of(F.col("text").cast("string")).alias("size"), F.array(F.col("source").cast("string")).alias("members"))
    return common.stored(rows, "sized")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, any others) that the mix takes, each as often as it does."""
    whole = F.struct(*common.columns(docs)).alias("_row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text").cast("string")).alias("size"), F.array(F.col("source").cast("string")).alias("members"))
    taken = mix(rows).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(sized_documents(common.table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
