"""Quality classifier by weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Labellers vote good, bad or abstain on each document. With no true labels, EM estimates each labeller's
accuracy (the chance of each vote under either class) and the share of good documents; votes of a document
are taken as independent given its class. Documents with the same votes are one row: EM runs over the table of vote patterns,
3^labellers rows at most, whatever the corpus. Posteriors then train a logistic scorer over hashed words
on a bounded sample, and every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

ABSTAIN, BAD, GOOD = -1, 0, 1
BITS = 14
#: Documents the scorer is fitted on, at most.
SAMPLE = 3000
STEPS = 100
RIDGE = 1e-4


def labellers(text: Column) -> dict[str, Column]:
    """Overlapping heuristics: good, bad, or null where they abstain. Counts are over the whole text. All say bad of a text without words."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    words, chars = count(r"[^\x20\x09-\x0D]+"), F.char_length(text)
    letters, capitals = count(r"\p{L}"), count(r"\p{Lu}")
    ends = count(r"[.!?](?:\s|$)")
    odd = count(r"[^\p{L}\p{N}\s.,;:!?'\"()-]")
    runs = count(r"([^\p{L}\p{N}\s])\1")
    again = count(r"(?<![^\s])([^\s]{2,}) \1(?: \1)+")
    share = F.try_divide
    vote = lambda good, bad: F.when(words == 0, BAD).when(good, GOOD).when(bad, BAD)
    return {
        "letters": vote(share(letters, chars) >= 0.72, share(letters, chars) < 0.6),
        "capitals": vote(share(capitals, letters) <= 0.12, share(capitals, letters) > 0.3),
        "sentences": vote(share(words, ends).between(2, 60), (words > 60) & ((ends == 0) | (share(words, ends) > 120))),
        "symbols": vote(share(odd, words) <= 0.02, share(odd, words) > 0.1),
        "runs": vote(share(runs, words) <= 0.01, share(runs, words) > 0.08),
        "repeats": vote(again == 0, again > 0),
    }


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good, P(vote | class) as labellers x 2 x 2, posterior of each pattern). ``votes``: patterns x labellers, -1
    abstains. Starts from the suspicion that one bad vote is enough; counts are smoothed by one vote each way."""
    post = np.where((votes == BAD).any(1), 0.3, np.where((votes == GOOD).any(1), 0.9, 0.5))
    share, chance = 0.5, np.full((votes.shape[1], 2, 2), 0.5)
    for _ in range(steps):
        weight = np.stack([(1 - post) * counts, post * counts])
        share = (weight[1].sum() + 1) / (weight.sum() + 2)
        for v in (0, 1):
            chance[:, :, v] = (weight @ (votes == v)).T + 1
        # a labeller is better than chance: what it calls good is likelier so in good documents
        chance[:, 0, 0] += 1
        chance[:, 1, 1] += 1
        chance /= chance.sum(2, keepdims=True)
        log = np.log([[1 - share], [share]]) + sum(np.where(votes[:, j] >= 0, np.log(chance[j][:, np.maximum(votes[:, j], 0)]), 0.0) for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            post = new
            break
        post = new
    return share, chance, post


_class = np.full(256, 1, np.uint8)  # other: letters of two bytes and more
_class[97:123] = 1
_class[65:91], _class[48:58], _class[[0x20, *range(0x09, 0x0E)]] = 2, 3, 0
_class[[i for i in range(33, 127) if not chr(i).isalnum()]] = 4 + np.arange(32)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, share) of hashed features: words, and the shapes of four bytes: small, capital, digit, space, or which sign."""
    doc, word = shingles.words_of(texts)
    data = np.frombuffer(b" ".join(texts), np.uint8)
    shape = _class[data].astype(np.uint64)
    if len(shape) > 3:
        four = shingles.mixed(shape[:-3] + shape[1:-2] * np.uint64(40) + shape[2:-1] * np.uint64(1600) + shape[3:] * np.uint64(64000) + np.uint64(1))
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        own = np.searchsorted(ends, np.arange(len(four)))
        inside = np.arange(len(four)) + 3 < ends[own]  # four bytes of one text
        doc = np.concatenate([doc, own[inside]])
        word = np.concatenate([word, four[inside]])
    key = (doc.astype(np.int64) << BITS) | (word >> np.uint64(64 - BITS)).astype(np.int64)
    key, n = np.unique(key, return_counts=True)
    doc = key >> BITS
    return doc, key & ((1 << BITS) - 1), n / np.bincount(doc, n, len(texts))[doc]


def fit(row: np.ndarray, feature: np.ndarray, share: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels from the non-zero features of rows, by gradient steps with momentum.
    Features are scaled by their root mean square; both classes weigh the same."""
    n, d = len(y), 1 << BITS
    scale = 1 / (np.sqrt(np.bincount(feature, share**2, d) / max(1, n)) + 1e-3)
    z = share * scale[feature]
    good = min(0.999, max(0.001, y.mean())) if n else 0.5
    weight = y * 0.5 / good + (1 - y) * 0.5 / (1 - good)
    weight /= max(1e-12, weight.sum())
    w, b, dw, db = np.zeros(d), 0.0, np.zeros(d), 0.0
    rate = 1.0 / (0.25 * np.bincount(row, z * z, n).max(initial=0) + 1)
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(np.bincount(row, z * w[feature], n) + b, -500, 500))) - y)
        dw = 0.95 * dw - rate * (np.bincount(feature, z * error[row], d) + RIDGE * w)
        db = 0.95 * db - rate * error.sum()
        w, b = w + dw, b + db
    return w * scale, b


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Rows (id, posterior, score, keep): the weak labels' posterior, the scorer's probability of good, and whether it is 1/2 or
    more. Null text is empty. A text without words has nothing to score: its score is its posterior, which is that of six bad votes. Labellers run once over each
    text. The scorer's sample is of different (id, text) pairs, so repeated rows do not fill it. Other columns are not read; an empty table gives none."""
    spark = docs.sparkSession
    common.modest_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("mark", F.xxhash64("id", "text"))
    votes = [F.coalesce(v, F.lit(ABSTAIN)).cast("int") for v in labellers(F.col("text")).values()]
    voted = common.stored(base.select("mark", F.array(*votes).alias("votes")), "votes")
    patterns = voted.groupBy("votes").count().collect()  # 3^labellers rows at most
    if not patterns:
        return base.select("id", F.lit(0.5).alias("posterior"), F.lit(0.5).alias("score"), F.lit(True).alias("keep"))
    table = np.array([r["votes"] for r in patterns])
    _, _, post = expectation_maximisation(table, np.array([r["count"] for r in patterns], float))
    known = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(patterns, post, strict=True)], "votes array<int>, posterior double")
    posterior = voted.join(F.broadcast(known), "votes").groupBy("mark").agg(F.any_value("posterior").alias("posterior"))
    n = sum(r["count"] for r in patterns)
    bound = 2**63 - 1 if n <= sample else int(-(2**63) + min(1.0, (sample + 4 * sample**0.5 + 8) / n) * (2**64 - 1))
    chosen = F.col("mark") <= min(bound, 2**63 - 1)
    few = base.where(chosen).groupBy("mark").agg(F.any_value("text").alias("text")).join(posterior.where(chosen), "mark")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
            doc, feature, share = hashed(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            rows = [(feature[a:b].astype(np.int32).tobytes(), share[a:b].astype(np.float32).tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("posterior"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["mark", "posterior", "f", "s"])

    rows = few.select("mark", "posterior", "text").mapInArrow(featured, "mark long, posterior double, f binary, s binary").collect()
    rows = sorted(rows, key=lambda r: r["mark"])[:sample]
    row = np.repeat(np.arange(len(rows)), [len(r["f"]) // 4 for r in rows])
    feature = np.frombuffer(b"".join(r["f"] for r in rows), np.int32)
    share = np.frombuffer(b"".join(r["s"] for r in rows), np.float32).astype(float)
    shared = spark.sparkContext.broadcast(fit(row, feature, share, np.array([r["posterior"] for r in rows])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
            out = np.full(len(texts), float(b))
            for first, last in shingles.groups(texts):
                doc, feature, share = hashed(texts[first:last])
                out[first:last] += np.bincount(doc, share * w[feature], last - first)
            out = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            blank = np.array([not t.strip() for t in texts], bool)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(out, mask=blank)], names=["id", "mark", "score"])
            common.trim()

    # equal (id, text) rows have one mark and one posterior; both sides are shuffled for the join, so a hot mark can be split
    scored = base.select("id", "mark", "text").mapInArrow(score, "id long, mark long, score double")
    scored = scored.join(common.stored(posterior, "posteriors", n), "mark")
    return scored.withColumn("score", F.coalesce("score", "posterior")).select("id", "posterior", "score", (F.col("score") >= 0.5).alias("keep"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
