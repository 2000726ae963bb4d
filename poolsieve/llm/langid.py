"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier a bit, over hashed byte n-grams, predicts that bit.
Decoding adds up the loss of every codeword's bits under the classifiers' margins and takes the nearest one;
the gap to the next tells how sure it is, and a small gap is flagged as ambiguous.

Features are the shares of a whole text's byte n-grams (1 to 4 bytes), hashed to ``DIMENSIONS``. A margin is
thus a mean of weights over the n-grams of a text, so prediction needs no feature vectors: text is read in
slices of bounded size, whatever the length of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DIMENSIONS = 1 << 12
#: The classifiers are fitted on at most so many labelled documents (of each language SAMPLE / number of languages).
SAMPLE = 2000
RIDGE = 3e-3
COLUMNS = 256
SLICE = 1 << 18
#: Below this gap between the losses of the two nearest codewords, relative to their sum, a prediction is ambiguous.
AMBIGUOUS = 0.02
GRAMS = (1, 2, 3, 4)


def codewords(k: int) -> np.ndarray:
    """k rows of +-1. Up to 5 languages the exhaustive code; for more, the best by smallest row distance of
    seeded random codes of length 8 + 5 log2(k), columns that don't divide the languages left out."""
    if k <= 5:
        n = max(1, 2 ** (k - 1) - 1)
        return np.array([[1] * n] + [[-1 if (b + 1) >> (k - 1 - r) & 1 else 1 for b in range(n)] for r in range(1, k)], float)[:k]
    rng, best, width = np.random.default_rng(k), None, 8 + int(5 * np.log2(k))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, width))
        code = code[:, np.abs(code.sum(0)) < k]
        apart = ((code.shape[1] - code @ code.T) / 2 + 1e9 * np.eye(k)).min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram length, the hashed n-gram that ends at each byte; bytes before the slice count as 0."""
    h = np.zeros(len(data), np.uint32)
    back = data.astype(np.uint32) + 1
    for n in GRAMS:
        shifted = back if n == 1 else np.concatenate([np.zeros(n - 1, np.uint32), back[: len(back) - n + 1]])[: len(data)]
        h = h * np.uint32(0x9E3779B1) + shifted * np.uint32(0x85EBCA6B) + np.uint32(n)
        yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)


def slices(data: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(data), SLICE):
        yield data[at : at + SLICE]


def features(data: np.ndarray) -> np.ndarray:
    """Shares of the hashed n-grams of one text."""
    counts = np.zeros(DIMENSIONS)
    for part in slices(data):
        for g in grams(part):
            counts += np.bincount(g, minlength=DIMENSIONS)
    return (counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIMENSIONS x bits
    bias: np.ndarray

    def margins(self, data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.bias))
        for part in slices(data):
            for g in grams(part):
                total += np.bincount(g, minlength=DIMENSIONS) @ self.weights
        return total / max(1, len(data) * len(GRAMS)) + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of margins: the nearest language's number, its score, whether it is ambiguous. A bit's loss is log(1 + exp(-4 x bit x margin))."""
        loss = np.logaddexp(0, -4 * margins[:, None, :] * self.code[None]).mean(2)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        best = loss.argmin(1)
        two = np.sort(loss, 1)[:, :2]
        gap = (two[:, 1] - two[:, 0]) / (two.sum(1) + 1e-12) if loss.shape[1] > 1 else np.ones(len(loss))
        return best, p.max(1) / p.sum(1), gap < AMBIGUOUS


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """Ridge classifiers, one a bit of the code, of standardised features; languages weigh the same."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = np.array([languages.index(s) for s in labels])
    weight = 1 / np.bincount(y)[y]
    weight /= weight.mean()
    # by columns: beside the sample and the kernel the driver holds ``COLUMNS`` features of each row
    root = np.sqrt(weight)[:, None]
    mean, scale, kernel = np.empty(x.shape[1]), np.empty(x.shape[1]), np.zeros((len(x), len(x)))  # rows are fewer than dimensions

    def columns() -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, x.shape[1], COLUMNS):
            yield slice(at, at + COLUMNS), x[:, at : at + COLUMNS].astype(np.float64)

    for part, z in columns():
        mean[part] = weight @ z / weight.sum()
        z -= mean[part]
        scale[part] = np.sqrt(np.einsum("ij,ij,i->j", z, z, weight) / weight.sum()) + 1e-5
        z /= scale[part]
        z *= root
        kernel += z @ z.T
    kernel /= x.shape[1]
    kernel.flat[:: len(x) + 1] += RIDGE * len(x)
    target = code[y]
    mid = np.average(target, axis=0, weights=weight)
    dual = np.linalg.solve(kernel, (target - mid) * root)
    del kernel
    w = np.empty((x.shape[1], code.shape[1]))
    for part, z in columns():
        z -= mean[part]
        z /= scale[part]
        z *= root
        w[part] = z.T @ dual / x.shape[1] / scale[part][:, None]
    return Model(languages, code, w, mid - mean @ w)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of a bounded sample of rows: of each language the ``sample`` / languages first in order of a hash
    of id and text; of more languages than ``sample`` the most frequent are learned; None if no row is labelled. Rows with equal id, text and language count once in the sample, whatever their number. Only
    hashed features of the sample reach the driver."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    mark = F.xxhash64(F.col(id_col).cast("string"), F.lit(3), F.col(text_col).cast("string"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    counts = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:sample])
    each = sample // len(counts)
    # the share of each language whose marks, uniform, hold a little more than ``each`` rows, then the first of them
    top = {s: min(1.0, (each + 4 * each**0.5 + 8) / n) for s, n in counts.items()}
    limit = F.create_map(*[F.lit(v) for s, t in top.items() for v in (s, int(-(2**63) + t * (2**64 - 1)) if t < 1 else 2**63 - 1)])
    few = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"), mark.alias("mark")).where(F.col("mark") <= limit[F.col("lang")])
    few = few.groupBy("lang", "mark").agg(F.any_value("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))  # of the sample only
    few = few.withColumn("k", first).where(F.col("k") <= each).select("text", "lang", "mark")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(np.frombuffer(t.as_py().encode(), np.uint8)).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1), batch.column(2)], names=["x", "lang", "mark"])

    found = few.mapInArrow(featured, "x binary, lang string, mark long").collect()
    by: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["mark"], r["x"])):
        by.setdefault(r["lang"], []).append(r["x"])
    del found
    pairs = [(x, s) for s in sorted(by) for x in by[s][:each]]
    sampled = np.empty((len(pairs), DIMENSIONS), np.float32)
    for n, (x, _) in enumerate(pairs):
        sampled[n] = np.frombuffer(x, np.float32)
    labels = [s for _, s in pairs]
    del by, pairs
    model = fit(sampled, labels)
    common.trim(0)
    return model


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``. ``und``, score 0, where the text is null or has no
    letter, or there is no model. All other columns are kept, whatever their names (or ``keep`` of
    them; columns with names of the results are replaced); equal texts get equal results."""
    keep = [c for c in keep or docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    own_text, own_letter = (max([name, *[c + "_" for c in docs.columns if c.startswith(name)]], key=len) for name in ("_text", "_letter"))
    common.modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            common.trim()
            text, letter = batch.column(own_text), batch.column(own_letter).to_pylist()
            n = batch.num_rows
            pred, score, unsure = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            rows = [i for i in range(n) if letter[i]] if model else []
            if rows:
                margins = np.stack([model.margins(np.frombuffer(text[i].as_buffer(), np.uint8)) for i in rows])
                best, p, flag = model.decode(margins)
                pred[rows], score[rows], unsure[rows] = np.array(model.languages, object)[best], p, flag
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], names=[*keep, "lang_pred", "score", "ambiguous"])

    letter = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    given = docs.select(*keep, F.col(text_col).cast("string").alias(own_text), letter.alias(own_letter))
    more = T.StructType().add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    out = T.StructType([*docs.select(*keep).schema.fields, *more.fields])
    return given.mapInArrow(run, out)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, any others) whose language is found and not ambiguous."""
    model = train(docs.where(~held_out()))
    found = predict(docs.select(F.struct(*common.columns(docs)).alias("_row"), "text"), model, keep=["_row"])
    return found.where("lang_pred <> 'und' and not ambiguous").select("_row.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    model = train(docs.where(~held_out()))
    return predict(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
