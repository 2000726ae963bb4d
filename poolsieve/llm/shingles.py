"""Weighted word shingles of whole texts, in bulk: hashed words, shingles of five, TF-IDF weights.

A word is a run of anything but ASCII white space, ASCII letters in lower case. A shingle's weight is its
number of occurrences times the mean of its words' idf, idf being 1 + ln((documents + 1) / (documents with the word + 1)).
Document frequencies are counted over all documents in BUCKETS hash buckets of words, so what is
broadcast has a fixed size. Weights by the words rather than by the shingle itself keep copies alike: a
shingle's own frequency would make the text that a large group of near copies shares light, and their
few edits heavy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
CHUNK = 1 << 14
GROUP_BYTES = 1 << 20
GROUP_ROWS = 1 << 14

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint64) + np.uint64(1)
_lower[65:91] += np.uint64(32)
_place = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_order = np.random.default_rng(6).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a piece that cuts no word."""
    inside = ~_space[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return at, np.empty(0, np.uint64)
    head = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    length = np.diff(head, append=len(at))
    nth = np.arange(len(at)) - np.repeat(head, length)
    value = _lower[data[at]] * _place[nth & 255]
    return at[head], mixed(np.add.reduceat(value, head) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of all words; long data in pieces that end at white space."""
    array, at, starts, hashes = np.frombuffer(data, np.uint8), 0, [], []
    while at < len(array):
        end = min(at + 2 * GROUP_BYTES, len(array))
        while end < len(array) and not _space[array[end]]:
            gap = np.flatnonzero(_space[array[end : end + 65536]])
            end += int(gap[0]) if len(gap) else min(65536, len(array) - end)
        s, h = _hash_words(array[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about GROUP_BYTES together."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and (size + len(t) > GROUP_BYTES or i - first >= GROUP_ROWS):
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of each word, in order."""
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, hashes = word_hashes(b" ".join(texts))
    return np.searchsorted(offsets, starts, side="right") - 1, hashes


def weighted(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hash, weight) of each text's different shingles, by text and hash. A text of fewer
    than five words has one shingle of all its words, one without words has none."""
    doc, word = words_of(texts)
    value = idf[word >> np.uint64(64 - BUCKET_BITS)]
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    if len(word) >= WORDS:
        m = len(word) - WORDS + 1
        h, v = np.zeros(m, np.uint64), np.zeros(m, np.float32)
        for j in range(WORDS):
            h += word[j : j + m] * _order[j]
            v += value[j : j + m]
        v /= WORDS
        keep = doc[:m] == doc[WORDS - 1 :]
        owner, h, v = doc[:m][keep], mixed(h[keep]), v[keep]
    else:
        owner, h, v = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.float32)
    few = np.flatnonzero((n > 0) & (n < WORDS))
    if len(few):
        extra = [np.sum(word[first[i] : first[i] + n[i]] * _order[: n[i]], dtype=np.uint64) + np.uint64(n[i]) for i in few]
        owner = np.concatenate([owner, few])
        h = np.concatenate([h, mixed(np.array(extra, np.uint64))])
        v = np.concatenate([v, np.array([value[first[i] : first[i] + n[i]].mean() for i in few], np.float32)])
    key = (owner.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    count = np.diff(head, append=len(key))
    key = key[head]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), (count * v[order[head]]).astype(np.float32)


def inverse_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """idf of each bucket, over all rows of ``docs``, and their number. Tasks send sums of a fixed size, added up by range of buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(0)]
            n += len(texts)
            for a, b in groups(texts):
                doc, word = words_of(texts[a:b])
                seen = np.unique((doc.astype(np.uint64) << np.uint64(BUCKET_BITS)) | (word >> np.uint64(64 - BUCKET_BITS)))
                total += np.bincount((seen & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            common.trim()
        if n:
            parts = [total[i : i + CHUNK] for i in range(0, BUCKETS, CHUNK)]
            parts = [p.astype(np.int32 if p.max() < 1 << 31 else np.int64).tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(parts)), -1], pa.int32()), pa.array([*parts, np.int64(n).tobytes()], pa.binary())], names=["part", "counts"])

    def add(key, rows):  # noqa: ANN001, ANN202
        total: np.ndarray | int = 0
        for x in rows.column("counts").to_pylist():
            total = total + np.frombuffer(x, np.int32 if len(x) == 4 * CHUNK else np.int64).astype(np.int64)
        return pa.table({"part": rows.column("part").slice(0, 1), "counts": pa.array([np.asarray(total).tobytes()], pa.binary())})

    counted = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "part int, counts binary")
    found = {r[0]: np.frombuffer(r[1], np.int64) for r in counted.groupBy("part").applyInArrow(add, "part int, counts binary").collect()}
    if not found:
        return np.ones(BUCKETS, np.float32), 0
    df = np.concatenate([found[i] for i in range(BUCKETS // CHUNK)])
    n = int(found[-1][0])
    return (1 + np.log((n + 1) / (df + 1))).astype(np.float32), n
