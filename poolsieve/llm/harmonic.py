"""Harmonic packing of token sequences, each worker for itself.

A piece of n tokens belongs to class j = capacity // n: a sequence holds j such pieces, and always gets j, whatever their lengths. A worker keeps
one open sequence a class, so it needs no sight of other workers and nothing is shuffled. The share that a class wastes is the distance of its pieces
from the class's longest length, capacity // j. As documents may be cut, a document that is more than SLACK below gives
a piece of exactly the next class's longest length, and its rest goes on to a smaller class: rests shrink with the square of j, so pieces are few.

What is left open when a worker's rows end, less than a sequence a class, is laid end to end and cut into full sequences and powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
END_ID = 2
#: A piece stays whole if it is shorter than its class's longest by no more than this share.
SLACK = 1 / 128
#: Strings whose ids a task remembers, of words and of what stands between white space; others are worked out each time.
REMEMBERED = 200_000
#: Longer texts are encoded in runs of about so many characters, cut at white space.
RUN = 1 << 16

# fixed values: how the vocabulary's rule cuts a lower-case text; white space is dropped
CUT = r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+"
#: Texts of these characters only are cut by CUT as by the rule, and are in normal form: ASCII but four separators, Latin letters, common signs.
PLAIN = "[\x00-\x1b\x20-\x7f\xa1\xa7\xa9\xab\xae\xb0\xb1\xb6\xb7\xbb\xbf-įı-ňŊ-ž‐-‧€]*"


class Known(dict):
    """Ids of strings as little-endian unsigned 32-bit numbers; the first REMEMBERED are kept."""

    def __init__(self, ids: Callable[[str], bytes]) -> None:
        self.ids = ids

    def __missing__(self, string: str) -> bytes:
        found = self.ids(string)
        if len(self) < REMEMBERED:
            self[string] = found
        return found


class Encoder:
    """Token ids of whole texts, equal to those of the tokenizers library for the same file. Of plain texts, what stands between white space
    is encoded once each, by its words; other texts go to the library as they are. Strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        self.ids = lambda text: library.encode(text, add_special_tokens=False).ids
        self.plain, self.gap = re.compile(PLAIN).fullmatch, re.compile("[ \t\n\r]").search
        cut, tokenize = re.compile(CUT).findall, library.model.tokenize
        # the vocabulary spells bytes as printable characters: those that print stand for themselves
        others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        spelt = {b: chr(256 + i) for i, b in enumerate(others)}

        def word(text: str) -> bytes:
            if not text.isascii() or not text.isprintable():
                text = text.encode().decode("latin-1").translate(spelt)
            return array("I", [t.id for t in tokenize(text)]).tobytes()

        words = Known(word)
        self.known = Known(lambda chunk: b"".join(map(words.__getitem__, cut(chunk))))
        with open(path, encoding="utf-8") as f:
            if len(json.load(f)["added_tokens"]) != 2:
                raise ValueError("the rule of this class is that of the word-end vocabulary")

    def runs(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            gap = self.gap(text, at + RUN) if len(text) - at > RUN else None
            end = gap.start() if gap else len(text)
            yield text[at:end]
            at = end

    def __call__(self, text: str) -> bytes:
        out = []
        for run in self.runs(text):
            if self.plain(run):
                out += map(self.known.__getitem__, run.lower().split())
            else:
                out.append(np.array(self.ids(run), "<u4").tobytes())
        return b"".join(out)


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """A worker process keeps what it remembers from task to task."""
    return Encoder(path)


def cut_lengths(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of n tokens: full sequences, then pieces that are nearly as long as their class allows."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        j = capacity // n
        if n < (1 - slack) * (capacity // j):
            out.append(capacity // (j + 1))
        else:
            out.append(n)
        n -= out[-1]
    return out


class Shelf:
    """A worker's open sequences, one a class, and the places it has given."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = {}

    def sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        """Rows of a sequence of pieces (doc_id, doc_tokens, start, ids)."""
        offset = 0
        for doc, tokens, start, ids in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), tokens, self.next, offset
            offset += n
        self.next += 1

    def put(self, doc: int | None, tokens: int, start: int, ids: memoryview) -> Iterator[tuple]:
        """Takes a piece; gives the rows of the sequence it fills, if it does."""
        j = self.capacity // (len(ids) // 4)
        pieces = self.open.setdefault(j, [])
        pieces.append((doc, tokens, start, bytes(ids)))
        if len(pieces) == j:
            del self.open[j]
            yield from self.sequence(pieces)

    def close(self) -> Iterator[tuple]:
        """Rows of all that is open, end to end, in sequences of the capacity and of powers of two."""
        rest = [p for j in sorted(self.open) for p in self.open.pop(j)]
        left = sum(len(p[3]) // 4 for p in rest)
        rest.reverse()
        while left:
            room = min(self.capacity, 1 << left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                doc, tokens, start, ids = rest.pop()
                n = min(room, len(ids) // 4)
                pieces.append((doc, tokens, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    rest.append((doc, tokens, start + n, ids[4 * n :]))
                room -= n
            yield from self.sequence(pieces)


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
ROWS = pa.schema([(c, pa.int64()) for c in COLUMNS])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, vocabulary: Callable[[], str] = default_vocabulary, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row a piece, all long.

    A document is its text's ids, then END_ID; a null or empty text is END_ID alone. Repeated rows, and rows without an id, are documents of
    their own. Other columns are not read. ``vocabulary`` tells the file's place on the executor; ``capacity`` is a power of two. A worker numbers
    its sequences from its partition's number times 2^36. No documents give no rows. A task holds one batch of texts, the ids of one, and less than a sequence a class."""
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError(f"the capacity must be a power of two: {capacity}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = encoder_of(vocabulary()), np.array([END_ID], "<u4").tobytes()
        shelf = Shelf(capacity, TaskContext.get().partitionId() << 36)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            table = np.array(rows, object).reshape(-1, len(COLUMNS))
            return pa.RecordBatch.from_arrays([pa.array(table[:, i], pa.int64()) for i in range(len(COLUMNS))], schema=ROWS)

        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encoder(text.as_py() or "") + tail)
                tokens, at = len(ids) // 4, 0
                for n in cut_lengths(tokens, capacity, slack):
                    rows += shelf.put(doc, tokens, at, ids[4 * at : 4 * (at + n)])
                    at += n
            common.trim()
            yield batch_of(rows)
        yield batch_of(list(shelf.close()))

    common.modest_batches(docs.sparkSession)
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cols.mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (tokens, padded, sequences): sequences are padded to the capacity, but for those of a power of two."""
    each = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return each.agg(F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))).alias("padded"), F.count("*").alias("sequences"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
