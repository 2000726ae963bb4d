"""Best-fit packing of token sequences by swap-based local search.

Each document is tokenized once; only its pieces' lengths (at most ``capacity`` values) matter for packing.
So the histogram of lengths, not the pieces, goes to the driver. Local search starts from a bin a piece and works on groups of
equal bins (what they hold, how many), all bins of a group at once: a piece moves to the fullest bin it fits in, or is exchanged, one for one or two for one,
wherever that raises the sum of squared fills, until bins are as few as they can be or no step helps. Then each piece takes the next place of
its length: pieces are numbered within (length, salt), the salts' counts are summed, and a plan of the
bins' places, whose size depends on the capacity and not on the number of pieces, is looked up. A piece as long as the capacity is a sequence of its own.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END_ID = 0
#: Pieces of a length are numbered in independent parts of about so many, or of all pieces / 2^17 if these are more: parts are
#: never more than 2^17 and one for each length.
PART = 1000
#: Words whose ids a task remembers; others are worked out each time.
REMEMBERED = 150_000

# fixed values: how byte-level BPE cuts a text, letters first as no other alternative can begin with one
CUT = r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


class Known(dict):
    """Ids of words as little-endian unsigned 32-bit numbers; the first REMEMBERED words are kept."""

    def __init__(self, piece: Callable[[bytes], list[int]]) -> None:
        self.piece = piece

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.piece(word.encode())).tobytes()
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


class Encoder:
    """Token ids of whole texts, equal to those of the tokenizers library for the same file.

    A text is cut into words by the file's own rule and each word is encoded once. Where Python's
    character classes differ from the rule's (numerals that aren't decimal digits, four control
    characters, characters beyond the basic plane), and where the text holds a special token's string (ordinary text here), the library encodes the whole text.
    """

    def __init__(self, path: str) -> None:
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # the vocabulary spells bytes as printable characters: those that print stand for themselves
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printing]
        byte_of = {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(others)}
        self.special = [t["content"] for t in model["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.cut = re.compile(CUT).findall
        numerals = "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) in ("No", "Nl"))
        self.numeral = re.compile(f"[{re.escape(numerals)}]").search
        self.control = re.compile("[\x1c-\x1f]").search
        self.astral = re.compile("[\U00010000-\U0010ffff]").search
        self.known = Known(tiktoken.Encoding("words", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece)

    def odd(self, text: str) -> bool:
        """Whether the library must cut the text itself."""
        if self.control(text) or any(s in text for s in self.special):
            return True
        return not text.isascii() and bool(self.numeral(text) or self.astral(text))

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.odd(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, self.cut(text)))


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n ids: full pieces, but for the first."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return [first] * bool(first) + [capacity] * (n // capacity)


def pieces_of(docs: DataFrame, vocabulary: Callable[[], str], capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32). ``vocabulary`` tells the file's place on the executor."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary())
        common.trim()
        tail = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encoder(text.as_py() or "") + tail)
                at = 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    rows.append((doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                    at += n
            common.trim()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, PIECES, strict=True)], schema=PIECES)

    common.modest_batches(docs.sparkSession)
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cols.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


Held = tuple[tuple[int, int], ...]  # what a bin holds: lengths, in falling order, with their numbers


def _fill(held: Held) -> int:
    return sum(n * k for n, k in held)


def _changed(held: Held, out: tuple[int, ...], into: tuple[int, ...]) -> Held:
    now = dict(held)
    for n in out:
        now[n] -= 1
    for n in into:
        now[n] = now.get(n, 0) + 1
    return tuple(sorted(((n, k) for n, k in now.items() if k), reverse=True))


class Index:
    """Things by a number from 0 to ``most``, to find those of a number, or the next larger ones."""

    def __init__(self, most: int) -> None:
        self.things: list[dict] = [{} for _ in range(most + 1)]
        self.used: list[int] = []

    def put(self, n: int, thing: tuple) -> None:
        if not self.things[n]:
            insort(self.used, n)
        self.things[n][thing] = None

    def take(self, n: int, thing: tuple) -> None:
        del self.things[n][thing]
        if not self.things[n]:
            del self.used[bisect_left(self.used, n)]

    def upwards(self, least: int) -> Iterator[tuple[int, tuple]]:
        for i in range(bisect_left(self.used, least), len(self.used)):
            for thing in self.things[self.used[i]]:
                yield self.used[i], thing


class Bins:
    """Groups of equal bins, found by the room they have left, and by the room each would have without one of its pieces."""

    def __init__(self, bins: dict[Held, int], capacity: int) -> None:
        self.capacity, self.count, self.room = capacity, Counter(), {}
        self.open, self.without = Index(capacity), Index(capacity)
        self.queue: list[tuple[int, Held]] = []  # the emptiest first; those that are gone are passed over
        for held, k in bins.items():
            self.add(held, k)

    def add(self, held: Held, k: int) -> None:
        if not held or not k:
            return
        self.count[held] += k
        if self.count[held] == k:
            room = self.room[held] = self.capacity - _fill(held)
            if room:
                self.open.put(room, held)
                for n, _ in held:
                    self.without.put(room + n, (held, n))
                heappush(self.queue, (self.capacity - room, held))

    def drop(self, held: Held, k: int) -> None:
        self.count[held] -= k
        if not self.count[held]:
            del self.count[held]
            if room := self.room.pop(held):
                self.open.take(room, held)
                for n, _ in held:
                    self.without.take(room + n, (held, n))


    def step(self, giver: Held, taker: Held, give: tuple[int, ...], get: tuple[int, ...]) -> int:
        """Moves or exchanges pieces between as many of these bins as there are, and tells how many bins that empties. Of
        bins with one piece, several go into a taker at once, where they fit."""
        n, each = give[0], 1
        single = giver == ((n, 1),) and not get
        if giver == taker:
            each = min(self.capacity // n, self.count[giver]) - 1 if single else 1
            times = self.count[giver] // (each + 1)
        else:
            times = min(self.count[giver], self.count[taker])
            if single:
                each = max(1, min(self.room[taker] // n, self.count[giver] // self.count[taker]))
        self.drop(giver, times * each)
        self.drop(taker, times)
        rest = _changed(giver, give, get)
        self.add(rest, times * each)
        self.add(_changed(taker, get, give * each), times)
        return 0 if rest else times * each


def _move(bins: Bins, giver: Held) -> tuple | None:
    """The move of a piece of ``giver`` that leaves the least room where it goes, of those that raise the squared fills."""
    best, least = None, bins.room[giver]
    for n, _ in giver:
        for room, taker in bins.open.upwards(n):
            if room - n >= least:
                break
            if taker != giver or bins.count[giver] > 1:
                best, least = (giver, taker, (n,), ()), room - n
                break
        if not least:
            break
    return best


def _exchange(bins: Bins, giver: Held) -> tuple | None:
    """The exchange of one or two pieces of ``giver`` for a smaller one that leaves the least room where they go, of those that raise the
    squared fills."""
    best, least = None, bins.room[giver]
    sizes = [n for n, _ in giver]
    for out in [*((n,) for n in sizes), *((n, m) for i, (n, k) in enumerate(giver) for m in sizes[i + (k < 2) :])]:
        given = sum(out)
        for room, (taker, n) in bins.without.upwards(given):
            if room - given >= least:
                break
            if n < given and (taker != giver or bins.count[giver] > 1):
                best, least = (giver, taker, out, (n,)), room - given
                break
        if not least:
            break
    return best


def local_search(lengths: dict[int, int], capacity: int) -> Counter[Held]:
    """Bins of pieces, from a bin a piece. Each step raises the sum of squared fills, so the search ends: at
    the least possible number of bins, or when no bin has a step left. At first the longest pieces move, to the fullest of bins
    that are at least as full; then the emptiest bins give, by moves, and by exchanges where they have none."""
    bins = Bins({((n, 1),): k for n, k in lengths.items()}, capacity)
    least = -(-sum(n * k for n, k in lengths.items()) // capacity)
    number = sum(lengths.values())
    for n in sorted(lengths, reverse=True):
        giver = ((n, 1),)
        while giver in bins.count:
            taker = next((t for room, t in bins.open.upwards(n) if t != giver or bins.count[t] > 1), None)
            if taker is None or bins.room[taker] > capacity - n:
                break
            number -= bins.step(giver, taker, (n,), ())
    bins.queue.sort()
    stuck: list[tuple[int, Held]] = []
    helped = False
    while number > least:
        if not bins.queue:
            if not helped:
                break
            bins.queue, stuck, helped = sorted(stuck), [], False
            continue
        at, giver = heappop(bins.queue)
        if giver not in bins.count:
            continue
        found = _move(bins, giver) or _exchange(bins, giver)
        if not found:
            stuck.append((at, giver))
            continue
        helped = True
        number -= bins.step(*found)
        if giver in bins.count:
            heappush(bins.queue, (at, giver))
    return bins.count


def plan_of(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Places of the pieces of each length, in runs: the run's first piece, its bins' first sequence id,
    pieces a bin, offset of the first piece."""
    bins = local_search(histogram, capacity)
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    sequence = 0
    for b in sorted(bins, key=lambda b: (-_fill(b), b)):
        offset = 0
        for n, k in b:
            runs[n].append((used[n], sequence, k, offset))
            used[n] += k * bins[b]
            offset += n * k
        sequence += bins[b]
    assert used == Counter(histogram)
    flat = [(n, *run) for n in sorted(runs) for run in runs[n]]
    names = ("length", "first", "sequence", "each", "offset")
    return dict(zip(names, np.array(flat, np.int64).reshape(-1, 5).T.copy(), strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (kept in the shared folder). An empty table stays empty. Sequences of a
    full piece have negative numbers."""
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == capacity).select(*PIECES.names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces = pieces.where(F.col("length") < capacity)
    histogram = Counter({r[0]: r[1] for r in pieces.groupBy("length").count().collect()})  # less than capacity rows
    part = max(PART, sum(histogram.values()) >> 17)
    salts = [-(-histogram[n] // part) or 1 for n in range(capacity + 1)]
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.array(*map(F.lit, salts)), F.col("length").cast("int") + 1) if max(salts) > 1 else F.lit(1)).cast("int")
    pieces = pieces.withColumn("salt", salt)
    counts = pieces.groupBy("length", "salt").count().collect()  # a row for each part
    base = {n: np.zeros(k, np.int64) for n, k in enumerate(salts)}
    for n, own, k in counts:
        base[n][own] = k
    base = {n: np.cumsum(x) - x for n, x in base.items()}
    shared = spark.sparkContext.broadcast((base, plan_of(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, plan = shared.value
        where = np.searchsorted(plan["length"], np.arange(capacity + 2))  # where the runs of a length begin
        for batch in batches:
            n, salt, rank = (batch.column(c).to_numpy() for c in ("length", "salt", "rank"))
            rank = rank - 1
            run = np.empty(len(n), np.int64)
            by = np.argsort(n, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(n[by])) + 1) if len(by) else []:
                length = int(n[part[0]])
                rank[part] += base[length][salt[part]]
                lo, hi = where[length], where[length + 1]
                run[part] = lo + np.searchsorted(plan["first"][lo:hi], rank[part], side="right") - 1
            nth = rank - plan["first"][run]
            columns = [batch.column(f.name) for f in PIECES]
            sequence = plan["sequence"][run] + nth // plan["each"][run]
            offset = plan["offset"][run] + nth % plan["each"][run] * n
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*PIECES.names, "sequence_id", "offset"])

    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within).cast("long"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").union(full)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, vocabulary: Callable[[], str] = default_vocabulary, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents; null text is empty (only the end id), repeated rows are packed each."""
    return pack(common.stored(pieces_of(docs, vocabulary, capacity), "pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
