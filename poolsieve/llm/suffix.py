"""Removal of byte strings that repeat across documents.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id; all
strings are judged on the input. The work is done in blocks of documents and ranges of hashes, which talk by
compact messages; texts are shuffled once, into blocks, and all three passes over them read that exchange.

1. Each window of LENGTH bytes is named by the smallest hash of its GRAM-grams (equal windows have equal names). A
   block sends its different names, and a digest of each text, to hash ranges. A range answers
   each block with those that other documents have as well. Equal whole texts are settled by this.
2. Of neighbouring windows with the same, repeated name a block sends the bytes they span (a context, 81
   bytes at most), once, with the smallest document of the block that has it. A range sorts out where the windows
   of its contexts occur first: it builds the
   Burrows-Wheeler transform of the contexts and derives common prefixes by increasing value, breadth
   first: intervals of suffixes that share l characters are extended backward to l + 1, until LENGTH. What
   still lies in one interval then is the same string.
3. A block marks its windows by the answers.

Hot strings do not gather: a block mentions a name or a context once, however often it has it, so a string in all
documents is one entry a block; and names that many blocks have are told apart by the bytes beside their gram, so that the many contexts of a
common phrase go to many ranges. Null text is empty; a null id counts as larger than all others; rows with
the same id do not remove each other's bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH = 50
GRAM = 20
SEGMENT = 1 << 19
#: A name that more blocks than HOT have is told apart by BESIDE bytes more.
HOT, BESIDE = 24, 15
RUN = 32  # windows a context has at most: bits of a mask
TRANSFORM_BYTES = 1 << 19  # text of one transform, about
NULL_ID = np.iinfo(np.int64).max
#: Text that a block holds, and whose names a range gets, about.
BLOCK_BYTES, RANGE_BYTES = 2 << 20, 2 << 20

MESSAGE = "range long, block long, kind int, a binary, b binary, c binary, d binary, e binary"
ARROW = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcde")])
DIGEST, NAME, MASK, OWN = range(4)


def _messages(rows: list[tuple]) -> pa.Table:
    common.trim()
    rows = [(*r, *[b""] * (8 - len(r))) for r in rows]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def _grams(data: np.ndarray) -> np.ndarray:
    """The mixed hash of each GRAM-gram (20 = 16 + 4 bytes)."""
    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    h16 = h8[:-8] * power(8) + h8[8:]
    h = h16[:-4] * power(4) + h4[16:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _even(least: np.ndarray) -> np.ndarray:
    """Least hashes crowd near zero: one to one, they are spread over all numbers, as names are dealt out by their size."""
    names = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (names ^ (names >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _names(data: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes, the smallest hash of its grams."""
    m, width = _grams(data), 1
    want = LENGTH - GRAM + 1
    while 2 * width <= want:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (want - width)], m[want - width :]) if want > width else m


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, name) of runs of neighbouring windows with one name, in order; none
    crosses documents, which begin at ``offsets`` (the last is the end), and none is longer than RUN."""
    first, last = offsets[:-1], offsets[1:] - LENGTH  # windows of a document, both included
    keep = last >= first
    first, last = first[keep], last[keep]
    starts, counts, names = [], [], []
    for at in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        end = min(at + SEGMENT, len(data) - LENGTH + 1)
        lo, hi = np.searchsorted(last, at), np.searchsorted(first, end)
        if lo >= hi:
            continue
        m = _names(data[at : end + LENGTH - 1])
        begin, stop = np.maximum(first[lo:hi], at) - at, np.minimum(last[lo:hi] + 1, end) - at
        edge = np.empty(len(m) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(m[1:], m[:-1], out=edge[1:-1])
        edge[begin] = edge[stop] = True
        inside = np.zeros(len(m) + 1, np.int8)
        inside[begin] += 1
        inside[stop] -= 1
        pos = np.flatnonzero(edge)
        live = np.cumsum(inside, dtype=np.int8)[pos[:-1]] > 0
        s, n = pos[:-1][live], np.diff(pos)[live]
        parts = -(-n // RUN)
        if parts.max(initial=0) > 1:
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            s, n = np.repeat(s, parts) + RUN * nth, np.minimum(RUN, np.repeat(n, parts) - RUN * nth)
        starts.append(s + at)
        counts.append(n)
        names.append(_even(m[s]))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(names)


def refined(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs with names that also tell BESIDE bytes next to the first gram that gave the name: those behind it, or, where the window ends
    before, those before it. Equal windows still have equal names."""
    row = np.repeat(np.arange(len(starts)), counts)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    key = np.empty(len(at), np.uint64)
    wide = np.arange(LENGTH)
    for i in range(0, len(at), 1 << 14):
        own = slice(i, i + (1 << 14))
        windows = data[at[own][:, None] + wide]
        flat = _grams(windows.reshape(-1))
        gram = np.lib.stride_tricks.as_strided(flat, (len(windows), LENGTH - GRAM + 1), (LENGTH * 8, 8)).argmin(1)
        from_ = np.where(gram + GRAM + BESIDE <= LENGTH, gram + GRAM, gram - BESIDE)
        h = names[row[own]] + (from_ > gram).astype(np.uint64)
        for k in range(BESIDE):
            h = h * np.uint64(0x9E3779B97F4A7C15) + windows[np.arange(len(windows)), from_ + k] + np.uint64(1)
        h ^= h >> np.uint64(32)
        key[own] = h * np.uint64(0xD6E8FEB86659FD93)
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(at) else np.empty(0, np.int64)
    return at[head], np.diff(head, append=len(at)), key[head]


class Block:
    """The documents of a block, in order of id: their ids, bytes end to end, and where each begins."""

    def __init__(self, rows: pa.Table) -> None:
        ids = rows.column("doc_id").fill_null(NULL_ID).to_numpy()
        self.order = order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        text = rows.column("text").combine_chunks()
        self.texts = [text[int(i)].as_py() or b"" for i in order]

    def joined(self, rows: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes, offsets, and runs' source for some of the documents."""
        texts = [self.texts[i] for i in rows]
        data = b"".join(texts)
        return data, np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])

    def digests(self) -> list[bytes]:
        return [hashlib.blake2b(t, digest_size=16).digest() for t in self.texts]


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as their differences, 4 bytes each where these are small enough."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values[:1])
    if steps.max() < 1 << 32:
        return b"\x04" + values[:1].tobytes() + steps.astype("<u4").tobytes()
    return b"\x08" + values.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    if data[:1] == b"\x04":
        return np.cumsum(np.frombuffer(data, "<u4", offset=9).astype(np.uint64)) + np.frombuffer(data, np.uint64, 1, offset=1)
    return np.frombuffer(data, np.uint64, offset=1)


def _range(names: np.ndarray, ranges: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def name_messages(rows: pa.Table, block: int, ranges: int, bits: int) -> pa.Table:
    """Pass 1 over a block: digests with the smallest document and their number, names with a mark for those of
    two documents. Names are shortened to their first ``bits`` bits: more may seem repeated than are."""
    own = Block(rows)
    out: list[tuple] = []
    first: dict[bytes, list] = {}
    for i, digest in enumerate(own.digests()):
        if digest in first:
            first[digest][1] += 1
        else:
            first[digest] = [i, 1]
    by: dict[int, list] = {}
    for digest, (i, n) in first.items():
        by.setdefault(int(_range(np.frombuffer(digest, np.uint64, 1), ranges)[0]), []).append((digest, own.ids[i], n))
    for r, found in sorted(by.items()):
        out.append((r, block, DIGEST, b"".join(x[0] for x in found), np.array([x[1] for x in found], np.int64).tobytes(), np.array([x[2] for x in found], np.int64).tobytes()))
    _, data, offsets = own.joined(np.array([i for i, _ in first.values()], np.int64))
    starts, _, names = runs(data, offsets)
    order = np.argsort(names, kind="stable")
    names, docs = names[order] >> np.uint64(64 - bits), np.searchsorted(offsets, starts[order], side="right")
    head = np.flatnonzero(np.diff(names, prepend=~names[:1]))
    if len(head):
        several = np.minimum.reduceat(docs, head) != np.maximum.reduceat(docs, head)
        names = names[head]
        cut = np.searchsorted(_range(names << np.uint64(64 - bits), ranges), np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(cut)):
            a, b = cut[r], cut[r + 1]
            out.append((int(r), block, NAME, pack_sorted(names[a:b]), np.packbits(several[a:b]).tobytes()))
    return _messages(out)


def repeated_names(rows: pa.Table, r: int) -> pa.Table:
    """A range's answers to pass 1: to each block its digests of several documents, with the first of all, and its names of several documents."""
    out: list[tuple] = []
    kinds, blocks = rows.column("kind").to_pylist(), rows.column("block").to_pylist()
    a, b, c = (rows.column(x).to_pylist() for x in "abc")
    seen: dict[bytes, list] = {}
    for i, kind in enumerate(kinds):
        if kind == DIGEST:
            for k, (doc, n) in enumerate(zip(np.frombuffer(b[i], np.int64), np.frombuffer(c[i], np.int64), strict=True)):
                x = seen.setdefault(a[i][16 * k : 16 * k + 16], [doc, 0, []])
                x[0] = min(x[0], doc)
                x[1] += n
                x[2].append(blocks[i])
    reply: dict[int, list] = {}
    for digest, (doc, n, where) in seen.items():
        if n > 1:
            for block in where:
                reply.setdefault(block, []).append((digest, doc))
    out += [(r, block, DIGEST, b"".join(x[0] for x in found), np.array([x[1] for x in found], np.int64).tobytes()) for block, found in reply.items()]
    sets = [(blocks[i], unpack_sorted(a[i]), b[i]) for i, kind in enumerate(kinds) if kind == NAME]
    if sets:
        every = np.concatenate([x[1] for x in sets])
        several = np.concatenate([np.unpackbits(np.frombuffer(x[2], np.uint8), count=len(x[1])) for x in sets]).astype(bool)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        again = np.zeros(len(every), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        again[np.isin(every, every[several])] = True
        _, place, often = np.unique(every, return_inverse=True, return_counts=True)
        hot = (often > HOT)[place]
        at = 0
        for block, names, _ in sets:
            own = np.flatnonzero(again[at : at + len(names)])
            if len(own):
                out.append((r, block, NAME, pack_sorted(names[own]), np.packbits(hot[at + own]).tobytes()))
            at += len(names)
    return _messages(out)


def context_messages(rows: pa.Table, answers: pa.Table, block: int, ranges: int, bits: int) -> pa.Table:
    """Pass 2 over a block: contexts of repeated names to their ranges, and a message to itself that says
    which rows are copies of an earlier document and where each context occurs."""
    own = Block(rows)
    kinds, a, b = (answers.column(x).to_pylist() for x in ("kind", "a", "b"))
    first: dict[bytes, int] = {}
    for i, kind in enumerate(kinds):
        if kind == DIGEST:
            first |= {a[i][16 * k : 16 * k + 16]: d for k, d in enumerate(np.frombuffer(b[i], np.int64).tolist())}
    copies = np.array([own.ids[i] > first.get(d, NULL_ID) for i, d in enumerate(own.digests())], bool)
    data, array, offsets = own.joined(np.flatnonzero(~copies))
    ids = own.ids[~copies]
    told = [(unpack_sorted(a[i]), b[i]) for i, k in enumerate(kinds) if k == NAME]
    repeated = np.concatenate([np.empty(0, np.uint64), *(x for x, _ in told)])
    hot = np.concatenate([np.empty(0, bool), *(np.unpackbits(np.frombuffer(y, np.uint8), count=len(x)).astype(bool) for x, y in told)])
    order = np.argsort(repeated)
    repeated, hot = repeated[order], hot[order]
    starts, counts, names = runs(array, offsets)
    short = names >> np.uint64(64 - bits)
    at = np.minimum(np.searchsorted(repeated, short), max(0, len(repeated) - 1))
    keep = repeated[at] == short if len(repeated) else np.zeros(len(short), bool)
    warm = hot[at[keep]] if len(repeated) else np.empty(0, bool)
    starts, counts, names = starts[keep], counts[keep], names[keep]
    parts = zip(refined(array, starts[warm], counts[warm], names[warm]), (starts[~warm], counts[~warm], names[~warm]), strict=True)
    starts, counts, names = (np.concatenate(x) for x in parts)
    order = np.argsort(starts, kind="stable")
    starts, counts, names = starts[order], counts[order], names[order]
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(data[s:e], len(number)) for s, e in zip(starts.tolist(), (starts + counts + LENGTH - 1).tolist(), strict=True)], np.int64)
    lead = np.unique(which, return_index=True)[1]  # where each context occurs first: in the smallest document
    docs = ids[np.searchsorted(offsets, starts[lead], side="right") - 1]
    part = _range(names[lead], ranges)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    contexts = list(number)
    cut = np.searchsorted(part[order], np.arange(ranges + 1))
    out: list[tuple] = []
    for r in np.flatnonzero(np.diff(cut)):
        mine = order[cut[r] : cut[r + 1]]
        bytes_ = [contexts[i] for i in mine.tolist()]
        out.append((int(r), block, NAME, names[lead[mine]].tobytes(), np.array([len(x) for x in bytes_], np.uint8).tobytes(), docs[mine].astype(np.int64).tobytes(), b"".join(bytes_)))
    used = np.flatnonzero(np.diff(cut))
    out.append((ranges + block, block, OWN, starts.astype(np.int64).tobytes(), counts.astype(np.uint8).tobytes(), place[which].astype(np.uint32).tobytes() if len(which) else b"", np.stack([used, cut[used]]).astype(np.int64).tobytes(), np.packbits(copies).tobytes()))
    return _messages(out)


def _sorted(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, equal ones by place, and the sorted keys. Places have ``bits`` bits; where keys leave these free, key and place are sorted as one number."""
    if len(keys) and int(keys.max()).bit_length() + bits > 64:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    keys = keys << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64)
    keys.sort()
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int32), keys >> np.uint64(bits)


def _ranks(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]))
    return rank


def first_occurrences(texts: list[bytes], docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of ``length`` bytes of the texts, in order, the smallest of ``docs`` (one a text) that has it.

    A suffix array of the texts, each with an end mark of its own (marks are in order of the texts), gives their Burrows-Wheeler transform;
    a stable sort of the transform is the backward step: row psi[r] is row r without its first character. Rows r - 1 and r share no
    character where the first ones differ (value 0), and l + 1 of them where psi[r - 1] and psi[r] are still in one interval after
    l: values are set by increasing l, each once, and what is unset after ``length`` - 1 shares ``length``.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    n, ends = int(offsets[-1]), len(texts)
    bits = n.bit_length()
    s = np.zeros(n + 3, np.uint64)  # 0: an end
    mark = offsets[1:] - 1
    inner = np.ones(n, bool)
    inner[mark] = False
    s[:n][inner] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    # ranks by four characters, then by twice as many each time. Beyond the longest text, suffixes that are equal up to their ends are in order of
    # place, which is the order of their marks; what lies behind an end does not count
    until = np.repeat(mark, sizes + 1) - np.arange(n)  # characters before the end
    key = s[:n].copy()
    for k in range(1, 4):
        key = key * np.uint64(257) + np.where(until >= k, s[k : n + k], np.uint64(0))
    order, key = _sorted(key, bits)
    step = 4
    while step <= int(sizes.max(initial=0)):
        rank = _ranks(order, key)
        if rank[order[-1]] == n - 1:
            break
        behind = np.zeros(n, np.uint64)
        on = np.flatnonzero(until >= step)
        behind[on] = rank[on + step] + np.uint64(1)
        order, key = _sorted(rank * np.uint64(n + 1) + behind, bits)
        step *= 2
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    # with marks that differ: the mark of text t is t, characters come behind all marks
    first = s[:n] + np.uint64(ends)
    first[mark] = np.arange(ends, dtype=np.uint64)
    transform = first[order - 1]
    psi, top = _sorted(transform, bits)
    new = np.concatenate([[True], top[1:] != top[:-1]])
    del transform, top, key, until, s, first
    unset = np.flatnonzero(~new)
    here, above = psi[unset], psi[unset - 1]
    for _ in range(1, length):
        interval = np.cumsum(new, dtype=np.int32)
        found = interval[here] != interval[above]
        new[unset[found]] = True
        keep = ~found
        unset, here, above = unset[keep], here[keep], above[keep]
        if not len(unset):
            break
    interval = np.cumsum(new, dtype=np.int32)
    windows = sizes - length + 1
    at = np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    string, owner = interval[rank[at]], np.repeat(docs, windows)
    least = np.full(n + 1, NULL_ID, np.int64)
    by, strings = _sorted(string.astype(np.uint64), bits)
    head = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1]])) if len(strings) else np.empty(0, np.int64)
    if len(head):
        least[strings[head].astype(np.int64)] = np.minimum.reduceat(owner[by], head)
    return least[string]


def _masks(texts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For each context, a bit for each of its windows that occurs in a smaller document than the context's own."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
    least = np.full(len(number), NULL_ID, np.int64)
    np.minimum.at(least, which, docs)
    texts = list(number)
    windows = np.array([len(t) - LENGTH + 1 for t in texts], np.int64)
    firsts = first_occurrences(texts, least)
    begin = np.cumsum(windows) - windows
    mask = np.zeros(len(which), np.uint32)
    for bit in range(RUN):
        on = np.flatnonzero(windows[which] > bit)
        mask[on[firsts[begin[which[on]] + bit] < docs[on]]] |= np.uint32(1 << bit)
    return mask


def mask_messages(rows: pa.Table, r: int) -> pa.Table:
    """A range's answers to pass 2: a mask for each context of a block, a bit for each window that occurs in a smaller
    document than the block's first with it. A block's message to itself goes on as it is."""
    if rows.column("kind")[0].as_py() == OWN:
        return rows.select(ARROW.names).cast(ARROW)
    blocks, b = rows.column("block").to_pylist(), [np.frombuffer(x, np.uint8) for x in rows.column("b").to_pylist()]
    name = np.frombuffer(b"".join(rows.column("a").to_pylist()), np.uint64)
    docs = np.frombuffer(b"".join(rows.column("c").to_pylist()), np.int64)
    data = b"".join(rows.column("d").to_pylist())
    lengths = np.concatenate(b).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    mask = np.zeros(len(name), np.uint32)
    # names are settled some at a time: equal windows have equal names
    by = np.argsort(name, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], name[by][1:] != name[by][:-1]]))
    part = (np.cumsum(lengths[by]) // TRANSFORM_BYTES)[head]
    for some in np.split(by, head[1:][np.diff(part) > 0]):
        mask[some] = _masks([data[i:j] for i, j in zip(begin[some].tolist(), (begin[some] + lengths[some]).tolist(), strict=True)], docs[some])
    out, at = [], 0
    for block, own_lengths in zip(blocks, b, strict=True):
        own = mask[at : at + len(own_lengths)]
        at += len(own_lengths)
        if len(some := np.flatnonzero(own)):
            out.append((r, block, MASK, some.astype(np.uint32).tobytes(), own[some].tobytes()))
    return _messages(out)


def removed_bytes(own: Block, answers: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Pass 3 over a block: each document's place in it, and which of its bytes go."""
    kinds, ranges, a, b, c, d, e = (answers.column(x).to_pylist() for x in ("kind", "range", "a", "b", "c", "d", "e"))
    i = kinds.index(OWN)
    copies = np.unpackbits(np.frombuffer(e[i], np.uint8), count=len(own.ids)).astype(bool)
    rest = np.flatnonzero(~copies)
    data, _, offsets = own.joined(rest)
    starts, counts, which = np.frombuffer(a[i], np.int64), np.frombuffer(b[i], np.uint8).astype(np.int64), np.frombuffer(c[i], np.uint32).astype(np.int64)
    begins = dict(np.frombuffer(d[i], np.int64).reshape(2, -1).T.tolist())
    mask = np.zeros(int(which.max(initial=-1)) + 1, np.uint32)
    for k, kind in enumerate(kinds):
        if kind == MASK:
            mask[begins[ranges[k]] + np.frombuffer(a[k], np.uint32).astype(np.int64)] = np.frombuffer(b[k], np.uint32)
    go = np.zeros(len(data) + 1, np.int32)
    if len(starts):
        doc = own.ids[rest][np.searchsorted(offsets, starts, side="right") - 1]
        lead = np.full(len(mask), NULL_ID, np.int64)
        np.minimum.at(lead, which, doc)
        bits = np.where(doc > lead[which], np.uint32(0xFFFFFFFF), mask[which])
        for bit in range(RUN):
            at = starts[(bits >> np.uint32(bit) & 1 == 1) & (bit < counts)] + bit
            go[at] += 1  # a window starts at a byte once
    total = np.cumsum(go[:-1], dtype=np.int64)
    covered = total.copy()
    covered[LENGTH:] -= total[:-LENGTH]
    covered = covered > 0
    for k, row in enumerate(rest.tolist()):
        yield row, covered[offsets[k] : offsets[k + 1]]
    for row in np.flatnonzero(copies).tolist():
        n = len(own.texts[row])
        yield row, np.full(n, n >= LENGTH)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep_bytes: bool = True, carry: str | None = None) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): one a row of ``docs``; ``kept``, the remaining
    bytes, is null without ``keep_bytes``. The column named by ``carry`` comes along as ``row``. Blocks and ranges have the same
    size at any size of the corpus; a block sends a message to each range it has names for, so messages are never more than names. An empty table gives an empty result."""
    text = F.coalesce(F.encode(F.col(text_col).cast("string"), "utf-8"), F.lit(b""))
    common.modest_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    ranges = max(1, -(-total // (block_bytes * RANGE_BYTES // BLOCK_BYTES)))
    bits = min(64, max(40, total.bit_length() + 16))
    block = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(n_blocks)).alias("block")
    along = [F.col(carry).alias("row")] if carry else []
    blocks = docs.select(block, F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *along)

    def one(key, rows):  # noqa: ANN001, ANN202
        return name_messages(rows, key[0].as_py(), ranges, bits)

    def answer_one(key, rows):  # noqa: ANN001, ANN202
        return repeated_names(rows, key[0].as_py())

    def two(key, rows, answers):  # noqa: ANN001, ANN202
        return context_messages(rows, answers, key[0].as_py(), ranges, bits) if rows.num_rows else _messages([])

    def answer_two(key, rows):  # noqa: ANN001, ANN202
        return mask_messages(rows, key[0].as_py())

    def three(key, rows, answers):  # noqa: ANN001, ANN202
        own, found, places = Block(rows), [], []
        for i, gone in removed_bytes(own, answers):
            data, doc = own.texts[i], int(own.ids[i])
            spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
            found.append((None if doc == NULL_ID else doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            places.append(own.order[i])
        out = pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), RESULT, strict=True)], schema=RESULT)
        return out.append_column("row", rows.column("row").take(pa.array(places))) if carry else out

    result = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if carry:
        result = T.StructType([*result.fields, blocks.schema["row"]])
    by_block = blocks.groupBy("block")
    names = by_block.applyInArrow(one, MESSAGE).groupBy("range").applyInArrow(answer_one, MESSAGE)
    contexts = by_block.cogroup(names.groupBy("block")).applyInArrow(two, MESSAGE)
    masks = contexts.groupBy("range").applyInArrow(answer_two, MESSAGE)
    return by_block.cogroup(masks.groupBy("block")).applyInArrow(three, result)


def cut_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) with repeated strings cut out of ``text`` and ``n_chars``, if it is there,
    counted anew. Bytes of a character that was cut in part go too. A row of which nothing is left goes."""
    row = F.struct(*common.columns(docs, ("text",)), F.col("text").isNull().alias("_null of text"))
    found = deduplicate(docs.select(row.alias("row"), F.col("doc_id"), F.col("text")), carry="row")
    found = found.where("n_removed < n_bytes or n_removed = 0")

    def decode(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            text = [k.as_buffer().to_pybytes().decode("utf-8", "ignore") for k in batch.column("kept")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], names=["row", "text"])

    schema = T.StructType([found.schema["row"], T.StructField("text", T.StringType())])
    plain = found.select("row", "kept").mapInArrow(decode, schema)
    null = F.col("row")["_null of text"]
    named = {c: F.col("row")[c].alias(c) for c in docs.columns if c != "text"} | {"text": F.when(~null, F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        named["n_chars"] = F.when(null, F.col("row")["n_chars"]).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return plain.select(*[named[c] for c in docs.columns])


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


OP8_SQL = """
with n as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from n, unnest(range(greatest(n - 49, 0))) t(i)),
f as (select s, min(doc_id) as first from w group by s having min(doc_id) < max(doc_id)),
r as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as head from w join f using (s) where first < doc_id),
g as (select doc_id, i, sum(head) over (partition by doc_id order by i) as g from r),
spans as (select doc_id, g, min(i) as a, max(i) + 50 as b from g group by doc_id, g),
cuts as (select *, lag(b, 1, 0) over (partition by doc_id order by a) as p from spans),
kept as (select c.doc_id, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as k from cuts c join n using (doc_id) group by c.doc_id)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from n left join kept using (doc_id)
"""
