"""Plain versions of the operators, over Python values."""

import collections
import hashlib
import re

import numpy as np
import xxhash


def repeated_bytes(docs, length=50):
    """{row: which bytes go} for (id, text) rows; null ids are largest."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    first, out = {}, {}
    data = [(docs[i][1] or "").encode() for i in range(len(docs))]
    key = lambda i: (docs[i][0] is None, docs[i][0] or 0)
    for i in order:
        for at in range(len(data[i]) - length + 1):
            first.setdefault(data[i][at : at + length], key(i))
    for i in order:
        gone = np.zeros(len(data[i]), bool)
        for at in range(len(data[i]) - length + 1):
            if first[data[i][at : at + length]] < key(i):
                gone[at : at + length] = True
        out[i] = gone
    return out


def near_classes(docs, threshold=0.8):
    """[class id] of (id, text) rows by exact weighted Jaccard; ids differ and are not null."""
    low = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words = [re.findall(rb"[^\x20\x09-\x0D]+", low((t or "").encode())) for _, t in docs]
    df = collections.Counter(w for x in words for w in set(x))
    idf = {w: 1 + np.log((len(docs) + 1) / (c + 1)) for w, c in df.items()}
    bags = []
    for x in words:
        grams = [tuple(x[i : i + 5]) for i in range(len(x) - 4)] if len(x) >= 5 else [tuple(x)] if x else []
        bags.append({g: c * np.mean([idf[w] for w in g]) for g, c in collections.Counter(grams).items()})
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            shared = sum(min(v, bags[b][g]) for g, v in bags[a].items() if g in bags[b])
            total = sum(bags[a].values()) + sum(bags[b].values()) - shared
            if (docs[a][1] or "") == (docs[b][1] or "") or (shared and shared / total >= threshold):
                x, y = find(docs[a][0]), find(docs[b][0])
                root[max(x, y)] = min(x, y)
    return [find(i) for i, _ in docs]


def vector_links(rows, threshold=0.9):
    """{id: (links, component)} of (id, vector) rows."""
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    link = collections.defaultdict(int)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(fine)):
        for b in range(a):
            (i, x), (j, y) = fine[a], fine[b]
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                link[i] += 1
                link[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (link[i], find(i)) for i, _ in rows}


def sha(x):
    return hashlib.sha256(x).hexdigest()


def unit_flow(patterns, quotas, most=3):
    """(value, cost) of the cheapest largest flow, a unit at a time along a cheapest path."""
    names, p = list(quotas), len(patterns)
    arcs = []  # from, to, room, cost, number of the reverse arc

    def arc(a, b, room, cost):
        arcs.append([a, b, room, cost, len(arcs) + 1])
        arcs.append([b, a, 0, -cost, len(arcs) - 1])

    for i, (members, size) in enumerate(patterns):
        for c in range(1, most + 1):
            arc("s", i, size, c)
        for m in members:
            arc(i, ("q", m), 10**9, 0)
    for m in names:
        arc(("q", m), "t", round(quotas[m]), 0)
    value = cost = 0
    while True:
        far, by = {"s": 0}, {}
        for _ in range(p + len(names) + 2):
            for k, (a, b, room, c, _) in enumerate(arcs):
                if room and a in far and far[a] + c < far.get(b, 10**9):
                    far[b], by[b] = far[a] + c, k
        if "t" not in far:
            return value, cost
        at = "t"
        while at != "s":
            a = arcs[by[at]]
            a[2] -= 1
            arcs[a[4]][2] += 1
            at = a[0]
        value, cost = value + 1, cost + far["t"]


def mixed(docs, most=3):
    """Sorted (id, size, source size, target, taken) of (id, text, source) rows, sources of a document each its own."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    names = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    of = {s: sum(z for z, d in zip(size, docs, strict=True) if d[2] == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, list(names), float(sum(size))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > most * of[s]]
        target |= {s: most * of[s] for s in full} if full else share
        free, left = [s for s in free if s not in full] if full else [], left - sum(most * of[s] for s in full)
    # Spark's hash of several columns: each is hashed with the hash before it as the seed
    mark = lambda i: xxhash.xxh64_intdigest((20).to_bytes(4, "little"), xxhash.xxh64_intdigest(str(i).encode(), 42))
    out = []
    for s in names:
        copies, rest = divmod(min(round(target[s]), most * of[s]), of[s]) if of[s] else (0, 0)
        at = 0
        for k in sorted((k for k in range(len(docs)) if docs[k][2] == s), key=lambda k: (mark(docs[k][0]), docs[k][0], size[k])):
            more = at < rest and at + size[k] / 2 <= rest
            out.append((docs[k][0], size[k], of[s], round(float(target[s]), 6), (copies + more) * size[k]))
            at += size[k]
    return sorted(out)


def best_fit(sizes, capacity):
    """Number of bins of best fit, longest first."""
    rooms = []
    for n in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return len(rooms)


def fewest_bins(sizes, capacity):
    """The least number of bins, by trying all."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= sizes[i]}):
            rest = list(rooms)
            rest[rest.index(room)] -= sizes[i]
            put(i + 1, rest)
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best[0]
