"""Operators 11 to 13 against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from poolsieve.llm import audit, harmonic, ranking

LINES = "a long, b long, s long, t long, x long, y long, more string"


def ranked(rows, k):
    """Group (a, b), score (s larger first, t smaller first), then x, y; nulls last."""
    last = lambda v, sign=1: (v is None, 0 if v is None else sign * v)
    groups = defaultdict(list)
    for a, b, s, t, x, y, _ in rows:
        groups[a, b].append((s, t, x, y))
    out = []
    for (a, b), lines in groups.items():
        lines.sort(key=lambda r: (last(r[0], -1), last(r[1]), last(r[2]), last(r[3])))
        tied = Counter(r[:2] for r in lines)
        places = {score: i for i, score in enumerate(dict.fromkeys(r[:2] for r in lines), 1)}
        out += [(a, b, *r, pos, places[r[:2]], tied[r[:2]]) for pos, r in enumerate(lines, 1) if places[r[:2]] <= k]
    return sorted(out, key=repr)


def spark_ranked(spark, rows, k):
    df = spark.createDataFrame(rows, LINES)
    out = ranking.rank_ties(df, ["a", "b"], [("s", True), ("t", False)], ["x", "y"], k)
    assert out.columns == ["a", "b", "s", "t", "x", "y", "pos", "place", "tied"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def some_lines(seed, n=400):
    r = random.Random(seed)
    draw = lambda *values: r.choice([*values, None])
    rows = [(draw(1, 1, 1, -5), draw(0, 1), draw(*range(-3, 9)), draw(0, 7, 9, 200), draw(*range(40)), draw(1, 2), "z") for _ in range(n)]
    return rows + rows[:30]


@pytest.mark.parametrize("bucket", [1 << 14, 8])
def test_ranks_equal_a_plain_sort(spark, monkeypatch, bucket):
    """With small buckets, short digits and few copies a row: scores are refined, and lines of a score too."""
    monkeypatch.setattr(ranking, "BUCKET", bucket)
    if bucket == 8:
        monkeypatch.setattr(ranking, "DIGIT", 5)
        monkeypatch.setattr(ranking, "COPIES", 4)
    rows = some_lines(bucket)
    rows += [(7, 7, 1, 1, 3, 3, "")] * 50  # equal lines, more than a bucket
    assert spark_ranked(spark, rows, 3) == ranked(rows, 3)


def test_ranks_of_wide_columns_and_edges(spark):
    big = 2**63 - 1
    rows = [(big, -big, big, 1, 5, None, ""), (big, -big, -big, 2, 5, 1, ""), (big, -big, big, 2, -big, 1, ""), (None, None, None, None, None, None, None)]
    rows += [(-big - 1, 0, -big - 1, 0, 0, 0, ""), (-big - 1, 0, big, 0, 0, 0, "")]
    assert spark_ranked(spark, rows, 2) == ranked(rows, 2)
    assert spark_ranked(spark, [(None,) * 7] * 3, 2) == ranked([(None,) * 7] * 3, 2)
    assert spark_ranked(spark, rows, 0) == []
    assert spark_ranked(spark, [], 5) == []
    with pytest.raises(ValueError):
        ranking.rank_ties(spark.createDataFrame(rows, LINES).withColumnRenamed("x", "pos"), ["a"], [("s", True)], ["pos"], 1)


def test_numpy_radix_order_is_stable():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 5, 500), r.integers(0, 2**61, 500)
    b[:200] = b[200:400]
    assert (ranking.radix_order([a, b]) == np.lexsort((np.arange(500), b, a))).all()
    assert len(ranking.radix_order([a[:0]])) == 0


DOCS = "doc_id long, text string, lang string, n string"
LABELS = "doc_id long, quality int, toxic int"


def plain_audit(docs, labels):
    space = " \t\n\x0b\x0c\r"
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang, _ in docs:
        text = text or ""
        words = "".join(" " if c in space else c for c in text).split(" ")
        words = [w for w in words if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                 "D": any(c in "#$%&*|" for c in text), "E": i is not None and least[text] < i}
        parts[lang or ""].append((fails, any(d == i is not None and q == 1 for d, q, _ in labels), any(d == i is not None and t == 1 for d, _, t in labels)))
    out = []
    for part, of in parts.items():
        shapley, rows = Counter(), []
        for order in permutations("ABCDE"):
            left = of
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[0][x]]
                left = [d for d in left if not d[0][x]]
                shapley[x] += len(gone)
                rows.append((x, (part, "".join(order), step, len(left), len(gone), sum(d[0][x] for d in of) - len(gone), sum(d[0][x] and sum(d[0].values()) == 1 for d in of), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out += [(*row, shapley[x]) for x, row in rows]
    return sorted(out)


def test_audit_equals_filters_in_every_order(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    texts = [None, "", " \t", "x#", "AB cd", "ABCDEFGHIJ é", "ünï\x1ccode #", "a" * 50_000]
    texts += [" ".join(word(r.choice((1, 3, 6))) for _ in range(n)) + r.choice(("", "|", "SHOUT" * 30)) for n in (60, 99, 100, 101, 140) for _ in range(6)]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, ""]), "n") for i in range(120)]
    docs += [(3, docs[3][1], "en", ""), docs[5], docs[5], (None, docs[7][1], "de", ""), (None, "", None, ""), (None, "", "fr", "")]
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1, None))) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1), (4, 1, 0), (999, 1, 1)]
    got = audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)
    assert audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0


def test_removal_polynomial():
    counts = {0: 4, 1: 2, 3: 5, 6: 7, 7: 1}
    p = audit.Polynomial(counts, 3)
    removed = lambda s: sum(n for m, n in counts.items() if m & s)
    assert [p.corner(s) for s in range(8)] == [removed(s) for s in range(8)]
    by_orders = [Fraction(sum(removed(sum(1 << j for j in o[: o.index(i) + 1])) - removed(sum(1 << j for j in o[: o.index(i)])) for o in permutations(range(3))), math.factorial(3)) for i in range(3)]
    assert [p.shapley(i) for i in range(3)] == by_orders


TEXTS = ["", None, "a", "Don't STOP'S we'LL 'tis it''s 12345 a_b--c!?", "Straße ÉCOLE naïve œuvre", "İstanbul ΣΑΣ ŉ ½ x² é 你好 \U0001f600", "<|startoftext|> <|endoftext|>",
         "\x00\x1c\x85\xa0  z", "w" * 5000, "ab cd " * 60_000, "é" * 70_000]


def library_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(harmonic.default_vocabulary())
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, harmonic.END_ID]


def test_ids_equal_the_library(monkeypatch):
    monkeypatch.setattr(harmonic, "RUN", 1000)
    encoder = harmonic.Encoder(harmonic.default_vocabulary())
    for text in TEXTS:
        assert np.frombuffer(encoder(text or ""), "<u4").tolist() == library_ids(text)[:-1], text


@pytest.mark.parametrize("capacity", [1, 64, 4096])
def test_pieces_cover_each_id_once_with_little_padding(spark, capacity):
    r = random.Random(capacity)
    texts = TEXTS[:9] + [" ".join(r.choice(("the", "cat", "xyzzy", "of", "7")) for _ in range(r.randrange(1, 400))) for _ in range(60)]
    texts += texts[-3:]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, start long").repartition(3, "doc_id")
    out = harmonic.pack_documents(docs, capacity=capacity)
    assert out.columns == list(harmonic.COLUMNS)
    rows = out.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x["doc_id"]].append(x)
        by_sequence[x["sequence_id"]].append(x)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids, at = np.array(library_ids(text), "<u4"), 0
        for x in sorted(by_doc[i], key=lambda x: x["start"]):
            assert (x["start"], x["doc_tokens"]) == (at, len(ids)) and x["length"] > 0
            assert x["ids_crc32"] == zlib.crc32(ids[at : at + x["length"]].tobytes())
            at += x["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= capacity
    done = harmonic.padding(out, capacity).first()
    assert done["tokens"] == sum(x["length"] for x in rows) and done["sequences"] == len(by_sequence)
    assert done["padded"] <= 0.05 * done["tokens"]


def test_class_sequences_hold_a_fixed_number():
    """Full sequences of a class hold j pieces; pieces lie within the slack below the class's longest length."""
    shelf, done = harmonic.Shelf(4096, 0), []
    for doc, n in enumerate([4095, 2048, 1500, 3000, 700, 1, 50, 2048] * 40):
        at = 0
        for m in harmonic.cut_lengths(n):
            j = 4096 // m
            assert m >= (1 - harmonic.SLACK) * (4096 // j)
            rows = list(shelf.put(doc, n, at, memoryview(bytes(4 * m))))
            assert len(rows) in (0, j)
            done += rows
            at += m
        assert at == n
    assert len(done) > 300 and all(len(p) < j for j, p in shelf.open.items())
    left = sum(len(p[3]) // 4 for of in shelf.open.values() for p in of)
    closed = list(shelf.close())
    fills = Counter()
    for row in closed:
        fills[row[5]] += row[2]
    assert sum(fills.values()) == left and all(n & (n - 1) == 0 for n in fills.values())
    assert harmonic.cut_lengths(0) == [] and harmonic.cut_lengths(8192) == [4096, 4096]


def test_packing_of_no_documents(spark):
    assert harmonic.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        harmonic.pack_documents(spark.createDataFrame([], "doc_id long, text string"), capacity=100)
