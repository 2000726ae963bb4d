from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsieve.functions import proba, text, vector
from poolsieve.operators import acquire, analytics, metrics, overlap


def one(spark, **cols):
    df = spark.range(1)
    return df.select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def arr(xs):
    return F.array(*[arr(x) if isinstance(x, list) else F.lit(x) for x in xs])


def test_probability_scores(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(4), 5)
    c, m = arr(p.tolist()), p.mean(0)
    ent = lambda x: float(-(x * np.log(np.clip(x, 1e-8, 1))).sum())
    got = one(spark, a=proba.mean_entropy(c), b=proba.bald(c), c=proba.variance(c), d=proba.sampled_max(c), e=proba.variation_ratio(c), f=proba.mnlp(c), g=proba.margin(arr(p[0].tolist())), h=proba.entropy(arr([0.0, 1.0])))
    votes = np.bincount(p.argmax(1), minlength=4).max()
    want = {"a": ent(m), "b": ent(m) - np.mean([ent(x) for x in p]), "c": p.var(0).sum(), "d": 1 - m.max(), "e": 1 - votes / 5, "f": -np.log(p.max(1)).mean(), "g": 1 + np.sort(p[0])[-2] - p[0].max(), "h": 0.0}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


def test_softmax_and_smoothing(spark):
    got = one(spark, s=proba.softmax(arr([1000.0, 1000.0])), t=proba.smoothed(arr([0.2, 0.5, 0.3]), 0.8), u=proba.smoothed(arr([0.2, 0.5, 0.3]), False), v=proba.one_hot(F.lit(1), 3))
    assert got["s"] == [0.5, 0.5]
    assert got["t"] == pytest.approx([0.1, 0.8, 0.1])
    assert got["u"] == 1 and got["v"] == [0.0, 1.0, 0.0]


def test_vectors(spark):
    a, b = arr([3.0, 4.0]), arr([4.0, 3.0])
    got = one(spark, d=vector.dot(a, b), c=vector.cosine(a, b), s=vector.squared_distance(a, b), n=vector.normalised(a), q=vector.quadratic(a, [[2, 0], [0, 1]]))
    assert got["d"] == 24 and got["c"] == pytest.approx(0.96) and got["s"] == 2 and got["n"] == pytest.approx([0.6, 0.8]) and got["q"] == 34


def test_words_and_ngrams(spark):
    got = one(spark, w=text.words(F.lit("It's a\n Test,  a test!")), e=text.words(F.lit("")), g=text.ngrams(arr(["a", "b", "c"]), 2), h=text.ngrams(arr(["a"]), 2))
    assert got["w"] == ["its", "a", "test", "a", "test"] and got["e"] == [] and got["g"] == ["a b", "b c"] and got["h"] == []


def test_novelty(spark):
    s, t = arr(["a", "b", "x", "a", "b"]), arr(["a", "b", "c"])
    got = one(spark, n1=text.novel_share(s, t, 1), n2=text.novel_share(s, t, 2), u2=text.uncopied_share(s, t, 2), none=text.novel_share(arr(["a"]), t, 2))
    assert got["n1"] == pytest.approx(0.2) and got["n2"] == pytest.approx(0.5) and got["u2"] == pytest.approx(0.2) and got["none"] is None


def test_label_alignment(spark):
    ids = F.array(F.lit(None).cast("int"), F.lit(0), F.lit(0), F.lit(1), F.lit(None).cast("int"))
    labels = arr([3, 0])
    got = one(spark, a=text.align_labels(labels, ids), b=text.align_labels(labels, ids, "repeat"), c=text.align_labels(labels, ids, "inside"), f=text.first_subtokens(ids))
    assert got["a"] == [-100, 3, -100, 0, -100] and got["b"] == [-100, 3, 3, 0, -100] and got["c"] == [-100, 3, 4, 0, -100] and got["f"] == [1, 3]


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "conditional": "condit", "hopping": "hop", "happy": "happi", "agreed": "agre", "electricity": "electr", "controlling": "control", "adjustment": "adjust"}
    assert {w: text.porter(w) for w in pairs} == pairs


def test_lcs_against_table():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = (list(map(str, rng.integers(0, 4, rng.integers(0, 12)))) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert text._lcs(a, b) == t[-1, -1]


def plain_bleu(hyp, ref):
    a, b = hyp.split(), ref.split()
    matches, possible = [], []
    for n in range(1, 5):
        x, y = (Counter(zip(*[t[i:] for i in range(n)], strict=False)) for t in (a, b))
        matches.append(sum((x & y).values()))
        possible.append(max(0, len(a) - n + 1))
    return overlap.bleu(matches, possible, len(a), len(b), smooth=True)


def test_bleu(spark):
    rng = np.random.default_rng(3)
    some = lambda n: " ".join(rng.choice(["a", "b", "c", "d", "e"], n))
    groups = [(i, [some(rng.integers(0, 9)) for _ in range(4)]) for i in range(12)]
    groups += [(100, ["a b c d e", "a b c d e", "z"]), (101, ["x"]), (102, []), (103, ["", " ", "CLS"]), (104, [None, "a b", "a c"]), (105, ["a " * 3000, "a b " * 2000]), (106, None)]
    df = spark.createDataFrame(groups, "id long, g array<string>")
    got = {(r["id"], r["i"], r["j"]): r["bleu"] for r in overlap.group_bleu(df, "id", "g").collect()}
    for i, g in groups:
        for p in range(len(g or [])):
            for q in range(len(g)):
                if p != q and g[p] is not None and g[q] is not None:
                    assert got.get((i, p, q), 0) == pytest.approx(plain_bleu(g[p], g[q])), (g[p], g[q])
    assert got[100, 0, 1] == pytest.approx(100) and (100, 0, 2) not in got
    scores = {r["id"]: r["score"] for r in acquire.bleu_variance(df, "g", "id").collect()}
    for i, g in groups:
        known = [t if t.strip() else "CLS" for t in g or [] if t is not None]
        pairs = [(1 - round(plain_bleu(a, b), 4) / 100) ** 2 for m, a in enumerate(known) for n, b in enumerate(known) if m != n]
        assert scores[i] == (pytest.approx(np.mean(pairs), abs=1e-9) if pairs else None)


def table_matches(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = set(), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_subsequence_by_bits_equals_the_table():
    rng = np.random.default_rng(4)
    for size in (0, 1, 5, 40, 150):
        for _ in range(8):
            a, b = (rng.integers(0, rng.choice([2, 5, 30]), rng.integers(0, size + 1)).tolist() for _ in range(2))
            assert overlap._matches(a, b) == table_matches(a, b)
    assert overlap._lsum("a b\nc d", "c d\na b") == pytest.approx(1)
    assert overlap._lsum(None, "a") == 0


@pytest.mark.parametrize("bound", [0.3, 0.5, 1.0])
def test_pairs_above_a_bound_are_those_of_all_pairs(spark, bound):
    """A gram that all texts have, copies, texts without a gram, repeated grams."""
    rng = np.random.default_rng(5)
    texts = ["hot " * int(rng.integers(0, 3)) + " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 9))) for _ in range(50)]
    texts += texts[:5] + ["", "hot", "hot hot hot hot"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    g = overlap.gram_counts(df, "id", text.tokens(F.col("t")))
    every = overlap.pair_overlap(g, g).select("n", "i", "j", "common", "recall", "precision").collect()
    want = {(r["n"], r["i"], r["j"]): r["common"] for r in every if 2 / (1 / r["recall"] + 1 / r["precision"]) >= bound - 1e-12}
    got = {(r["n"], r["i"], r["j"]): r["common"] for r in overlap.pairs_above(g, g, bound).collect()}
    assert got == want and len(want) > 50
    assert overlap.pairs_above(g, g.limit(0), bound).count() == 0


def test_entity_spans(spark):
    df = spark.createDataFrame([(1, ["B-X", "I-X", "O", "I-Y", "B-Y"], ["B-X", "I-X", "O", "O", "B-Y"])], "id long, l array<string>, p array<string>")
    got = {r["type"]: (r["precision"], r["recall"], r["support"]) for r in metrics.entity_f1(df, "id", "l", "p").collect()}
    assert got["X"] == (1, 1, 1) and got["Y"] == (1, 0.5, 2) and got["overall"][1] == pytest.approx(2 / 3)


def test_classification(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    got = metrics.classification(df, "y", "p").first()
    assert got["accuracy"] == 0.5 and got["f1_macro"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_t_quantile_and_bands(spark):
    assert analytics.t_quantile(0.975, 9) == pytest.approx(2.262157163)
    assert analytics.t_quantile(0.975, 2) == pytest.approx(4.302652730)
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    got = {r["k"]: r for r in analytics.bands(df, ["k"], "v").collect()}
    assert got["a"]["mean"] == 2 and got["a"]["high"] == pytest.approx(2 + 4.302652730 * 2**0.5 / 2**0.5)
    assert got["b"]["std"] is None and got["b"]["low"] is None
