"""Steps whose work must not grow faster than their tables."""

import math
from collections import Counter

import pytest


def _plan(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    texts = ["a a b c", "a b  d", None, "", "c q q r", "a a a", "z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), texts


@pytest.mark.parametrize("frequent", [1, 3, 1 << 16])
def test_sequence_scores_are_worked_out_once(spark, tables, monkeypatch, frequent):
    from poolsieve.plans import providers

    monkeypatch.setattr(providers, "FREQUENT", frequent, raising=False)
    d, texts = tables
    got = providers.seq_scores(spark, d)
    assert "Exchange" not in _plan(got) and "Generate" not in _plan(got)
    total = Counter(w for t in texts for w in (t or "").split())
    n = sum(total.values())
    want = {i: round(sum(math.log(total[w] / n) for w in t.split()) / len(t.split()), 6) for i, t in enumerate(texts) if t and t.split() and i != 5}
    assert {r[0]: r[1] for r in got.collect()} == pytest.approx(want, abs=2e-6)


def test_grams_of_a_text_are_counted_where_it_is_read(spark):
    from pyspark.sql import functions as F

    from poolsieve.functions.text import tokens
    from poolsieve.operators.overlap import gram_counts, gram_totals

    rows = [(1, "a b a b a"), (2, None), (3, ""), (4, "x"), (5, "p q"), (5, "q p q"), (None, "n o"), (None, "n o")]
    one, all_ = (spark.createDataFrame(r, "id long, text string") for r in (rows[:5], rows))
    assert "Exchange" not in _plan(gram_totals(one, "id", tokens(F.col("text"))))
    plain = gram_counts(all_, "id", tokens(F.col("text"))).groupBy("n", "i").agg(F.sum("c").alias("total"), F.count("*").alias("different"))
    key = lambda r: (r[0], -1 if r[1] is None else r[1])
    assert sorted(map(tuple, gram_totals(all_, "id", tokens(F.col("text"))).collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_bleu_shuffles_texts_and_not_grams(spark):
    from poolsieve.operators.overlap import corpus_bleu, group_bleu

    df = spark.createDataFrame([(1, ["a b c d", "a b c e", None]), (2, ["x", "y x", ""])], "id long, g array<string>")
    plan = _plan(group_bleu(df, "id", "g"))
    assert plan.count("Exchange hashpartitioning") == 1
    pairs = spark.createDataFrame([(1, "a b c d e", "a b c d f"), (1, "a b c d", "g"), (2, "x y", None), (None, "a b c d", "a b c d")], "id long, p string, q string")
    # id 1 has two rows, whose grams count together; a null id matches nothing
    assert corpus_bleu(pairs, "id", "p", "q") == pytest.approx(100 * min(1, math.exp(1 - 10 / 15)) * (4 / 15 * 3 / 11 * 2 / 7 * 1 / 4) ** 0.25)


@pytest.mark.parametrize("measure", ["dot", "cosine", "euclid"])
def test_rows_are_copied_by_regions_not_by_cells(spark, monkeypatch, measure):
    import numpy as np

    from poolsieve.operators import topk

    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "CELL", 8)
    monkeypatch.setattr(topk, "TILE", 640)
    x = np.random.default_rng(1).normal(size=(300, 12))
    x[40:60] = x[40]  # equal rows: ties go to smaller ids
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    report = {}
    got = {r["id"]: [n["other"] for n in r["near"]] for r in topk.nearest(df, df, "id", "v", 3, measure, report).collect()}
    # 38 cells, all of which most rows meet, are 5 regions or a few more
    assert report["copies"] <= 10 * len(x)
    y = x / np.linalg.norm(x, axis=1)[:, None] if measure == "cosine" else x
    sim = np.round(-((y[:, None] - y[None]) ** 2).sum(2) if measure == "euclid" else y @ y.T, 9)
    assert got == {i: np.argsort(-sim[i], kind="stable")[:3].tolist() for i in range(300)}


def test_all_pairs_are_not_shuffled(spark):
    from poolsieve.operators.neighbours import similarities

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0]), (3, None)], "id long, v array<double>")
    got = similarities(df, df, "id", "v", "dot")
    # both sides are dealt to their blocks; nothing comes after these
    assert _plan(got).count("Exchange") == 2 and "Aggregate" not in _plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 5.0), (1, 2, 2.0), (2, 1, 2.0), (2, 2, 1.0)]


@pytest.mark.parametrize("measure", ["dot", "cosine", "euclid"])
def test_all_pairs_copy_no_vector_to_blocks(spark, monkeypatch, measure):
    """Blocks and parts of few rows, rows without a vector, a side without rows."""
    import numpy as np

    from poolsieve.operators import topk

    for name, value in {"PAIRED": 4, "PART": 2, "TASKS": 2}.items():
        monkeypatch.setattr(topk, name, value, raising=False)
    x = np.random.default_rng(5).normal(size=(70, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = topk.pairs(df, df.where("id < 30"), "id", "v", measure)
    # a vector lies in one part: nothing is exploded to the blocks that it meets
    assert "Generate" not in _plan(got) and "CartesianProduct" in _plan(got)
    y = x / np.linalg.norm(x, axis=1)[:, None] if measure == "cosine" else x
    sim = -((y[:, None] - y[None]) ** 2).sum(2) if measure == "euclid" else y @ y.T
    found = [((r["id"], r["other"]), r["sim"]) for r in got.collect()]
    assert len(found) == 70 * 30 and dict(found) == pytest.approx({(i, j): sim[i, j] for i in range(70) for j in range(30)})
    assert topk.pairs(df, df.where("id = 99"), "id", "v", measure).count() == 0


def test_conll_files_hold_bounded_numbers_of_records(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from poolsieve.plans import source_queries

    monkeypatch.setattr(source_queries, "RECORDS", 2, raising=False)
    monkeypatch.setattr(source_queries, "_path", lambda *_: f"{tmp_path}/conll")
    rows = [(i, 0, "user", "a bb ccc"[: i + 2]) for i in range(7)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = source_queries.source_conll(spark, str(tmp_path))
    assert max(p.read_text().count("-DOCSTART-") for p in Path(f"{tmp_path}/conll").glob("part*")) == 2
    assert got.count() == sum(len(r[3].split()) for r in rows)


def test_language_fit_holds_its_sample_once(monkeypatch):
    import tracemalloc

    import numpy as np

    from poolsieve.llm import langid

    x = np.random.default_rng(0).random((200, 4096), dtype=np.float32)
    tracemalloc.start()
    langid.fit(x, [("a", "b", "c")[i % 3] for i in range(200)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes


@pytest.mark.parametrize(("n", "bound"), [(1, 0.3), (2, 0.3), (2, 0.5), (2, 1.0)])
def test_texts_that_share_grams_meet_in_classes(spark, monkeypatch, n, bound):
    """Levels, classes in blocks and regions of few texts, copies, a hot gram, texts without a gram, against all pairs."""
    import numpy as np
    from pyspark.sql import functions as F

    from poolsieve.functions.text import tokens
    from poolsieve.operators import overlap, shared

    for name, value in {"SIZE": 3, "BLOCK": 40, "TILE": 64, "SLICE": 16, "REGION": 4, "SENT": 20}.items():
        monkeypatch.setattr(shared, name, value)
    rng = np.random.default_rng(8)
    texts = ["hot " * int(rng.integers(0, 4)) + " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 40) ** 2 // 20)) for _ in range(40)]
    texts += [t[: len(t) // 2] for t in texts[:8]] + texts[:5] + texts[:3] + [t + " new words" for t in texts[8:20]] + [None, "", "hot", "hot hot hot hot hot"]
    df = spark.createDataFrame([(i * 7 % 101, t) for i, t in enumerate(texts)], "id long, t string")
    g = overlap.gram_counts(df, "id", tokens(F.col("t")), (n,))
    want = {(r["i"], r["j"]): (r["common"], round(r["f1"], 9)) for r in overlap.pairs_above(g, g, bound).where("i < j").collect()}
    got = [((r["i"], r["j"]), (r["common"], round(r["f1"], 9))) for r in shared.texts_above(df, "id", tokens(F.col("t")), n, bound).collect()]
    assert dict(got) == want and len(got) == len(want) > 10


def test_pairs_above_have_no_row_a_gram(spark, tmp_path):
    import __spark_entry__ as e

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:i] + ["x"] + words[i + 1 :]) for i in range(12)] + [" ".join(words)] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = e.queries()["pairwise_rouge_above"](spark, str(tmp_path))
    # texts are shuffled, their grams are not
    assert "Generate" not in _plan(got)
    assert got.count() == 14 * 13 // 2 and got.where("i = 12 and j = 13").first()["common"] == 59


@pytest.mark.parametrize("block", [60, 1 << 20])
def test_texts_lie_in_blocks_once(spark, monkeypatch, block):
    """What is written has each different text once, however many blocks meet; copies beyond a part of them; equal sizes on both sides of a bound."""
    from itertools import combinations

    import numpy as np
    from pyspark.sql import functions as F

    from poolsieve.functions.text import tokens
    from poolsieve.operators import shared

    for name, value in {"SIZE": 3, "BLOCK": block, "REGION": 3, "RUN": 2, "ROWS": 7, "MANY": 1}.items():
        monkeypatch.setattr(shared, name, value, raising=False)
    written = []
    monkeypatch.setattr(shared, "kept", lambda df, keep=shared.kept: written.append(keep(df)) or written[-1])
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(list("abcdefghijklmnop"), 12)) for _ in range(8)]
    texts = base + [t[:-2] + " zz" for t in base] + [t + " z z" for t in base[:4]] + base[:2] * 4 + [base[0]] * 5
    df = spark.createDataFrame([(i * 11 % 997, t) for i, t in enumerate(texts)], "id long, t string").repartition(5)
    got = shared.texts_above(df, "id", tokens(F.col("t")), 1, 0.5)
    assert "CartesianProduct" in _plan(got)
    counts = [Counter(t.split()) for t in texts]
    size = [sum(c.values()) for c in counts]
    want = {}
    for i, j in combinations(range(len(texts)), 2):
        common = sum((counts[i] & counts[j]).values())
        if 2 * common / (size[i] + size[j]) >= 0.5:
            want[tuple(sorted((i * 11 % 997, j * 11 % 997)))] = common
    found = [((r["i"], r["j"]), r["common"]) for r in got.collect()]
    assert len(found) == len(want) and dict(found) == want
    blocks = [f for f in written if "e" in f.columns]
    assert len(blocks) == 1 and (blocks[0].count() > 2) == (block == 60)
    assert blocks[0].select(F.sum(F.length("e"))).first()[0] == 8 * sum(len(t.split()) for t in set(texts))


def test_average_linkage_keeps_a_row_a_cluster_and_block(spark, monkeypatch):
    """Rows about one centre, whose averages no bound tells apart, and groups larger than a block, against one merge at a time."""
    import numpy as np

    from poolsieve.operators import linkage

    from .test_greedy import linked

    for name, value in {"FEW": 14, "BLOCK": 8, "CHUNK": 3, "SPREAD": 2}.items():
        monkeypatch.setattr(linkage, name, value, raising=False)
    written = []
    monkeypatch.setattr(linkage, "kept", lambda df, keep=linkage.kept: written.append(keep(df)) or written[-1])
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 12)), rng.normal(size=(30, 12)) * 0.01 + 9])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in linkage.average_linkage(df, 5, "id", "v").collect()}
    assert got == linked(x, 5, "euclidean")
    # 90 rows lie in 3 blocks; a cluster has a nearest in each, and those beyond a block have their sums with all others
    assert max(f.count() for f in written) <= 90 * 8
