import json

import pytest
from pyspark.sql import functions as F

from poolsieve.operators import analytics, corpus, pseudo, rows
from poolsieve.plans.loop import STRATEGIES, PoolState, Spec, adaptive, epochs_and_batch, fan_out, named_strategy, resume, run, strategy_name, train_constants
from poolsieve.sources import readers


def test_conll(spark, tmp_path):
    p = tmp_path / "train.txt"
    p.write_text("-DOCSTART- O\n\nEU B-ORG\nrejects O\n\nPeter B-PER\nB I-PER\n\n\n")
    got = readers.conll(spark, str(p)).orderBy("sentence").collect()
    assert [r["tokens"] for r in got] == [["EU", "rejects"], ["Peter", "B"]]
    assert [r["tags"] for r in got] == [["B-ORG", "O"], ["B-PER", "I-PER"]]
    ids = {r["tag"]: r["tag_id"] for r in readers.tag_ids(readers.conll(spark, str(p))).collect()}
    assert ids == {"O": 0, "B-ORG": 1, "B-PER": 2, "I-PER": 3}
    assert sorted(r["text"] for r in readers.plain_sentences(spark, str(p)).collect()) == ["EU rejects", "Peter B"]


def test_folders(spark, tmp_path):
    for c in ("bad", "good"):
        (tmp_path / c).mkdir()
        for i in range(5):
            (tmp_path / c / f"{i}.txt").write_text(f"{c} {i}")
    train, dev, test = readers.folders(spark, str(tmp_path))
    assert train.count() == 8 and test.count() == 2
    assert {(r["label_name"], r["label"]) for r in train.union(test).collect()} == {("bad", 0), ("good", 1)}


def test_records_and_vectors(spark, tmp_path):
    p = tmp_path / "x.list.json"
    p.write_text(json.dumps([{"_text": ["a", "b"], "sum": "s", "id": 1}, {"_text": ["c"], "sum": "t", "id": 2}]))
    got = readers.records(spark, str(p), "text", "sum", "id").orderBy("id").collect()
    assert [r["text"] for r in got] == ["a\nb", "c"]
    v = tmp_path / "v.vec"
    v.write_text("2 3\na 1 2 3\nb 3 4 5\n")
    vectors = readers.word_vectors(spark, str(v))
    vocab = spark.createDataFrame([("a", 1), ("zz", 2)], "token string, token_id long")
    got = {r["token"]: r["vector"] for r in readers.embedding_table(vectors, vocab).collect()}
    assert got["a"] == [1, 2, 3] and got["[PAD]"] == [0, 0, 0] and all(-0.1 <= x <= 0.1 for x in got["zz"])
    assert got["[UNK]"] == pytest.approx([(x + y) / 2 for x, y in zip(got["a"], got["zz"], strict=True)])


def test_blocks_drop_the_rest(spark):
    docs = spark.createDataFrame([(i, [f"{i}.{k}" for k in range(i)]) for i in range(7)], "id long, t array<string>")
    got = {r["block"]: r["tokens"] for r in corpus.blocks(docs, "id", F.col("t"), 4).collect()}
    flat = [f"{i}.{k}" for i in range(7) for k in range(i)]
    assert got == {b: flat[4 * b : 4 * b + 4] for b in range(len(flat) // 4)}


def test_masks(spark):
    docs = spark.createDataFrame([(1, list(range(1000)))], "id long, t array<long>")
    r = corpus.masked(docs, "id", F.col("t"), 50, -1, 3).first()
    chosen = [i for i, t in enumerate(r["targets"]) if t != -100]
    assert 100 < len(chosen) < 200 and all(r["targets"][i] == i for i in chosen)
    assert all(r["inputs"][i] == i for i in range(1000) if i not in set(chosen))


def test_pseudo_labels(spark):
    t = spark.createDataFrame([(i, i / 10, f"g{i}") for i in range(10)], "id long, s double, g string")
    keep = lambda *a, **k: sorted(r["id"] for r in pseudo.sure(t, F.col("s"), *a, "id", **k).collect())
    assert keep(0.65) == [7, 8, 9]
    assert keep((0.2, 0.1), by_quantile=True) == [2, 3, 4, 5, 6, 7, 8]
    assert keep((0.2, 0.0), by_quantile=True) == list(range(2, 10))  # nothing dropped above


@pytest.fixture(scope="module")
def state(spark):
    t = spark.createDataFrame([(i, float(i), [0.1 * (i % 7), 0.2, 0.3 + i / 100]) for i in range(30)], "id long, seq_score double, embedding array<double>")
    t = t.withColumn("probas", F.transform("embedding", lambda x: x / F.lit(2.0)))
    t = t.withColumn("label", (F.col("id") % 2).cast("int")).withColumn("tokens", F.array(F.lit("a"), F.col("id").cast("string"), (F.col("id") % 5).cast("string")))
    return PoolState(t.where("id < 5"), t.where("id >= 5"), "id")


@pytest.mark.parametrize("name", ["random", "seq_score", "idds", "embeddings_similarity", "idds_with_uncertainty", "lc", "margin", "mahalanobis", "triplet", "mahalanobis_filtering", "mmr_rec_prec", "mmr_f1"])
def test_loop_moves_rows(state, name):
    total, seen = 30, set()
    for s, chosen, _ in run(state, Spec(name, 3, 2)):
        ids = {r["id"] for r in chosen.collect()}
        assert len(ids) == 3 and not ids & seen
        seen |= ids
        assert s.labelled.count() + s.pool.count() == total
        assert rows.within(s.labelled, s.pool, "id").count() == 0


def test_resume_equals_run(state):
    log, last = None, None
    for s, chosen, _ in run(state, Spec("random", 4, 2)):
        log, last = chosen if log is None else log.union(chosen), s
    again = resume(state.labelled, state.pool, "id", log)
    assert again.iteration == 2
    assert sorted(r["id"] for r in again.pool.collect()) == sorted(r["id"] for r in last.pool.collect())


def test_fan_out():
    assert [s.seed for s in fan_out([Spec("random", 1, 1)], [1, 2])] == [1, 2]
    assert "bleuvar" in STRATEGIES and "cluster_margin" in STRATEGIES


CONFIG = """
al: {strategy: idds, sampling_type: null, plasm_thresh: 0.75}
acquisition_model: {name: bart}
successor_model:
  checkpoint: pegasus
target_model: {name: ""}
data:
  dataset_name: [xsum, small]
framework: {name: transformers}
tracin: {use: true}
seed: 7
"""


def test_runs(spark, tmp_path):
    for i, names in enumerate((["config.yaml", "metrics.json", "acquisition_metrics.json", "target_tracin_quantile_0.1_metrics.json"], ["config.yaml"], ["metrics.json"])):
        d = tmp_path / f"run{i}"
        d.mkdir()
        for n in names:
            (d / n).write_text(CONFIG if n.endswith("yaml") else json.dumps({"test_f1": [0.5, -1.0]} if n[0] == "a" else {"f1": [9.0]} if n[0] == "m" else {"eval_f1": 0.25}))
    got = analytics.collect_metrics(spark, str(tmp_path), "f1").orderBy("deleted", "iteration").collect()
    assert [(r["deleted"], r["iteration"], r["value"]) for r in got] == [(None, 0, 0.5), (None, 1, None), ("0.1", 0, 0.25)]
    flat = analytics.runs(spark, str(tmp_path)).select(analytics.flat_config(F.col("config")).alias("c")).first()["c"].asDict()
    assert flat == {"strategy": "idds", "dataset": "xsum small", "acquisition": "bart", "successor": "pegasus", "target": "", "ups": "k=1.0, T=0", "deleted": "0.25", "framework": "transformers", "al_type": "plasm_thresh", "seed": 7}
    plain = spark.createDataFrame([(json.dumps({"model": {"checkpoint": "b"}, "data": {"dataset_name": "x"}, "framework": "f", "seed": 1}),)], "c string")
    flat = plain.select(analytics.flat_config(F.col("c")).alias("c")).first()["c"]
    assert (flat["strategy"], flat["acquisition"], flat["target"], flat["ups"], flat["deleted"], flat["framework"], flat["al_type"]) == ("full", "b", "b", "None", "0", "f", "full")


def test_records_in_a_struct(spark, tmp_path):
    p = tmp_path / "train.json"
    p.write_text("\n".join(json.dumps({"translation": {"en": f"text {i}", "de": f"wort {i}"}, "other": i}) for i in range(20)))
    rows = readers.records(spark, str(p), "en", "de", extra_key="translation")
    assert rows.columns == ["en", "de"] and rows.count() == 20
    train, dev, test = readers.dataset(rows, "en", "de", 5, subset=8, test_subset=2)
    assert (train.count(), dev.count(), test.count()) == (8, 5, 2)
    ids = [r["id"] for r in train.union(dev).collect()]
    assert sorted(ids) == list(range(13)) and set(train.columns) == {"en", "de", "id"}
    again = readers.dataset(rows, "en", "de", 5, subset=8, test_subset=2)[0]
    assert sorted(r["en"] for r in again.collect()) == sorted(r["en"] for r in train.collect())


def test_dataset_quantiles_and_labels(spark, tmp_path):
    rows = spark.createDataFrame([(i, "w " * (i + 1), i % 2) for i in range(100)], "id long, text string, label int")
    train, _, _ = readers.dataset(rows, "text", "label", 0.0, quantiles=(0.1, 0.9), subset=20, stratify=True)
    got = train.collect()
    assert len(got) == 20 and sum(r["label"] for r in got) == 10 and min(r["id"] for r in got) >= 10 and max(r["id"] for r in got) < 90
    rows.where("id < 50").write.parquet(str(tmp_path / "set" / "train"))
    rows.where("id >= 50").write.parquet(str(tmp_path / "set" / "valid"))
    parts = readers.catalogued(spark, {"path": "set", "splits": {"train": "train", "dev": "valid"}, "text": "text", "label": "label", "names": ["even", "odd"]}, str(tmp_path))
    assert parts["train"].count() == 50 and parts["test"].count() == 50 and {(r["id"] % 2, r["label_name"]) for r in parts["dev"].collect()} == {(0, "even"), (1, "odd")}
    parts = readers.catalogued(spark, {"path": "set", "text": "text", "label": "label", "test": 10}, str(tmp_path))
    assert parts["train"].count() == 40 and parts["test"].count() == 10


def test_small_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("x: {y: [1, 2]}")
    (tmp_path / "b.json").write_text('{"x": 3}')
    (tmp_path / "bad.yml").write_text("a: [")
    got = {r["path"].rsplit("/", 1)[1]: r["value"] for r in readers.load(spark, "files", str(tmp_path)).collect()}
    assert json.loads(got["a.yaml"]) == {"x": {"y": [1, 2]}} and json.loads(got["b.json"]) == {"x": 3} and got["bad.yml"] is None


def test_steps_of_training():
    assert epochs_and_batch(1000, 3, 16, 10) == (3, 16)
    assert epochs_and_batch(20, 5, 16, 50) == (10, 4)  # four rows a batch are five steps, half of what is needed
    assert epochs_and_batch(20, 5, 16, 50, adjust_epochs=False) == (5, 4) and epochs_and_batch(20, 0.5, 16, 50) == (0.5, 16)
    assert epochs_and_batch(100, 5, 16, 50) == (5, 11)
    assert train_constants(100, 5, 16, 50, 0.1) == (11, 5, 10, 5) and train_constants(20, 5, 16, 50, 0.1, dev_share=0.1)[:2] == (4, 10)


def test_names_and_thresholds(spark):
    assert [strategy_name("bald", None, True), strategy_name("lc", True), strategy_name("random", False)] == ["bald_head", "lc_tokens", "random_samples"]
    assert named_strategy("bald_head") is STRATEGIES["bald"] and named_strategy("random_samples") is STRATEGIES["random"]
    with pytest.raises(ValueError):
        named_strategy("nothing_tokens")
    log = spark.createDataFrame([("f1", 0, 0.5), ("f1", 1, 0.75)], "metric string, iteration int, value double")
    assert adaptive("adaptive", log, "f1") == 0.75 and adaptive("adaptive", log, "acc") == 1.0 and adaptive(0.3, log, "f1") == 0.3


def test_streaming_scores_each_row_once(spark, tmp_path):
    from poolsieve.streaming.scoring import score_arrivals

    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = score_arrivals(stream, lambda b: b.withColumn("score", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "cp"), "id")
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_rotation(spark):
    f = spark.createDataFrame([("a", f"checkpoint-{i}") for i in (1, 20, 3)], "d string, n string")
    assert [r["n"] for r in analytics.rotated(f, 2, "d", "n").collect()] == ["checkpoint-1"]
