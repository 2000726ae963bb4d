"""From descriptions of data sets to their parts."""

import pytest
from pyspark.sql import functions as F

from poolsieve.operators.rows import split
from poolsieve.sources import catalogue
from poolsieve.sources.catalogue import Description


def test_place_and_task_decide_the_reader():
    assert [catalogue.kind_of(p, t) for p, t in [("url", "ner"), ("datasets", "cls"), ("/x", "cls"), ("/x", "ner"), ("/x", "abs-sum"), ("/x", "other")]] == ["reviews", "catalogue", "folders", "conll", "records", "folders"]


def test_parts_that_serve():
    every = {"train", "validation", "test"}
    assert catalogue.chosen(every, "news", False) == {"train": "train", "dev": "validation", "test": "test"}
    assert catalogue.chosen(every, "glue/sst2", False) == {"train": "train", "dev": "validation", "test": "validation"}
    assert catalogue.chosen(every - {"validation"}, "glue/x", False) == {"train": "train", "dev": "test", "test": "test"}
    assert catalogue.chosen(every, "news", True) == catalogue.chosen({"train"}, "news", False) == {"train": "train", "dev": None, "test": None}
    with pytest.raises(ValueError, match="no part train"):
        catalogue.chosen({"test"}, "news", False)


def test_translations_of_the_catalogue(spark, tmp_path):
    rows = [(p, (f"de {i}", f"en {i}", "more")) for i, p in enumerate(["train"] * 8 + ["test"] * 3)]
    spark.createDataFrame(rows, "part string, translation struct<de: string, en: string, x: string>").write.partitionBy("part").parquet(f"{tmp_path}/pairs")
    train, dev, test, names = catalogue.load(spark, str(tmp_path), Description("datasets", "de", "en", "pairs", names=("a",)), "nmt")
    assert names is None and sorted(train.columns) == ["de", "en", "id"]
    assert sorted(r["id"] for r in train.collect()) == list(range(8)) and sorted(r["id"] for r in dev.collect()) == [8, 9, 10] and sorted(map(tuple, dev.collect())) == sorted(map(tuple, test.collect()))


def test_records_and_tagged_files_by_task(spark, tmp_path):
    for name, n in (("train.json", 10), ("dev.json", 3)):
        spark.createDataFrame([(f"w {i}" * (1 + i), "s", i) for i in range(n)], "document string, summary string, id long").write.json(f"{tmp_path}/{name}")
    about = Description(str(tmp_path), "document", "summary", parts={"train": "train.json", "validation": "dev.json"}, quantiles=(0.2, 0.8))
    train, dev, test, _ = catalogue.load(spark, "", about, "abs-sum")
    assert train.count() == 6 and dev.count() == test.count() == 3
    (tmp_path / "x.conll").write_text("a N O\nb N B-X\n\nc N O\n\nd N O\n\ne N O\n")
    train, dev, test, names = catalogue.load(spark, "", Description(str(tmp_path), "words", "tags", parts={"train": "x.conll"}, test=1, names=("O", "B-X")), "ner")
    got = train.unionByName(dev).collect()
    assert dev.count() == 1 and sorted(" ".join(r["words"]) for r in got) == ["a b", "c", "d", "e"] and sorted(r["id"] for r in got) == [0, 1, 2, 3] and names == {0: "O", 1: "B-X"}


def test_labels_that_go_and_subsets(spark, tmp_path):
    rows = [(i, f"t {i}", [0, 1, 2, None][i % 4], "train" if i % 5 else "test") for i in range(100)]
    spark.createDataFrame(rows, "id long, text string, label int, part string").write.partitionBy("part").parquet(f"{tmp_path}/set")
    about = Description("datasets", "text", "label", "set", labels_to_remove=(1,), subset=20, stratify=True, test_subset=4)
    train, dev, test, _ = catalogue.load(spark, str(tmp_path), about, "cls")
    assert {r[0]: r[1] for r in train.groupBy("label").count().collect()} == {0: 7, 2: 7, None: 7}
    assert dev.count() == 15 and test.count() == 4 and train.where("label = 1").isEmpty()


@pytest.mark.parametrize(("size", "want"), [(0, 0), (3, 3), (0.5, 6), (12, 12), (99, 12)])
def test_split_is_whole(spark, size, want):
    df = spark.createDataFrame([(i, "x") for i in [*range(11), None]], "id long, t string")
    rest, part = split(df, size, "id", 3)
    assert part.count() == want and rest.count() == 12 - want and rest.intersect(part).isEmpty()
    assert split(df.where(F.lit(False)), size, "id", 3)[1].count() == 0
