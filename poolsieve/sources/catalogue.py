"""From a description of a data set to its parts: where it lies decides the reader, the task what is read where nothing else is said, and the parts that are there
decide what serves as dev and test. All of it is a plan over the files: choosing a part prunes folders, and only counts, quantiles and names of parts reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import whitespace_tokens
from ..operators.rows import numbered, sample, split, stratified, within_quantiles
from . import readers

# fixed values: how configurations name places of data, parts, and the field that holds translations
URL, CATALOGUE = "url", "datasets"
TRAIN, VALIDATION, TEST = "train", "validation", "test"
TRANSLATION = "translation"
#: Names of data sets whose test part has no labels hold one of these.
UNLABELLED_TEST = ("glue",)


@dataclass(frozen=True)
class Description:
    """What a configuration says of a data set. ``path``: ``url``, ``datasets``, or a folder or file. ``test``: rows, or the share of them, that are held out where there is no
    test part. ``subset``: rows of train to use, ``test_subset`` of test. ``names`` of label numbers."""

    path: str
    text: str
    label: str
    name: str = ""
    parts: dict[str, str] = field(default_factory=dict)
    extra_key: str | None = None
    no_test: bool = False
    test: int | float = 0.2
    labels_to_remove: tuple = ()
    quantiles: tuple[float, float] | None = None
    subset: int | None = None
    stratify: bool = False
    test_subset: int | None = None
    names: tuple[str, ...] = ()
    id_col: str = "id"
    seed: int = 42


def kind_of(path: str, task: str) -> str:
    """The reader: of files from the web for ``url``, of the catalogue for ``datasets``; anything else is read by task: folders of classes, CoNLL files for tagging, records for summaries."""
    if path in (URL, CATALOGUE):
        return {URL: "reviews", CATALOGUE: "catalogue"}[path]
    return {"ner": "conll", "abs-sum": "records"}.get(task, "folders")


def chosen(parts: set[str], name: str, no_test: bool) -> dict[str, str | None]:
    """Which part of ``parts`` serves as train, dev and test; None: held out of train. Without labels in its test part, or without such a part, test is what dev is."""
    if TRAIN not in parts:
        raise ValueError(f"no part {TRAIN} among {sorted(parts)}")
    if no_test or not parts & {VALIDATION, TEST}:
        return {"train": TRAIN, "dev": None, "test": None}
    dev = VALIDATION if VALIDATION in parts else TEST
    labelled = TEST in parts and not any(x in name for x in UNLABELLED_TEST)
    return {"train": TRAIN, "dev": dev, "test": TEST if labelled else dev}


def catalogue_rows(spark: SparkSession, root: str, d: Description, task: str) -> DataFrame:
    """All rows of a data set of the catalogue, Parquet under ``root/name`` with a folder ``part=...`` for each part; fields of a nested record come up."""
    rows = spark.read.parquet(f"{root}/{d.name}")
    key = d.extra_key or (TRANSLATION if task == "nmt" else None)
    return rows.select("part", f"{key}.*") if key else rows


def load(spark: SparkSession, root: str, d: Description, task: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[int, str] | None]:
    """(train, dev, test, names of label numbers) of what ``d`` describes, for ``task``; ``root`` holds the catalogue and the copies of web files.

    Where nothing else is there, test and dev are one table. Labels of ``labels_to_remove`` go from all parts (an array of tags goes as a whole); quantiles of length and the
    subset are of train; ids go on over the parts, dev and test being numbered once if they are one. Columns but text, label and id go. Null labels stay."""
    kind = kind_of(d.path, task)
    wanted = lambda f: f.select(*[c for c in (d.text, d.label, d.id_col) if c in f.columns])
    if kind == "catalogue":
        rows = catalogue_rows(spark, root, d, task)
        there = {r[0] for r in rows.select("part").distinct().collect()}  # a row a part
        use = chosen(there, d.name, d.no_test)
        part = lambda name: wanted(rows.where(F.col("part") == name))
        train, dev, test = part(use["train"]), use["dev"] and part(use["dev"]), use["test"] and part(use["test"])
        one = use["dev"] == use["test"]
    elif kind == "reviews":
        train, dev, test = map(wanted, readers.reviews(spark, f"{root}/{d.name}", d.seed))
        one = False
    elif kind == "folders":
        train, dev, test = map(wanted, readers.folders(spark, d.path, float(d.test), d.seed))
        one = True
    else:
        made = {k: _part(spark, kind, f"{d.path}/{f}", d) for k, f in (d.parts or {TRAIN: ""}).items()}
        use = chosen(set(made), d.name, d.no_test)
        train, dev, test = made[use["train"]], use["dev"] and made[use["dev"]], use["test"] and made[use["test"]]
        one = use["dev"] == use["test"]
    if dev is None:
        train, dev = split(_keyed(train, d.id_col), d.test, _key(train, d.id_col), d.seed)
        train, dev = train.drop("_key"), dev.drop("_key")
        test = dev
    train, dev, test = (_without_labels(f, d) for f in (train, dev, test))
    train = _of_train(train, d)
    if d.id_col not in train.columns:
        train, dev, *more = numbered([f.withColumn("_key", _hash(f)) for f in ([train, dev] if one else [train, dev, test])], "_key", d.id_col)
        train, dev, test = train.drop("_key"), dev.drop("_key"), (more[0] if more else dev).drop("_key")
    if d.test_subset is not None:
        test = sample(test, d.test_subset, d.id_col, d.seed)
    return train, dev, test, dict(enumerate(d.names)) if d.names and task not in ("abs-sum", "nmt") else None


def _part(spark: SparkSession, kind: str, path: str, d: Description) -> DataFrame:
    if kind == "records":
        return readers.records(spark, path, d.text, d.label, extra_key=d.extra_key)
    return readers.conll(spark, path).select(F.col("tokens").alias(d.text), F.col("tags").alias(d.label))


def _hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def _key(df: DataFrame, id_col: str) -> str:
    return id_col if id_col in df.columns else "_key"


def _keyed(df: DataFrame, id_col: str) -> DataFrame:
    return df if id_col in df.columns else df.withColumn("_key", _hash(df))


def _without_labels(df: DataFrame, d: Description) -> DataFrame:
    gone = F.col(d.label).isin(list(d.labels_to_remove)) if d.labels_to_remove else F.lit(False)
    return df.where(~F.coalesce(gone, F.lit(False)))


def _of_train(train: DataFrame, d: Description) -> DataFrame:
    train = _keyed(train, d.id_col)
    key = _key(train, d.id_col)
    if d.quantiles:
        words = F.col(d.text) if train.schema[d.text].dataType.typeName() == "array" else whitespace_tokens(F.col(d.text))
        train = within_quantiles(train, F.coalesce(F.size(words), F.lit(0)), *d.quantiles)
    if d.subset is not None and d.stratify:
        total = train.count()
        train = stratified(train, {r[0]: round(d.subset * r[1] / total) for r in train.groupBy(d.label).count().collect()}, d.label, key, d.seed)  # a row a label
    elif d.subset is not None:
        train = split(train, d.subset, key, d.seed)[1]
    return train.drop("_key")
