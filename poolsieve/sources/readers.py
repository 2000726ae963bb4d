"""Readers of corpora and model files. Files are read by Spark, whole where a record spans lines; nothing is
read on the driver."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import whitespace_tokens
from ..operators.rows import numbered, sample, stratified, within_quantiles
from ..operators.rows import split as split_rows
from ..session import hash01


def folders(spark: SparkSession, root: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, dev, test) of text files in one folder a class: text, label (folders by name, from 0); dev is test."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    files = files.withColumn("name", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    names = files.select("name").distinct()
    labels = names.withColumn("label", F.row_number().over(Window.orderBy("name")) - 1)  # a row a class
    rows = files.join(F.broadcast(labels), "name").select("path", "text", "label", F.col("name").alias("label_name"))
    train, test = split_rows(rows, share, "path", seed)
    return train, test, test


def sentences_of(text: Column) -> Column:
    """Sentences of a CoNLL text, arrays of its lines: blank and -DOCSTART- lines divide."""
    parts = F.split(F.regexp_replace(text, r"(?m)^-DOCSTART-.*$", ""), r"\r?\n[ \t]*(?:\r?\n[ \t]*)*(?=\r?\n|\z)|\n\s*\n")
    lines = F.transform(parts, lambda p: F.filter(F.split(p, r"\r?\n"), lambda line: F.length(F.trim(line)) > 0))
    return F.filter(lines, lambda s: F.size(s) > 0)


def conll(spark: SparkSession, path: str, tag_index: int = -1) -> DataFrame:
    """Rows (path, sentence, tokens, tags): column 0 is the token; of the other columns ``tag_index`` is the tag, names as written."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"), F.col("_metadata.file_path").alias("path"))
    return conll_text(files, "v", tag_index)


def conll_text(df: DataFrame, text: str, tag_index: int = -1) -> DataFrame:
    """As ``conll`` from a column of text; other columns are kept."""
    rest = [c for c in df.columns if c != text]
    flat = df.select(*rest, F.posexplode(sentences_of(F.col(text))).alias("sentence", "lines"))
    fields = F.transform("lines", lambda line: F.split(F.trim(line), r"\s+"))
    tag = lambda f: F.get(F.slice(f, 2, F.size(f)), F.lit(tag_index)) if tag_index >= 0 else F.try_element_at(F.slice(f, 2, F.size(f)), F.lit(tag_index))
    return flat.select(*rest, "sentence", F.transform(fields, lambda f: f[0]).alias("tokens"), F.transform(fields, tag).alias("tags"))


def tag_ids(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Rows (tag, tag_id): O is 0, the others follow in order of the first sentence they occur in, then by name."""
    flat = df.select("sentence", F.explode(tags).alias("tag")).where("tag <> 'O'").groupBy("tag").agg(F.min("sentence").alias("s"))
    numbered = flat.select("tag", F.row_number().over(Window.orderBy("s", "tag")).alias("tag_id"))  # a row a tag
    return df.sparkSession.createDataFrame([("O", 0)], "tag string, tag_id int").union(numbered)


def plain_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Rows (text): each sentence of a CoNLL file as its tokens joined by a space."""
    return conll(spark, path).select(F.array_join("tokens", " ").alias("text"))


def records(spark: SparkSession, path: str, text: str, label: str | None = None, id_col: str | None = None, schema: T.StructType | str | None = None, extra_key: str | None = None) -> DataFrame:
    """Rows (text, label, id) of CSV, JSON lines, gzip included, or one JSON list (``*.list.json``). With ``extra_key`` they are the fields
    of that struct. Without a schema, JSON is read once more to find one."""
    if ".csv" in path:
        df = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema)
    else:
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.option("multiLine", path.endswith(".list.json")).json(path)
        df = normal_records(df.select(f"{extra_key}.*") if extra_key else df, text)
    return df.select(*[c for c in (text, label, id_col) if c])


def normal_records(df: DataFrame, text: str) -> DataFrame:
    """One leading underscore of names goes; a text that is an array is joined by newlines; a struct becomes the array of its values."""
    df = df.toDF(*[c[1:] if c.startswith("_") else c for c in df.columns])
    for f in df.schema.fields:
        if f.name == text and isinstance(f.dataType, T.ArrayType):
            df = df.withColumn(f.name, F.array_join(f.name, "\n"))
        elif isinstance(f.dataType, T.StructType):
            df = df.withColumn(f.name, F.array(*[F.col(f"{f.name}.{x.name}") for x in f.dataType.fields]))
    return df


def dataset(
    rows: DataFrame, text: str, label: str | None, test: int | float = 0.2, seed: int = 42, quantiles: tuple[float, float] | None = None, length: Column | None = None,
    subset: int | None = None, stratify: bool = False, test_subset: int | None = None, id_col: str = "id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, dev, test) of records: a test part of a share or a number of rows by a seeded hash, dev being the same; of the training part, rows whose
    ``length`` (words of the text) lies between two quantiles, then a subset, stratified by label or not; ids from 0 over all parts where there are none; of the
    test part a subset."""
    keyed = rows if id_col in rows.columns else rows.withColumn("_key", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    key = id_col if id_col in rows.columns else "_key"
    train, held = split_rows(keyed, test, key, seed)
    dev = held
    if quantiles:
        train = within_quantiles(train, F.size(whitespace_tokens(F.col(text))) if length is None else length, *quantiles)
    if subset is not None:
        if stratify:
            total = train.count()
            quotas = {r[0]: round(subset * r[1] / total) for r in train.groupBy(label).count().collect()}  # a row a label
            train = stratified(train, quotas, label, key, seed)
        else:
            train = sample(train, subset, key, seed)
    if id_col not in rows.columns:
        train, held = (f.drop("_key") for f in numbered([train, held], "_key", id_col))
        dev = held
    return train, dev, sample(held, test_subset, id_col, seed) if test_subset else held


def catalogued(spark: SparkSession, entry: dict, root: str) -> dict[str, DataFrame]:
    """The parts {train, dev, test} of a data set that an entry of a catalogue describes: ``path`` below ``root``, ``kind`` of reader, ``splits`` (names of the files of
    each part; dev falls back to test, test to a share of train), ``text``, ``label``, and ``names`` of label numbers, which add ``label_name``."""
    kind, splits = entry.get("kind", "parquet"), entry.get("splits", {"train": "train"})
    more = {"text": entry["text"], "label": entry.get("label")} if kind == "records" else {}
    parts = {k: load(spark, kind, f"{root}/{entry['path']}/{name}", **more) for k, name in splits.items()}
    if "test" not in parts:
        if "dev" in parts:
            parts["test"] = parts["dev"]
        else:
            parts["train"], _, parts["test"] = dataset(parts["train"], entry["text"], entry.get("label"), entry.get("test", 0.2), entry.get("seed", 42))
    parts.setdefault("dev", parts["test"])
    if names := entry.get("names"):
        named = F.array(*[F.lit(x) for x in names])
        parts = {k: f.withColumn("label_name", F.get(named, F.col(entry["label"]).cast("int"))) for k, f in parts.items()}
    return parts


def small_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, value): JSON and YAML files, whole, as JSON."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.withColumn("value", F.when(F.col("path").rlike(r"\.ya?ml$"), yaml_as_json(F.col("value"))).otherwise(F.col("value")))


def yaml_as_json(text: Column) -> Column:
    """YAML texts as JSON; null where a text is not YAML. Needs the yaml package."""
    try:
        import yaml  # noqa: F401
    except ImportError as e:
        raise ImportError("reading YAML needs the yaml package") from e

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        import json

        import yaml

        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(yaml.safe_load(t), default=str)
            except yaml.YAMLError:
                return None

        return texts.map(one).astype(object)

    return convert(text)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def reviews(spark: SparkSession, path: str, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, dev, test) of JSON lines with a rating from 1: label = overall - 1; test is a tenth, dev 7/9 of another split of the rest."""
    df = spark.read.schema("reviewText string, overall double").json(path).select(F.col("reviewText").alias("text"), (F.col("overall") - 1).cast("int").alias("label"))
    df = df.withColumn("id", F.xxhash64("text", "label"))
    rest, test = split_rows(df, 0.1, "id", seed)
    _, dev = split_rows(rest, 2 / 9, "id", seed + 1)
    train = rest.join(dev.select("id"), "id", "left_anti")
    return train, dev, test


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Rows (word, vector) of a text file ``word v1 ... vd`` whose first line is a header of two numbers."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    return rows.select(F.col("p")[0].alias("word"), F.slice("p", 2, F.size("p") - 1).cast("array<double>").alias("vector"))


def embedding_table(vectors: DataFrame, vocabulary: DataFrame, seed: int = 0) -> DataFrame:
    """Rows (token, token_id, vector) for a vocabulary (token, token_id from 1): a token without a vector draws from
    (-0.1, 0.1); [UNK], 0, is the mean of all, [PAD], last, is zero."""
    width = vectors.select(F.size("vector")).first()[0]
    drawn = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: hash01(seed, F.col("token"), i) * 0.2 - 0.1)
    known = vocabulary.join(vectors.withColumnRenamed("word", "token"), "token", "left").select("token", F.col("token_id").cast("long"), F.coalesce("vector", drawn).alias("vector"))
    flat = known.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    mean = flat.agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")).select(F.lit("[UNK]").alias("token"), F.lit(0).cast("long").alias("token_id"), F.transform("s", lambda x: x["m"]).alias("vector"))
    zero = known.agg(F.lit("[PAD]").alias("token"), (F.coalesce(F.max("token_id"), F.lit(0)) + 1).alias("token_id"), F.array_repeat(F.lit(0.0), width).alias("vector"))
    return known.unionByName(mean).unionByName(zero)


def write_lines(df: DataFrame, text: str, path: str) -> None:
    """A text column as a text file for language-model training, a row a line (or several)."""
    df.select(F.col(text).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_selection(selection: DataFrame, path: str) -> None:
    """Selected ids, a folder for each iteration; writing an iteration again replaces it."""
    selection.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iteration").parquet(path)


def append_metrics(spark: SparkSession, path: str, experiment: str, seed: int, iteration: int, model: str, values: dict[str, float]) -> None:
    """Metrics, times among them, as rows of a long table."""
    rows = [(experiment, seed, iteration, model, k, float(v)) for k, v in values.items()]
    spark.createDataFrame(rows, "experiment string, seed long, iteration int, model string, metric string, value double").coalesce(1).write.mode("append").parquet(path)


Reader = Callable[..., DataFrame]
READERS: dict[str, Reader] = {
    "conll": conll,
    "records": records,
    "word_vectors": word_vectors,
    "sentences": plain_sentences,
    "files": small_files,
    "folders": lambda spark, path, **kw: reduce(DataFrame.unionByName, folders(spark, path, **kw)[::2]),
    "reviews": lambda spark, path, **kw: reduce(DataFrame.unionByName, reviews(spark, path, **kw)),
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def load(spark: SparkSession, kind: str, path: str, **kwargs) -> DataFrame:  # noqa: ANN003
    """A reader by name."""
    if kind not in READERS:
        raise ValueError(f"unknown kind of source: {kind}; known are {sorted(READERS)}")
    return READERS[kind](spark, path, **kwargs)
