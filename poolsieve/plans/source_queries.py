"""Sources and sinks as queries: the test tables are written to the shared folder in each format and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import analytics
from ..session import table
from ..sources import catalogue, readers
from .providers import hash_sql
from .registry import query


#: Most records of a CoNLL file: a file is read as one row, whatever the size of the table.
RECORDS = 2000


def _path(spark: SparkSession, name: str) -> str:
    """A new place in the folder all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="poolsieve-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("source_records_json", "select doc_id as id, text, lang as label from documents")
def source_records_json(spark, d):  # noqa: ANN001, ANN201
    path = _path(spark, "records")
    docs = table(spark, d, "documents").select(F.struct(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")).alias("translation"), F.col("n_chars").alias("_n"))
    readers.write_json(docs, path)
    schema = "translation struct<id: bigint, text: string, label: string>, _n bigint"
    return readers.records(spark, path, "text", "label", "id", schema, "translation")


@query("source_conll", r"""select conv_id * 1000 + turn as id, length(w) as n, w as token, case length(w) % 3 when 0 then 'O' when 1 then 'B-A' else 'I-A' end as tag, pos::bigint as pos from
(select conv_id, turn, unnest(t) as w, generate_subscripts(t, 1) - 1 as pos from (select conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as t from conversations))""")
def source_conll(spark, d):  # noqa: ANN001, ANN201
    path = _path(spark, "conll")
    from ..functions.text import whitespace_tokens

    tag = F.array(*[F.lit(x) for x in ("O", "B-A", "I-A")])
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), whitespace_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    lines = F.transform("t", lambda w: F.concat_ws(" ", w, F.col("id").cast("string"), F.get(tag, F.length(w) % 3)))
    text = c.select(F.concat(F.lit("-DOCSTART- -X- O\n\n"), F.array_join(lines, "\n"), F.lit("\n\n")).alias("value"))
    text.write.option("maxRecordsPerFile", RECORDS).text(path)
    ids = readers.conll(spark, path, 0).select("path", "sentence", F.col("tags")[0].cast("long").alias("id"))
    rows = readers.conll(spark, path).select("path", "sentence", F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "z")).join(ids, ["path", "sentence"])
    return rows.select("id", F.length("z.tokens").cast("long").alias("n"), F.col("z.tokens").alias("token"), F.col("z.tags").alias("tag"), F.col("pos").cast("long"))


@query("source_folders", "select source as label_name, dense_rank() over (order by source) - 1 as label, count(*) as n, sum(length(text)) as chars from documents where source is not null and text is not null group by source")
def source_folders(spark, d):  # noqa: ANN001, ANN201
    path = _path(spark, "folders")
    docs = table(spark, d, "documents").where("source is not null and text is not null")
    # a folder a class; in each, a file a document would be a file a row, so each line holds one, as JSON
    docs.select("source", F.to_json(F.struct("text")).alias("value")).write.partitionBy("source").text(path)
    files = readers.folders(spark, path, 0.0)[0].withColumn("label_name", F.regexp_replace("label_name", "^source=", ""))
    rows = files.select("label_name", "label", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    text = F.from_json("line", "text string")["text"]
    return rows.groupBy("label_name", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), F.sum(F.char_length(text)).cast("long").alias("chars"))


@query("source_word_vectors", "select vec_id, pos::bigint as pos, x from (select vec_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings)")
def source_word_vectors(spark, d):  # noqa: ANN001, ANN201
    path = _path(spark, "vectors")
    v = table(spark, d, "embeddings").select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), " ")).alias("value"))
    v.write.text(path)
    got = readers.word_vectors(spark, path)
    return got.select(F.substring("word", 2, 20).cast("long").alias("vec_id"), F.posexplode("vector").alias("pos", "x")).select("vec_id", F.col("pos").cast("long"), "x")


@query("sink_selection", "select doc_id, (n_chars % 4)::int as iteration from documents where n_chars % 4 < 2 union all select doc_id, 2 from documents where n_chars % 4 = 3")
def sink_selection(spark, d):  # noqa: ANN001, ANN201
    """Iterations 0, 1 and 2 are written, then 2 again."""
    path = _path(spark, "selection")
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 4).cast("int").alias("iteration"))
    readers.write_selection(docs.where("iteration < 3"), path)
    readers.write_selection(docs.where("iteration = 3").withColumn("iteration", F.lit(2)), path)
    return spark.read.parquet(path).select("doc_id", F.col("iteration").cast("int"))


@query("sink_metrics", "select 'a' as experiment, 1::bigint as seed, 0 as iteration, 'm' as model, 'rows' as metric, count(*)::double as value from documents union all select 'a', 1, 1, 'm', 'rows', count(*) from labels")
def sink_metrics(spark, d):  # noqa: ANN001, ANN201
    path = _path(spark, "metrics")
    for i, name in enumerate(("documents", "labels")):
        readers.append_metrics(spark, path, "a", 1, i, "m", {"rows": table(spark, d, name).count()})
    return spark.read.parquet(path)


@query("sink_lines", r"select unnest(string_split(text, chr(10))) as line, count(*) as n from documents where text is not null and not contains(text, chr(13)) group by 1")
def sink_lines(spark, d):  # noqa: ANN001, ANN201
    path = _path(spark, "lines")
    docs = table(spark, d, "documents").where("text is not null and not contains(text, '\r')")
    readers.write_lines(docs, "text", path)
    return spark.read.option("lineSep", "\n").text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("source_runs_yaml", """select event_type as strategy, 'asm' as al_type, (user_id % 3)::int as seed, i::int as iteration, v as value from
(select event_type, user_id, unnest(range(len(vs))) as i, unnest(vs) as v from (select event_type, user_id, list(round(value, 6) order by event_id) as vs from events group by all))""")
def source_runs_yaml(spark, d):  # noqa: ANN001, ANN201
    """Each user's events of a type are a run: a configuration in YAML and a file of metrics."""
    path = _path(spark, "runs")
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.round("value", 6).alias("v")))).alias("vs"))
    yaml = F.concat(F.lit("al: {strategy: "), F.col("event_type"), F.lit(", sampling_type: null}\nacquisition_model: {name: a}\nsuccessor_model: {name: b}\ndata: {dataset_name: x}\nframework: f\nseed: "), (F.col("user_id") % 3).cast("string"))
    metrics = F.to_json(F.struct(F.transform("vs", lambda x: x["v"]).alias("test_f1")))
    run = F.concat_ws("-", "event_type", "user_id").alias("run")
    # Spark names files itself, so the two files of a run are read as rows of their names
    files = e.select(run, F.explode(F.array(F.struct(F.lit("config.yaml").alias("file"), yaml.alias("value")), F.struct(F.lit("acquisition_metrics.json").alias("file"), metrics.alias("value")))).alias("f")).select("run", "f.*")
    files.write.parquet(path)
    back = spark.read.parquet(path)
    config = back.where("file = 'config.yaml'").select("run", analytics.flat_config(readers.yaml_as_json(F.col("value"))).alias("c"))
    found = analytics.first_file(back, "run", "file").select("run", F.posexplode(analytics.first_metric(F.from_json("value", "map<string, array<double>>"), "f1")).alias("iteration", "value"))
    return found.join(config, "run").select("c.strategy", "c.al_type", "c.seed", "iteration", "value")


def _catalogue(spark, d, name, parts):  # noqa: ANN001, ANN202
    """Documents as a data set of a catalogue, a folder a part."""
    root = _path(spark, "catalogue")
    docs = table(spark, d, "documents").where("text is not null and lang is not null").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), "n_chars", parts.alias("part"))
    docs.write.partitionBy("part").parquet(f"{root}/{name}")
    return root


def _parts(train, dev, test):  # noqa: ANN001, ANN202
    rows = [f.select(F.lit(k).alias("part"), F.col("id").alias("doc_id"), "label", F.md5("text").alias("text_md5")) for k, f in (("train", train), ("dev", dev), ("test", test))]
    return rows[0].union(rows[1]).union(rows[2])


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::double"
_THREE = "case when doc_id % 10 < 6 then 'train' when doc_id % 10 < 8 then 'validation' else 'test' end"


def _chain_sql(part: str, dev: str, test: str, subset: int, test_subset: int, gone: str) -> str:
    """The chain from parts to subsets."""
    return f"""with r as (select doc_id, lang as label, text, {part} as part from documents where text is not null and lang is not null), s as (select * from r where label not in ({gone})),
t as (select *, {_WORDS} as n from s where part = 'train'), q as (select quantile_cont(n, 0.05) as lo, quantile_cont(n, 0.9) as hi from t),
k as (select doc_id, label, text, row_number() over (order by {hash_sql(5, "doc_id")}, doc_id) as k from t, q where n between lo and hi),
e as (select doc_id, label, text, row_number() over (order by {hash_sql(5, "doc_id")}, doc_id) as k from s where part = '{test}')
select 'train' as part, doc_id, label, md5(text) as text_md5 from k where k <= {subset} union all select 'dev', doc_id, label, md5(text) from s where part = '{dev}' union all select 'test', doc_id, label, md5(text) from e where k <= {test_subset}"""


@query("source_catalogue", _chain_sql(_THREE, "validation", "test", 100, 40, "'fr'"))
def source_catalogue(spark, d):  # noqa: ANN001, ANN201
    """Three parts; of train, a language less, lengths between quantiles, and a subset; a subset of test."""
    root = _catalogue(spark, d, "news", F.expr(_THREE))
    about = catalogue.Description("datasets", "text", "label", "news", labels_to_remove=("fr",), quantiles=(0.05, 0.9), subset=100, test_subset=40, seed=5)
    return _parts(*catalogue.load(spark, root, about, "cls")[:3])


@query("source_catalogue_unlabelled_test", _chain_sql(_THREE, "validation", "validation", 100, 40, "'fr', 'de'"))
def source_catalogue_unlabelled_test(spark, d):  # noqa: ANN001, ANN201
    """The test part of such a data set has no labels, so dev serves as test."""
    root = _catalogue(spark, d, "glue-news", F.expr(_THREE))
    about = catalogue.Description("datasets", "text", "label", "glue-news", labels_to_remove=("fr", "de"), quantiles=(0.05, 0.9), subset=100, test_subset=40, seed=5)
    return _parts(*catalogue.load(spark, root, about, "cls")[:3])


@query("source_held_out", f"""with r as (select doc_id, lang as label, text, row_number() over (order by {hash_sql(5, "doc_id")}, doc_id) as k, count(*) over () as n from documents where text is not null and lang is not null),
p as (select *, k <= round_even(n * 0.25, 0) as held from r)
select 'train' as part, doc_id, label, md5(text) as text_md5 from p where not held union all select unnest(['dev', 'test']), doc_id, label, md5(text) from p where held""")
def source_held_out(spark, d):  # noqa: ANN001, ANN201
    """Only a train part: a quarter of it is dev and test."""
    root = _catalogue(spark, d, "news", F.lit("train"))
    return _parts(*catalogue.load(spark, root, catalogue.Description("datasets", "text", "label", "news", test=0.25, seed=5), "cls")[:3])
