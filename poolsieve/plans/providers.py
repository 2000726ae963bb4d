"""Columns that stand for a model's output on the test tables, in Spark and in SQL. The operators take any columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import proba
from ..functions.text import whitespace_tokens
from ..functions.vector import cosine, doubles, group_means
from ..operators.rows import within, without
from ..session import kept, literal_vector, table

PASSES = 4
CLASSES = 10


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a label."""
    return without(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return within(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


#: So many of the most frequent words go to every task; all others meet their totals in a join.
FREQUENT = 1 << 16


def seq_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rows (doc_id, seq_score): mean log frequency of the tokens of each pool document over the whole corpus.

    Words are counted within the tasks first. A document's frequent words are summed up where its text is read, so that only its rare words are shuffled. The scores
    are kept, a row a document: those who use them more than once don't work them out anew."""
    flat = table(spark, d, "documents").select("doc_id", F.explode(whitespace_tokens(F.col("text"))).alias("w"))
    words = kept(flat.groupBy("w").agg(F.count("*").alias("total")))
    n = words.agg(F.sum("total")).first()[0]
    log = F.log(F.col("total") / F.lit(float(n or 1)))
    frequent = words.orderBy(F.col("total").desc(), "w").limit(FREQUENT).select("w", log.alias("log"))
    rare = F.when(F.col("log").isNull(), F.col("w"))
    summed = flat.join(F.broadcast(frequent), "w", "left").groupBy("doc_id", rare.alias("w")).agg(F.count("*").alias("c"), F.sum("log").alias("s"))
    met = summed.where("w is not null").join(words, "w").select("doc_id", "c", (F.col("c") * log).alias("s"))
    both = summed.where("w is null").select("doc_id", "c", "s").unionByName(met).groupBy("doc_id").agg((F.sum("s") / F.sum("c")).alias("mean"))
    return kept(without(both, table(spark, d, "labels"), "doc_id").select("doc_id", F.round("mean", 6).alias("seq_score")))


SEQ_SCORES = r"""tok as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as w from documents),
counted as (select doc_id, w, count(*) as c from tok group by all),
words as (select w, sum(c) as total from counted group by w),
seq_scores as (select doc_id, round(sum(c * ln(total / (select sum(c) from counted)::double)) / sum(c), 6) as seq_score
    from counted join words using (w) where doc_id not in (select doc_id from labels) group by doc_id)"""


def split_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(labelled, pool) of the embeddings: every tenth is labelled."""
    x = table(spark, d, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("embedding"))
    return x.where("vec_id % 10 = 0"), x.where("vec_id % 10 <> 0")


VECTORS = """vec as (select vec_id, label, embedding::double[] as embedding from embeddings),
lab as (select * from vec where vec_id % 10 = 0), pool as (select * from vec where vec_id % 10 <> 0)"""


def with_probas(spark: SparkSession, d: str) -> DataFrame:
    """Pool vectors with ``probas``: softmax of 10 x cosine to the labelled classes' means."""
    lab, rest = split_vectors(spark, d)
    means = [r["centroid"] for r in group_means(lab, "label", "embedding").orderBy("label").collect()]
    logits = F.array(*[10 * cosine(F.col("embedding"), literal_vector(m)) for m in means])
    return rest.withColumn("probas", F.transform(proba.softmax(logits), lambda x: F.round(x, 9)))


_MEANS = """flat as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from lab),
means as (select label, list(m order by pos) as c from (select label, pos, avg(x) as m from flat group by label, pos) group by label)"""
PROBAS = f"""{VECTORS}, {_MEANS},
logits as (select vec_id, p.label as own, m.label, exp(10 * list_cosine_similarity(p.embedding, m.c)) as e from pool p cross join means m),
probas as (select vec_id, any_value(own) as label, list(round(e / s, 9) order by label) as p from (select *, sum(e) over (partition by vec_id) as s from logits) group by vec_id)"""


def with_passes(spark: SparkSession, d: str) -> DataFrame:
    """Pool vectors with ``passes``: the same for each of four blocks of components."""
    lab, rest = split_vectors(spark, d)
    means = [r["centroid"] for r in group_means(lab, "label", "embedding").orderBy("label").collect()]
    width = len(means[0]) // PASSES

    def one(b: int):  # noqa: ANN202
        part = F.slice("embedding", b * width + 1, width)
        return F.transform(proba.softmax(F.array(*[10 * cosine(part, literal_vector(m[b * width : (b + 1) * width])) for m in means])), lambda x: F.round(x, 9))

    return rest.withColumn("passes", F.array(*[one(b) for b in range(PASSES)]))


PASS_SQL = f"""{VECTORS}, {_MEANS},
pass_logits as (select vec_id, b, m.label, exp(10 * list_cosine_similarity(p.embedding[16 * b + 1:16 * b + 16], m.c[16 * b + 1:16 * b + 16])) as e
    from pool p cross join means m cross join range(4) r(b)),
pass_probas as (select vec_id, b, label, round(e / sum(e) over (partition by vec_id, b), 9) as p from pass_logits)"""


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Rows (id, pred, ref): each assistant turn with the user turn before it."""
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("pred"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref"))
    return a.join(u, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "pred", "ref")


REPLIES = """replies as (select a.conv_id * 1000 + a.turn as id, a.text as pred, u.text as ref from conversations a join conversations u
    on a.conv_id = u.conv_id and a.turn = u.turn + 1 where a.role = 'assistant' and u.role = 'user')"""
WORDS_SQL = r"list_filter(regexp_split_to_array(lower(regexp_replace({0}, '[[:punct:]]', '', 'g')), '\s+'), lambda x: x <> '')"
TOKENS_SQL = r"list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"


def hash_sql(seed: int, *cols: str) -> str:
    joined = " || ':' || ".join([f"'{seed}'", *cols])
    return f"(('0x' || substr(md5({joined}), 1, 8))::bigint / 4294967296.0)"
