"""Queries of sub-word tokens and of the inputs of tasks. The vocabulary is made by rule from the words of every second conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import subwords
from ..operators.rows import rank_by
from ..session import table
from .providers import REPLIES, replies
from .registry import query


def made_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Rows (token, token_id from 4): of each word its first three letters and its first, within it the next four, and single letters to r."""
    c = table(spark, d, "conversations").where("conv_id % 2 = 0")
    w = c.select(F.explode(subwords.text_words(F.col("text"))).alias("w")).distinct()
    inside = F.transform(F.filter(F.split(F.substring("w", 2, 1000), ""), lambda x: (x != "") & (x <= "r")), lambda x: F.concat(F.lit("##"), x))
    heads = F.array(F.substring("w", 1, 3), F.substring("w", 1, 1))
    middle = F.when(F.length("w") > 3, F.array(F.concat(F.lit("##"), F.substring("w", 4, 4)))).otherwise(F.array().cast("array<string>"))
    tokens = w.select(F.explode(F.concat(heads, middle, inside)).alias("token")).distinct()
    return rank_by(tokens, F.col("token"), name="token_id").select("token", (F.col("token_id") + 4).alias("token_id"))


def _cut(texts: str, words: str = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')") -> str:
    """``texts``: a query of (id, side, text). Gives ``pieces`` (id, side, k, ids), a row a word."""
    split = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"
    return f"""with recursive {REPLIES}, base as (select distinct unnest({split}) as w from conversations where conv_id % 2 = 0),
made as (select substr(w, 1, 3) as token from base union select substr(w, 1, 1) from base union select '##' || substr(w, 4, 4) from base where length(w) > 3
    union select '##' || x from (select unnest(regexp_split_to_array(substr(w, 2), '')) as x from base) where x <> '' and x <= 'r'),
vocab as (select token, (3 + row_number() over (order by token))::int as token_id from made),
given as ({texts}), tok as (select id, side, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as k from (select id, side, {words} as ws from given)),
walk(w, gone, ids) as (select distinct w, 0::bigint, []::int[] from tok where w <> '' and length(w) <= 100 union all
    select w, gone + max(l), list_append(ids, arg_max(token_id, l)) from (select w, gone, ids, unnest(range(1, 6)) as l from walk where gone < length(w)) c
    join vocab on token = case when gone = 0 then '' else '##' end || substr(w, gone + 1, l) where gone + l <= length(w) group by w, gone, ids),
pieces as (select id, side, k, coalesce(walk.ids, [1]) as ids from tok left join walk on tok.w = walk.w and walk.gone = length(walk.w) where tok.w <> '')"""


def _joined(values: str, room: int) -> str:
    return f"array_to_string(list_concat(list_concat([2], coalesce(({values})[1:{room}], [])), [3]), ' ')"


def _text(ids: str | Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


_TURNS = "select conv_id * 1000 + turn as id, 's' as side, text from conversations"


@query("tokenized_classes", f"""{_cut(_TURNS)}, f as (select id, flatten(list(ids order by k)) as ids from pieces group by id)
select t.id, {_joined('any_value(f.ids)', 62)} as input_ids, (t.id % 3)::int as labels from given t left join f using (id) group by t.id""")
def tokenized_classes(spark, d):  # noqa: ANN001, ANN201
    """Turns as inputs of a classifier of at most 64 tokens."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    got = subwords.task_inputs(c.withColumn("class", (F.col("id") % 3).cast("int")), "cls", "id", "text", "class", made_vocabulary(spark, d), max_length=64)
    return got.select("id", _text("input_ids").alias("input_ids"), "labels")


@query("tokenized_pairs", f"""{_cut("select id, 's' as side, ref as text from replies union all select id, 't', pred from replies")}, f as (select id, side, flatten(list(ids order by k)) as ids from pieces group by id, side)
select r.id, {_joined("any_value(f.ids) filter (where side = 's')", 126)} as input_ids, {_joined("any_value(f.ids) filter (where side = 't')", 126)} as labels from replies r left join f using (id) group by r.id""")
def tokenized_pairs(spark, d):  # noqa: ANN001, ANN201
    """User turns as documents, replies as summaries."""
    got = subwords.task_inputs(replies(spark, d), "abs-sum", "id", "ref", "pred", made_vocabulary(spark, d), max_length=128)
    return got.select("id", _text("input_ids").alias("input_ids"), _text("labels").alias("labels"))


_SPACES = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"


@query("tokenized_tagging", f"""{_cut(_TURNS, _SPACES)}, p as (select id, k, length(w) % 5 as label, unnest(ids) as t, generate_subscripts(ids, 1) as i from (select pieces.*, w from pieces join tok using (id, side, k))),
q as (select *, row_number() over (partition by id order by k, i) as pos from p), r as (select *, case when i > 1 and label % 2 = 1 then label + 1 else label end as l from q where pos <= 126)
select t.id, {_joined('list(r.t order by pos) filter (where pos is not null)', 126)} as input_ids,
    array_to_string(list_concat(list_concat([-100], coalesce(list(r.l order by pos) filter (where pos is not null), [])), [-100]), ' ') as labels,
    array_to_string(coalesce(list(pos order by pos) filter (where i = 1), []), ' ') as idx_first from given t left join r using (id) group by t.id""")
def tokenized_tagging(spark, d):  # noqa: ANN001, ANN201
    """Words of turns with a tag each (length mod 5), spread over their pieces."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce(tx.whitespace_tokens(F.lower("text")), F.array().cast("array<string>")).alias("words"))
    c = c.withColumn("tags", F.transform("words", lambda w: F.length(w) % 5))
    got = subwords.task_inputs(c, "ner", "id", "words", "tags", made_vocabulary(spark, d), max_length=128, first_places=True)
    return got.select("id", _text("input_ids").alias("input_ids"), _text("labels").alias("labels"), _text("idx_first").alias("idx_first"))
