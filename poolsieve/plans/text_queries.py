"""Queries over texts and over experiment logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import acquire, analytics, greedy, metrics, overlap, shared
from ..session import table
from .providers import PROBAS, REPLIES, TOKENS_SQL, WORDS_SQL, replies, with_probas
from .registry import ORACLES, query

_GRAMS = "list_transform(range(1, greatest(len({0}) - {1} + 2, 1)), lambda i: array_to_string({0}[i:i + {1} - 1], ' '))"


@query("words_normalized", f"select doc_id, len({WORDS_SQL.format('text')})::bigint as n, md5(array_to_string({WORDS_SQL.format('text')}, ' ')) as digest from documents")
def words_normalized(spark, d):  # noqa: ANN001, ANN201
    w = tx.words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


@query("ngram_counts", f"""with t as (select doc_id, {TOKENS_SQL.format('text')} as t from documents), g as (select doc_id, 1 as n, unnest({_GRAMS.format('t', 1)}) as gram from t union all select doc_id, 2, unnest({_GRAMS.format('t', 2)}) from t)
select n, doc_id, count(*) as total, count(distinct gram) as different from g group by all""")
def ngram_counts(spark, d):  # noqa: ANN001, ANN201
    return overlap.gram_totals(table(spark, d, "documents"), "doc_id", tx.tokens(F.col("text"))).withColumnRenamed("i", "doc_id")


def _novel(n: int) -> None:
    head = f"with {REPLIES}, w as (select id, {WORDS_SQL.format('pred')} as p, {WORDS_SQL.format('ref')} as r from replies), g as (select id, p, {_GRAMS.format('p', n)} as a, {_GRAMS.format('r', n)} as b from w)"

    @query(f"novel_ngrams_{n}", f"{head} select id, round(len(list_filter(a, lambda x: not list_contains(b, x))) / len(a)::double, 6) as share from g where len(a) > 0")
    def novel(spark, d):  # noqa: ANN001, ANN202
        r = replies(spark, d).withColumn("share", F.round(tx.novel_share(tx.words(F.col("pred")), tx.words(F.col("ref")), n), 6))
        return r.where("share is not null").select("id", "share")

    @query(f"ngram_overlap_{n}", f"""{head}, c as (select id, p, list_distinct(flatten(list_transform(list_intersect(a, b), lambda x: string_split(x, ' ')))) as c from g where len(a) > 0)
select id, round(1 - len(list_filter(p, lambda x: list_contains(c, x))) / len(p)::double, 6) as share from c""")
    def uncopied(spark, d):  # noqa: ANN001, ANN202
        r = replies(spark, d).withColumn("share", F.round(tx.uncopied_share(tx.words(F.col("pred")), tx.words(F.col("ref")), n), 6))
        return r.where("share is not null").select("id", "share")


for _n in (1, 2, 3, 4):
    _novel(_n)

_PARTS = f"""with {REPLIES}, t as (select id, {TOKENS_SQL.format('pred')} as p, {TOKENS_SQL.format('ref')} as r from replies),
g as (select id, 1 as n, {_GRAMS.format('p', 1)} as a, {_GRAMS.format('r', 1)} as b, len(r) as size from t union all select id, 2, {_GRAMS.format('p', 2)}, {_GRAMS.format('r', 2)}, len(r) from t),
x as (select id, n, unnest(a) as gram from g), y as (select id, n, unnest(b) as gram from g),
xc as (select id, n, gram, count(*) as c from x group by all), yc as (select id, n, gram, count(*) as c from y group by all),
common as (select id, n, sum(least(xc.c, yc.c)) as c from xc join yc using (id, n, gram) group by all),
f as (select id, n, size, coalesce(2 * c / nullif(len(a) + len(b), 0)::double, 0) as f from g left join common using (id, n))"""


def _rouge(n: int) -> None:
    @query(f"rouge{n}_f", f"{_PARTS} select id, round(f, 6) as f from f where n = {n} and len_ok".replace("len_ok", "id in (select id from g where n = " + str(n) + " and len(a) + len(b) > 0)"))
    def run(spark, d):  # noqa: ANN001, ANN202
        p = overlap.rouge_parts(replies(spark, d), "id", "pred", "ref").where(F.col("n") == n)
        return p.select("id", F.round(overlap.f_measure(F.col("common"), F.col("n_pred"), F.col("n_label")), 6).alias("f"))


_rouge(1)
_rouge(2)


@query("rouge_scaled_mean", f"{_PARTS} select round(100 * sum(f) filter (where n = 1) / count(*) filter (where n = 1 and size > 0), 6) as rouge1, round(100 * sum(f) filter (where n = 2) / count(*) filter (where n = 2 and size > 1), 6) as rouge2 from f")
def rouge_scaled_mean(spark, d):  # noqa: ANN001, ANN201
    return overlap.rouge_scores(replies(spark, d), "id", "pred", "ref").select(F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


@query("rouge_l")
def rouge_l(spark, d):  # noqa: ANN001, ANN201
    return overlap.rouge_scores(replies(spark, d), "id", "pred", "ref", stem=True).select("rougeL")


@query("rouge_lsum")
def rouge_lsum(spark, d):  # noqa: ANN001, ANN201
    return overlap.summary_lcs(replies(spark, d), "pred", "ref").select("id", "rouge_lsum")


_BLEU_COUNTS = f"""with {REPLIES}, t as (select id, list_filter(regexp_split_to_array(pred, '\\s+'), lambda x: x <> '') as p, list_filter(regexp_split_to_array(ref, '\\s+'), lambda x: x <> '') as r from replies),
o as (select unnest([1, 2]) as n), x as (select id, n, unnest(list_transform(range(1, greatest(len(p) - n + 2, 1)), lambda i: array_to_string(p[i:i + n - 1], ' '))) as gram from t, o),
y as (select id, n, unnest(list_transform(range(1, greatest(len(r) - n + 2, 1)), lambda i: array_to_string(r[i:i + n - 1], ' '))) as gram from t, o),
xc as (select id, n, gram, count(*) as c from x group by all), yc as (select id, n, gram, count(*) as c from y group by all)
select n::bigint as n, sum(xc.c)::bigint as possible, sum(case when yc.c is null then 0 else least(xc.c, yc.c) end)::bigint as matches from xc left join yc using (id, n, gram) group by n"""
_BLEU = _BLEU_COUNTS.replace("unnest([1, 2])", "unnest([1, 2, 3, 4])").replace("\nselect n::bigint as n, sum", ",\nm as (select n::bigint as n, sum") + """),
l as (select sum(len(p)) as hyp, sum(len(r)) as ref from t)
select round(case when min(matches) = 0 then 0 else 100 * least(1, exp(1 - any_value(ref) / any_value(hyp))) * exp(avg(ln(greatest(matches, 1) / possible))) end, 6)::double as bleu from m, l"""


@query("corpus_bleu", _BLEU)
def corpus_bleu(spark, d):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(overlap.corpus_bleu(replies(spark, d), "id", "pred", "ref"),)], "bleu double").select(F.round("bleu", 6).alias("bleu"))


@query("bleuvar_topk", f"""with {REPLIES}, g as (select id, unnest([0, 1, 2]) as i, unnest([pred, ref, pred || ' ' || ref]) as t from replies),
w as (select id, i, list_filter(regexp_split_to_array(case when trim(t) = '' then 'CLS' else t end, '\\s+'), lambda x: x <> '') as w from g),
x as (select id, i, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda k: array_to_string(w[k:k + n - 1], ' '))) as gram from w, (select unnest([1, 2, 3, 4]) as n)),
c as (select id, i, n, gram, count(*) as c from x group by all),
m as (select a.id, a.i, b.i as j, a.n, sum(least(a.c, b.c)) as m from c a join c b using (id, n, gram) where a.i <> b.i group by all),
p as (select a.id, a.i, b.i as j, n, len(a.w) as hyp, len(b.w) as ref, len(a.w) - n + 1 as possible from w a join w b on a.id = b.id and a.i <> b.i, (select unnest([1, 2, 3, 4]) as n)),
z as (select p.*, coalesce(m, 0) as m, count(*) filter (where coalesce(m, 0) = 0) over (partition by id, i, j order by n) as none from p left join m using (id, i, j, n)),
b as (select id, i, j, case when max(m) filter (where n = 1) = 0 then 0 else 100 * least(1, exp(1 - any_value(ref) / any_value(hyp))) * exp(avg(ln(case when m > 0 then m else 2.0 ** -none end / possible)) filter (where possible > 0)) end as bleu from z group by all)
select id, round(avg((1 - round(bleu, 4) / 100) ** 2), 6) as score from b group by id order by score desc, id limit 10""")
def bleuvar_topk(spark, d):  # noqa: ANN001, ANN201
    r = replies(spark, d).select("id", F.array("pred", "ref", F.concat_ws(" ", "pred", "ref")).alias("g"))
    scored = acquire.bleu_variance(r, "g", "id").select("id", F.round("score", 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(10)


@query("gen_len", f"with {REPLIES} select round(avg(len(list_filter(regexp_split_to_array(pred, '\\s+'), lambda x: length(x) > 2))), 6) as gen_len from replies")
def gen_len(spark, d):  # noqa: ANN001, ANN201
    ids = F.transform(tx.whitespace_tokens(F.col("pred")), lambda w: F.when(F.length(w) > 2, F.length(w)).otherwise(0))
    return metrics.generated_length(replies(spark, d), ids).select(F.round("gen_len", 6).alias("gen_len"))


_PAIRS = f"""with b as (select item_id, {TOKENS_SQL.format('text')} as t from benchmark), g as (select item_id, 1 as n, unnest({_GRAMS.format('t', 1)}) as gram from b union all select item_id, 2, unnest({_GRAMS.format('t', 2)}) from b),
c as (select item_id, n, gram, count(*) as c from g group by all), s as (select item_id, n, sum(c) as s from c group by all),
o as (select x.n, x.item_id as i, y.item_id as j, sum(least(x.c, y.c)) as common from c x join c y using (n, gram) group by all),
p as (select o.*, common / a.s as recall, common / b.s as precision from o join s a on a.item_id = i and a.n = o.n join s b on b.item_id = j and b.n = o.n)"""


def _pairs(spark, d):  # noqa: ANN001, ANN202
    g = overlap.gram_counts(table(spark, d, "benchmark"), "item_id", tx.tokens(F.col("text")))
    return g, overlap.pair_overlap(g, g)


@query("pairwise_rouge_recall", f"{_PAIRS} select n::bigint as n, i, j, round(recall, 6) as recall from p")
def pairwise_rouge_recall(spark, d):  # noqa: ANN001, ANN201
    return _pairs(spark, d)[1].select(F.col("n").cast("long"), "i", "j", F.round("recall", 6).alias("recall"))


@query("pairwise_rouge_precision", f"{_PAIRS} select n::bigint as n, i, j, round(precision, 6) as precision, round(2 * recall * precision / (recall + precision + 1e-15), 6) as f1 from p")
def pairwise_rouge_precision(spark, d):  # noqa: ANN001, ANN201
    return _pairs(spark, d)[1].select(F.col("n").cast("long"), "i", "j", F.round("precision", 6).alias("precision"), F.round("f1", 6).alias("f1"))


@query("pairwise_rouge_above", f"""with t as (select doc_id, {TOKENS_SQL.format('text')} as t from documents), g as (select doc_id, unnest({_GRAMS.format('t', 2)}) as gram from t),
c as (select doc_id, gram, count(*) as c from g group by all), s as (select doc_id, sum(c) as s from c group by all),
o as (select x.doc_id as i, y.doc_id as j, sum(least(x.c, y.c)) as common from c x join c y on x.gram = y.gram and x.doc_id < y.doc_id group by all)
select i, j, common::bigint as common, round(2 * common / (a.s + b.s), 6) as f1 from o join s a on a.doc_id = i join s b on b.doc_id = j where 2 * common / (a.s + b.s) >= 0.5""")
def pairwise_rouge_above(spark, d):  # noqa: ANN001, ANN201
    """Pairs of documents that share half of their bigrams."""
    return shared.texts_above(table(spark, d, "documents"), "doc_id", tx.tokens(F.col("text")), 2, 0.5).select("i", "j", "common", F.round("f1", 6).alias("f1"))


@query("mmr_k3", _PAIRS.replace("with b as", "with recursive b as").replace("p as (", "p as materialized (", 1) + """,
items as (select distinct i from p),
step(k, picked, scores) as (select 0, []::bigint[], []::double[] union all
    select k + 1, list_append(picked, best.i), list_append(scores, best.s) from step, lateral (
        select arg_max(i, (s, -i)) as i, max(s) as s from (
            select i, round(case when min(v) >= 0 then sqrt(product(greatest(v, 0))) else sqrt(product(greatest(v + 1, 0))) - 1 end, 9) as s from (
                select i, n, 0.5 * (coalesce(sum(precision) filter (where not list_contains(picked, j)), 0) - 1) / greatest(1, (select count(*) from items) - k - 1)
                    - 0.5 * coalesce(max(recall) filter (where list_contains(picked, j)), 0) as v
                from p where not list_contains(picked, i) group by i, n) group by i)) best where k < 3)
select unnest(range(3)) as ord, unnest(picked) as item_id, round(unnest(scores), 6) as score from step where k = 3""")
def mmr_k3(spark, d):  # noqa: ANN001, ANN201
    g, pairs = _pairs(spark, d)
    picks = greedy.mmr(pairs.select("n", "i", "j", "common"), g.groupBy("n", "i").agg(F.sum("c").alias("total")), 3)
    return picks.frame(spark, "item_id").select("ord", "item_id", F.round("score", 6).alias("score"))


_F1 = ORACLES["mmr_k3"].replace("common / b.s as precision from", "common / b.s as precision, 2 * common / (a.s + b.s) as f1 from").replace("sum(precision)", "sum(f1)").replace("max(recall)", "max(f1)")


@query("mmr_f1_k3", _F1)
def mmr_f1_k3(spark, d):  # noqa: ANN001, ANN201
    g, pairs = _pairs(spark, d)
    picks = greedy.mmr(pairs.select("n", "i", "j", "common"), g.groupBy("n", "i").agg(F.sum("c").alias("total")), 3, f1=True)
    return picks.frame(spark, "item_id").select("ord", "item_id", F.round("score", 6).alias("score"))


@query("accuracy_f1", f"""with {PROBAS}, r as (select label, list_position(p, list_max(p)) - 1 as pred from probas), k as (select label as k, count(*) as support from r group by 1), s as (select pred as k, count(*) as said from r group by 1), h as (select label as k, count(*) as hit from r where label = pred group by 1),
f as (select k, coalesce(support, 0) as support, coalesce(hit, 0) as hit, 2 * coalesce(hit, 0) / (coalesce(support, 0) + coalesce(said, 0))::double as f1 from k full join s using (k) left join h using (k))
select round(sum(hit) / sum(support), 6) as accuracy, round(sum(hit) / sum(support), 6) as f1_micro, round(avg(f1), 6) as f1_macro, round(sum(f1 * support) / sum(support), 6) as f1_weighted from f""")
def accuracy_f1(spark, d):  # noqa: ANN001, ANN201
    from ..functions.proba import argmax

    got = metrics.classification(with_probas(spark, d).withColumn("pred", argmax(F.col("probas"))), "label", "pred")
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


_NER = "list_transform(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''), lambda w: case length(w) % 5 when 0 then 'B-A' when 1 then 'I-A' when 2 then 'B-B' when 3 then 'I-B' else 'O' end)"


def _tags(c: str):  # noqa: ANN202
    names = F.array(*[F.lit(x) for x in ("B-A", "I-A", "B-B", "I-B", "O")])
    return F.transform(tx.whitespace_tokens(F.col(c)), lambda x: F.get(names, F.length(x) % 5))


def _spans(c: str, name: str) -> str:
    return f"""{name}_t as (select id, unnest({_NER.format(c)}) as tag, generate_subscripts({_NER.format(c)}, 1) as pos from replies),
{name}_h as (select *, split_part(tag, '-', 1) as kind, nullif(split_part(tag, '-', 2), '') as type, lag(nullif(split_part(tag, '-', 2), '')) over (partition by id order by pos) as before from {name}_t),
{name}_g as (select *, sum(case when kind = 'B' or type is distinct from before then 1 else 0 end) over (partition by id order by pos) as g from {name}_h),
{name} as (select id, type, min(pos) as a, max(pos) as b from {name}_g where kind in ('B', 'I') group by id, g, type)"""


@query("entity_f1", f"""with {REPLIES}, {_spans('ref', 'l')}, {_spans('pred', 'p')}, c as (select type, count(*) as support, 0 as said, 0 as hit from l group by type union all select type, 0, count(*), 0 from p group by type
union all select type, 0, 0, count(*) from l join p using (id, type, a, b) group by type), s as (select type, sum(support) as support, sum(said) as said, sum(hit) as hit from c group by type union all select 'overall', sum(support), sum(said), sum(hit) from c)
select type, round(hit / said, 6) as precision, round(hit / support, 6) as recall, round(2 * hit / (said + support), 6) as f1, support::bigint as support from s""")
def entity_f1(spark, d):  # noqa: ANN001, ANN201
    r = replies(spark, d).select("id", _tags("ref").alias("l"), _tags("pred").alias("p"))
    got = metrics.entity_f1(r, "id", "l", "p")
    return got.select("type", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long"))


@query("seed_mean_std_ci", """with m as (select event_type, user_id % 9 as seed, avg(value) as v from events group by all), g as (select event_type, avg(v) as mean, stddev_samp(v) as std, count(v) as n from m group by all)
select event_type, round(mean, 6) as mean, round(std, 6) as std, n, round(mean - 2.2621571627409915 * std / sqrt(n), 6) as low, round(mean + 2.2621571627409915 * std / sqrt(n), 6) as high from g where n = 9""")
def seed_mean_std_ci(spark, d):  # noqa: ANN001, ANN201
    m = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 9).alias("seed")).agg(F.avg("value").alias("v"))
    got = analytics.bands(m, ["event_type"], "v").where("n = 9")
    return got.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "n", *[F.round(c, 6).alias(c) for c in ("low", "high")])


_LONG = "l as (select event_type, user_id % 9 as seed, (event_id % 4)::int as iteration, round(avg(value), 6) as value from events group by all)"


def _long(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 9).alias("seed"), (F.col("event_id") % 4).cast("int").alias("iteration")).agg(F.round(F.avg("value"), 6).alias("value"))


@query("metrics_wide", f"with {_LONG} select event_type, seed, " + ", ".join(f"max(value) filter (where iteration = {i}) as f1_{i}" for i in range(4)) + " from l group by all")
def metrics_wide(spark, d):  # noqa: ANN001, ANN201
    return analytics.wide(_long(spark, d), ["event_type", "seed"], 4)


@query("metrics_unpivot", f"with {_LONG} select event_type, seed, iteration, value from (select distinct event_type, seed from l) cross join (select unnest(range(4))::int as iteration) left join l using (event_type, seed, iteration)")
def metrics_unpivot(spark, d):  # noqa: ANN001, ANN201
    return analytics.long(analytics.wide(_long(spark, d), ["event_type", "seed"], 4), ["event_type", "seed"])


@query("metrics_padded", f"with {_LONG} select event_type, seed, iteration, value from (select distinct event_type, seed from l) cross join (select unnest(range(6))::int as iteration) left join l using (event_type, seed, iteration)")
def metrics_padded(spark, d):  # noqa: ANN001, ANN201
    return analytics.padded(_long(spark, d), ["event_type", "seed"], 6)


@query("pretty_names", "select event_id, case when event_type like 'click%' then 'C' || substr(event_type, 6) when event_type like 'v%' then 'V' || substr(event_type, 2) else event_type end as name from events")
def pretty_names(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "events").select("event_id", analytics.pretty(F.col("event_type"), {"click": "C", "v": "V"}).alias("name"))


@query("checkpoint_rotation", "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id desc) as k from documents) where k > 3")
def checkpoint_rotation(spark, d):  # noqa: ANN001, ANN201
    files = table(spark, d, "documents").select("source", "doc_id", F.concat(F.lit("checkpoint-"), F.col("doc_id").cast("string")).alias("name"))
    return analytics.rotated(files, 3, "source", "name").select("source", "doc_id")


@query("aligned_token_labels", """with t as (select conv_id * 1000 + turn as id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as w, generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1) as k from conversations)
select id, unnest(generate_series(k * 2 - 1, k * 2)) as pos, unnest([length(w) % 5, case when length(w) % 5 % 2 = 1 then length(w) % 5 + 1 else length(w) % 5 end])::int as label from t""")
def aligned_token_labels(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.transform(tx.whitespace_tokens(F.col("text")), lambda w: F.length(w) % 5).alias("labels"))
    c = c.where(F.size("labels") > 0)
    ids = F.flatten(F.transform(F.sequence(F.lit(0), F.size("labels") - 1), lambda i: F.array(i, i)))
    framed = F.concat(F.array(F.lit(None).cast("int")), ids, F.array(F.lit(None).cast("int")))
    flat = c.select("id", F.posexplode(tx.align_labels(F.col("labels"), framed, "inside")).alias("pos", "label")).where("label <> -100")
    return flat.select("id", F.col("pos").cast("long"), "label")
