"""Queries over the pool of documents: selection, sub-sampling, preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import whitespace_tokens
from ..operators import acquire, corpus, rows
from ..session import hash01, table
from .providers import SEQ_SCORES, hash_sql, labelled, pool, seq_scores
from .registry import query

POOL = "pool as (select * from documents where doc_id not in (select doc_id from labels))"
UNC = f"{SEQ_SCORES}, unc as (select doc_id, -seq_score as uncertainty from seq_scores)"


def _uncertain(spark: SparkSession, d: str) -> DataFrame:
    return seq_scores(spark, d).select("doc_id", (-F.col("seq_score")).alias("uncertainty"))


@query("pool_anti_join", f"with {POOL} select doc_id, source from pool")
def pool_anti_join(spark, d):  # noqa: ANN001, ANN201
    return pool(spark, d).select("doc_id", "source")


@query("labeled_semi_join", "select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def labeled_semi_join(spark, d):  # noqa: ANN001, ANN201
    return labelled(spark, d).select("doc_id", "lang")


@query("gather_by_ids", "with ids as (select unnest([7, 3, 7, 11]) as doc_id, unnest([0, 1, 2, 3]) as ord) select ord::bigint as ord, doc_id::bigint as doc_id, source from ids join documents using (doc_id)")
def gather_by_ids(spark, d):  # noqa: ANN001, ANN201
    ids = spark.createDataFrame(list(enumerate([7, 3, 7, 11])), "ord long, id long")
    return rows.gather(table(spark, d, "documents"), ids, "doc_id").select("ord", "doc_id", "source")


@query("uncertainty_topk", f"with {UNC} select doc_id, uncertainty, row_number() over (order by uncertainty desc, doc_id) - 1 as ord from unc qualify ord < 10")
def uncertainty_topk(spark, d):  # noqa: ANN001, ANN201
    top = acquire.by_uncertainty(seq_scores(spark, d), F.col("seq_score"), 10, "doc_id")
    return top.select("doc_id", "uncertainty", F.col("ord").cast("long"))


@query("uncertainty_filter_absolute", f"""with {UNC}, c as (select least(count(*) filter (where uncertainty >= 7.5), count(*) - 10) as c from unc),
r as (select *, row_number() over (order by uncertainty desc, doc_id) - 1 as k from unc) select doc_id, uncertainty, k - c as ord from r, c where k >= c and k < c + 10""")
def uncertainty_filter_absolute(spark, d):  # noqa: ANN001, ANN201
    top = acquire.filtered_by_uncertainty(_uncertain(spark, d), "uncertainty", 7.5, 10, "doc_id")
    return top.select("doc_id", "uncertainty", F.col("ord").cast("long"))


@query("uncertainty_filter_relative", f"""with {UNC}, c as (select least(ceil(count(*) * 0.05)::bigint, count(*) - 10) as c from unc),
r as (select *, row_number() over (order by uncertainty desc, doc_id) - 1 as k from unc) select doc_id, uncertainty, k - c as ord from r, c where k >= c and k < c + 10""")
def uncertainty_filter_relative(spark, d):  # noqa: ANN001, ANN201
    top = acquire.filtered_by_uncertainty(_uncertain(spark, d), "uncertainty", 0.05, 10, "doc_id", mode="relative")
    return top.select("doc_id", "uncertainty", F.col("ord").cast("long"))


@query("metric_filter_topk", f"""with {UNC}, m as (select doc_id, uncertainty, n_chars from unc join documents using (doc_id)),
c as (select least(count(*) filter (where n_chars <= 300), count(*) - 10) as c from m), r as (select *, row_number() over (order by n_chars, doc_id) as k from m)
select doc_id, uncertainty, row_number() over (order by uncertainty desc, doc_id) - 1 as ord from r, c where k > c qualify ord < 10""")
def metric_filter_topk(spark, d):  # noqa: ANN001, ANN201
    m = _uncertain(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return acquire.filtered_by_metric(m, "n_chars", "uncertainty", 300, 10, "doc_id").select("doc_id", "uncertainty", F.col("ord").cast("long"))


@query("scatter_scores_left_join", f"with {UNC} select d.doc_id, coalesce(u.uncertainty, 'inf'::double) as uncertainty from documents d left join unc u using (doc_id)")
def scatter_scores_left_join(spark, d):  # noqa: ANN001, ANN201
    return acquire.scatter_scores(table(spark, d, "documents").select("doc_id"), _uncertain(spark, d), "doc_id", "uncertainty")


@query("random_hash_sample", f"with {POOL} select doc_id from pool order by {hash_sql(7, 'doc_id')}, doc_id limit 50")
def random_hash_sample(spark, d):  # noqa: ANN001, ANN201
    return rows.sample(pool(spark, d), 50, "doc_id", 7).select("doc_id")


@query("pool_subsample_divisor", f"with {POOL}, r as (select doc_id, row_number() over (order by {hash_sql(3, 'doc_id')}, doc_id) as k from pool) select doc_id from r where k <= round_even((select count(*) from pool) / 4.0, 0)")
def pool_subsample_divisor(spark, d):  # noqa: ANN001, ANN201
    return rows.subsample(pool(spark, d), 4, "doc_id", 3).select("doc_id")


_BUDGET = r"""with docs as (select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as tok from documents),
r as (select *, sum(tok) over (order by n desc, doc_id rows unbounded preceding) as cum from (select docs.*, n_chars as n from docs join documents using (doc_id)))
select doc_id, cum::bigint as cum from r where """


def _budget(spark, d, include):  # noqa: ANN001, ANN202
    got = rows.token_budget(table(spark, d, "documents"), F.size(whitespace_tokens(F.col("text"))), 20000, F.col("n_chars").desc(), F.col("doc_id"), include_last=include)
    return got.select("doc_id", "cum")


@query("token_budget_include_last", _BUDGET + "cum - tok <= 20000")
def token_budget_include_last(spark, d):  # noqa: ANN001, ANN201
    return _budget(spark, d, True)


@query("token_budget_exclude_last", _BUDGET + "cum <= 20000")
def token_budget_exclude_last(spark, d):  # noqa: ANN001, ANN201
    return _budget(spark, d, False)


@query("stratified_subset", f"""select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by {hash_sql(5, 'doc_id')}, doc_id) as k from documents)
where k <= case lang when 'en' then 20 when 'fr' then 10 when 'de' then 5 end""")
def stratified_subset(spark, d):  # noqa: ANN001, ANN201
    return rows.stratified(table(spark, d, "documents"), {"en": 20, "fr": 10, "de": 5}, "lang", "doc_id", 5).select("doc_id", "lang")


@query("balanced_per_class", f"select doc_id, quality from (select *, row_number() over (partition by quality order by {hash_sql(5, 'doc_id')}, doc_id) as k from labels) where k <= 15")
def balanced_per_class(spark, d):  # noqa: ANN001, ANN201
    return rows.balanced(table(spark, d, "labels"), 15, "quality", "doc_id", 5).select("doc_id", "quality")


@query("fixed_length_resample", f"""with c as (select ceil(5056 / count(*)::double)::bigint as c from documents),
r as (select doc_id, k as copy from documents, c, range(0, (select c from c)) t(k)) select doc_id, copy from r order by copy, {hash_sql(9, 'doc_id', 'copy')}, doc_id limit 5056""")
def fixed_length_resample(spark, d):  # noqa: ANN001, ANN201
    return rows.fixed_length(table(spark, d, "documents").select("doc_id"), 5056, "doc_id", 9).select("doc_id", F.col("copy").cast("long"))


@query("quantile_length_filter", r"""with t as (select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::double as n from documents),
q as (select quantile_cont(n, 0.1) as lo, quantile_cont(n, 0.9) as hi from t) select doc_id, n::bigint as n from t, q where n between lo and hi""")
def quantile_length_filter(spark, d):  # noqa: ANN001, ANN201
    t = table(spark, d, "documents").select("doc_id", F.size(whitespace_tokens(F.col("text"))).cast("long").alias("n"))
    return rows.within_quantiles(t, F.col("n"), 0.1, 0.9)


@query("label_not_in", "select doc_id, lang from documents where lang not in ('fr', 'de')")
def label_not_in(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").where(~F.col("lang").isin("fr", "de")).select("doc_id", "lang")


@query("replicate_rows", "select doc_id, k as copy from labels, range(0, 3) t(k)")
def replicate_rows(spark, d):  # noqa: ANN001, ANN201
    return rows.replicate(table(spark, d, "labels"), 3).select("doc_id", F.col("copy").cast("long"))


@query("split_offsets_ids", """select doc_id, row_number() over (order by doc_id) - 1 as id from documents where doc_id in (select doc_id from labels)
union all select doc_id, (select count(*) from documents where doc_id in (select doc_id from labels)) + row_number() over (order by doc_id) - 1 from documents where doc_id not in (select doc_id from labels)""")
def split_offsets_ids(spark, d):  # noqa: ANN001, ANN201
    a, b = rows.numbered([labelled(spark, d).select("doc_id"), pool(spark, d).select("doc_id")], "doc_id")
    return a.unionByName(b).select("doc_id", F.col("id").cast("long"))


@query("hash_train_test_split", f"""select doc_id, case when k <= round_even(n * 0.2, 0) then 'test' else 'train' end as split
from (select doc_id, row_number() over (order by {hash_sql(11, 'doc_id')}, doc_id) as k, count(*) over () as n from documents)""")
def hash_train_test_split(spark, d):  # noqa: ANN001, ANN201
    train, test = rows.split(table(spark, d, "documents").select("doc_id"), 0.2, "doc_id", 11)
    return train.withColumn("split", F.lit("train")).union(test.withColumn("split", F.lit("test")))


@query("ups_probability", f"""with {UNC}, r as (select doc_id, (row_number() over (order by uncertainty desc, doc_id) - 1) / (count(*) over ())::double as r from unc)
select doc_id, round(exp(-greatest(0.0, r - 0.1) / 0.2), 6) as probability from r""")
def ups_probability(spark, d):  # noqa: ANN001, ANN201
    r = acquire.ranked(_uncertain(spark, d), "uncertainty", "doc_id")
    return r.select("doc_id", F.round(acquire.ups_probability(F.col("rank_share"), 0.1, 0.2), 6).alias("probability"))


@query("ups_accept", f"""with {UNC}, r as (select doc_id, (row_number() over (order by uncertainty desc, doc_id) - 1) / (count(*) over ())::double as r from unc)
select doc_id from r where {hash_sql(13, 'doc_id')} < exp(-greatest(0.0, r - 30 / (select count(*) from unc)::double) / 0.1)""")
def ups_accept(spark, d):  # noqa: ANN001, ANN201
    return acquire.ups_subsample(_uncertain(spark, d), "uncertainty", 30, 0.1, "doc_id", 13).select("doc_id")


@query("naive_subsample", f"with {UNC} select doc_id from unc order by uncertainty desc, doc_id limit (select (0.1 * count(*))::double::int - case when (0.1 * count(*))::double::int > 0.1 * count(*) then 1 else 0 end from unc)")
def naive_subsample(spark, d):  # noqa: ANN001, ANN201
    return acquire.naive_subsample(_uncertain(spark, d), "uncertainty", 0.1, "doc_id").select("doc_id")


@query("minmax_uncertainty", f"with {UNC} select doc_id, round((uncertainty - min(uncertainty) over ()) / (max(uncertainty) over () - min(uncertainty) over ()), 6) as normalised from unc")
def minmax_uncertainty(spark, d):  # noqa: ANN001, ANN201
    return acquire.minmax(_uncertain(spark, d), "uncertainty").select("doc_id", F.round("normalised", 6).alias("normalised"))


@query("initial_split_stratified", f"""with n as (select lang, round_even(100 * count(*) / (select count(*) from documents)::double, 0) as quota from documents group by lang),
r as (select doc_id, lang, row_number() over (partition by lang order by {hash_sql(21, 'doc_id')}, doc_id) as k from documents)
select doc_id, k <= quota as chosen from r join n using (lang)""")
def initial_split_stratified(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").select("doc_id", "lang")
    chosen, rest = rows.initial_split(docs, 100, "doc_id", 21, label="lang")
    return chosen.select("doc_id", F.lit(True).alias("chosen")).union(rest.select("doc_id", F.lit(False)))


@query("vocab_first_seen", r"""with t as (select doc_id, unnest(w) as token, generate_subscripts(w, 1) as pos from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from documents)),
f as (select token, min((doc_id, pos)) as place from t group by token) select token, row_number() over (order by place) - 1 as token_id from f""")
def vocab_first_seen(spark, d):  # noqa: ANN001, ANN201
    from ..functions.text import tokens

    return corpus.vocabulary(table(spark, d, "documents"), "doc_id", tokens(F.col("text"))).select("token", F.col("token_id").cast("long"))


@query("lm_block_chunks", r"""with t as (select doc_id, unnest(w) as token, generate_subscripts(w, 1) as pos from (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents)),
n as (select token, row_number() over (order by doc_id, pos) - 1 as k from t)
select k // 512 as block, md5(string_agg(token, ' ' order by k)) as digest from n group by 1 having count(*) = 512""")
def lm_block_chunks(spark, d):  # noqa: ANN001, ANN201
    got = corpus.blocks(table(spark, d, "documents"), "doc_id", whitespace_tokens(F.col("text")), 512)
    return got.select("block", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("line_by_line", r"""with l as (select doc_id, unnest(s) as line_text, generate_subscripts(s, 1) - 1 as line from (select doc_id, string_split(text, chr(10)) as s from documents))
select doc_id, line::bigint as line, array_to_string(list_filter(regexp_split_to_array(line_text, '\s+'), lambda x: x <> '')[1:16], ' ') as head from l where trim(line_text) <> ''""")
def line_by_line(spark, d):  # noqa: ANN001, ANN201
    got = corpus.lines(table(spark, d, "documents"), "doc_id", F.col("text"), 16)
    return got.select("doc_id", F.col("line").cast("long"), F.array_join("tokens", " ").alias("head"))


@query("mlm_mask", f"""with t as (select conv_id * 1000 + turn as id, unnest(a) as t, generate_subscripts(a, 1) - 1 as i from (select *, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: length(x)) as a from conversations)),
h as (select *, {hash_sql(17, "'choose'", 'id', 'i')} < 0.15 as chosen, {hash_sql(17, "'how'", 'id', 'i')} as how, floor({hash_sql(17, "'id'", 'id', 'i')} * 30)::bigint as other from t)
select id, i::bigint as i, (case when not chosen or how >= 0.9 then t when how < 0.8 then 99 else other end)::bigint as input, (case when chosen then t else -100 end)::bigint as target from h""")
def mlm_mask(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.transform(whitespace_tokens(F.col("text")), lambda w: F.length(w)).alias("t"))
    m = corpus.masked(c, "id", F.col("t"), 30, 99, 17)
    flat = m.select("id", F.posexplode(F.arrays_zip("inputs", "targets")).alias("i", "x"))
    return flat.select("id", F.col("i").cast("long"), F.col("x.inputs").alias("input"), F.col("x.targets").alias("target"))


@query("al_loop_3_iterations", f"""with {POOL}, r as (select doc_id, n_chars, row_number() over (order by n_chars desc, doc_id) - 1 as k from pool)
select doc_id, (k // 20)::bigint as iteration, (k % 20)::bigint as ord from r where k < 60""")
def al_loop_3_iterations(spark, d):  # noqa: ANN001, ANN201
    from .loop import PoolState, Spec, run

    def longest(state, n, **_):  # noqa: ANN001, ANN003, ANN202
        return acquire.by_uncertainty(state.pool, -F.col("n_chars"), n, "doc_id")

    keep = ["doc_id", "n_chars"]
    state = PoolState(labelled(spark, d).select(keep), pool(spark, d).select(keep), "doc_id")
    picked = [s for _, s, _ in run(state, Spec(longest, 20, 3))]
    return rows.union(*picked).select("doc_id", F.col("iteration").cast("long"), F.col("ord").cast("long"))


@query("seeded_selections", " union all ".join(f"(with {POOL} select {s}::bigint as seed, doc_id from pool order by {hash_sql(s, 'doc_id')}, doc_id limit 10)" for s in (1, 2, 3)))
def seeded_selections(spark, d):  # noqa: ANN001, ANN201
    p = pool(spark, d)
    return rows.union(*[rows.sample(p, 10, "doc_id", s).select(F.lit(s).cast("long").alias("seed"), "doc_id") for s in (1, 2, 3)])


@query("resume_from_log", "select doc_id, doc_id in (select doc_id from labels) or doc_id % 7 = 0 as labelled from documents")
def resume_from_log(spark, d):  # noqa: ANN001, ANN201
    from .loop import resume

    p, q = pool(spark, d).select("doc_id"), labelled(spark, d).select("doc_id")
    log = p.where("doc_id % 7 = 0").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("iteration"))
    state = resume(q, p, "doc_id", log)
    return state.labelled.withColumn("labelled", F.lit(True)).union(state.pool.withColumn("labelled", F.lit(False)))


@query("batched_map", "select doc_id, length(text) as chars from documents where text is not null")
def batched_map(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return rows.batched_map(docs, lambda b: {"doc_id": b["doc_id"], "chars": [len(t) for t in b["text"]]}, "doc_id long, chars long", 100)
