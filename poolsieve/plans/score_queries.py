"""Queries over probabilities, Monte-Carlo passes, vectors, and greedy selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import proba
from ..functions.vector import group_means, masked_mean
from ..operators import acquire, density, greedy, influence, moments, neighbours, pseudo, rows
from ..session import table
from .providers import _MEANS, PASS_SQL, PROBAS, VECTORS, split_vectors, with_passes, with_probas
from .registry import ORACLES, query


def _score(name: str, expression, sql: str) -> None:  # noqa: ANN001
    @query(name, f"with {PROBAS} select vec_id, round({sql}, 6) as score from probas")
    def run(spark, d):  # noqa: ANN001, ANN202
        return with_probas(spark, d).select("vec_id", F.round(expression(F.col("probas")), 6).alias("score"))


_ENT = "list_sum(list_transform({0}, lambda x: -x * ln(least(greatest(x, 1e-8), 1))))"
_score("least_confidence", proba.least_confidence, "1 - list_max(p)")
_score("entropy", proba.entropy, _ENT.format("p"))
_score("margin", proba.margin, "1 + list_sort(p)[len(p) - 1] - list_max(p)")


@query("softmax_probas", f"with {PROBAS} select vec_id, generate_subscripts(p, 1) - 1 as k, round(unnest(p), 6) as p from probas")
def softmax_probas(spark, d):  # noqa: ANN001, ANN201
    flat = with_probas(spark, d).select("vec_id", F.posexplode("probas").alias("k", "p"))
    return flat.select("vec_id", F.col("k").cast("long"), F.round("p", 6).alias("p"))


_BY_CLASS = "by_class as (select vec_id, label, avg(p) as m, var_pop(p) as v from pass_probas group by all)"


def _passes(name: str, expression, sql: str) -> None:  # noqa: ANN001
    @query(name, f"with {PASS_SQL}, {_BY_CLASS} {sql}")
    def run(spark, d):  # noqa: ANN001, ANN202
        return with_passes(spark, d).select("vec_id", F.round(expression(F.col("passes")), 6).alias("score"))


_passes("mean_entropy", proba.mean_entropy, "select vec_id, round(sum(-m * ln(greatest(m, 1e-8))), 6) as score from by_class group by vec_id")
_passes("bald", proba.bald, "select vec_id, round(sum(-m * ln(greatest(m, 1e-8))) - any_value(e), 6) as score from by_class join (select vec_id, sum(-p * ln(greatest(p, 1e-8))) / 4 as e from pass_probas group by vec_id) using (vec_id) group by vec_id")
_passes("var_ratio", proba.variation_ratio, "select vec_id, round(1 - max(c) / 4.0, 6)::double as score from (select vec_id, best, count(*) as c from (select vec_id, b, arg_max(label, (p, -label)) as best from pass_probas group by all) group by all) group by vec_id")
_passes("sampled_max_prob", proba.sampled_max, "select vec_id, round(1 - max(m), 6) as score from by_class group by vec_id")
_passes("probability_variance", proba.variance, "select vec_id, round(sum(v), 6) as score from by_class group by vec_id")
_passes("mnlp", proba.mnlp, "select vec_id, round(-avg(ln(p)), 6) as score from (select vec_id, b, max(p) as p from pass_probas group by all) group by vec_id")


def _as_tokens(spark, d):  # noqa: ANN001, ANN202
    """Two tokens a row: passes 0 and 1, passes 2 and 3."""
    return with_passes(spark, d).select("vec_id", F.array(F.slice("passes", 1, 2), F.slice("passes", 3, 2)).alias("tokens"))


_TOKENS = f"with {PASS_SQL}, by_token as (select vec_id, b // 2 as t, label, avg(p) as m, var_pop(p) as v from pass_probas group by all)"


@query("mean_entropy_ner", f"{_TOKENS} select vec_id, round(sum(-m * ln(greatest(m, 1e-8))) / 2, 6) as score from by_token group by vec_id")
def mean_entropy_ner(spark, d):  # noqa: ANN001, ANN201
    return _as_tokens(spark, d).select("vec_id", F.round(proba.over_tokens(proba.mean_entropy, F.col("tokens")), 6).alias("score"))


@query("probability_variance_ner", f"{_TOKENS} select vec_id, round(sum(v) / 2, 6) as score from by_token group by vec_id")
def probability_variance_ner(spark, d):  # noqa: ANN001, ANN201
    return _as_tokens(spark, d).select("vec_id", F.round(proba.over_tokens(proba.variance, F.col("tokens")), 6).alias("score"))


@query("bald_ner", f"{_TOKENS} select vec_id, round(sum(-m * ln(greatest(m, 1e-8))) / 2 - any_value(e), 6) as score from by_token join (select vec_id, sum(-p * ln(greatest(p, 1e-8))) / 4 as e from pass_probas group by vec_id) using (vec_id) group by vec_id")
def bald_ner(spark, d):  # noqa: ANN001, ANN201
    return _as_tokens(spark, d).select("vec_id", F.round(proba.over_tokens(proba.bald, F.col("tokens")), 6).alias("score"))


_LOGS = f"with {PASS_SQL}, s as (select vec_id, b, max(p) as p from pass_probas group by all)"


def _log_scores(spark, d):  # noqa: ANN001, ANN202
    return with_passes(spark, d).select("vec_id", F.transform("passes", lambda p: F.log(F.array_max(p))).alias("log_scores"))


@query("esp_mean", f"{_LOGS} select vec_id, round(avg(p), 6) as score from s group by vec_id order by 2, 1 limit 20")
def esp_mean(spark, d):  # noqa: ANN001, ANN201
    scored = acquire.stochastic_scores(_log_scores(spark, d), "log_scores", "mean").withColumn("score", F.round("score", 6))
    return rows.top(scored, 20, F.col("score"), F.col("vec_id")).select("vec_id", "score")


@query("esv_variance", f"{_LOGS} select vec_id, round(var_pop(p), 6) as score from s group by vec_id order by 2 desc, 1 limit 20")
def esv_variance(spark, d):  # noqa: ANN001, ANN201
    scored = acquire.stochastic_scores(_log_scores(spark, d), "log_scores", "var").withColumn("score", F.round("score", 6))
    return rows.top(scored, 20, F.col("score").desc(), F.col("vec_id")).select("vec_id", "score")


@query("class_frequency", "select label, count(*) as n, count(*) / (select count(*) from embeddings)::double as share from embeddings group by label")
def class_frequency(spark, d):  # noqa: ANN001, ANN201
    x = table(spark, d, "embeddings")
    return x.groupBy("label").agg(F.count("*").alias("n"), (F.count("*") / F.lit(float(x.count()))).alias("share"))


@query("class_centroids", "with f as (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) select label, pos, round(avg(x), 6) as m from f group by label, pos")
def class_centroids(spark, d):  # noqa: ANN001, ANN201
    flat = group_means(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("pos", "m"))
    return flat.select("label", F.col("pos").cast("long"), F.round("m", 6).alias("m"))


@query("within_class_scatter", """with f as (select vec_id, label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
m as (select label, pos, avg(x) as m from f group by all), c as (select vec_id, pos, x - m as x from f join m using (label, pos))
select a.pos as i, b.pos as j, round(sum(a.x * b.x) / ((select count(*) from embeddings) - 1), 6) as s from c a join c b using (vec_id) group by all""")
def within_class_scatter(spark, d):  # noqa: ANN001, ANN201
    x = table(spark, d, "embeddings")
    s = moments.moments(x, "label", "embedding").covariance()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(s)], "i long, v array<double>")  # d x d
    return rows.select("i", F.posexplode("v").alias("j", "s")).select("i", F.col("j").cast("long"), F.round("s", 6).alias("s"))


def _neighbours(name: str, measure: str, sql: str) -> None:
    @query(name, f"""with {VECTORS} select p.vec_id, l.vec_id as other, round({sql}, 6) as sim from pool p cross join lab l
qualify row_number() over (partition by p.vec_id order by {sql} desc, l.vec_id) <= 3""")
    def run(spark, d):  # noqa: ANN001, ANN202
        lab, pool = split_vectors(spark, d)
        near = neighbours.nearest(pool, lab, "vec_id", "embedding", 3, measure)
        return near.select(F.col("id").alias("vec_id"), F.explode("near").alias("x")).select("vec_id", "x.other", F.round("x.sim", 6).alias("sim"))


_neighbours("cosine_topk_neighbors", "cosine", "list_cosine_similarity(p.embedding, l.embedding)")
_neighbours("dot_topk_neighbors", "dot", "list_dot_product(p.embedding, l.embedding)")
_neighbours("neg_sq_euclidean_nn", "euclid", "-(list_distance(p.embedding, l.embedding) ** 2)")


@query("self_topk_neighbors", f"""with {VECTORS} select p.vec_id, l.vec_id as other, round(list_dot_product(p.embedding, l.embedding), 6) as sim from vec p cross join vec l
qualify row_number() over (partition by p.vec_id order by list_dot_product(p.embedding, l.embedding) desc, l.vec_id) <= 4""")
def self_topk_neighbors(spark, d):  # noqa: ANN001, ANN201
    """All vectors against all, each other's cells skipped where their bounds allow."""
    x = table(spark, d, "embeddings")
    near = neighbours.nearest(x, x, "vec_id", "embedding", 4)
    return near.select(F.col("id").alias("vec_id"), F.explode("near").alias("x")).select("vec_id", "x.other", F.round("x.sim", 6).alias("sim"))


@query("cosine_pairs", f"with {VECTORS} select p.vec_id, l.vec_id as other, round(list_cosine_similarity(p.embedding, l.embedding), 6) as sim from pool p cross join lab l")
def cosine_pairs(spark, d):  # noqa: ANN001, ANN201
    lab, pool = split_vectors(spark, d)
    return neighbours.similarities(pool, lab, "vec_id", "embedding").select(F.col("id").alias("vec_id"), "other", F.round("sim", 6).alias("sim"))


@query("self_influence", """with g as (select vec_id, unnest(range(4)) as checkpoint, embedding::double[] as x, label + 1 as length from embeddings),
n as (select vec_id, 0.5 * list_sum(list_transform(x[16 * checkpoint + 1:16 * checkpoint + 16], lambda v: v * v)) / length as s from g)
select vec_id, round(avg(s), 6) as score from n group by vec_id""")
def self_influence(spark, d):  # noqa: ANN001, ANN201
    """Sixteen components stand for the gradient at each of four checkpoints."""
    x = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") + 1).alias("length"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("checkpoint"))
    x = x.withColumn("g", F.slice("x", 16 * F.col("checkpoint") + 1, F.lit(16)))
    return influence.self_influence(x, "vec_id", "g", 0.5, "length").select("vec_id", F.round("score", 6).alias("score"))


@query("mean_similarity_linear", f"with {VECTORS} select a.vec_id, round(avg(list_dot_product(a.embedding, b.embedding)), 6) as sim from pool a cross join pool b group by a.vec_id")
def mean_similarity_linear(spark, d):  # noqa: ANN001, ANN201
    from ..functions.vector import dot
    from ..session import literal_vector

    _, pool = split_vectors(spark, d)
    total, n = greedy.vector_sum(pool, "embedding"), pool.count()
    return pool.select("vec_id", F.round(dot(F.col("embedding"), literal_vector(total)) / F.lit(float(n)), 6).alias("sim"))


@query("nearest_centroid", f"""with {VECTORS}, {_MEANS} select vec_id, arg_min(m.label, (round(list_distance(p.embedding, m.c), 9), m.label)) as cluster, round(min(list_distance(p.embedding, m.c)), 6) as distance
from pool p cross join means m group by vec_id""")
def nearest_centroid(spark, d):  # noqa: ANN001, ANN201
    lab, pool = split_vectors(spark, d)
    got = neighbours.nearest_centre(pool, group_means(lab, "label", "embedding"), "label", "embedding")
    return got.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query("min_center_distance", f"with {VECTORS} select p.vec_id, round(min(list_distance(p.embedding, l.embedding)), 6) as distance from pool p cross join lab l group by p.vec_id")
def min_center_distance(spark, d):  # noqa: ANN001, ANN201
    lab, pool = split_vectors(spark, d)
    return neighbours.centre_distance(pool, lab, "vec_id", "embedding").select("vec_id", F.round("distance", 6).alias("distance"))


def _far_sql(tail: str) -> str:
    """Mahalanobis distances over whole vectors; every other row is labelled, so that the covariances are regular on small tables too. The inverse is
    taken by Gauss and Jordan, a row a step."""
    inverse = lambda n, cov: f"""start_{n} as (select list(list_concat(r, list_transform(range(1, len(r) + 1), lambda k: case when k = i then 1.0::double else 0.0::double end)) order by i) as m from (select i, list(s order by j) as r from {cov} group by i)),
steps_{n}(k, m) as (select 1, m from start_{n} union all select k + 1, list_transform(m, lambda row, i: case when i = k then p else list_transform(list_zip(row, p), lambda z: z[1] - row[k] * z[2]) end)
    from (select k, m, list_transform(m[k], lambda v: v / m[k][k]) as p from steps_{n} where k <= len(m))),
inv_{n} as (select list_transform(m, lambda r: r[len(m) + 1:]) as w from steps_{n} where k = len(m) + 1)"""  # noqa: E731
    form = lambda w, d: f"sqrt(list_sum(list_transform(list_zip({w}, {d}), lambda z: list_dot_product(z[1], {d}) * z[2])))"
    return f"""with recursive v as (select vec_id, label, embedding::double[] as x from embeddings), l as (select * from v where vec_id % 2 = 0), p as (select * from v where vec_id % 2 = 1),
flat as (select vec_id, label, unnest(x) as v, generate_subscripts(x, 1) as i from l),
mean as (select label, i, avg(v) as m from flat group by all), one as (select i, avg(v) as m from flat group by i),
own as (select vec_id, i, v - m as d from flat join mean using (label, i)), off as (select vec_id, i, v - m as d from flat join one using (i)),
cov as (select a.i, b.i as j, sum(a.d * b.d) / ((select count(*) from l) - 1) as s from own a join own b using (vec_id) group by all),
cov_one as (select a.i, b.i as j, sum(a.d * b.d) / ((select count(*) from l) - 1) as s from off a join off b using (vec_id) group by all),
{inverse("class", "cov")}, {inverse("one", "cov_one")},
centre as (select label, list(m order by i) as c from mean group by label), centre_one as (select list(m order by i) as c from one),
diff as (select vec_id, label, list_transform(list_zip(x, c), lambda z: z[1] - z[2]) as d from (select vec_id, centre.label, x, c from p cross join centre)),
near as (select vec_id, min({form("w", "d")}) as near from diff cross join inv_class group by vec_id),
diff_one as (select vec_id, x[1] as first, list_transform(list_zip(x, c), lambda z: z[1] - z[2]) as d from p cross join centre_one),
far as (select vec_id, first, {form("w", "d")} as far from diff_one cross join inv_one) {tail}"""


def _halves(spark, d):  # noqa: ANN001, ANN202
    x = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return x.where("vec_id % 2 = 0"), x.where("vec_id % 2 = 1")


@query("mahalanobis_centroids", _far_sql("select vec_id, round(near, 6) as distance from near"))
def mahalanobis_centroids(spark, d):  # noqa: ANN001, ANN201
    lab, pool = _halves(spark, d)
    return density.mahalanobis(lab, pool, "label", "v").select("vec_id", F.round("distance", 6).alias("distance"))


def _fit_sql(tag: str, rows: str, own: bool = False) -> str:
    """Means and the inverse of the pooled covariance of ``rows`` (vec_id, label, x), or each class's own with the logarithm of its determinant, by
    Gauss and Jordan; ``w_{tag}`` has them by label. Own ones are over n - ``own``."""
    over = "any_value(n) - 1" if own == 1 else "any_value(n)"
    cov = f"select label, a.i, b.i as j, sum(a.d * b.d) / ({over}) as s from off_{tag} a join off_{tag} b using (vec_id, label) join (select label, count(*) as n from {rows} group by label) using (label) group by label, a.i, b.i"
    if own is False:
        cov = f"select 0 as label, a.i, b.i as j, sum(a.d * b.d) / ((select count(*) from {rows}) - 1) as s from off_{tag} a join off_{tag} b using (vec_id) group by a.i, b.i"
    return f"""flat_{tag} as (select vec_id, label, unnest(x) as v, generate_subscripts(x, 1) as i from {rows}),
mean_{tag} as (select label, i, avg(v) as m from flat_{tag} group by all),
off_{tag} as (select f.vec_id, f.label, f.i, v - m as d from flat_{tag} f join mean_{tag} using (label, i)),
steps_{tag}(label, k, m, ld) as (
    select label, 1, list(list_concat(r, list_transform(range(1, len(r) + 1), lambda k: case when k = i then 1.0::double else 0.0::double end)) order by i), 0.0::double
    from (select label, i, list(s order by j) as r from ({cov}) group by label, i) group by label
    union all select label, k + 1, list_transform(m, lambda row, i: case when i = k then p else list_transform(list_zip(row, p), lambda z: z[1] - row[k] * z[2]) end), ld + ln(m[k][k])
    from (select label, k, m, ld, list_transform(m[k], lambda v: v / m[k][k]) as p from steps_{tag} where k <= len(m))),
w_{tag} as (select label, list_transform(m, lambda r: r[len(m) + 1:]) as w, ld from steps_{tag} where k = len(m) + 1),
centre_{tag} as (select label, list(m order by i) as c from mean_{tag} group by label)"""


_FORM = "list_sum(list_transform(list_zip(w, d), lambda z: list_dot_product(z[1], d) * z[2]))"
_TWO = """with recursive v as (select vec_id, label % 2 as label, embedding::double[] as x from embeddings),
l as (select * from v where vec_id % 2 = 0), p as (select * from v where vec_id % 2 = 1)"""
_OWN = """diff as (select vec_id, c.label, w, ld, list_transform(list_zip(x, c), lambda z: z[1] - z[2]) as d from p cross join centre_l c join w_l on w_l.label = c.label)"""


def _two_classes(spark, d):  # noqa: ANN001, ANN202
    """Halves with two classes: ten classes have too few rows on small tables for a regular covariance of their own."""
    return (x.withColumn("label", F.col("label") % 2) for x in _halves(spark, d))


@query("mahalanobis_per_class", f"{_TWO}, {_fit_sql('l', 'l', own=2)}, {_OWN} select vec_id, round(min(sqrt({_FORM})), 6) as distance from diff group by vec_id")
def mahalanobis_per_class(spark, d):  # noqa: ANN001, ANN201
    lab, pool = _two_classes(spark, d)
    return density.mahalanobis(lab, pool, "label", "v", per_class=True).select("vec_id", F.round("distance", 6).alias("distance"))


@query("unicentroid_mahalanobis", _far_sql("select vec_id, round(far, 6) as distance from far"))
def unicentroid_mahalanobis(spark, d):  # noqa: ANN001, ANN201
    lab, pool = _halves(spark, d)
    return density.single_centre(lab, pool, "v").select("vec_id", F.round("distance", 6).alias("distance"))


@query("triplet_mahalanobis", _far_sql("select vec_id, round(0.25 * near - 0.75 * far, 6) as score from near join far using (vec_id)"))
def triplet_mahalanobis(spark, d):  # noqa: ANN001, ANN201
    lab, pool = _halves(spark, d)
    return density.triplet(lab, pool, "label", "v").select("vec_id", F.round("score", 6).alias("score"))


_LEFT = """, kept as (select *, row_number() over (order by far desc, vec_id) as k, round_even(0.01 * count(*) over (), 0) as c from far)
select vec_id, round({0}, 6) as score from kept {1} where k > c order by {0} desc, vec_id limit 20"""


@query("mahalanobis_filtering", _far_sql(_LEFT.format("near", "join near using (vec_id)")))
def mahalanobis_filtering(spark, d):  # noqa: ANN001, ANN201
    lab, pool = _halves(spark, d)
    return density.filtered_scores(lab, pool, 20, "vec_id", "label", "v", "mahalanobis").select("vec_id", F.round("score", 6).alias("score"))


@query("mahalanobis_filtering_score", _far_sql(_LEFT.format("first", "")))
def mahalanobis_filtering_score(spark, d):  # noqa: ANN001, ANN201
    lab, pool = _halves(spark, d)
    return density.filtered_scores(lab, pool, 20, "vec_id", "label", "v", F.col("v")[0]).select("vec_id", F.round("score", 6).alias("score"))


def _picks(spark, p) -> object:  # noqa: ANN001
    return p.frame(spark, "vec_id").select("ord", "vec_id", F.round("score", 6).alias("score"))


def _idds_sql(k: int, near: str, cte: str = "", lam: float = 0.667, similarity: str = "list_dot_product") -> str:
    """Greedy picks by a recursive query; its state is the list of picks."""
    return f"""with recursive {VECTORS}, sims as materialized (select a.vec_id as i, b.vec_id as j, b.vec_id % 10 = 0 as known, {similarity}(a.embedding, b.embedding) as s from pool a cross join vec b){cte},
step(n, picked, scores) as (
    select 0, []::bigint[], []::double[] union all
    select n + 1, list_append(picked, best.i), list_append(scores, best.s) from step, lateral (
        select arg_max(i, (s, -i)) as i, max(s) as s from (
            select i, round({lam} * {near} - {1 - lam} * avg(s) filter (where known or list_contains(picked, j)), 9) as s
            from sims where not list_contains(picked, i) group by i)) best where n < {k})
select unnest(range({k})) as ord, unnest(picked) as vec_id, round(unnest(scores), 6) as score from step where n = {k}"""


_POOL_MEAN = "((sum(s) filter (where not known and not list_contains(picked, j)) - 1) / (count(*) filter (where not known and not list_contains(picked, j)) - 1))"


@query("idds_greedy_k5", _idds_sql(5, _POOL_MEAN))
def idds_greedy_k5(spark, d):  # noqa: ANN001, ANN201
    lab, pool = split_vectors(spark, d)
    return _picks(spark, greedy.idds(pool, lab, 5, "vec_id", "embedding"))


@query("idds_cosine_k5", _idds_sql(5, _POOL_MEAN, similarity="list_cosine_similarity"))
def idds_cosine_k5(spark, d):  # noqa: ANN001, ANN201
    lab, pool = split_vectors(spark, d)
    return _picks(spark, greedy.idds(pool, lab, 5, "vec_id", "embedding", cosine=True))


_EUCLID = "-(list_distance(a.embedding, b.embedding) ** 2)"


@query("idds_euclid_k5", _idds_sql(5, _POOL_MEAN).replace("list_dot_product(a.embedding, b.embedding)", _EUCLID))
def idds_euclid_k5(spark, d):  # noqa: ANN001, ANN201
    lab, pool = split_vectors(spark, d)
    return _picks(spark, greedy.idds(pool, lab, 5, "vec_id", "embedding", similarity="euclidean_distance"))


@query("idds_unc_k5", _idds_sql(5, "any_value(u)", ", unc as (select vec_id, embedding[1] as u0 from pool), un as (select vec_id, (u0 - min(u0) over ()) / (max(u0) over () - min(u0) over ()) as u from unc)").replace("from sims where", "from sims join un on un.vec_id = i where"))
def idds_unc_k5(spark, d):  # noqa: ANN001, ANN201
    lab, pool = split_vectors(spark, d)
    pool = acquire.minmax(pool.withColumn("u0", F.col("embedding")[0]), "u0", "u")
    return _picks(spark, greedy.idds(pool, lab, 5, "vec_id", "embedding", uncertainty="u"))


def _mahalanobis_sql(k: int) -> str:
    white = f"rows_z as (select vec_id, 0 as label, embedding as x from vec), {_fit_sql('z', 'rows_z')}, white as (select vec_id, list_transform(w, lambda r: list_dot_product(r, embedding)) as u from pool cross join w_z), sims as"
    return _idds_sql(k, _POOL_MEAN).replace("a.embedding, b.embedding", "a.u, b.embedding").replace("from pool a", "from white a").replace("sims as", white, 1)


@query("idds_mahalanobis_k5", _mahalanobis_sql(5))
def idds_mahalanobis_k5(spark, d):  # noqa: ANN001, ANN201
    """Similarity under the inverse covariance of all rows."""
    lab, pool = split_vectors(spark, d)
    return _picks(spark, greedy.idds(pool, lab, 5, "vec_id", "embedding", similarity="mahalanobis_similarity"))


def _averaged_sql() -> str:
    token = "list_transform(range(16), lambda c: list_avg([embedding[16 * b + c + 1]::double for b in range(4) if b < 3 or vec_id % 3 > 0]))"
    return _idds_sql(5, _POOL_MEAN).replace(VECTORS, f"vec as (select vec_id, {token} as embedding from embeddings), pool as (select * from vec where vec_id % 10 <> 0)")


@query("idds_averaged_k5", _averaged_sql())
def idds_averaged_k5(spark, d):  # noqa: ANN001, ANN201
    """A text's vector is the mean of its tokens' (four blocks of components; every third text has three tokens and padding)."""
    x = table(spark, d, "embeddings")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.slice("embedding", b * 16 + 1, 16))
    mask = F.when(F.col("vec_id") % 3 > 0, F.array(*[F.lit(1)] * 4)).otherwise(F.array(*map(F.lit, (1, 1, 1, 0))))
    x = x.select("vec_id", masked_mean(blocks, mask).alias("embedding"))
    return _picks(spark, greedy.idds(x.where("vec_id % 10 <> 0"), x.where("vec_id % 10 = 0"), 5, "vec_id", "embedding"))


def _outliers_sql(k: int, share: float) -> str:
    """A fit, distances and a pick a step; the first two picks see all rows."""
    steps = []
    for n in range(k):
        far = ""
        if n > 1:
            steps.append(f"rows_{n} as (select vec_id, 0 as label, x from v where vec_id % 2 = 0 or vec_id in (select vec_id from got_{n})), {_fit_sql(str(n), f'rows_{n}')}")
            steps.append(f"""far_{n} as (select vec_id from (select vec_id, row_number() over (order by {_FORM} desc, vec_id) as r from
                (select vec_id, w, list_transform(list_zip(x, c), lambda z: z[1] - z[2]) as d from v cross join centre_{n} cross join w_{n})) where r <= (select round({share} * count(*)) from v))""")
            far = f" and i not in (select vec_id from far_{n})"
        out = f"j % 2 = 1 and j not in (select vec_id from got_{n})"
        steps.append(f"""pick_{n} as (select i as vec_id, s as score from (select i, round(0.667 * (sum(s) filter (where {out}) - 1) / (count(*) filter (where {out}) - 1) - 0.333 * avg(s) filter (where not ({out})), 9) as s
            from sims where i not in (select vec_id from got_{n}){far} group by i) order by s desc, i limit 1), got_{n + 1} as (select vec_id from got_{n} union all select vec_id from pick_{n})""")
    return f"""with recursive v as (select vec_id, embedding::double[] as x from embeddings), sims as materialized (select a.vec_id as i, b.vec_id as j, list_dot_product(a.x, b.x) as s from v a cross join v b where a.vec_id % 2 = 1),
got_0 as (select vec_id from v where false), {", ".join(steps)} {" union all ".join(f"select {n}::bigint as ord, vec_id, round(score, 6) as score from pick_{n}" for n in range(k))}"""


@query("idds_outliers_k4", _outliers_sql(4, 0.3))
def idds_outliers_k4(spark, d):  # noqa: ANN001, ANN201
    """The three tenths of all rows that are farthest from the labelled and picked ones can't be picked from the third pick on."""
    lab, pool = _halves(spark, d)
    return _picks(spark, greedy.idds(pool, lab, 4, "vec_id", "v", outliers=0.3))


_U = "((list_sum(list_reverse_sort(list(s) filter (where not known and not list_contains(picked, j)))[1:6]) - 1) / 5)"
_L = "list_avg(list_reverse_sort(list(s) filter (where known or list_contains(picked, j)))[1:4])"


@query("idds_utop_ltop_k3", _idds_sql(3, _U).replace("avg(s) filter (where known or list_contains(picked, j))", _L))
def idds_utop_ltop_k3(spark, d):  # noqa: ANN001, ANN201
    lab, pool = split_vectors(spark, d)
    return _picks(spark, greedy.idds_top(pool, lab, 3, "vec_id", "embedding", 5, 4))


@query("kcenter_k5", f"""with recursive {VECTORS}, far as materialized (select a.vec_id as i, b.vec_id as j, b.vec_id % 10 = 0 as known, list_distance(a.embedding, b.embedding) ** 2 as f from pool a cross join vec b),
step(n, picked, scores) as (select 0, []::bigint[], []::double[] union all
    select n + 1, list_append(picked, best.i), list_append(scores, best.s) from step, lateral (select arg_max(i, (s, -i)) as i, max(s) as s from (
        select i, round(min(f) filter (where known or list_contains(picked, j)), 9) as s from far where not list_contains(picked, i) group by i)) best where n < 5)
select unnest(range(5)) as ord, unnest(picked) as vec_id, round(unnest(scores), 6) as score from step where n = 5""")
def kcenter_k5(spark, d):  # noqa: ANN001, ANN201
    lab, pool = split_vectors(spark, d)
    return _picks(spark, greedy.k_center(pool, lab, 5, "vec_id", "embedding"))


@query("kmeans_pp_k5")
def kmeans_pp_k5(spark, d):  # noqa: ANN001, ANN201
    return _picks(spark, greedy.k_means_pp(split_vectors(spark, d)[1], 5, "vec_id", "embedding", 3))


@query("badge_k3")
def badge_k3(spark, d):  # noqa: ANN001, ANN201
    g = with_probas(spark, d).select("vec_id", F.transform("probas", lambda p, i: p - (i == proba.argmax(F.col("probas"))).cast("double")).alias("g"))
    return _picks(spark, greedy.badge(g, 3, "vec_id", "g", 5))


@query("kmeans_medoids")
def kmeans_medoids(spark, d):  # noqa: ANN001, ANN201
    return neighbours.k_means(split_vectors(spark, d)[1], 5, "vec_id", "embedding", 7)


@query("cluster_pool")
def cluster_pool(spark, d):  # noqa: ANN001, ANN201
    lab, pool = split_vectors(spark, d)
    return neighbours.cluster_pool(lab, pool, 10, "vec_id", "embedding").select("vec_id", "cluster")


@query("gmm_density", f"""{_TWO}, {_fit_sql('l', 'l', own=1)}, {_OWN}, share as (select label, count(*) / sum(count(*)) over () as s from l group by label)
select vec_id, round(sum(exp((-0.5 * {_FORM} - 0.5 * (len(d) * ln(2 * pi()) + ld)) / 768) * s), 9) as density from diff join share using (label) group by vec_id""")
def gmm_density(spark, d):  # noqa: ANN001, ANN201
    lab, pool = _two_classes(spark, d)
    return density.gaussian_density(lab, pool, "label", "v").select("vec_id", F.round("density", 9).alias("density"))


def _pick_sql(tag: str, pool: str) -> str:
    """The row of ``pool`` whose nearest centre, under the fit ``tag``, is farthest."""
    return f"""near_{tag} as (select vec_id, any_value(own) as label, any_value(x) as x, min(sqrt({_FORM})) as far from (
    select p.vec_id, p.label as own, x, w, list_transform(list_zip(x, c), lambda z: z[1] - z[2]) as d from {pool} p cross join centre_{tag} cross join w_{tag}) group by vec_id),
pick_{tag} as (select * from near_{tag} order by far desc, vec_id limit 1)"""


@query("batched_mahalanobis_k2", f"""with recursive v as (select vec_id, label, embedding::double[] as x from embeddings), l as (select * from v where vec_id % 2 = 0), p as (select * from v where vec_id % 2 = 1),
{_fit_sql('a', 'l')}, {_pick_sql('a', 'p')}, l2 as (select * from l union all select vec_id, label, x from pick_a), p2 as (select * from p where vec_id not in (select vec_id from pick_a)),
{_fit_sql('b', 'l2')}, {_pick_sql('b', 'p2')}
select 0::bigint as ord, vec_id, round(far, 6) as score from pick_a union all select 1, vec_id, round(far, 6) from pick_b""")
def batched_mahalanobis_k2(spark, d):  # noqa: ANN001, ANN201
    lab, pool = _halves(spark, d)
    return _picks(spark, density.batched_picks(lab, pool, 2, "label", "vec_id", "v"))


@query("cluster_round_robin", f"""with {PROBAS}, m as (select vec_id, label, round(1 + list_sort(p)[len(p) - 1] - list_max(p), 6) as margin from probas), z as (select label, count(*) as size from m group by label),
r as (select m.*, size, row_number() over (partition by label order by margin desc, vec_id) as k from m join z using (label))
select vec_id, label, row_number() over (order by k, size, label, vec_id) - 1 as ord from r qualify ord < 25""")
def cluster_round_robin(spark, d):  # noqa: ANN001, ANN201
    m = with_probas(spark, d).withColumn("margin", F.round(proba.margin(F.col("probas")), 6))
    return acquire.cluster_round_robin(m, "label", -F.col("margin"), 25, "vec_id").select("vec_id", "label", F.col("ord").cast("long"))


@query("plasm_threshold", f"with {PROBAS} select vec_id, list_position(p, list_max(p)) - 1 as pseudo from probas where list_max(p) > 0.5")
def plasm_threshold(spark, d):  # noqa: ANN001, ANN201
    return pseudo.label_classes(with_probas(spark, d), "probas", "pseudo", 0.5, "vec_id").select("vec_id", F.col("pseudo").cast("int"))


@query("plasm_two_sided_quantile", """with s as (select doc_id, n_chars::double as score from documents), r as (select *, row_number() over (order by score, doc_id) - 1 as k, count(*) over () as n from s)
select doc_id from r where k >= round_even(n * 0.1, 0) and k < n - round_even(n * 0.05, 0)""")
def plasm_two_sided_quantile(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), "text")
    return pseudo.label_texts(docs, "text", "score", "summary", (0.1, 0.05), "doc_id", by_quantile=True).select("doc_id")


@query("plasm_ner", f"with {PASS_SQL}, t as (select vec_id, b, max(p) as p, arg_max(label, (p, -label)) as best from pass_probas group by all), s as (select vec_id, 1 + avg(ln(p)) as s from t group by vec_id) select vec_id, b, best from t join s using (vec_id) where s > 0")
def plasm_ner(spark, d):  # noqa: ANN001, ANN201
    got = pseudo.label_tokens(with_passes(spark, d), "passes", "tags", 0.0, "vec_id")
    return got.select("vec_id", F.posexplode("tags").alias("b", "best")).select("vec_id", F.col("b").cast("long"), F.col("best").cast("int"))


@query("label_smoothing", f"with {PROBAS} select vec_id, generate_subscripts(p, 1) - 1 as k, unnest(list_transform(p, lambda x, i: case when i = list_position(p, list_max(p)) then 0.9 else round(0.1 / 9, 6) end))::double as y from probas")
def label_smoothing(spark, d):  # noqa: ANN001, ANN201
    flat = with_probas(spark, d).select("vec_id", F.posexplode(proba.smoothed(F.col("probas"), 0.9)).alias("k", "y"))
    return flat.select("vec_id", F.col("k").cast("long"), F.round("y", 6).alias("y"))


@query("weighted_union", f"with {PROBAS} select vec_id, label, 1.0::double as weight from lab union all select vec_id, (list_position(p, list_max(p)) - 1)::int, 0.3::double from probas where list_max(p) > 0.5")
def weighted_union(spark, d):  # noqa: ANN001, ANN201
    lab, _ = split_vectors(spark, d)
    guessed = pseudo.label_classes(with_probas(spark, d), "probas", "label", 0.5, "vec_id").select("vec_id", "label")
    return pseudo.weighted_union(lab.select("vec_id", "label"), guessed, 0.3, "label")


@query("smoothed_loss", f"with {PROBAS}, l as (select vec_id, -0.5 * list_sum(list_transform(p, lambda x, i: case when i = label + 1 then ln(greatest(x, 1e-8)) else 0 end)) as l from probas) select round(avg(l), 6) as loss from l")
def smoothed_loss(spark, d):  # noqa: ANN001, ANN201
    p = with_probas(spark, d)
    loss = proba.weighted_loss(F.col("probas"), proba.one_hot(F.col("label"), 10), F.lit(0.5))
    return p.agg(F.round(F.avg(loss), 6).alias("loss"))
