import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsieve.operators import density, greedy, linkage, moments, neighbours, topk


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, label int, v array<double>").persist()
    return x, df.where("id < 10"), df.where("id >= 10")


def naive(x, n, lam, u_top=None, l_top=None):
    pool, known, out = list(range(10, 40)), list(range(10)), []
    s = x @ x.T
    for _ in range(n):
        def score(i):
            u = np.sort(s[i, pool])[::-1]
            v = np.sort(s[i, known])[::-1]
            first = (u.sum() - 1) / (len(pool) - 1) if u_top is None else (u[: u_top + 1].sum() - 1) / u_top
            return round(lam * first - (1 - lam) * (v.mean() if l_top is None else v[:l_top].mean()), 9)

        best = max(pool, key=lambda i: (score(i), -i))
        out.append(best)
        pool.remove(best)
        known.append(best)
    return out


def test_idds(data):
    x, lab, pool = data
    assert greedy.idds(pool, lab, 5, "id", "v", 0.6).ids == naive(x, 5, 0.6)


def test_idds_top(data):
    x, lab, pool = data
    assert greedy.idds_top(pool, lab, 4, "id", "v", 5, 3, 0.6).ids == naive(x, 4, 0.6, 5, 3)


def test_idds_takes_all_and_no_more(data):
    _, lab, pool = data
    few = pool.where("id < 13")
    assert sorted(greedy.idds(few, lab, 9, "id", "v").ids) == [10, 11, 12]
    assert greedy.idds(few, lab, 0, "id", "v").ids == []


def test_equal_vectors_are_one_row(spark):
    pool = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<double>")
    assert sorted(greedy.idds(pool, pool.where("id < 0"), 5, "id", "v").ids) == [1, 3]


def test_k_center(data):
    x, lab, pool = data
    centres, out = list(range(10)), []
    for _ in range(5):
        far = {i: round(min(((x[i] - x[c]) ** 2).sum() for c in centres), 9) for i in range(10, 40) if i not in out}
        best = max(far, key=lambda i: (far[i], -i))
        out.append(best)
        centres.append(best)
    assert greedy.k_center(pool, lab, 5, "id", "v").ids == out


def test_k_means_pp_picks_differ(data):
    picks = greedy.k_means_pp(data[2], 6, "id", "v", 1).ids
    assert len(set(picks)) == 6


def test_nearest(data):
    x, lab, pool = data
    got = {r["id"]: [n["other"] for n in r["near"]] for r in neighbours.nearest(pool, lab, "id", "v", 3).collect()}
    for i, near in got.items():
        assert near == np.argsort(-(x[i] @ x[:10].T), kind="stable")[:3].tolist()


@pytest.mark.parametrize("measure", ["dot", "cosine", "euclid"])
def test_nearest_skips_cells_and_loses_nothing(spark, monkeypatch, measure):
    """Clustered rows with ties, cells smaller than k, rows without a vector."""
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "CELL", 8)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 4)) * 20
    x = np.concatenate([c + rng.normal(size=(n, 4)) for c, n in zip(centres, (30, 30, 20, 20, 20, 10, 2, 2), strict=True)])
    x[5] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "id long, v array<double>").repartition(3)
    z = x / np.linalg.norm(x, axis=1, keepdims=True) if measure == "cosine" else x
    sim = -((z[:, None] - z[None]) ** 2).sum(2) if measure == "euclid" else z @ z.T
    report = {}
    got = {r["id"]: [(n["other"], n["sim"]) for n in r["near"]] for r in topk.nearest(df, df, "id", "v", 4, measure, report).collect()}
    assert set(got) == set(range(len(x)))
    for i, near in got.items():
        assert [s for _, s in near] == pytest.approx(np.sort(sim[i])[::-1][:4].tolist(), abs=1e-6)
        assert all(s == pytest.approx(sim[i, j], abs=1e-6) for j, s in near) and len({j for j, _ in near}) == 4
    assert report["pairs"] == len(x) ** 2
    if measure == "euclid":
        assert report["met"] < report["pairs"] / 2


def linked(x, clusters, metric):
    """One merge at a time over the matrix of all distances; clusters named by the first member."""
    z = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    d = 1 - z @ z.T if metric == "cosine" else ((z[:, None] - z[None]) ** 2).sum(2)
    d = np.sqrt(d) if metric == "euclidean" else d
    groups = {i: [i] for i in range(len(x))}
    while len(groups) > clusters:
        names = list(groups)
        at = np.array([[np.inf if a >= b else d[np.ix_(groups[a], groups[b])].mean() for b in names] for a in names]) if len(groups) == len(x) else at  # noqa: F821
        i, j = divmod(int(at.argmin()), len(names))
        a, b = names[i], names[j]
        groups[a] += groups.pop(b)
        at = np.delete(np.delete(at, j, 0), j, 1)
        names.pop(j)
        for k, name in enumerate(names):
            if k != i:
                at[min(i, k), max(i, k)] = d[np.ix_(groups[a], groups[name])].mean()
    return {m: min(g) for g in groups.values() for m in g}


@pytest.mark.parametrize(("metric", "clusters"), [("euclidean", 3), ("euclidean", 40), ("sqeuclidean", 40), ("cosine", 3)])
def test_average_linkage(spark, monkeypatch, metric, clusters):
    """Rounds over blocks, then few on the driver, against one merge at a time; 40 clusters undo merges of the rounds."""
    monkeypatch.setattr(linkage, "FEW", 30)
    monkeypatch.setattr(linkage, "BLOCK", 40)
    monkeypatch.setattr(linkage, "CHUNK", 3)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(n, 3)) * s + rng.normal(size=3) * 6 for n, s in ((30, 1), (25, 0.2), (15, 2), (2, 0.1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in linkage.average_linkage(df, clusters, "id", "v", metric).collect()}
    assert got == linked(x, clusters, metric)


def test_average_linkage_of_ties_and_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i // 3)]) for i in range(9)], "id long, v array<double>")
    assert sorted(tuple(r) for r in linkage.average_linkage(df, 3, "id", "v").collect()) == [(i, i // 3 * 3) for i in range(9)]
    assert linkage.average_linkage(df, 20, "id", "v").where("id <> cluster").count() == 0
    assert linkage.average_linkage(df, 1, "id", "v").select("cluster").distinct().collect() == [(0,)]
    assert linkage.average_linkage(df.limit(0), 2, "id", "v").count() == 0


def test_late_groups_have_a_cluster(spark):
    lab = spark.createDataFrame([(i, [float(i >= 2000) * 50, i % 7 / 10]) for i in range(2010)], "id long, v array<double>")
    got = neighbours.cluster_pool(lab, lab.where("id in (5, 2005)"), 2, "id", "v").collect()
    assert len({r["cluster"] for r in got}) == 2 and max(r["distance"] for r in got) < 1


def test_mahalanobis(data):
    x, lab, pool = data
    y = np.arange(40) % 3
    mu = np.stack([x[:10][y[:10] == c].mean(0) for c in range(3)])
    d = x[:10] - mu[y[:10]]
    inv = density.inverse(d.T @ d / 9)
    for r in density.mahalanobis(lab, pool, "label", "v").select("id", "distance").collect():
        want = min(np.sqrt((x[r["id"]] - m) @ inv @ (x[r["id"]] - m)) for m in mu)
        assert r["distance"] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("name", ["gmm_density", "batched_mahalanobis_k2", "mahalanobis_per_class"])
def test_queries_over_whole_vectors(spark, tmp_path, name):
    import __spark_entry__ as e

    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 6)) * [1, 1, 1, 2, 3, 9]
    y = np.arange(400) // 10 % 2
    spark.createDataFrame([(i, int(y[i]), v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    lab, pool = np.arange(0, 400, 2), np.arange(1, 400, 2)

    def far(i, known):
        mu = [x[[k for k in known if y[k] == c]].mean(0) for c in (0, 1)]
        d = np.stack([x[k] - mu[y[k]] for k in known])
        inv = np.linalg.inv(d.T @ d / (len(known) - 1))
        return min((np.sqrt((x[i] - m) @ inv @ (x[i] - m)), c) for c, m in enumerate(mu))

    rows = e.queries()[name](spark, str(tmp_path)).collect()
    if name == "batched_mahalanobis_k2":
        first = max(pool, key=lambda i: far(i, lab)[0])
        second = max((i for i in pool if i != first), key=lambda i: far(i, [*lab, first])[0])
        assert [r["vec_id"] for r in sorted(rows)] == [first, second]
        return
    for r in rows:
        i, want = r["vec_id"], 0.0
        if name == "gmm_density":
            for c in (0, 1):
                z = x[[k for k in lab if y[k] == c]]
                cov, d = np.cov(z.T), x[i] - z.mean(0)
                want += np.exp((-0.5 * d @ np.linalg.inv(cov) @ d - 0.5 * (6 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1])) / 768) * len(z) / len(lab)
        else:
            want = min(np.sqrt((x[i] - z.mean(0)) @ np.linalg.inv(np.cov(z.T, bias=True)) @ (x[i] - z.mean(0))) for z in (x[[k for k in lab if y[k] == c]] for c in (0, 1)))
        assert next(v for k, v in r.asDict().items() if k != "vec_id") == pytest.approx(want, rel=1e-4)


def test_empty_class_is_infinitely_far(data):
    _, lab, pool = data
    rows = density.centroids(lab, "label", "v", [0, 1, 2, 7]).collect()
    assert {r["label"]: r["empty"] for r in rows}[7]


def test_mmr(spark):
    sets = {0: "abc", 1: "abd", 2: "xyz", 3: "ab"}
    pairs = [(1, i, j, len(set(a) & set(b))) for i, a in sets.items() for j, b in sets.items() if set(a) & set(b)]
    overlap = spark.createDataFrame(pairs, "n int, i long, j long, common long")
    counts = spark.createDataFrame([(1, i, len(a)) for i, a in sets.items()], "n int, i long, total long")
    got = greedy.mmr(overlap, counts, 9)
    assert sorted(got.ids) == [0, 1, 2, 3]

    def naive_pick(picked):
        left = [i for i in sets if i not in picked]
        share = lambda i, j: len(set(sets[i]) & set(sets[j])) / len(sets[j])
        def s(i):
            out = (sum(share(i, j) for j in left) - 1) / max(1, len(left) - 1)
            inn = max((len(set(sets[i]) & set(sets[q])) / len(sets[i]) for q in picked), default=0)
            v = 0.5 * out - 0.5 * inn
            return round(v if v >= 0 else max(v + 1, 0) - 1, 9)
        return max(left, key=lambda i: (s(i), -i))

    picked = []
    for _ in sets:
        picked.append(naive_pick(picked))
    assert got.ids == picked


def test_mmr_f1(spark):
    """Of two orders, with the F1 of grams on both sides, naively."""
    words = {0: "a b c d", 1: "a b d", 2: "x y z", 3: "a b", 4: "b c d x"}
    grams = {(n, i): [tuple(t.split()[k : k + n]) for k in range(len(t.split()) - n + 1)] for i, t in words.items() for n in (1, 2)}
    common = lambda n, i, j: len(set(grams[n, i]) & set(grams[n, j]))
    pairs = [(n, i, j, common(n, i, j)) for n in (1, 2) for i in words for j in words if common(n, i, j)]
    overlap = spark.createDataFrame(pairs, "n int, i long, j long, common long")
    counts = spark.createDataFrame([(n, i, len(g)) for (n, i), g in grams.items()], "n int, i long, total long")
    got = greedy.mmr(overlap, counts, 4, f1=True)

    def f1(n, i, j):
        return 2 * common(n, i, j) / (len(grams[n, i]) + len(grams[n, j]))

    picked = []
    for _ in range(4):
        left = [i for i in words if i not in picked]

        def s(i, left=left):
            v = [0.5 * (sum(f1(n, i, j) for j in left) - 1) / max(1, len(left) - 1) - 0.5 * max((f1(n, i, q) for q in picked), default=0) for n in (1, 2)]
            return round(np.prod([max(z, 0) for z in v]) ** 0.5 if min(v) >= 0 else np.prod([max(z + 1, 0) for z in v]) ** 0.5 - 1, 9)

        picked.append(max(left, key=lambda i: (s(i), -i)))
    assert got.ids == picked


@pytest.mark.parametrize("similarity", ["scalar_product", "cosine_similarity", "euclidean_distance", "euclidean_normalized_distance", "mahalanobis_similarity", "mahalanobis_distance"])
def test_idds_similarities(data, similarity):
    x, lab, pool = data
    z = x / np.linalg.norm(x, axis=1, keepdims=True) if similarity in ("cosine_similarity", "euclidean_normalized_distance") else x
    if similarity.startswith("mahalanobis"):
        inv = np.linalg.inv(np.cov(x.T))
        sim = x @ inv @ x.T if similarity.endswith("similarity") else -np.stack([[(a - b) @ inv @ (a - b) for b in x] for a in x])
    else:
        sim = z @ z.T if "distance" not in similarity else -((z[:, None] - z[None]) ** 2).sum(-1)
    known, left, out = list(range(10)), list(range(10, 40)), []
    for _ in range(4):
        score = {i: round(0.667 * (sim[i, left].sum() - 1) / (len(left) - 1) - 0.333 * sim[i, known].mean(), 9) for i in left}
        best = max(left, key=lambda i: (score[i], -i))
        out.append(best)
        known.append(best)
        left.remove(best)
    assert greedy.idds(pool, lab, 4, "id", "v", similarity=similarity).ids == out


def test_idds_leaves_outliers_out(data):
    """From the third pick on, rows farthest from the single centre of the labelled and picked ones can't be picked."""
    x, lab, pool = data
    known, left, out = list(range(10)), list(range(10, 40)), []
    for step in range(4):
        far = []
        if step > 1:
            inv = density.inverse(np.cov(x[known].T))
            d = {i: np.sqrt((x[i] - x[known].mean(0)) @ inv @ (x[i] - x[known].mean(0))) for i in range(40)}
            far = sorted(d, key=lambda i: (-d[i], i))[: round(0.2 * 40)]
        score = {i: round(0.667 * (x[i] @ x[left].sum(0) - 1) / (len(left) - 1) - 0.333 * (x[i] @ x[known].T).mean(), 9) for i in left}
        best = max((i for i in left if i not in far), key=lambda i: (score[i], -i))
        out.append(best)
        known.append(best)
        left.remove(best)
    assert greedy.idds(pool, lab, 4, "id", "v", outliers=0.2).ids == out


def test_k_means_fills_up_equal_rows(spark):
    rows = spark.createDataFrame([(i, [float(i // 5) * 9, 1.0]) for i in range(10)], "id long, v array<double>")
    assert sorted(len({r["id"] for r in neighbours.k_means(rows, k, "id", "v", 3).collect()}) for k in (2, 5)) == [2, 5]


def test_filtering_by_the_single_centre(data):
    x, lab, pool = data
    inv = density.inverse(np.cov(x[:10].T))
    far = {i: np.sqrt((x[i] - x[:10].mean(0)) @ inv @ (x[i] - x[:10].mean(0))) for i in range(10, 40)}
    stay = sorted(far, key=lambda i: (-far[i], i))[3:]
    want = sorted(stay, key=lambda i: (-x[i][0], i))[:5]
    assert [r["id"] for r in density.filtered_scores(lab, pool, 5, "id", "label", "v", F.col("v")[0], 0.1).orderBy("ord").collect()] == want
    near = {r["id"]: r["distance"] for r in density.mahalanobis(lab, pool, "label", "v").collect()}
    want = sorted(stay, key=lambda i: (-near[i], i))[:5]
    assert [r["id"] for r in density.filtered_scores(lab, pool, 5, "id", "label", "v", "mahalanobis", 0.1).orderBy("ord").collect()] == want


def test_mahalanobis_pairs(data):
    x, lab, pool = data
    inv = np.linalg.inv(np.cov(x.T))
    for r in neighbours.similarities(pool, lab, "id", "v", "mahalanobis").collect():
        d = x[r["id"]] - x[r["other"]]
        assert r["sim"] == pytest.approx(-(d @ inv @ d), rel=1e-6, abs=1e-9)
    got = {(r["id"], r["other"]): r["sim"] for r in neighbours.similarities(pool, lab, "id", "v", "mahalanobis_dot").collect()}
    assert len(got) == 300 and got[12, 3] == pytest.approx(x[12] @ inv @ x[3])


def test_influence(spark):
    from poolsieve.operators import influence

    g = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)] + [(3, [5.0, 0.0])], "id long, g array<double>")
    got = {r["id"]: r["score"] for r in influence.self_influence(g, "id", "g", 0.5).collect()}
    assert got[3] == (0.5 * 10 + 0.5 * 25) / 2 and got[0] == 0.5
    assert sorted(r["id"] for r in influence.least_influential(influence.self_influence(g, "id", "g"), 0.2, "id").collect()) == list(range(8))


def test_moments_of_one_scan(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) + 1e6  # far from 0
    y = [None if i % 3 == 0 else i % 2 for i in range(300)]
    df = spark.createDataFrame([(i, y[i], v.tolist()) for i, v in enumerate(x)] + [(999, 1, None)], "id long, label int, v array<double>").repartition(5)
    for matrices in (None, moments.ALL, moments.OWN):
        fit = moments.moments(df, "label", "v", matrices)
        groups = [x[[i for i in range(300) if y[i] == c]] for c in (None, 0, 1)]
        assert fit.labels == [None, 0, 1] and fit.n.tolist() == [len(g) for g in groups]
        assert np.allclose(fit.mean, [g.mean(0) for g in groups], rtol=1e-12)
        own = [np.cov(g.T, bias=True) for g in groups]
        if matrices == moments.OWN:
            assert np.allclose(fit.covariances(), own, rtol=1e-6)
        if matrices == moments.ALL:
            assert np.allclose(fit.covariance(), sum(c * len(g) for c, g in zip(own, groups, strict=True)) / 299, rtol=1e-6)
    assert moments.moments(df.limit(0), "label", "v").labels == []


@pytest.mark.parametrize("refresh", [64, 5])
def test_batched_equals_a_fit_for_each_pick(spark, monkeypatch, refresh):
    """Classes that are new, ties, labels of the rows themselves, the single centre, rows that can't be picked."""
    monkeypatch.setattr(moments.Running, "REFRESH", refresh)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(70, 3)) * [1, 2, 5]
    x[60:] = x[50:60]
    y = [i % 3 if i < 40 else (i % 4 or None) for i in range(70)]
    df = spark.createDataFrame([(i, y[i], v.tolist()) for i, v in enumerate(x)], "id long, label int, v array<double>")
    for lam, barred in ((None, []), (0.25, [33, 41])):
        known, own, out, scores = list(range(20)), y[:], [], []
        inv_one = np.linalg.inv(np.cov(x[:20].T))
        one = lambda i: np.sqrt((x[i] - x[:20].mean(0)) @ inv_one @ (x[i] - x[:20].mean(0)))  # noqa: E731,B023
        for _ in range(12):
            classes = sorted({own[i] for i in known})
            mu = [x[[i for i in known if own[i] == c]].mean(0) for c in classes]
            d = np.stack([x[i] - mu[classes.index(own[i])] for i in known])
            inv = np.linalg.inv(d.T @ d / (len(known) - 1))
            near = {i: min((np.sqrt((x[i] - m) @ inv @ (x[i] - m)), c) for c, m in zip(classes, mu, strict=True)) for i in range(20, 70) if i not in known and i not in barred}
            score = {i: v[0] if lam is None else lam * v[0] - (1 - lam) * one(i) for i, v in near.items()}
            best = max(score, key=lambda i: (round(score[i], 9), -i))
            out.append(best)
            scores.append(score[best])
            known.append(best)
            own[best] = near[best][1] if own[best] is None else own[best]
        got = density.batched_picks(df.where("id < 20"), df.where("id >= 20"), 12, "label", "id", "v", lam, barred)
        same = lambda i: i - 10 if i >= 60 else i
        assert [same(i) for i in got.ids] == [same(i) for i in out] and got.scores == pytest.approx(scores, rel=1e-8)


def test_batched_with_a_singular_scatter(spark):
    x = [[0.0, 0.0], [1.0, 0.0], [3.0, 0.0], [0.5, 0.0], [9.0, 0.0]]
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(x)], "id long, label int, v array<double>")
    assert density.batched(df.where("id < 3"), df.where("id >= 3"), 2, "label", "id", "v") == [4, 3]
    assert density.batched(df.where("id < 0"), df, 2, "label", "id", "v") == []


def test_outliers_without_labelled_rows_and_many_picks(spark):
    """The first pick begins the fit; more picks than a refresh of kept files; ids picked never come again."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 3))
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    known, left = [], list(range(30))
    for _ in range(2):
        score = {i: round(0.667 * (x[i] @ x[left].sum(0) - 1) / (len(left) - 1) - (0.333 * (x[i] @ x[known].T).mean() if known else 0), 9) for i in left}
        known.append(max(left, key=lambda i: (score[i], -i)))
        left.remove(known[-1])
    assert greedy.idds(pool, pool.limit(0), 4, "id", "v", outliers=0.2).ids[:2] == known
    got = greedy.idds(pool, pool.where("id < 0"), 10, "id", "v", outliers=0.2).ids
    assert len(set(got)) == 10


@pytest.mark.parametrize("few", [1, 7, 1000])
def test_nth_largest(spark, few):
    from poolsieve.operators.rows import nth_largest

    rng = np.random.default_rng(few)
    rows = [(i, float(v)) for i, v in enumerate(rng.integers(0, 6, 60))] + [(100 + i, float(v)) for i, v in enumerate(rng.normal(size=60))] + [(500, None), (7, 5.0), (7, 5.0)]
    df = spark.createDataFrame(rows, "id long, v double")
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    for n in (1, 3, 8, 40, 77, 121, 122):
        assert nth_largest(df, F.col("v"), "id", n, few, 50) == (order[n - 1][1], order[n - 1][0])
    assert nth_largest(df, F.col("v"), "id", 123, few) is None and nth_largest(df, F.col("v"), "id", 0, few) is None


def test_masked_mean(spark):
    from poolsieve.functions.vector import masked_mean

    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0]), ([], []), ([[4.0, 1.0], None], [1, 1])], "v array<array<double>>, m array<int>")
    assert [r[0] for r in df.select(masked_mean(F.col("v"), F.col("m"))).collect()] == [[2.0, 4.0], None, None, [4.0, 1.0]]
