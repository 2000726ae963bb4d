import math

import pytest
from pyspark.sql import functions as F

from poolsieve.operators import acquire, rows


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([(i, float(i % 4), i % 3) for i in range(10)], "id long, score double, label int")


def ids(df, col="id"):
    return [r[col] for r in df.collect()]


def test_top_breaks_ties_by_id(ten):
    got = rows.top(ten, 4, F.col("score").desc(), F.col("id")).orderBy("ord")
    assert ids(got) == [3, 7, 2, 6]
    assert ids(rows.top(ten, 2, F.col("score").desc(), F.col("id"), offset=1).orderBy("ord")) == [7, 2]
    assert rows.top(ten, 0, F.col("id")).count() == 0
    assert rows.top(ten, 99, F.col("id")).count() == 10


def test_sample_is_seeded_and_sized(ten):
    a, b = (sorted(ids(rows.sample(ten, 5, "id", 1))) for _ in range(2))
    assert a == b and len(a) == 5
    assert rows.subsample(ten, 4, "id", 0).count() == 2  # 2.5, half to even


def test_split_is_a_partition(ten):
    rest, part = rows.split(ten, 0.3, "id", 4)
    assert part.count() == 3
    assert sorted(ids(rest) + ids(part)) == list(range(10))


def test_balanced_and_stratified(ten):
    assert {r["label"]: r["count"] for r in rows.balanced(ten, 2, "label", "id", 0).groupBy("label").count().collect()} == {0: 2, 1: 2, 2: 2}
    assert rows.stratified(ten, {0: 1, 2: 9}, "label", "id", 0).count() == 1 + 3


def test_fixed_length(ten):
    got = rows.fixed_length(ten, 25, "id", 3)
    counts = [r["count"] for r in got.groupBy("id").count().collect()]
    assert sum(counts) == 25 and set(counts) == {2, 3}


def test_rank_matches_order(ten):
    got = {r["id"]: r["_rank"] for r in rows.rank_by(ten, F.col("score").desc(), F.col("id")).collect()}
    want = sorted(range(10), key=lambda i: (-(i % 4), i))
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == want


def test_token_budget(ten):
    cum = lambda keep: sorted(ids(rows.token_budget(ten, F.lit(10), 35, F.col("id"), include_last=keep)))
    assert cum(True) == [0, 1, 2, 3]
    assert cum(False) == [0, 1, 2]
    assert rows.token_budget(ten, F.lit(1), 100, F.col("id")).count() == 10  # never reached


def test_quantiles_and_empty(ten, spark):
    assert sorted(ids(rows.within_quantiles(ten, F.col("id"), 0.1, 0.9))) == list(range(1, 9))
    empty = ten.where("id < 0")
    assert rows.within_quantiles(empty, F.col("id"), 0.1, 0.9).count() == 0
    assert rows.fixed_length(empty, 5, "id", 0).count() == 0


def test_union_checks_columns(ten):
    with pytest.raises(ValueError):
        rows.union(ten, ten.drop("score"))


def test_filters(ten):
    got = acquire.filtered_by_uncertainty(ten, "score", 3.0, 3, "id").orderBy("ord")
    assert ids(got) == [2, 6, 1]
    got = acquire.filtered_by_metric(ten, "id", "score", 6, 2, "id").orderBy("ord")
    assert ids(got) == [7, 9]
    assert acquire.outliers(10, 9, 0.5, "absolute", 3) == 7


def test_scatter_and_minmax(ten):
    got = acquire.scatter_scores(ten.drop("score"), ten.where("id < 2"), "id")
    assert sum(math.isinf(r["score"]) for r in got.collect()) == 8
    assert {r["normalised"] for r in acquire.minmax(ten, "score").collect()} == {0.0, 1 / 3, 2 / 3, 1.0}
    assert {r["normalised"] for r in acquire.minmax(ten.withColumn("score", F.lit(2.0)), "score").collect()} == {0.0}


def test_ups_with_zero_temperature_keeps_k_and_one(ten):
    assert acquire.ups_subsample(ten, "score", 3, 0.0, "id", 1).count() == 4


def test_round_robin_takes_turns(spark):
    t = spark.createDataFrame([(i, 0 if i < 6 else 1 if i < 9 else 2, float(i)) for i in range(10)], "id long, c int, s double")
    got = acquire.cluster_round_robin(t, "c", F.col("s"), 6, "id").orderBy("ord")
    assert ids(got) == [9, 6, 0, 7, 1, 8]
