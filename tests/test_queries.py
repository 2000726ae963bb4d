"""A few named queries against their SQL on the smallest tables, where these are there."""

import math
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
NAMES = ["pool_anti_join", "uncertainty_topk", "token_budget_include_last", "hash_train_test_split", "class_centroids", "least_confidence", "idds_greedy_k5", "novel_ngrams_2", "metrics_wide"]


def test_entry_imports_without_a_session():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    a, b = e.queries()[name](spark, str(DATA)).toPandas(), con.execute(e.oracle_sql()[name]).df()
    assert sorted(a) == sorted(b)
    norm = lambda f: sorted(tuple("-" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.5f}" if not isinstance(v, str) else v for v in r) for r in f[sorted(f)].itertuples(index=False))
    assert norm(a) == norm(b)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["min_center_distance", "kcenter_k5"])
def test_all_labelled_rows_are_centres(spark, name):
    test_query_matches_sql(spark, name)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_corpus_bleu(spark):
    test_query_matches_sql(spark, "corpus_bleu")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["source_records_json", "source_conll", "source_folders", "sink_selection", "source_runs_yaml", "idds_euclid_k5", "mmr_f1_k3", "entity_f1"])
def test_sources_and_strategies_match_sql(spark, name):
    test_query_matches_sql(spark, name)
