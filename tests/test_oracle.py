"""Every registered query against its SQL, on the smallest data set."""

import pathlib

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
#: The smallest data set has too few users to train on.
LARGER = "/root/testdata/sf0.01"
TRAINED = {"gbt_score_counts", "feature_importance_total", "model_save_load_differences"}
pytestmark = pytest.mark.skipif(not pathlib.Path(ROOT).exists(), reason="test data is not here")


@pytest.fixture(scope="module")
def db():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - TRAINED))
def test_query_matches_sql(spark, db, name):
    assert compare(spark, ROOT, db, entry.queries()[name], entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, LARGER).count() > 0


@pytest.mark.parametrize("name", sorted(TRAINED))
def test_trained_query_matches_sql(spark, name):
    assert compare(spark, LARGER, connect(LARGER), entry.queries()[name], entry.oracle_sql()[name]) is None


def test_wide_table_has_all_columns(spark):
    from conversion_engine.operators.features import WIDE_COLUMNS

    assert len(WIDE_COLUMNS) == 126 and entry.entry(spark).columns == WIDE_COLUMNS
