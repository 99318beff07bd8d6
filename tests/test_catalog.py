"""Every registered query against its check SQL, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
# These fit trees or forests and are covered by their own tests.
SLOW = {
    "learned_ensemble", "boosted_trees", "boosted_trees_early_stop", "boosted_trees_deep",
    "random_forest", "feature_importance", "two_branch_regression", "feature_ablation",
    "training_suite", "residual_model", "standardised_regression", "sequence_regression",
    "leafwise_trees", "penalised_trees",
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(queries()[name](spark, FOLDER), con, oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["hour", "load"]
