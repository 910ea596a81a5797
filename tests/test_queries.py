"""Every registered query: values beside its SQL statement, and the shape of its plan."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from millrace.catalog import fixtures  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    problem = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert problem is None, problem


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    queries = entry.queries()
    text = plan(queries["scale_minmax"](spark, SF))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double,l_returnflag:string>" in text
    assert "Exchange" not in text
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThanOrEqual(o_orderkey" in plan(queries["head_fraction"](spark, SF))
    assert "Exchange" not in plan(queries["bin_quantile"](spark, SF))


@pytest.mark.parametrize("name", ["stratified_folds", "train_test_split", "undersample_to_class_caps", "impute_median"])
def test_row_choices_need_no_sort_of_a_class(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "Window" not in text and "Exchange hashpartitioning" not in text


@pytest.mark.parametrize(
    "name", ["nearest_neighbor_join", "dbscan", "smote", "silhouette", "sweep_neighbors", "spearman_matrix", "rules_by_lift", "adjusted_rand_index"]
)
def test_no_row_products(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_texts_are_counted_before_their_join(spark, tmp_path):
    texts = [(1, "a 1\nb 22", 8), (2, None, None), (3, "not labelled", 12), (4, "", 0)]
    spark.createDataFrame(texts, "doc_id bigint, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(1, 1, 0), (1, 0, 1), (2, 1, 0), (4, 0, 0), (5, 1, 1)]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = fixtures.doc_features(spark, str(tmp_path))
    rows = {tuple(r) for r in docs.collect()}
    assert docs.columns == ["row_id", "quality", "toxic", "n_chars", "n_spaces", "n_digits", "n_lines"]
    assert rows == {(1, 1, 0, 8, 2, 3, 2), (1, 0, 1, 8, 2, 3, 2), (2, 1, 0, None, None, None, None), (4, 0, 0, 0, 0, 0, 1)}
    text = docs._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join Inner") < text.index("replace(text")
