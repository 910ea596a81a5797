"""Reading and writing tables, results and run records."""

import json

import pytest
from pyspark.sql import types as T

from millrace.operators import classify, clean
from millrace.session import new_path
from millrace.sources import csv, models, runs


def test_two_header_lines(spark, tmp_path):
    rows = [f"{i},{i % 2},{i * 0.5 if i % 4 else 'na'},{i}.25,na,{i % 2}" for i in range(12)]
    (tmp_path / "speech.csv").write_text("\n".join([",,Group A,,Group B,", "id,gender,f1,f2,f3,class", *rows]) + "\n")
    raw = csv.read_two_header_csv(spark, str(tmp_path / "speech.csv"))
    assert raw.columns == ["id", "gender", "f1", "f2", "f3", "class"] and raw.count() == 12
    table = clean.text_to_numbers(clean.sentinel_to_null(raw), ["f1", "f2", "f3", "class"])
    table = clean.label_to_boolean(table, "class")
    got = {int(r.id): r for r in table.collect()}
    assert got[4].f1 is None and got[5].f1 == 2.5 and got[5].f3 is None and got[5]["class"] is True


def test_headerless(spark, tmp_path):
    (tmp_path / "cover.data").write_text("".join(f"{i}.5,1,0,na,{i % 7 + 1}\n" for i in range(12)))
    table = clean.name_last_column(csv.read_headerless_csv(spark, str(tmp_path / "cover.data"), 5))
    assert table.columns == ["0", "1", "2", "3", "class"]
    numbers = clean.text_to_numbers(clean.sentinel_to_null(table), table.columns)
    assert numbers.where("`3` IS NULL").count() == 12
    assert {r["class"] for r in numbers.collect()} == {float(i) for i in range(1, 8)}


def test_results_per_run(spark, tmp_path):
    for run, value in (("k - 1", 0.25), ("k - 5", 0.75)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "output.csv").write_text(f",accuracy,name\n0,{value},a\n1,{value + 0.1},b\n")
    table = csv.read_results_per_run(spark, str(tmp_path), "output.csv")
    assert sorted((r["run"], r["index"], r["accuracy"]) for r in table.collect()) == [
        ("k - 1", 0, 0.25), ("k - 1", 1, 0.35), ("k - 5", 0, 0.75), ("k - 5", 1, 0.85),
    ]


def test_flatten_rejects_clashes(spark):
    df = spark.createDataFrame([(1, (2, 3))], "a int, p struct<b: int, c: int>")
    assert runs.flatten(df).collect() == [(1, 2, 3)]
    with pytest.raises(ValueError, match="b"):
        runs.flatten(spark.createDataFrame([(1, (2, 3))], "b int, p struct<b: int, c: int>"))


def test_unify_runs(spark):
    base = new_path(spark, "unify")
    configs = {"r1": {"classifier": "KNN", "accuracy": "asked", "params": {"k": 1}}, "r2": {"classifier": "NB", "params": {"w": "d"}}}
    runs.write_records(spark, {"r1": configs["r1"]}, f"{base}/config")
    runs.write_records(spark, {"r2": configs["r2"]}, f"{base}/config")
    logs = {"r1": {"accuracy": 0.5, "accuracy_kfoldVals": [0.4, 0.6], "dropedCols": ["z"]}, "r2": {"accuracy": 0.75}}
    runs.write_records(spark, logs, f"{base}/logs")
    table = runs.unify_to_csv(spark, f"{base}/config", f"{base}/logs", f"{base}/output")
    assert set(table.columns) == {"run", "classifier", "k", "w", "accuracy", "accuracy_kfoldVals"}
    got = {r.run: r for r in table.collect()}
    assert got["r1"].accuracy == 0.5 and got["r1"].k == 1 and got["r1"].w is None and got["r2"].accuracy_kfoldVals is None
    text = spark.read.option("header", True).csv(f"{base}/output").where("run = 'r1'").first()
    assert json.loads(text.accuracy_kfoldVals) == [0.4, 0.6]


@pytest.mark.parametrize(
    "name,params",
    [
        ("decisionTree", {"max_depth": 3}),
        ("naiveBays", {}),
        ("KNN", {"n_neighbors": 3, "weights": "distance"}),
        ("ensembleBagging", {"base_estimator": "naiveBays", "n_estimators": 3}),
        ("ensembleVoting", {"members": [{"name": "KNN"}, {"name": "naiveBays"}, {"name": "decisionTree", "max_depth": 2}]}),
    ],
)
def test_model_survives_saving(spark, name, params):
    rows = [(i, float(i), float(i % 5), int(i > 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, x double, y double, label int")
    fitted = classify.CLASSIFIERS[name](df, ("x", "y"), "label", "row_id", **params)
    path = new_path(spark, name)
    models.save_model(spark, fitted, path)
    again = models.load_model(spark, path)
    key = lambda m: sorted((r.row_id, r.prediction) for r in m.predict(df).collect())
    assert type(again) is type(fitted) and key(again) == key(fitted)


def test_typed_headerless(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,2.5\n3,4.5\n")
    schema = T.StructType([T.StructField("0", T.IntegerType()), T.StructField("1", T.DoubleType())])
    assert csv.read_headerless_csv(spark, str(tmp_path / "t.csv"), 2, schema).dtypes == [("0", "int"), ("1", "double")]
