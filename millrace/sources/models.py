"""Saving and loading fitted classifiers in the shared storage."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.operators.bayes import GaussianModel
from millrace.operators.classify import BaggedBayes, NaiveBayes, NearestNeighbors, Votes
from millrace.operators.trees import Forest


def _write_facts(spark: SparkSession, path: str, facts: dict) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def save_model(spark: SparkSession, model, path: str) -> None:
    """Writes the model below ``path``: its facts as JSON, beside it the tree nodes or training table."""
    if isinstance(model, Forest):
        model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        facts = {"features": model.features, "classes": model.classes, "n_trees": model.n_trees}
    elif isinstance(model, NaiveBayes):
        facts = asdict(model.model)
    elif isinstance(model, BaggedBayes):
        facts = {"models": [asdict(m) for m in model.models], "classes": model.classes}
    elif isinstance(model, NearestNeighbors):
        columns = dict.fromkeys([model.row_id, model.label, *model.features])
        model.train.select(*columns).write.mode("overwrite").parquet(f"{path}/train")
        names = ("features", "label", "row_id", "n_neighbors", "weights")
        facts = {n: getattr(model, n) for n in names}
    elif isinstance(model, Votes):
        for i, m in enumerate(model.members):
            save_model(spark, m, f"{path}/member{i}")
        facts = {"n": len(model.members), "row_id": model.row_id, "voting": model.voting, "weights": model.weights, "classes": model.classes}
    else:
        raise TypeError(f"cannot save {type(model).__name__}")
    _write_facts(spark, path, {"kind": type(model).__name__, **facts})


def _gaussian(facts: dict) -> GaussianModel:
    return GaussianModel(
        tuple(facts["features"]),
        tuple(facts["classes"]),
        tuple(facts["log_prior"]),
        tuple(tuple(m) for m in facts["mean"]),
        tuple(tuple(v) for v in facts["var"]),
    )


def load_model(spark: SparkSession, path: str):
    facts = json.loads(spark.read.text(f"{path}/facts").select(F.col("value")).first()[0])
    kind = facts.pop("kind")
    if kind == "Forest":
        return Forest(spark.read.parquet(f"{path}/nodes"), tuple(facts["features"]), tuple(facts["classes"]), facts["n_trees"])
    if kind == "NaiveBayes":
        return NaiveBayes(_gaussian(facts))
    if kind == "BaggedBayes":
        return BaggedBayes(tuple(_gaussian(m) for m in facts["models"]), tuple(facts["classes"]))
    if kind == "NearestNeighbors":
        return NearestNeighbors(spark.read.parquet(f"{path}/train"), **{**facts, "features": tuple(facts["features"])})
    if kind == "Votes":
        members = tuple(load_model(spark, f"{path}/member{i}") for i in range(facts.pop("n")))
        return Votes(members, facts["row_id"], facts["voting"], tuple(facts["weights"]), tuple(facts["classes"]))
    raise TypeError(f"unknown model {kind}")
