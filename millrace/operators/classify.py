"""Classifiers: fit on one table, predict any other."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import uniform
from millrace.functions.vectors import as_array
from millrace.operators.bayes import GaussianModel, class_moments, fit_gaussian, model_from
from millrace.operators.neighbors import knn, knn_until
from millrace.operators.projection import knn_by_trees
from millrace.operators.trees import fit_trees

# Poisson(1) distribution function at 0, 1, 2, ...
POISSON_STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(j + 1)) for j in range(9)]


def classes_of(df: DataFrame, label: str) -> list:
    return sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())


def class_index(label: str, classes: Sequence) -> Column:
    # one flat CASE, however many classes
    out = F
    for i, c in enumerate(classes):
        out = out.when(F.col(label) == F.lit(c), F.lit(float(i)))
    return F.lit(None).cast("double") if out is F else out


def class_at(index: Column, classes: Sequence) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), index.cast("int"))


@dataclass(frozen=True)
class NearestNeighbors:
    """The training table itself is the model."""

    train: DataFrame
    features: tuple[str, ...]
    label: str
    row_id: str
    n_neighbors: int = 5
    weights: str = "uniform"
    #: Below 1 the neighbours come from random-projection trees, with this share of them found.
    recall: float = 1.0

    def _vectors(self, df: DataFrame, *extra: str) -> DataFrame:
        return df.select(F.col(self.row_id).alias("row_id"), as_array(self.features).alias("vec"), *extra)

    def neighbors(self, df: DataFrame) -> DataFrame:
        train = self._vectors(self.train.where(F.col(self.label).isNotNull()), self.label)
        if self.recall == 1:
            return knn(self._vectors(df), train, self.n_neighbors, carry=self.label)
        near = knn_by_trees(self._vectors(df), train, self.n_neighbors, self.recall)
        return near.join(train.select(F.col("row_id").alias("neighbor_id"), self.label), "neighbor_id")

    def predict(self, df: DataFrame) -> DataFrame:
        votes = vote(self.neighbors(df), self.label, self.weights)
        return df.join(votes.withColumnRenamed("row_id", self.row_id), self.row_id)

    def predict_probability(self, df: DataFrame) -> DataFrame:
        shares = vote_shares(self.neighbors(df), self.label, classes_of(self.train, self.label), self.weights)
        return df.join(shares.withColumnRenamed("row_id", self.row_id), self.row_id)


def vote(near: DataFrame, label: str, weights: str = "uniform") -> DataFrame:
    """(row_id, prediction) from neighbour rows; equal votes go to the lowest label.

    Distance weights are 1/d; when neighbours coincide with the row only those count.
    """
    zero = F.col("distance") == 0
    w = F.lit(1.0) if weights == "uniform" else F.when(~zero, 1.0 / F.when(~zero, F.col("distance")))
    per_class = (
        near.repartition("row_id")
        .groupBy("row_id", label)
        .agg(
            F.coalesce(F.sum(w), F.lit(0.0)).alias("w"),
            F.lit(0).cast("bigint").alias("z") if weights == "uniform" else F.count_if(zero).alias("z"),
        )
    )
    return per_class.groupBy("row_id").agg(
        F.min_by(label, F.struct((-F.col("z")).alias("z"), F.when(F.col("z") == 0, -F.col("w")).alias("w"), F.col(label)))
        .alias("by_zero"),
        F.min_by(label, F.struct((-F.col("w")).alias("w"), F.col(label))).alias("by_weight"),
        F.max("z").alias("z"),
    ).select("row_id", F.when(F.col("z") > 0, F.col("by_zero")).otherwise(F.col("by_weight")).alias("prediction"))


def vote_shares(near: DataFrame, label: str, classes: Sequence, weights: str = "uniform") -> DataFrame:
    """(row_id, probability): the share of each class in the vote."""
    zero = F.col("distance") == 0
    w = F.lit(1.0) if weights == "uniform" else F.when(~zero, 1.0 / F.when(~zero, F.col("distance")))
    z = F.lit(0.0) if weights == "uniform" else zero.cast("double")

    def per_class(value):
        return F.array(*[F.coalesce(F.sum(F.when(F.col(label) == F.lit(c), value)), F.lit(0.0)) for c in classes])

    sums = near.groupBy("row_id").agg(per_class(w).alias("w"), per_class(z).alias("z"), F.sum(z).alias("any"))
    chosen = F.when(F.col("any") > 0, F.col("z")).otherwise(F.col("w"))
    total = F.aggregate("chosen", F.lit(0.0), lambda a, x: a + x)
    return sums.select("row_id", chosen.alias("chosen")).select(
        "row_id", F.transform("chosen", lambda x: x / total).alias("probability")
    )


@dataclass(frozen=True)
class NaiveBayes:
    model: GaussianModel

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.model.prediction())

    def predict_probability(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", self.model.probabilities())


def fit_knn(df, features, label, row_id, n_neighbors: int = 5, weights: str = "uniform", metric: str = "euclidean", recall: float = 1.0):
    if not 0 < recall <= 1:
        raise ValueError(f"recall must be above 0 and at most 1, not {recall}")
    if metric not in ("euclidean", "minkowski"):
        raise ValueError(f"unknown metric {metric}")
    return NearestNeighbors(df, tuple(features), label, row_id, n_neighbors, weights, recall)


def fit_bayes(df, features, label, row_id=None):
    return NaiveBayes(fit_gaussian(df, features, label))


def fit_tree(df, features, label, row_id=None, criterion: str = "gini", max_depth: int = 30):
    """A tree that tries every midpoint."""
    classes = classes_of(df, label)
    return fit_trees(df, features, class_index(label, classes), classes, criterion, max_depth)


def fit_forest(
    df, features, label, row_id, n_estimators: int = 100, criterion: str = "gini", max_depth: int = 30, subset: str = "sqrt", seed: int = 0,
):
    """Trees over bootstrap weights; at each node a random ``subset`` of the attributes that differ there is tried."""
    if subset not in ("sqrt", "all"):
        raise ValueError(f"subset must be 'sqrt' or 'all', not {subset!r}")
    classes = classes_of(df, label)
    tried = max(1, math.isqrt(len(features))) if subset == "sqrt" else None
    drawn = bootstrap_weight(seed, row_id, F.col("tree"))
    return fit_trees(df, features, class_index(label, classes), classes, criterion, max_depth, drawn, n_estimators, tried, seed)


def bootstrap_weight(seed: str | int, row_id: str, replicate: Column) -> Column:
    """How often a row occurs in a replicate: Poisson(1) by the row's hash."""
    u = uniform(f"{seed}:boot", F.col(row_id), replicate)
    out = F.lit(0)
    for step in POISSON_STEPS:
        out = out + (u >= F.lit(step)).cast("int")
    return out


@dataclass(frozen=True)
class Votes:
    """Unweighted or weighted vote of several members over the same rows."""

    members: tuple
    row_id: str
    voting: str = "hard"
    weights: tuple[float, ...] = field(default=())
    classes: tuple = ()

    def predict(self, df: DataFrame) -> DataFrame:
        weights = self.weights or (1.0,) * len(self.members)
        soft = self.voting == "soft"
        k = len(self.classes)
        # members look at the original rows one by one; their votes meet in one aggregation
        ballots = None
        for m, w in zip(self.members, weights):
            if soft:
                got = m.predict_probability(df).select(self.row_id, *[(F.col("probability")[j] * F.lit(float(w))).alias(f"v{j}_") for j in range(k)])
            else:
                got = m.predict(df).select(
                    self.row_id, *[F.when(F.col("prediction") == F.lit(c), F.lit(float(w))).otherwise(0.0).alias(f"v{j}_") for j, c in enumerate(self.classes)]
                )
            ballots = got if ballots is None else ballots.unionByName(got)
        totals = ballots.groupBy(self.row_id).agg(*[F.sum(f"v{j}_").alias(f"v{j}_") for j in range(k)])
        scores = F.array(*[F.round(F.col(f"v{j}_"), 9) for j in range(k)])
        best = F.array_position(scores, F.array_max(scores)) - 1
        return df.join(totals.select(self.row_id, class_at(best, self.classes).alias("prediction")), self.row_id)


def majority(columns: Sequence[Column], weights: Sequence[float], classes: Sequence) -> Column:
    """The class with the largest weighted vote, the lowest one when equal."""
    totals = F.array(
        *[
            sum((F.when(c == F.lit(k), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in zip(columns, weights)), F.lit(0.0))
            for k in classes
        ]
    )
    return class_at(F.array_position(totals, F.array_max(totals)) - 1, classes)


def fit_voting(df, features, label, row_id, members: Sequence[Mapping], voting: str = "hard", weights: Sequence[float] = ()):
    """Members are ``{"name": ..., **params}`` with a classifier name each."""
    fitted = []
    for m in members:
        params = {k: v for k, v in m.items() if k != "name"}
        name = next(k for k in ("KNN", "naiveBays", "decisionTree") if k in m["name"])
        fitted.append(CLASSIFIERS[name](df, features, label, row_id, **params))
    return Votes(tuple(fitted), row_id, voting, tuple(weights), tuple(classes_of(df, label)))


@dataclass(frozen=True)
class BaggedBayes:
    """Mean of the members' probabilities; a class that a replicate lacks has none there."""

    models: tuple[GaussianModel, ...]
    classes: tuple

    def predict_probability(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({f"b{i}_": m.probabilities() for i, m in enumerate(self.models)})
        shares = [
            sum((F.col(f"b{i}_")[m.classes.index(c)] for i, m in enumerate(self.models) if c in m.classes), F.lit(0.0))
            / F.lit(float(len(self.models)))
            for c in self.classes
        ]
        known = F.col("b0_").isNotNull()
        return out.withColumn("probability", F.when(known, F.array(*shares))).select(*df.columns, "probability")

    def predict(self, df: DataFrame) -> DataFrame:
        scores = F.transform("probability", lambda p: F.round(p, 9))
        best = F.array_position(scores, F.array_max(scores)) - 1
        return self.predict_probability(df).withColumn("prediction", class_at(best, self.classes)).select(*df.columns, "prediction")


@dataclass(frozen=True)
class BaggedNeighbors:
    """Mean of the vote shares among the nearest rows of every bootstrap replicate.

    The neighbours are looked up once.  A row counts in a replicate as often as it
    was drawn there, so the replicate's nearest rows are read off the list; only
    queries whose list runs short in some replicate are looked up deeper.
    """

    member: NearestNeighbors
    n_estimators: int
    seed: int
    classes: tuple

    def _drawn(self) -> list[Column]:
        return [bootstrap_weight(self.seed, "neighbor_id", F.lit(t)) for t in range(self.n_estimators)]

    def _near(self, df: DataFrame) -> DataFrame:
        """The rows of :func:`knn` for every (row, replicate); a row drawn twice stands there twice."""
        k, label = self.member.n_neighbors, self.member.label

        def short(lists: DataFrame) -> DataFrame:
            drawn = lists.groupBy("row_id").agg(F.array_min(F.array(*[F.sum(w) for w in self._drawn()])).alias("least"))
            return drawn.where(F.col("least") < k)

        train = self.member._vectors(self.member.train.where(F.col(label).isNotNull()), label)
        lists = knn_until(self.member._vectors(df), train, 2 * k + 8, short, carry=label)
        each = lists.select("*", F.posexplode(F.array(*self._drawn())).alias("replicate", "weight")).where("weight > 0")
        nearer = Window.partitionBy("row_id", "replicate").orderBy("distance", "neighbor_id").rowsBetween(Window.unboundedPreceding, -1)
        counted = each.withColumn("before", F.coalesce(F.sum("weight").over(nearer), F.lit(0))).where(F.col("before") < k)
        times = F.explode(F.sequence(F.lit(1), F.least(F.col("weight").cast("bigint"), F.lit(k) - F.col("before"))))
        return counted.select(F.struct("row_id", "replicate").alias("row_id"), label, "distance", times.alias("time"))

    def predict_probability(self, df: DataFrame) -> DataFrame:
        shares = vote_shares(self._near(df), self.member.label, self.classes, self.member.weights)
        totals = shares.groupBy(F.col("row_id.row_id").alias("near_id")).agg(
            F.array(*[F.sum(F.col("probability")[j]) / self.n_estimators for j in range(len(self.classes))]).alias("probability")
        )
        return df.join(totals, F.col(self.member.row_id) == F.col("near_id")).drop("near_id")

    def predict(self, df: DataFrame) -> DataFrame:
        scores = F.transform("probability", lambda p: F.round(p, 9))
        best = F.array_position(scores, F.array_max(scores)) - 1
        return self.predict_probability(df).withColumn("prediction", class_at(best, self.classes)).drop("probability")


def fit_bagging(df, features, label, row_id, base_estimator: str = "decisionTree", n_estimators: int = 10, seed: int = 0, **params):
    """Members fitted on bootstrap replicates; their class probabilities are averaged."""
    if base_estimator == "decisionTree":
        return fit_forest(df, features, label, row_id, n_estimators=n_estimators, subset="all", seed=seed, **params)
    if base_estimator == "naiveBays":
        # one pass: a row adds to the moments of every replicate it occurs in
        drawn = (
            df.withColumn("replicate_", F.explode(F.sequence(F.lit(0), F.lit(n_estimators - 1))))
            .withColumn("weight_", bootstrap_weight(seed, row_id, F.col("replicate_")))
            .where(F.col("weight_") > 0)
        )
        moments = class_moments(drawn, features, label, ["replicate_"], weight="weight_")
        models = tuple(
            model_from([m for m in moments if m.part[0] == t], features) for t in range(n_estimators)
        )
        return BaggedBayes(models, tuple(sorted({m.label for m in moments})))
    if base_estimator == "KNN":
        member = fit_knn(df, features, label, row_id, **params)
        return BaggedNeighbors(member, n_estimators, seed, tuple(classes_of(df, label)))
    raise ValueError(f"unknown base estimator {base_estimator}")


CLASSIFIERS = {
    "KNN": fit_knn,
    "naiveBays": fit_bayes,
    "decisionTree": fit_tree,
    "randomForest": fit_forest,
    "ensembleBagging": fit_bagging,
    "ensembleVoting": fit_voting,
}
