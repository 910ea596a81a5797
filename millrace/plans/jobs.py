"""The composed jobs: classification, clustering, pattern mining, variable analysis.

A job takes a table, its :class:`TableSpec` and a configuration dict whose names
are resolved against the registries of the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import as_array
from millrace.operators import cluster, density
from millrace.operators.classify import CLASSIFIERS
from millrace.operators.clean import head_fraction
from millrace.operators.encode import discretize, items_of
from millrace.operators.impute import impute
from millrace.operators.mining import (
    association_rules,
    frequent_itemsets,
    frequent_itemsets_decreasing,
)
from millrace.operators.neighbors import nearest_distance_curve
from millrace.operators.reduce import fit_pca, fit_pca_fraction
from millrace.operators.sample import (
    cluster_centroids,
    not_balanced,
    random_undersample,
    smote,
    stratified_folds,
    train_test_split,
)
from millrace.operators.scale import RESCALERS
from millrace.operators.score import (
    adjusted_rand,
    classification_metrics,
    fold_summary,
    silhouette,
    silhouette_squared,
)
from millrace.operators.select import SCORERS, best, best_fraction, drop_correlated
from millrace.session import cut_lineage, keep, scope
from millrace.sources.models import save_model
from millrace.spec import TableSpec

MINING_DEFAULTS = {
    "min_sup": 0.35,
    "min_conf": 0.9,
    "min_lift": 1.2,
    "iteratively_decreasing_support": True,
    "pattern_metric": "lift",
    "min_patterns": 30,
    "alg": "fpgrowth",
    "n": 3,
    "type": "cut",
}


def _smote(df, spec, params):
    return smote(df, spec.features, spec.label, spec.row_id, **params).drop("synthetic")


def _undersample(df, spec, params):
    return random_undersample(df, spec.label, spec.row_id, **params)


def _centroids(df, spec, params):
    return cluster_centroids(df, spec.features, spec.label, spec.row_id, **params)


BALANCERS: dict[str, Callable] = {
    "smote": _smote,
    "randUndersample": _undersample,
    "clusterCentroidsUnderSample": _centroids,
    "notBalanced": lambda df, spec, params: not_balanced(df),
}


def _kmeans(df, params):
    out, inertia = cluster.kmeans(df, **params)
    return out, {"inertia": inertia}


CLUSTERERS: dict[str, Callable] = {
    "kmeans": _kmeans,
    "miniBatchKMeans": lambda df, p: (cluster.mini_batch_kmeans(df, **p)[0], {}),
    "dbscan": lambda df, p: (density.dbscan(df, **p), {}),
    "GaussianMixture": lambda df, p: (cluster.gaussian_mixture(df, **p)[0], {}),
    "agglomerativeClustering": lambda df, p: (cluster.hierarchical(df, **p), {}),
    "birch": lambda df, p: (cluster.birch(df, **p), {}),
    "spectralClustering": lambda df, p: (cluster.spectral(df, **p), {}),
    "meanShift": lambda df, p: (density.mean_shift(df, **p)[0], {}),
}

REGISTRY: dict[str, Mapping[str, Callable]] = {
    "classifier": CLASSIFIERS,
    "balancingStrategy": BALANCERS,
    "rescaler": RESCALERS,
    "featureFunction": SCORERS,
    "clusterFunction": CLUSTERERS,
}


def resolve(config: Mapping) -> dict:
    """Registered names replaced by their functions; other values stay."""
    return {k: REGISTRY[k].get(v, v) if k in REGISTRY and isinstance(v, str) else v for k, v in config.items()}


def names_of(config: Mapping) -> dict:
    """The inverse of :func:`resolve`."""
    back = {k: {f: n for n, f in functions.items()} for k, functions in REGISTRY.items()}
    return {k: back[k].get(v, v) if k in back and callable(v) else v for k, v in config.items()}


def balance(df: DataFrame, spec: TableSpec, config: Mapping) -> DataFrame:
    name = config.get("balancingStrategy") or "notBalanced"
    kept = df.select(spec.row_id, spec.label, *spec.features)
    return BALANCERS[name](kept, spec, dict(config.get("balancingParams") or {}))


def fill(df: DataFrame, spec: TableSpec, config: Mapping) -> DataFrame:
    strategy = config.get("nanStrategy") or ""
    return impute(df, spec.features, strategy) if strategy else df


@dataclass
class Prepared:
    tables: list[DataFrame]
    spec: TableSpec
    dropped: list[str] = field(default_factory=list)


def reduce_features(tables: Sequence[DataFrame], spec: TableSpec, config: Mapping) -> Prepared:
    """Scaling, then one of PCA, scored selection or decorrelation, fitted on the first table."""
    tables = list(tables)
    if config.get("rescaler"):
        scaling = RESCALERS[config["rescaler"]](tables[0], spec.features)
        tables = [scaling.transform(t) for t in tables]
    components = dropped = None
    function, share = config.get("featureFunction"), config.get("featuresToKeepPercentage")
    threshold = config.get("correlationThreshold")
    if config.get("PCA") and config.get("percComponentsPCA"):
        components = fit_pca_fraction(tables[0], spec.features, config["percComponentsPCA"], standardize=True)
    elif config.get("PCA") and config.get("numComponents"):
        components = fit_pca(tables[0], spec.features, config["numComponents"])
    elif function and share:
        if function == "PCA":
            components = fit_pca_fraction(tables[0], spec.features, share)
        else:
            _, dropped = best_fraction(tables[0], spec.features, spec.label, function, share)
    elif threshold is not None and threshold != 1:
        dropped = drop_correlated(tables[0], spec.features, threshold)
    if components is not None:
        return Prepared([components.transform(t) for t in tables], spec.with_features(components.names))
    if dropped is not None:
        kept = [f for f in spec.features if f not in dropped]
        return Prepared([t.drop(*dropped) for t in tables], spec.with_features(kept), dropped)
    return Prepared(tables, spec)


def _fit(train: DataFrame, spec: TableSpec, config: Mapping):
    params = dict(config.get("classifierParams") or {})
    if config["classifier"] == "ensembleVoting":
        params = {"members": params["clfParams"], **(config.get("ensembleParams") or {})}
    elif config["classifier"] == "ensembleBagging":
        params = {**params, **(config.get("ensembleParams") or {})}
        if config.get("base_estimator"):
            params["base_estimator"] = config["base_estimator"]
    return CLASSIFIERS[config["classifier"]](train, spec.features, spec.label, spec.row_id, **params)


def _evaluate(train: DataFrame, test: DataFrame, spec: TableSpec, config: Mapping) -> dict:
    if not config.get("balance_before_split"):
        train = balance(train, spec, config)
    prepared = reduce_features([train, test], spec, config)
    train, test = (keep(t) for t in prepared.tables)
    model = _fit(train, prepared.spec, config)
    # training and test rows are predicted together, one job for both scores
    both = test.withColumn("part", F.lit("test")).unionByName(train.withColumn("part", F.lit("train")), True)
    scored = model.predict(both.select(spec.row_id, spec.label, *prepared.spec.features, "part"))
    metrics = classification_metrics(scored, spec.label, "prediction", ["part"])
    out = dict(metrics.get(("test",), {}))
    out["accuracyTrain"] = metrics.get(("train",), {}).get("accuracy")
    if prepared.dropped:
        out["dropedCols"] = prepared.dropped
    if config.get("saveModel"):
        save_model(train.sparkSession, model, config["saveModel"])
    return out


def classification_folds(df: DataFrame, spec: TableSpec, config: Mapping) -> list[dict]:
    """The metrics of the holdout split (one entry) or of every fold."""
    with scope():
        df = fill(df.where(F.col(spec.label).isNotNull()), spec, config)
        if config.get("debug"):
            df = head_fraction(df, spec.row_id)
        if config.get("balance_before_split"):
            df = balance(df, spec, config)
        # plans of caches hold those of the caches they read, at every use: the models start from a table
        df = cut_lineage(df.select(spec.row_id, spec.label, *spec.features))
        if config.get("dataSplitMethod", "split") == "split":
            marked = train_test_split(df, spec.row_id, limit=config.get("numTrainingPoints"))
            parts = [(~F.col("is_test"), F.col("is_test"))]
        else:
            marked = keep(stratified_folds(df, spec.label, spec.row_id, config["kFold"]))
            parts = [(F.col("fold") != i, F.col("fold") == i) for i in range(config["kFold"])]
        results = []
        for train, test in parts:
            with scope():
                rows = [marked.where(p).select(spec.row_id, spec.label, *spec.features) for p in (train, test)]
                results.append(_evaluate(*rows, spec, config))
        return results


def fold_frame(spark, results: Sequence[Mapping], run: str = "run") -> DataFrame:
    """(run, fold, metric, value) of the numeric metrics."""
    rows = [
        (run, i, k, float(v) if v is not None else None)
        for i, r in enumerate(results)
        for k, v in r.items()
        if v is None or isinstance(v, (int, float))
    ]
    return spark.createDataFrame(rows, "run string, fold int, metric string, value double")


def cost(results: Sequence[Mapping]) -> float | None:
    """Mean over the folds of (ref_sensitivity + ref_specificity) / 2."""
    values = [r.get("cost") for r in results]
    return None if not values or any(v is None for v in values) else sum(values) / len(values)


def last_fold_cost(results: Sequence[Mapping]) -> float | None:
    """The cost of the last fold alone."""
    return results[-1].get("cost") if results else None


def classification_job(df: DataFrame, spec: TableSpec, config: Mapping, run: str = "run") -> DataFrame:
    """(run, metric, mean, fold_values)."""
    return fold_summary(fold_frame(df.sparkSession, classification_folds(df, spec, config), run), ["run"])


def clustering_job(df: DataFrame, spec: TableSpec, config: Mapping) -> tuple[DataFrame, dict]:
    """(row_id, cluster) and {ad_rand_score, a silhouette, inertia?}; with ``epsP`` the distance curve.

    The silhouette is the linear one on squared distances (``silhouette_squared``);
    ``{"silhouette": "euclidean"}`` asks for the one that compares all rows with
    each other (``silhouette``), which is quadratic.
    """
    if config.get("silhouette", "squared") not in ("squared", "euclidean"):
        raise ValueError(f"unknown silhouette {config['silhouette']!r}")
    df = balance(fill(df, spec, config), spec, config)
    prepared = reduce_features([df], spec, config)
    points = keep(
        prepared.tables[0].select(
            F.col(spec.row_id).alias("row_id"),
            as_array(prepared.spec.features).alias("vec"),
            F.col(spec.label).alias("label"),
        )
    )
    if config.get("epsP"):
        return nearest_distance_curve(points), {}
    found, extra = CLUSTERERS[config["clusterFunction"]](points, dict(config.get("clusterParams") or {}))
    scored = keep(points.join(found.select("row_id", "cluster"), "row_id"))
    metrics = {"ad_rand_score": adjusted_rand(scored, "label", "cluster").first()[0], **extra}
    if config.get("silhouette", "squared") == "euclidean":
        metrics["silhouette"] = silhouette(scored, "cluster").first()[0]
    else:
        metrics["silhouette_squared"] = silhouette_squared(scored, "cluster")
    return found, metrics


def mining_items(df: DataFrame, spec: TableSpec, config: Mapping) -> DataFrame:
    """(row_id, items): the best features binned and encoded."""
    params = {**MINING_DEFAULTS, **(config.get("miningParams") or {})}
    function = config.get("featureFunction", "f_classif")
    # chi-square needs non-negative values
    scored = RESCALERS["normalize"](df, spec.features).transform(df) if function == "chi2" else df
    kept = best(SCORERS[function](scored, spec.features, spec.label), config.get("nFeatures", 10))
    binned, edges = discretize(scored.select(spec.row_id, *kept), kept, params["n"], params["type"])
    return binned.select(
        spec.row_id, items_of([c for c in kept if c in edges], [c for c in kept if c not in edges]).alias("items")
    )


def mining_job(df: DataFrame, spec: TableSpec, config: Mapping) -> DataFrame:
    """The association rules of the table."""
    params = {**MINING_DEFAULTS, **(config.get("miningParams") or {})}
    df = keep(balance(fill(df, spec, config), spec, config))
    items = keep(mining_items(df, spec, config))
    if params["iteratively_decreasing_support"]:
        itemsets, _ = frequent_itemsets_decreasing(items, "items", params["min_sup"], params["min_patterns"], params["alg"])
    else:
        itemsets = frequent_itemsets(items, "items", params["min_sup"], alg=params["alg"])
    return association_rules(itemsets, params["pattern_metric"], params["min_conf"], params["min_lift"])


def variable_analysis(df: DataFrame, spec: TableSpec, k: int = 10, max_corr: float = 0.94) -> DataFrame:
    """(attribute, x): decorrelated, the k best by ANOVA F, min-max scaled, unpivoted."""
    dropped = drop_correlated(df, spec.features, max_corr)
    left = [f for f in spec.features if f not in dropped]
    kept = best(SCORERS["f_classif"](df, left, spec.label), k)
    scaled = RESCALERS["normalize"](df, kept).transform(df.select(spec.row_id, *kept))
    return scaled.unpivot([spec.row_id], kept, "attribute", "x")
