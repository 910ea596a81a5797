"""Sweeps, random search and learning curves."""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import uniform
from millrace.functions.vectors import as_array
from millrace.operators.bayes import class_moments, model_from
from millrace.operators.classify import class_index, classes_of, vote
from millrace.operators.neighbors import knn_until
from millrace.operators.sample import stratified_folds
from millrace.operators.score import confusion_counts, metrics_of
from millrace.plans import jobs
from millrace.session import keep
from millrace.sources import runs
from millrace.spec import TableSpec


def grid(base: Mapping, variations: Sequence[Mapping]) -> list[dict]:
    """All combinations of the variations, the first one outermost.

    A variation is ``{"name", "values"}`` for a top-level key or also has
    ``subName`` for a key one level down.
    """
    configs = [copy.deepcopy(dict(base))]
    for v in variations:
        grown = []
        for config in configs:
            for value in v["values"]:
                c = copy.deepcopy(config)
                if "subName" in v:
                    c[v["name"]] = {**(c.get(v["name"]) or {}), v["subName"]: value}
                else:
                    c[v["name"]] = value
                grown.append(c)
        configs = grown
    return configs


def ordered(variations: Sequence[Mapping], priority: Sequence[str]) -> list[Mapping]:
    """The variations in the order of the priority line."""
    by_name = {v.get("subName", v["name"]): v for v in variations}
    return [by_name[p] for p in priority]


def run_all(configs: Sequence[Mapping], run: Callable[[Mapping], Mapping], parallel: int = 4) -> list[dict]:
    """One result per configuration; runs share the session, which interleaves their stages."""
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return [dict(r) for r in pool.map(run, configs)]


def trial_values(spark, ranges: Mapping[str, Mapping], trials: int = 30, seed: int = 0) -> list[dict]:
    """Reproducible random draws: ``{"int": [lo, hi]}``, ``uniform``, ``loguniform``,
    ``discrete`` [lo, hi, step] or ``categorical`` [...] per parameter."""
    names = sorted(ranges)
    draws = spark.range(trials).select("id", *[uniform(f"{seed}:{n}", "id").alias(n) for n in names]).orderBy("id")
    out = []
    for row in draws.collect():
        trial = {}
        for n in names:
            (kind, args), u = next(iter(ranges[n].items())), row[n]
            if kind == "int":
                trial[n] = int(args[0] + math.floor(u * (args[1] - args[0] + 1)))
            elif kind == "uniform":
                trial[n] = args[0] + u * (args[1] - args[0])
            elif kind == "loguniform":
                trial[n] = math.exp(math.log(args[0]) + u * (math.log(args[1]) - math.log(args[0])))
            elif kind == "discrete":
                steps = math.floor((args[1] - args[0]) / args[2] + 1e-9) + 1
                trial[n] = args[0] + args[2] * math.floor(u * steps)
            elif kind == "categorical":
                trial[n] = args[math.floor(u * len(args))]
            else:
                raise ValueError(f"unknown range {kind}")
        out.append(trial)
    return out


def search(spark, ranges: Mapping, objective: Callable[[Mapping], float | None], trials: int = 30, seed: int = 0, parallel: int = 4) -> DataFrame:
    """(trial, <parameters as text>, value, best): maximises the objective."""
    drawn = trial_values(spark, ranges, trials, seed)
    distinct = [dict(t) for t in {tuple(sorted(d.items())) for d in drawn}]
    values = run_all(distinct, lambda p: {"value": objective(p)}, parallel)
    known = {tuple(sorted(p.items())): v["value"] for p, v in zip(distinct, values)}
    scored = [(i, t, known[tuple(sorted(t.items()))]) for i, t in enumerate(drawn)]
    top = max((v for *_, v in scored if v is not None), default=None)
    names = sorted(ranges)
    rows = [(i, *[str(t[n]) for n in names], v, v is not None and v == top) for i, t, v in scored]
    fields = ", ".join(["trial int", *[f"`{n}` string" for n in names], "value double", "best boolean"])
    return spark.createDataFrame(rows, fields)


def ranges_of(config: Mapping) -> dict[str, Mapping]:
    """Entries marked ``{"optimize": {kind: range}}``, by dotted path."""
    out: dict[str, Mapping] = {}
    for k, v in config.items():
        if isinstance(v, Mapping):
            if set(v) == {"optimize"}:
                out[k] = v["optimize"]
            else:
                out |= {f"{k}.{sub}": r for sub, r in ranges_of(v).items()}
    return out


def with_values(config: Mapping, values: Mapping) -> dict:
    """The configuration with the values put in at their dotted paths."""
    out = copy.deepcopy(dict(config))
    for path, value in values.items():
        *parents, last = path.split(".")
        inner = out
        for p in parents:
            inner = inner[p]
        inner[last] = value
    return out


def search_job(
    df: DataFrame,
    spec: TableSpec,
    config: Mapping,
    trials: int = 30,
    seed: int = 0,
    parallel: int = 4,
    objective: Callable[[Sequence[Mapping]], float | None] = jobs.cost,
) -> DataFrame:
    """Random search over the entries of a classification job that are marked to be optimised, by its cost."""
    df = keep(df)

    def value(values: Mapping) -> float | None:
        return objective(jobs.classification_folds(df, spec, with_values(config, values)))

    return search(df.sparkSession, ranges_of(config), value, trials, seed, parallel)


def mean_metrics(results: Sequence[Mapping]) -> dict[str, float]:
    """Numeric metrics averaged over the folds that have them."""
    names = {k for r in results for k, v in r.items() if isinstance(v, (int, float))}
    known = {k: [float(r[k]) for r in results if r.get(k) is not None] for k in names}
    return {k: sum(v) / len(v) for k, v in sorted(known.items())}


def sweep(
    df: DataFrame,
    spec: TableSpec,
    base: Mapping,
    variations: Sequence[Mapping],
    priority: Sequence[str],
    out: str,
    levels: Sequence[int] = (),
    parallel: int = 4,
) -> DataFrame:
    """Runs a classification job for every combination and unifies the records below ``out``.

    Writes ``config`` and ``metrics`` (JSON, a record per run), ``output`` (one CSV
    table of all runs) and, for each flagged level i, ``level<i>``: the same table
    in a folder for each combination of the first i variations.
    """
    spark, df = df.sparkSession, keep(df)
    lines = ordered(variations, priority)
    configs = grid(base, lines)
    width = len(str(len(configs)))
    names = [f"run{i:0{width}d}" for i in range(len(configs))]
    found = run_all(configs, lambda c: mean_metrics(jobs.classification_folds(df, spec, c)), parallel)
    runs.write_records(spark, dict(zip(names, configs)), f"{out}/config")
    columns = sorted({k for r in found for k in r})
    rows = [(n, *[r.get(c) for c in columns]) for n, r in zip(names, found)]
    fields = ", ".join(["run string", *[f"`{c}` double" for c in columns]])
    runs.write_metrics(spark.createDataFrame(rows, fields), f"{out}/metrics")
    table = runs.unify_to_csv(spark, f"{out}/config", f"{out}/metrics", f"{out}/output")
    for level in levels:
        folders = [v.get("subName", v["name"]) for v in lines[:level]]
        runs.as_text_cells(table).write.mode("overwrite").option("header", True).partitionBy(*folders).csv(f"{out}/level{level}")
    return table


def neighbor_sweep(near: DataFrame, label: str, truth: DataFrame, ks: Sequence[int], weights: Sequence[str]) -> DataFrame:
    """Predictions of every (k, weights) from one neighbour table of the largest k.

    ``truth`` is (row_id, label).  A neighbour row is handed to the few
    configurations with k >= rank; no neighbour is searched twice.
    """
    parts = []
    for w in weights:
        configs = F.array(*[F.lit(k) for k in ks])
        per_k = near.withColumn("n_neighbors", F.explode(F.filter(configs, lambda k: k >= F.col("rank"))))
        # the configuration becomes part of the row identity of the vote
        keyed = per_k.withColumn("row_id", F.struct("row_id", "n_neighbors"))
        parts.append(
            vote(keyed, label, w).select(
                F.col("row_id.row_id").alias("row_id"),
                F.col("row_id.n_neighbors").alias("n_neighbors"),
                F.lit(w).alias("weights"),
                "prediction",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(truth, "row_id")


def bayes_learning_curve(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0),
    folds: int = 5,
    seed: int = 0,
) -> DataFrame:
    """(size, train_mean, train_std, test_mean, test_std) of naive Bayes accuracy.

    A training set is a hash prefix of the other folds, so the moments of every
    (fold, size) model pool from one grouped pass; a second pass scores every row
    under all of them at once.
    """
    marked = stratified_folds(df, label, row_id, folds)
    u = uniform(f"{seed}:curve", row_id)
    step = F.lit(0)
    for s in list(sizes)[:-1]:
        step = step + (u >= F.lit(float(s))).cast("int")
    marked = marked.withColumn("step", step).persist()
    moments = class_moments(marked, features, label, ["fold", "step"])
    cells = []
    for f in range(folds):
        for i, _ in enumerate(sizes):
            model = model_from([m for m in moments if m.part[0] != f and m.part[1] <= i], features)
            hit = (model.prediction() == F.col(label)).cast("bigint")
            test = F.col("fold") == F.lit(f)
            train = (F.col("fold") != F.lit(f)) & (F.col("step") <= F.lit(i))
            for name, rows in (("test", test), ("train", train)):
                cells.append(F.sum(F.when(rows, hit)).alias(f"{name}_{f}_{i}_hit"))
                cells.append(F.count(F.when(rows, F.lit(1))).alias(f"{name}_{f}_{i}_n"))
    one = marked.agg(*cells).first()
    marked.unpersist()
    rows = []
    for i, s in enumerate(sizes):
        row = [float(s)]
        for name in ("train", "test"):
            scores = [
                one[f"{name}_{f}_{i}_hit"] / one[f"{name}_{f}_{i}_n"] for f in range(folds) if one[f"{name}_{f}_{i}_n"]
            ]
            mean = sum(scores) / len(scores)
            row += [mean, math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores))]
        rows.append(tuple(row))
    return df.sparkSession.createDataFrame(
        rows, "size double, train_mean double, train_std double, test_mean double, test_std double"
    )


def nearest_learning_curve(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    n_neighbors: int = 5,
    sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0),
    folds: int = 5,
    seed: int = 0,
) -> DataFrame:
    """(size, train_mean, train_std, test_mean, test_std) of the accuracy of nearest neighbours.

    One neighbour join for all models: a neighbour brings its fold and the first
    size it belongs to, and the nearest rows of every (fold, size) training set are
    read off the list in order of distance.  Only rows whose list runs short in some
    training set are looked up deeper.  Equal votes go to the lowest label; a model
    without training rows scores nothing, a size without a score is null.
    """
    classes = classes_of(df, label)
    marked = stratified_folds(df, label, row_id, folds)
    u = uniform(f"{seed}:curve", row_id)
    step = sum(((u >= F.lit(float(s))).cast("int") for s in list(sizes)[:-1]), F.lit(0))
    place = (step * folds + F.col("fold")) * len(classes) + class_index(label, classes)
    rows = keep(marked.select(F.col(row_id).alias("row_id"), as_array(features).alias("vec"), place.cast("bigint").alias("place")))

    def models(batches: Iterator[pd.DataFrame], score: Callable) -> Iterator[pd.DataFrame]:
        """Calls ``score(pdf, size, fold, own, part, met, votes)`` for every model that a row concerns."""
        for pdf in batches:
            if not len(pdf):
                continue
            width = max(len(x) for x in pdf["near"])
            near = np.full((len(pdf), width), -1, np.int64)
            for i, x in enumerate(pdf["near"]):
                near[i, : len(x)] = x
            kind, fold, first = near % len(classes), near // len(classes) % folds, near // len(classes) // folds
            own = pdf["place"].to_numpy()
            own_fold, own_first = own // len(classes) % folds, own // len(classes) // folds
            for s in range(len(sizes)):
                for f in range(folds):
                    inside = (near >= 0) & (fold != f) & (first <= s)
                    met = inside.cumsum(axis=1)
                    for part, concerned in (("test", own_fold == f), ("train", (own_fold != f) & (own_first <= s))):
                        at = np.nonzero(concerned)[0]
                        chosen = inside[at] & (met[at] <= n_neighbors)
                        yield from score(pdf, s, f, part, at, met[at, -1], [(chosen & (kind[at] == c)).sum(axis=1) for c in range(len(classes))])

    def lacking(batches):
        def score(pdf, s, f, part, at, met, votes):
            yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy()[at[met < n_neighbors]]})

        return models(batches, score)

    def scored(batches):
        def score(pdf, s, f, part, at, met, votes):
            if len(at):
                hit = np.argmax(np.stack(votes), axis=0) == pdf["place"].to_numpy()[at] % len(classes)
                yield pd.DataFrame({"size": [s], "fold": [f], "part": [part], "hits": [int((hit & (met > 0)).sum())], "n": [int((met > 0).sum())]})

        return models(batches, score)

    def listed(lists: DataFrame) -> DataFrame:
        near = lists.groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "place"))), lambda x: x["place"]).alias("near"))
        return near.join(rows.select("row_id", "place"), "row_id")

    # so many rows hold n_neighbors of the smallest training set, and some more
    depth = math.ceil(1.5 * n_neighbors / (min(sizes) * (1 - 1 / folds))) + 16
    near = knn_until(rows, rows, depth, lambda lists: listed(lists).mapInPandas(lacking, "row_id bigint").distinct(), carry="place")
    cells = listed(near).mapInPandas(scored, "size int, fold int, part string, hits bigint, n bigint")
    sums = cells.groupBy("size", "fold", "part").agg((F.sum("hits") / F.nullif(F.sum("n"), F.lit(0))).alias("accuracy"))
    # one row per size, fold and part
    values: dict = {}
    for r in sums.where("accuracy IS NOT NULL").collect():
        values.setdefault((r["size"], r["part"]), []).append(r["accuracy"])
    out = []
    for s, size in enumerate(sizes):
        pairs = [values.get((s, part), []) for part in ("train", "test")]
        out.append((float(size), *[x for v in pairs for x in ((float(np.mean(v)), float(np.std(v))) if v else (None, None))]))
    return df.sparkSession.createDataFrame(out, "size double, train_mean double, train_std double, test_mean double, test_std double")


def learning_curve(
    df: DataFrame,
    fit: Callable,
    features: Sequence[str],
    label: str,
    row_id: str,
    sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0),
    folds: int = 5,
    seed: int = 0,
) -> DataFrame:
    """(size, fold, train_score, test_score) for any classifier ``fit(df, features, label, row_id)``."""
    marked = stratified_folds(df, label, row_id, folds).withColumn("u_", uniform(f"{seed}:curve", row_id)).persist()
    rows = []
    for s in sizes:
        for f in range(folds):
            train = marked.where((F.col("fold") != f) & (F.col("u_") < s))
            model = fit(train, features, label, row_id)
            both = train.withColumn("part", F.lit("train")).unionByName(
                marked.where(F.col("fold") == f).withColumn("part", F.lit("test"))
            )
            cells: dict = {}
            for r in confusion_counts(model.predict(both), label, "prediction", ["part"]).collect():
                cells.setdefault(r["part"], {})[(r["label"], r["prediction"])] = r["n"]
            rows.append((float(s), f, *[metrics_of(cells.get(p, {})).get("accuracy") for p in ("train", "test")]))
    marked.unpersist()
    return df.sparkSession.createDataFrame(rows, "size double, fold int, train_score double, test_score double")
