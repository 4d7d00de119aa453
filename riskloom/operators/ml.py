"""Model training, tuning and scoring with Spark ML (ML-1 .. ML-5, ML-8, IX-13).

Features arrive as the train-fitted encoded and standardised table.  Loops over
models, grid points, folds and seeds are driver control loops; the data stays in
Spark, and every result keeps the claim key.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.evaluate import binary_metrics, roc_auc
from riskloom.operators.explore import class_weights
from riskloom.operators.ordering import materialize
from riskloom.operators.trees import read_trees, staged_scores
from riskloom.session import derived_path

# Baseline hyperparameters and tuning grids (names as the estimators here call them).
BASELINE_PARAMS = {
    "logistic_regression": {"C": 1.0, "penalty": "l2", "maxIter": 3000},
    "random_forest": {"numTrees": 200, "maxDepth": 12},
    "gradient_boosting": {"maxIter": 150, "stepSize": 0.1, "maxDepth": 5},
}
GRIDS = {
    "gradient_boosting": {"maxIter": [100, 150, 200], "stepSize": [0.05, 0.1, 0.15], "maxDepth": [3, 5, 7], "subsamplingRate": [0.7, 0.8, 0.9]},
    "random_forest": {"numTrees": [100, 200, 300], "maxDepth": [8, 12, 16]},
    "logistic_regression": {"C": [0.1, 1.0, 10.0], "penalty": ["l1", "l2"]},
}
#: Balanced class weights are used by these models only.
WEIGHTED = ("logistic_regression", "random_forest")
#: How a forest is grown, not what it is: rows remember their nodes in place of walking every tree again at
#: each level, and a pass grows as many nodes as have their counts in 32 MB, which processor caches serve
#: better than the 256 MB by default.
FOREST_PASSES = {"cacheNodeIds": True, "maxMemoryInMB": 32}
#: Rows of a file of a table that models are fitted on: tasks of every core read one, however few tasks wrote it.
FIT_ROWS = 50_000
#: Fits that run at once: most of a fit's jobs are too short for all cores.
SIDE_BY_SIDE = 4
#: The parameter that says how many trees a model has.
TREE_COUNT = {"random_forest": "numTrees", "gradient_boosting": "maxIter"}


def _at_once(df: DataFrame) -> int:
    """Fits of a search on the stored table ``df`` that run at once: ``SIDE_BY_SIDE``, more if its tasks leave cores idle."""
    return max(SIDE_BY_SIDE, df.sparkSession.sparkContext.defaultParallelism // max(df.rdd.getNumPartitions(), 1))


def grid_points(name: str, grid: dict | None = None) -> list[dict]:
    """All combinations of a model's grid, in grid order."""
    grid = grid or GRIDS[name]
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def with_weights(df: DataFrame, label: str = "fraud_label") -> DataFrame:
    """Balanced class weights as a column (two-row table, broadcast)."""
    w = class_weights(df, label).select(label, F.col("weight").alias("class_weight"))
    return df.join(F.broadcast(w), label)


def estimator(name: str, rows: int, seed: int = 42, label: str = "fraud_label", **overrides):
    """The unfitted classifier.  ``C`` is the inverse penalty of a summed loss; the
    penalty here belongs to a mean loss over ``rows``, hence 1 / (C * rows)."""
    p = {**BASELINE_PARAMS[name], **overrides}
    common = dict(featuresCol="features", labelCol=label)
    if name in WEIGHTED:
        common["weightCol"] = "class_weight"
    if name == "logistic_regression":
        strength = 1.0 / (p.pop("C") * max(rows, 1))
        l1 = 1.0 if p.pop("penalty") == "l1" else 0.0
        return LogisticRegression(**common, regParam=strength, elasticNetParam=l1, standardization=False, tol=1e-4, **p)
    if name == "random_forest":
        return RandomForestClassifier(**common, seed=seed, **{**FOREST_PASSES, **p})
    return GBTClassifier(**common, seed=seed, **p)


def fit(train: DataFrame, features: Sequence[str], name: str, seed: int = 42, **overrides) -> PipelineModel:
    """ML-1: assembler + classifier pipeline fitted on the training rows."""
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    rows = train.count() if name == "logistic_regression" else 0
    return Pipeline(stages=[asm, estimator(name, rows, seed, **overrides)]).fit(with_weights(train) if name in WEIGHTED else train)


def save(model: PipelineModel, path: str) -> None:
    """ML-4: write a fitted pipeline (any Hadoop path)."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """ML-4: read a fitted pipeline."""
    return PipelineModel.load(path)


def model_score(model, df: DataFrame, key: str = "claim_id", threshold: float = 0.5) -> DataFrame:
    """ML-8: probability of the positive class and confidence = max class probability."""
    p = vector_to_array(F.col("probability"))
    return model.transform(df).select(key, "fraud_label", p[1].alias("ml_probability"),
                                      F.array_max(p).alias("confidence"),
                                      (p[1] > F.lit(threshold)).alias("ml_prediction"))


def evaluate(scored: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """EV-1 + EV-2 + EV-3 on model output (exact curves, not binned)."""
    m = binary_metrics(scored, F.col("fraud_label"), F.col("ml_prediction"), group_cols)
    a = roc_auc(scored, "fraud_label", "ml_probability", group_cols)
    return m.join(a, list(group_cols)) if group_cols else m.crossJoin(a)


def _f1(model, df: DataFrame, key: str) -> float:
    scored = model_score(model, df, key)
    return float(binary_metrics(scored, F.col("fraud_label"), F.col("ml_prediction")).select("f1").first()[0])


def tune(train: DataFrame, val: DataFrame, features: Sequence[str], name: str, grid: dict | None = None, seed: int = 42, key: str = "claim_id"):
    """ML-2: each point of the model's grid (``GRIDS`` unless given) fitted on train and
    scored (F1) on the predefined validation split; the best (first on ties) is
    refitted on train + val.  Returns (best params, per-point table rows, refitted model)."""
    rows = []
    best, best_f1 = None, -1.0
    points = grid_points(name, grid)
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        f1s = list(pool.map(lambda params: _f1(fit(train, features, name, seed, **params), val, key), points))
    for params, f1 in zip(points, f1s):
        rows.append((name, str(sorted(params.items())), f1))
        if f1 > best_f1:
            best, best_f1 = params, f1
    return best, rows, fit(train.unionByName(val), features, name, seed, **best)


def _staged_f1s(train: DataFrame, val: DataFrame, features: Sequence[str], name: str, params: dict, sizes: Sequence[int], seed: int, key: str, label: str = "fraud_label") -> dict[int, float]:
    """F1 on ``val`` for every tree count of ``sizes``, from one fit with the most trees: the trees
    that a smaller model would have are the first of a larger one."""
    spark, folder = train.sparkSession, derived_path(train.sparkSession)
    model = fit(train, features, name, seed, **params, **{TREE_COUNT[name]: max(sizes)})
    save(model, folder)
    stage = f"{folder}/stages/{len(model.stages) - 1}_{model.stages[-1].uid}"
    scored = staged_scores(val, key, label, read_trees(spark, stage, features, name == "gradient_boosting"), sizes).withColumn("ml_prediction", F.col("ml_probability") > 0.5)
    return {r["trees"]: float(r["f1"] or 0.0) for r in binary_metrics(scored, F.col(label), F.col("ml_prediction"), ["trees"]).select("trees", "f1").collect()}


def _by_size(name: str, grid: dict) -> tuple[list[dict], list[int]]:
    """The grid's points without their tree count, and its ascending tree counts."""
    count = TREE_COUNT[name]
    return grid_points(name, {k: v for k, v in grid.items() if k != count}) if len(grid) > 1 else [{}], sorted(grid[count])


def tune_trees(train: DataFrame, val: DataFrame, features: Sequence[str], name: str, grid: dict | None = None, seed: int = 42, key: str = "claim_id",
               side_by_side: int = SIDE_BY_SIDE, label: str = "fraud_label"):
    """ML-2 for a forest or boosted model: the result of ``tune``, with fewer fits.  One fit with the most
    trees scores every tree count of the grid; ``side_by_side`` candidates are fitted at once on one stored table."""
    grid = dict(grid or GRIDS[name])
    train, val = materialize(train.select(key, label, *features)), materialize(val.select(key, label, *features))
    others, sizes = _by_size(name, grid)
    with ThreadPoolExecutor(side_by_side) as pool:
        found = list(pool.map(lambda params: _staged_f1s(train, val, features, name, params, sizes, seed, key, label), others))
    f1 = {tuple(sorted({**params, TREE_COUNT[name]: n}.items())): v for params, of in zip(others, found) for n, v in of.items()}
    rows = [(name, str(sorted(p.items())), f1[tuple(sorted(p.items()))]) for p in grid_points(name, grid)]
    best = max(grid_points(name, grid), key=lambda p: f1[tuple(sorted(p.items()))])
    return best, rows, fit(train.unionByName(val), features, name, seed, **best)


def stratified_folds(df: DataFrame, key: str, folds: int = 5, label: str = "fraud_label") -> DataFrame:
    """Adds ``fold``: each class is dealt to the folds in the order of a hash of the
    key, so every fold has the same share of each class (to one row)."""
    from riskloom.operators.ordering import running_totals
    one = "_rl_one"
    h = df.withColumn("_rl_h", F.xxhash64(key)).withColumn(one, F.lit(1).cast("long"))
    placed = running_totals(h, [label], ["_rl_h", key], [one])
    return placed.withColumn("fold", F.pmod(F.col(f"cum_{one}") - 1, F.lit(folds)).cast("int")).drop("_rl_h", one, f"cum_{one}")


def cross_validate(pool: DataFrame, features: Sequence[str], name: str, key: str, grid: dict | None = None, folds: int = 5, seed: int = 42):
    """ML-3: stratified k-fold grid search on F1 over train + validation, refitted on
    the whole pool with the best point (first on ties).  The grid is the model's in ``GRIDS`` unless given;
    a boosted model is fitted once a fold for all its tree counts.  Returns (best params, table rows, model)."""
    dealt = materialize(stratified_folds(pool.select(key, "fraud_label", *features), key, folds), FIT_ROWS)
    grid = dict(grid or GRIDS[name])
    count = TREE_COUNT["gradient_boosting"]         # a smaller forest draws other rows: it is no part of a larger one
    others, sizes = _by_size(name, grid) if name == "gradient_boosting" and count in grid else (grid_points(name, grid), None)

    def fold_f1s(case: tuple) -> dict:
        params, i = case
        train, val = dealt.where(F.col("fold") != i), dealt.where(F.col("fold") == i)
        if sizes is None:
            return {None: _f1(fit(train, features, name, seed, **params), val, key)}
        return _staged_f1s(train, val, features, name, params, sizes, seed, key)

    with ThreadPoolExecutor(_at_once(dealt)) as threads:
        found = list(threads.map(fold_f1s, product(others, range(folds))))
    at = {tuple(sorted(params.items())): found[i * folds:(i + 1) * folds] for i, params in enumerate(others)}
    rows, best, best_f1 = [], None, -1.0
    for params in grid_points(name, grid):
        of = at[tuple(sorted((k, v) for k, v in params.items() if sizes is None or k != count))]
        mean = sum(f.get(params[count] if sizes else None, 0.0) for f in of) / folds
        rows.append((name, str(sorted(params.items())), mean))
        if mean > best_f1:
            best, best_f1 = params, mean
    return best, rows, fit(dealt, features, name, seed, **best)


def seed_refits(pool: DataFrame, test: DataFrame, features: Sequence[str], params: dict[str, dict], seeds: Sequence[int]) -> DataFrame:
    """ML-5: every model refitted on train + validation with fixed parameters and each
    seed, evaluated on test: (model, seed, metric, value), ``ring_recall``
    being the share of fraudulent ring claims that are caught (0 without any).
    ``SIDE_BY_SIDE`` refits run at once; the scores of each are stored for its metrics."""
    ring = test.select("claim_id", "ring_id")

    def refit(case: tuple) -> DataFrame:
        name, seed = case
        scored = materialize(model_score(fit(pool, features, name, seed, **params[name]), test).join(ring, "claim_id"))
        rare = (F.col("ring_id") > 0) & (F.col("fraud_label") == 1)
        caught = scored.agg(F.coalesce(F.try_divide(F.count_if(rare & F.col("ml_prediction")), F.count_if(rare)), F.lit(0.0)).alias("ring_recall"))
        m = evaluate(scored).select("accuracy", "precision", "recall", "f1", "roc_auc").crossJoin(caught)
        return materialize(m.select(F.lit(name).alias("model"), F.lit(seed).alias("seed"), *[F.col(c).cast("double").alias(c) for c in m.columns]))

    with ThreadPoolExecutor(SIDE_BY_SIDE) as threads:
        out = reduce(DataFrame.unionByName, threads.map(refit, product(params, seeds)))
    return out.unpivot(["model", "seed"], ["accuracy", "precision", "recall", "f1", "roc_auc", "ring_recall"], "metric", "value")


def importances(model, features: Sequence[str], top: int = 20) -> list[tuple[str, float]]:
    """IX-13: impurity importances of the tree stage, top n (a features-sized list)."""
    imp = model.stages[-1].featureImportances.toArray()
    pairs = sorted(zip(features, (float(x) for x in imp)), key=lambda t: (-t[1], t[0]))
    return pairs[:top]
