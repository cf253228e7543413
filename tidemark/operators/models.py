"""Samples, linear and tree-based forecasters, and the experiment grid.

Ridge is fitted per series (or any keys) from one distributed pass: the moment matrix of each
cell is a vector sum, and every penalty is solved from that one small matrix. Trees are
Spark ML models fitted on all series together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.tasks import by_value
from tidemark.operators.blocks import KEYS
from tidemark.operators.features import FEATURE_SETS, experiment_features
from tidemark.operators.metrics import regression_metrics, seed_summary
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.stage import register, shared_folder, stored
from tidemark.schemas import require_columns

# Penalties, seeds and tree settings of the experiments.
ALPHAS = (0.1, 1.0, 10.0, 100.0)
SEEDS = (20260921, 1, 2)
TREE_SETTINGS = {"stepSize": 0.05, "maxDepth": 4, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"}


def segment_samples(
    features: DataFrame,
    columns: Sequence[str],
    horizons: Sequence[int] = (1, 3, 6),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Usable rows in long form: keys, segment, horizon, ``observed_at``, ``x``, ``y``.

    Missing features stay NULL inside ``x``; whether such rows are dropped or filled is the
    model's choice.
    """
    require_columns(features, [*columns, *[f"target_h{h}" for h in horizons]], "features")
    # ``x`` travels through the generator: a later filter on it then stays above the generator
    # instead of being rewritten over every feature expression.
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    lines = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"), F.col(f"target_h{h}").alias("y"),
                F.col(f"usable_h{h}").alias("_usable"), x,
            )
            for h in horizons
        ]
    )
    return features.select(*keys, "segment", "observed_at", F.inline(lines)).filter("_usable").drop("_usable")


def is_complete(x: Column) -> Column:
    return ~F.exists(x, lambda v: v.isNull() | F.isnan(v))


def sample_counters(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Usable rows, rows and cells with missing features, and violated targets per cell."""
    empty = F.size(F.filter("x", lambda v: v.isNull()))
    return samples.groupBy(*keys, "segment", "horizon").agg(
        F.count("*").alias("usable_rows"),
        F.count_if(empty > 0).alias("missing_feature_rows"),
        F.sum(empty).alias("missing_feature_cells"),
        F.count_if(F.col("y").isNull()).alias("bad_targets"),
    )


def complete_cases(samples: DataFrame) -> DataFrame:
    """Rows without any missing feature; ``sample_counters`` tells how many were dropped."""
    return samples.filter(is_complete(F.col("x")))


def feature_statistics(samples: DataFrame, width: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Train-only mean and population deviation per feature; a constant column scales by 1."""
    train = complete_cases(samples.filter(F.col("segment") == "train"))
    columns = [F.get("x", F.lit(i)) for i in range(width)]
    deviation = [F.stddev_pop(c) for c in columns]
    return train.groupBy(*keys, "horizon").agg(
        F.count("*").alias("fit_rows"),
        F.array(*[F.avg(c) for c in columns]).alias("mean"),
        F.array(*[F.when(d > 0, d).otherwise(F.lit(1.0)) for d in deviation]).alias("scale"),
    )


def entirely_missing(samples: DataFrame, width: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells with a feature that has no train value at all (they cannot be standardised)."""
    train = samples.filter(F.col("segment") == "train")
    counts = train.groupBy(*keys, "horizon").agg(
        F.array(*[F.count(F.get("x", F.lit(i))) for i in range(width)]).alias("_n")
    )
    return counts.filter(F.array_contains("_n", 0)).drop("_n")


def train_medians(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact train median of every feature per (keys, horizon) as one array column."""
    train = samples.filter(F.col("segment") == "train")
    long = train.select(*keys, "horizon", F.posexplode("x").alias("feature", "value"))
    by = [*keys, "horizon"]
    medians = exact_quantiles(long, "value", [0.5], [*by, "feature"])
    pairs = F.array_sort(F.collect_list(F.struct("feature", "value")))
    return medians.groupBy(*by).agg(pairs["value"].alias("medians"))


def fill_missing(samples: DataFrame, medians: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fill missing features with the train medians; ``imputed_cells`` counts the fills, ``missing`` marks them with 1."""
    joined = samples.join(medians, [*keys, "horizon"])
    return (
        joined.withColumn("imputed_cells", F.size(F.filter("x", lambda v: v.isNull())))
        .withColumn("missing", F.transform("x", lambda v: v.isNull().cast("int")))
        .withColumn("x", F.zip_with("x", "medians", lambda v, m: F.coalesce(v, m)))
        .drop("medians")
    )


# --- ridge ---------------------------------------------------------------------------


def moment_matrices(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum of the outer product of (1, x, y) over the complete train rows of each cell.

    A vector sum: partial per task, then one small vector per cell and task is shuffled.
    """
    train = complete_cases(samples.filter(F.col("segment") == "train"))
    row = F.concat(F.array(F.lit(1.0)), F.col("x"), F.array("y"))
    outer = F.flatten(F.transform(row, lambda a: F.transform(row, lambda b: a * b)))
    return train.groupBy(*keys, "horizon").agg(
        vector_to_array(Summarizer.sum(array_to_vector(outer))).alias("moments")
    )


def _solve(moments: Sequence[float], alphas: Sequence[float]) -> list[dict]:
    """Ridge on standardised features from one moment matrix, one solution per penalty."""
    size = int(round(len(moments) ** 0.5))
    full = np.asarray(moments, dtype="float64").reshape(size, size)
    n = full[0, 0]
    mean = full[0, 1:-1] / n
    y_mean = full[0, -1] / n
    covariance = full[1:-1, 1:-1] / n - np.outer(mean, mean)
    variance = np.diag(covariance).copy()
    # A column that is constant up to rounding has no spread of its own.
    flat = variance <= 1e-12 * np.maximum(np.diag(full)[1:-1] / n, 1e-300)
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, variance)))
    covariance[flat, :] = 0.0
    covariance[:, flat] = 0.0
    gram = covariance / np.outer(scale, scale) * n
    against = (full[1:-1, -1] / n - mean * y_mean) / scale * n
    against[flat] = 0.0
    solutions = []
    for alpha in alphas:
        weights = np.linalg.solve(gram + alpha * np.eye(size - 2), against)
        slopes = weights / scale
        solutions.append(
            {
                "alpha": float(alpha),
                "fit_rows": int(round(n)),
                "mean": mean.tolist(),
                "scale": scale.tolist(),
                "coefficients": weights.tolist(),
                "slopes": slopes.tolist(),
                "intercept": float(y_mean),
                "offset": float(y_mean - slopes @ mean),
            }
        )
    return solutions


def fit_ridge(
    samples: DataFrame, alphas: Sequence[float] = ALPHAS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row per (keys, horizon, alpha) with the standardiser and the coefficients.

    ``slopes``/``offset`` are the same model in raw feature units. The solver sees one moment
    matrix per row, never the samples.
    """
    penalties = [float(a) for a in alphas]
    usable = [a for a in penalties if 0 < a < float("inf")]
    if len(usable) < max(1, len(penalties)):
        raise ValueError(f"every penalty has to be a finite number above zero: {penalties}")
    matrices = moment_matrices(samples, keys)
    kept = [f for f in matrices.schema.fields if f.name != "moments"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += (
        ", alpha double, fit_rows bigint, mean array<double>, scale array<double>, "
        "coefficients array<double>, slopes array<double>, intercept double, offset double"
    )
    names = [f.name for f in kept]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                {**{c: record[c] for c in names}, **solution}
                for record in batch.to_dict("records")
                for solution in _solve(record["moments"], penalties)
            ]
            if rows:
                yield pd.DataFrame(rows)

    return matrices.mapInPandas(solve, schema)


def linear_value(x: Column, slopes: Column, offset: Column) -> Column:
    """``offset + slopes . x``; a missing feature makes it NULL."""
    products = F.zip_with(x, slopes, lambda a, b: a * b)
    return F.aggregate(products, offset.cast("double"), lambda total, p: total + p)


def ridge_predictions(
    samples: DataFrame, models: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Long forecasts rows for one model per (keys, horizon); incomplete rows are NULL."""
    on = [*keys, "horizon"]
    joined = samples.join(models.select(*on, "slopes", "offset"), on)
    return joined.select(
        *keys, "horizon", "segment", F.col("observed_at").alias("anchor"), F.col("y").alias("observed"),
        linear_value(F.col("x"), F.col("slopes"), F.col("offset")).alias("prediction"),
    )


def select_alpha(
    samples: DataFrame, models: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Penalty with the smallest validation error per (keys, horizon); ties take the smaller.

    The models of a cell are gathered into one row (as many as penalties), so validation rows
    are joined and scored once, not once per penalty. Without any score the smallest penalty
    is chosen and its error is NULL.
    """
    on = [*keys, "horizon"]
    fields = [c for c in models.columns if c not in on]
    packed = models.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_models"))
    validation = samples.filter(F.col("segment") == "validation").join(packed, on)
    errors = F.transform(
        "_models",
        lambda m: F.struct(
            m["alpha"].alias("alpha"),
            F.abs(linear_value(F.col("x"), m["slopes"], m["offset"]) - F.col("y")).alias("error"),
        ),
    )
    scored = (
        validation.select(*on, F.inline(errors)).groupBy(*on, "alpha").agg(F.avg("error").alias("mae"))
    )
    table = packed.select(*on, F.inline("_models")).join(scored, [*on, "alpha"], "left")
    choice = F.struct(F.col("mae").isNull(), F.col("mae"), F.col("alpha"))
    return table.groupBy(*on).agg(
        F.min_by(F.struct(*fields, F.col("mae").alias("validation_mae")), choice).alias("_best")
    ).select(*on, "_best.*")


# --- trees ---------------------------------------------------------------------------


def tree_rows(filled: DataFrame) -> DataFrame:
    """Feature vectors for Spark ML: the filled features, then one column each that tells where one was missing.

    Rows without the marks of ``fill_missing`` have no such columns.
    """
    x = F.col("x")
    if "missing" in filled.columns:
        x = F.concat(x, F.col("missing").cast("array<double>"))
    return filled.withColumn("features", array_to_vector(x))


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """The round with the least error before ``patience`` rounds brought nothing, and whether they did."""
    best = 0
    for n, error in enumerate(errors):
        if error < errors[best]:
            best = n
        elif n - best >= patience:
            return best, True
    return best, False


def fit_trees(
    rows: DataFrame, seed: int, rounds: int = 2000, patience: int = 50, **settings: object
) -> GBTRegressionModel:
    """Boosted trees on the train rows; the validation rows choose how many.

    Boosting goes on until ``patience`` further rounds have not lowered the squared validation error, or to ``rounds``.
    Rounds are tried in doubling numbers: a round depends on those before it and the seed alone, so a longer
    fit repeats the shorter one. Without validation rows all ``rounds`` are the model.
    """
    options = {**TREE_SETTINGS, **settings}
    train = rows.filter(F.col("segment") == "train").select("features", "y")
    validation = rows.filter(F.col("segment") == "validation").select("features", "y")

    def fit(many: int) -> GBTRegressionModel:
        return GBTRegressor(
            featuresCol="features", labelCol="y", predictionCol="prediction", seed=seed, maxIter=many, maxBins=64, **options
        ).fit(train)

    if not validation.take(1):
        return fit(rounds)
    tried = min(rounds, patience + patience // 4 + 1)
    while True:
        model = fit(tried)
        best, settled = best_round(model.evaluateEachIteration(validation, "squared"), patience)
        if settled or tried >= rounds:
            return model if best + 1 == tried else fit(best + 1)
        tried = min(rounds, 2 * tried)


def tree_nodes(model: GBTRegressionModel) -> DataFrame:
    """The ensemble as a table: ``tree, weight, node, feature, border, left, right, value``.

    A row at an inner node goes left where the feature is at most the border; leaves have no feature. The table has at most
    ``rounds * 2 ** (depth + 1)`` rows, whatever the model was fitted on.
    """
    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.save(path)
    register(path)
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
    node = F.col("nodeData")
    inner = node["leftChild"] >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.get(weights, F.col("treeID")).alias("weight"),
        node["id"].alias("node"),
        F.when(inner, node["split"]["featureIndex"]).alias("feature"),
        F.when(inner, F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("border"),
        F.when(inner, node["leftChild"]).alias("left"),
        F.when(inner, node["rightChild"]).alias("right"),
        node["prediction"].alias("value"),
    )


def walk_trees(rows: DataFrame, nodes: DataFrame, depth: int = 4, features: str = "features") -> DataFrame:
    """``rows`` with ``prediction``, from the table of nodes alone: every row steps down every tree, all at once.

    The nodes are a bounded table, gathered into one map of nodes by tree; each step is a lookup in it.
    """
    entry = F.struct(F.struct("tree", "node").alias("key"), F.struct("feature", "border", "left", "right", "value").alias("value"))
    held = nodes.agg(
        F.map_from_entries(F.collect_list(entry)).alias("_nodes"),
        F.array_sort(F.collect_set(F.struct("tree", "weight"))).alias("_trees"),
    )
    at = vector_to_array(F.col(features))

    def down(tree: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            here = F.element_at("_nodes", F.struct(tree["tree"].alias("tree"), node.alias("node")))
            left = F.get("_x", here["feature"]) <= here["border"]
            return F.when(here["feature"].isNull(), node).when(left, here["left"]).otherwise(here["right"])

        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)
        return tree["weight"] * F.element_at("_nodes", F.struct(tree["tree"].alias("tree"), leaf.alias("node")))["value"]

    # One row; it travels to the tasks like a parameter.
    joined = rows.withColumns({"_x": at, "_one": F.lit(1)}).join(F.broadcast(held.withColumn("_one", F.lit(1))), "_one")
    total = F.aggregate(F.transform("_trees", down), F.lit(0.0), lambda a, v: a + v)
    return joined.withColumn("prediction", total).drop("_x", "_one", "_nodes", "_trees")


# --- experiment grid -----------------------------------------------------------------


def run_experiments(
    features: DataFrame,
    *,
    experiments: Sequence[str] = tuple(FEATURE_SETS),
    horizons: Sequence[int] = (1, 3, 6),
    seeds: Sequence[int] = SEEDS,
    models: Sequence[str] = ("ridge", "trees"),
    alphas: Sequence[float] = ALPHAS,
    rounds: int = 2000,
    patience: int = 50,
    parallel: int = 4,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Predictions of every (experiment, model, horizon, seed) on all three segments.

    ``features`` should be a stored table: each cell reads it. Ridge has no randomness, so
    its single fit per cell is listed under every seed. Tree fits run a few at a time, like
    the folds of a cross validator; test rows are only predicted, never fitted.
    """
    parts: list[DataFrame] = []
    jobs = []
    seed_list = F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed")
    for experiment in experiments:
        columns = experiment_features(features, experiment)
        samples = segment_samples(features, columns, horizons, keys)
        tag = F.lit(experiment).alias("experiment")
        if "ridge" in models:
            best = select_alpha(samples, fit_ridge(samples, alphas, keys), keys)
            fitted = ridge_predictions(samples, best, keys)
            parts.append(fitted.select("*", tag, F.lit("ridge").alias("model"), seed_list))
        if "trees" in models:
            # Filled once per experiment; a horizon is a folder of its own, which its seeds read.
            filled = fill_missing(samples, train_medians(samples, keys), keys)
            rows = tree_rows(stored(filled, "samples", ["horizon"]))
            for horizon in horizons:
                cell = rows.filter(F.col("horizon") == horizon)
                jobs += [(experiment, cell, int(seed)) for seed in seeds]

    def train(job: tuple[str, DataFrame, int]) -> DataFrame:
        experiment, cell, seed = job
        model = fit_trees(cell, seed, rounds, patience)
        return model.transform(cell).select(
            *keys, "horizon", "segment", F.col("observed_at").alias("anchor"),
            F.col("y").alias("observed"), "prediction", F.lit(experiment).alias("experiment"),
            F.lit("trees").alias("model"), F.lit(seed).alias("seed"),
        )

    if jobs:
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            target = inheritable_thread_target(features.sparkSession)(train)
            parts += list(pool.map(target, jobs))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def experiment_scores(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scores per seed summarised to mean and population deviation per cell."""
    cell = ["experiment", "model", "horizon", "segment"]
    per_seed = regression_metrics(predictions, [*cell, "seed"], keys)
    return seed_summary(per_seed, [*keys, *cell])


by_value(__name__)
