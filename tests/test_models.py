from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import START, HOUR
from tidemark.operators import metrics, models


def sample_frame(spark, keys=("a", "b"), rows=120, width=3, seed=0):
    """Samples in long form with a known linear part, gaps and one constant feature."""
    rng = np.random.default_rng(seed)
    out = []
    for key in keys:
        x = rng.normal(5, 2, (rows, width)).round(3)
        x[:, -1] = 7.0
        y = x[:, 0] * 2 - x[:, 1] + rng.normal(0, 0.5, rows)
        for i in range(rows):
            values = [float(v) for v in x[i]]
            if i % 17 == 3:
                values[0] = None
            segment = "train" if i < rows * 0.7 else "validation" if i < rows * 0.85 else "test"
            out.append((key, segment, START + i * HOUR, 1, float(y[i]), values))
    return spark.createDataFrame(
        out, "series_key string, segment string, observed_at timestamp, horizon int, y double, x array<double>"
    )


def train_arrays(samples, key):
    rows = samples.filter((F.col("series_key") == key) & (F.col("segment") == "train")).orderBy("observed_at").collect()
    full = [r for r in rows if None not in r.x]
    return np.array([r.x for r in full]), np.array([r.y for r in full])


def reference_ridge(x, y, alpha):
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return mean, scale, w, y.mean()


def test_ridge_equals_a_direct_solve(spark):
    samples = sample_frame(spark)
    fitted = models.fit_ridge(samples, (0.1, 10.0)).collect()
    assert len(fitted) == 4
    for r in fitted:
        x, y = train_arrays(samples, r.series_key)
        mean, scale, w, intercept = reference_ridge(x, y, r.alpha)
        assert r.fit_rows == len(y)
        np.testing.assert_allclose(r.mean, mean, rtol=1e-10)
        np.testing.assert_allclose(r.scale, scale, rtol=1e-8)
        np.testing.assert_allclose(r.coefficients, w, atol=1e-8)
        assert r.intercept == pytest.approx(intercept)


def test_test_rows_do_not_influence_the_fit(spark):
    samples = sample_frame(spark)
    moved = samples.withColumn("y", F.when(F.col("segment") == "test", F.col("y") + 100).otherwise(F.col("y")))
    pick = lambda s: sorted((r.series_key, r.alpha, r.offset) for r in models.select_alpha(s, models.fit_ridge(s)).collect())
    assert pick(samples) == pick(moved)


def test_alpha_is_chosen_by_validation_error(spark):
    samples = sample_frame(spark)
    best = {r.series_key: r for r in models.select_alpha(samples, models.fit_ridge(samples)).collect()}
    for key in ("a", "b"):
        x, y = train_arrays(samples, key)
        rows = samples.filter((F.col("series_key") == key) & (F.col("segment") == "validation")).collect()
        rows = [r for r in rows if None not in r.x]
        errors = {}
        for alpha in models.ALPHAS:
            mean, scale, w, intercept = reference_ridge(x, y, alpha)
            errors[alpha] = np.mean([abs((np.array(r.x) - mean) / scale @ w + intercept - r.y) for r in rows])
        want = min(errors, key=lambda a: (errors[a], a))
        assert best[key].alpha == want and best[key].validation_mae == pytest.approx(errors[want])


def test_without_validation_rows_the_smallest_penalty_is_kept(spark):
    samples = sample_frame(spark).filter("segment <> 'validation'")
    got = models.select_alpha(samples, models.fit_ridge(samples)).collect()
    assert {(r.alpha, r.validation_mae) for r in got} == {(0.1, None)}


def test_incomplete_rows_predict_null(spark):
    samples = sample_frame(spark)
    best = models.select_alpha(samples, models.fit_ridge(samples))
    predicted = models.ridge_predictions(samples, best)
    assert predicted.count() == samples.count()
    assert predicted.filter("prediction is null").count() == samples.filter(~models.is_complete(F.col("x"))).count() > 0
    score = metrics.regression_metrics(predicted.withColumn("model", F.lit("ridge"))).filter("segment = 'test'").collect()
    assert all(r.mae < 0.8 for r in score)


@pytest.mark.parametrize("alphas", [(), (0.0,), (-1.0,), (float("nan"),)])
def test_bad_penalties_are_refused(spark, alphas):
    with pytest.raises(ValueError):
        models.fit_ridge(sample_frame(spark), alphas)


def test_statistics_and_medians(spark):
    samples = sample_frame(spark)
    stats = {r.series_key: r for r in models.feature_statistics(samples, 3).collect()}
    medians = {r.series_key: r.medians for r in models.train_medians(samples).collect()}
    for key in ("a", "b"):
        x, _ = train_arrays(samples, key)
        np.testing.assert_allclose(stats[key].mean, x.mean(0))
        np.testing.assert_allclose(stats[key].scale[:2], x.std(0)[:2])
        assert stats[key].scale[2] == 1.0
        rows = samples.filter((F.col("series_key") == key) & (F.col("segment") == "train")).collect()
        want = [np.median([r.x[i] for r in rows if r.x[i] is not None]) for i in range(3)]
        np.testing.assert_allclose(medians[key], want)
    filled = models.fill_missing(samples, models.train_medians(samples))
    assert filled.filter(~models.is_complete(F.col("x"))).count() == 0
    assert filled.agg(F.sum("imputed_cells")).first()[0] == samples.filter(~models.is_complete(F.col("x"))).count()
    gone = samples.withColumn("x", F.transform("x", lambda v, i: F.when(i != 1, v)))
    assert models.entirely_missing(gone, 3).count() == 2 and models.entirely_missing(samples, 3).count() == 0


def test_trees_learn_and_are_reproducible(spark):
    samples = sample_frame(spark, keys=("a",), rows=400)
    rows = models.tree_rows(models.fill_missing(samples, models.train_medians(samples)))
    first, second = (models.fit_trees(rows, 7, 40, stepSize=0.3) for _ in range(2))
    assert first.getNumTrees > 3
    got = [m.transform(rows.filter("segment = 'test'")).select("prediction").toPandas() for m in (first, second)]
    assert got[0].equals(got[1])
    scored = first.transform(rows).withColumnRenamed("y", "observed").withColumn("model", F.lit("trees"))
    r = metrics.regression_metrics(scored).filter("segment = 'test'").first()
    assert r.nse > 0.7


def test_patience_outlasts_a_flat_stretch():
    flat = [5.0, 4.0, *[4.0 + 0.01 * i for i in range(40)], 3.0, *[3.5] * 80, 1.0]
    assert models.best_round(flat, 50) == (42, True)
    assert models.best_round(flat, 30) == (1, True)
    assert models.best_round(flat[:60], 50) == (42, False)
    assert models.best_round([2.0, 2.0, 2.0], 2) == (0, True)
    assert models.best_round([3.0, 2.0, 1.0], 2) == (2, False)


def stepped_frame(spark):
    """Two steps in two features, the first of which is sometimes missing."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(500):
        segment = "train" if i < 350 else "validation" if i < 430 else "test"
        a, b = float(rng.normal()), float(rng.normal())
        rows.append(("s", 1, segment, START + i * HOUR, [a if i % 9 else None, b], 2.0 * (a > 0) + float(b > 1) + 0.05 * float(rng.normal())))
    return spark.createDataFrame(rows, "series_key string, horizon int, segment string, observed_at timestamp, x array<double>, y double")


def test_rounds_are_chosen_with_patience(spark):
    samples = stepped_frame(spark)
    rows = models.tree_rows(models.fill_missing(samples, models.train_medians(samples))).coalesce(1).cache()
    model = models.fit_trees(rows, 3, 30, 6, stepSize=0.3)
    longer = models.GBTRegressor(featuresCol="features", labelCol="y", seed=3, maxIter=30, maxBins=64, **{**models.TREE_SETTINGS, "stepSize": 0.3})
    errors = longer.fit(rows.filter("segment = 'train'").select("features", "y")).evaluateEachIteration(rows.filter("segment = 'validation'"), "squared")
    # A shorter fit is the beginning of a longer one, so the chosen rounds are those of the whole curve.
    assert model.getNumTrees == models.best_round(errors, 6)[0] + 1
    assert np.isclose(model.evaluateEachIteration(rows.filter("segment = 'validation'"), "squared")[-1], min(errors[: model.getNumTrees]))
    # Test rows take no part.
    moved = rows.withColumn("y", F.when(F.col("segment") == "test", F.col("y") * 9).otherwise(F.col("y")))
    again = models.fit_trees(moved, 3, 30, 6, stepSize=0.3)
    assert again.toDebugString.split("\n", 1)[1] == model.toDebugString.split("\n", 1)[1]
    assert models.fit_trees(rows.filter("segment <> 'validation'"), 3, 5).getNumTrees == 5


def test_missing_features_are_columns(spark):
    samples = stepped_frame(spark)
    filled = models.fill_missing(samples, models.train_medians(samples))
    rows = models.tree_rows(filled).collect()
    assert len(rows) == samples.count() and all(len(r.features) == 4 for r in rows)
    assert {(r.features[2], r.features[3]) for r in rows} == {(0.0, 0.0), (1.0, 0.0)}
    assert sum(r.features[2] for r in rows) == samples.filter("x[0] is null").count() == filled.agg(F.sum("imputed_cells")).first()[0]


def test_node_table_predicts_like_the_model(spark):
    samples = stepped_frame(spark)
    rows = models.tree_rows(models.fill_missing(samples, models.train_medians(samples))).coalesce(1).cache()
    model = models.fit_trees(rows, 5, 20, 5, stepSize=0.3)
    nodes = models.tree_nodes(model).cache()
    assert nodes.select("tree").distinct().count() == model.getNumTrees
    # A binary tree has one leaf more than inner nodes.
    assert nodes.filter("feature is null").count() - nodes.filter("feature is not null").count() == model.getNumTrees
    want = {r.observed_at: r.prediction for r in model.transform(rows).collect()}
    got = {r.observed_at: r.prediction for r in models.walk_trees(rows, nodes).collect()}
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_seed_summary(spark):
    rows = spark.createDataFrame(
        [("m", 1, 10, 1.0, None), ("m", 2, 10, 3.0, None), ("n", 1, 0, None, "x"), ("n", 2, 0, None, "x")],
        "model string, seed int, sample_count long, mae double, reason string",
    )
    got = {r.model: r for r in metrics.seed_summary(rows, ["model"], metrics=["mae"]).collect()}
    assert (got["m"].mae_mean, got["m"].mae_std, got["m"].sample_counts_by_seed) == (2.0, 1.0, [10, 10])
    assert got["n"].mae_mean is None and got["n"].reason == "x" and got["m"].reason is None
