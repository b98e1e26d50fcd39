"""Model comparison on tables: linear fits for all groups at once, metrics and selection.

A linear model needs only moments of its rows. They are summed by group on the map
side, so one aggregation serves every (ticker, month, fold); a solve then touches one
small matrix per group and penalty. Trees go through Spark ML.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import corr_of

# Penalties and grids agreed before any validation result is seen.
RIDGE_ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
LASSO_ALPHAS = (0.000001, 0.00001, 0.0001, 0.001, 0.01, 0.1)
DEFAULT_ALPHA = {"Ridge": 1.0, "Lasso": 0.001}
#: The preset of each tree model, which is also its fallback.
TREE_PRESETS = {
    "RandomForest": {"n_estimators": 100, "max_depth": 3, "min_samples_leaf": 10, "max_features": "sqrt"},
    "XGBoost": {"n_estimators": 100, "max_depth": 2, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8, "reg_lambda": 1.0},
}
FOREST_GRID = {"n_estimators": (200,), "max_depth": (3, None), "min_samples_leaf": (5, 20), "max_features": ("sqrt", 0.5)}
BOOST_GRID = {
    "n_estimators": (100, 300), "max_depth": (2, 3), "learning_rate": (0.03, 0.1), "subsample": (0.8,), "colsample_bytree": (0.8,),
    "reg_lambda": (1.0, 10.0),
}
COMPLEXITY = ("OLS", "Ridge", "Lasso", "RandomForest", "XGBoost")


def grid_rows() -> list[tuple[str, str, str]]:
    """(model, parameter set id, parameters as JSON) for the whole predeclared grid."""
    import itertools
    import json

    sets: dict[str, list[dict]] = {"OLS": [{}], "Ridge": [{"alpha": a} for a in RIDGE_ALPHAS], "Lasso": [{"alpha": a} for a in LASSO_ALPHAS]}
    for model, grid in (("RandomForest", FOREST_GRID), ("XGBoost", BOOST_GRID)):
        sets[model] = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return [
        (model, f"{model.lower()}_{k:03d}", json.dumps(parameters, sort_keys=True)) for model in COMPLEXITY for k, parameters in enumerate(sets[model])
    ]


def impute_median(members: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Missing features take the median of the group's training rows, never of its validation rows."""
    train = members.where(F.col("role") == "train")
    medians = train.groupBy(*keys).agg(*[F.median(f).alias(f"_med_{f}") for f in features])
    return members.join(medians, list(keys)).withColumns({f: F.coalesce(f, f"_med_{f}") for f in features}).drop(*[f"_med_{f}" for f in features])


def moments(train: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    sums = [F.count(F.lit(1)).alias("n"), F.sum(target).alias("sy")]
    sums += [F.sum(f).alias(f"s_{i}") for i, f in enumerate(features)]
    sums += [F.sum(F.col(f) * F.col(target)).alias(f"xy_{i}") for i, f in enumerate(features)]
    sums += [
        F.sum(F.col(features[i]) * F.col(features[j])).alias(f"xx_{i}_{j}") for i in range(len(features)) for j in range(i, len(features))
    ]
    return train.groupBy(*keys).agg(*sums)


def ridge_fits(train: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """Ridge fits per group and penalty; a penalty of zero is ordinary least squares."""
    return linear_fits(train, features, target, keys, [("Ridge", a) for a in alphas])


def linear_fits(train: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], penalties: Sequence[tuple[str, float]]) -> DataFrame:
    """Intercept and coefficients per group, model and penalty, on features scaled by their population deviation.

    Models: OLS, Ridge (alpha times the squared length, against the sum of squares) and Lasso (alpha times the
    absolute length, against half the mean square). The matrices of a batch of groups are solved together.
    """
    p = len(features)
    table = moments(train, features, target, keys)
    key_fields = [f"{f.name} {f.dataType.simpleString()}" for f in table.select(*keys).schema.fields]
    schema = ", ".join(key_fields + ["model string", "alpha double", "train_mean double", "train_rows bigint", "intercept double", "coefficients array<double>"])

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            n = pdf["n"].to_numpy(dtype=float)
            mean = np.stack([pdf[f"s_{i}"].to_numpy(dtype=float) for i in range(p)], axis=1) / n[:, None]
            y_mean = pdf["sy"].to_numpy(dtype=float) / n
            second = np.empty((len(pdf), p, p))
            for i in range(p):
                for j in range(i, p):
                    second[:, i, j] = second[:, j, i] = pdf[f"xx_{i}_{j}"].to_numpy(dtype=float) / n
            cov = second - mean[:, :, None] * mean[:, None, :]
            cross = np.stack([pdf[f"xy_{i}"].to_numpy(dtype=float) for i in range(p)], axis=1) / n[:, None] - mean * y_mean[:, None]
            scale = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0.0))
            scale[scale == 0] = 1.0
            # A feature without a value in the whole group has no moments; it takes no part, as if constant.
            scale[np.isnan(scale)] = 1.0
            gram, side, mean = np.nan_to_num(cov / (scale[:, :, None] * scale[:, None, :])), np.nan_to_num(cross / scale), np.nan_to_num(mean)
            for model, alpha in penalties:
                beta = penalised(gram, side, n, model, alpha) / scale
                out = pdf[list(keys)].copy()
                out["model"], out["alpha"], out["train_mean"], out["train_rows"] = model, float(alpha), y_mean, n.astype("int64")
                out["intercept"] = y_mean - (beta * mean).sum(axis=1)
                out["coefficients"] = list(beta)
                yield out

    return table.mapInPandas(solve, schema)


def penalised(gram: np.ndarray, side: np.ndarray, n: np.ndarray, model: str, alpha: float) -> np.ndarray:
    """Coefficients of stacked standardised systems; OLS takes the shortest solution of a singular one."""
    p = side.shape[1]
    if model == "Lasso":
        beta = np.zeros_like(side)
        for _ in range(10_000):
            before = beta.copy()
            for j in range(p):
                rest = side[:, j] - (gram[:, j, :] * beta).sum(axis=1) + gram[:, j, j] * beta[:, j]
                beta[:, j] = np.sign(rest) * np.maximum(np.abs(rest) - alpha, 0.0) / np.where(gram[:, j, j] > 0, gram[:, j, j], 1.0)
            if np.abs(beta - before).max(initial=0.0) < 1e-12:
                break
        return beta
    if model == "OLS" or alpha == 0:
        return (np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ side[:, :, None])[:, :, 0]
    return np.linalg.solve(gram + np.eye(p) * (alpha / n)[:, None, None], side[:, :, None])[:, :, 0]


def linear_prediction(features: Sequence[str]) -> Column:
    """Prediction of a fit; a feature still missing after imputation had no training value and weighs nothing."""
    value = F.col("intercept")
    for i, f in enumerate(features):
        value = value + F.get("coefficients", F.lit(i)) * F.coalesce(F.col(f), F.lit(0.0))
    return value


def inner_search(members: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], penalties: Sequence[tuple[str, float]], folds: int) -> DataFrame:
    """Mean and deviation of the inner validation error per model and penalty; the lowest mean is marked.

    ``members`` carries the inner fold and role. A penalty without an error in each of the inner folds has
    failed. Where all of a model have failed, its default penalty is marked instead.
    """
    fold_keys = [*keys, "fold"]
    ready = impute_median(members, features, fold_keys)
    fits = linear_fits(ready.where("role = 'train'"), features, target, fold_keys, penalties)
    joined = ready.where("role = 'validation'").join(fits, fold_keys)
    error = linear_prediction(features) - F.col(target)
    return search_summary(joined.groupBy(*fold_keys, "model", "alpha").agg(F.avg(error * error).alias("mse")), keys, folds)


def search_summary(per_fold: DataFrame, keys: Sequence[str], folds: int) -> DataFrame:
    """Mean and deviation of the fold errors (keys, fold, model, alpha, mse), and the penalty selected by them."""
    table = per_fold.groupBy(*keys, "model", "alpha").agg(
        F.count("mse").alias("inner_folds"), F.avg("mse").alias("mean_inner_mse"), F.stddev_samp("mse").alias("std_inner_mse")
    )
    part = Window.partitionBy(*keys, "model")
    complete = F.col("inner_folds") >= folds
    default = F.coalesce(*[F.when(F.col("model") == m, F.col("alpha") == a) for m, a in DEFAULT_ALPHA.items()], F.lit(True))
    some = F.max(complete).over(part)
    best = F.min(F.when(complete, F.struct("mean_inner_mse", "alpha"))).over(part)
    return table.withColumn("selected", F.when(some, F.col("alpha") == best["alpha"]).otherwise(default)).withColumn(
        "search_status", F.when(complete, "success").when(~some & default, "fallback_default_parameters").otherwise("failed")
    )


def model_metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold errors, then model statistics; R2 is against the mean of the fold's training target."""
    ok = F.col("prediction_status") == "success"
    a, p, b = (F.when(ok, F.col(c)) for c in ("actual", "predicted", "benchmark"))
    per_fold = predictions.groupBy(*keys, "fold").agg(
        F.avg((a - p) * (a - p)).alias("mse"), F.sum((a - p) * (a - p)).alias("sse"), F.sum((a - b) * (a - b)).alias("benchmark_sse"), F.count(p).alias("n"),
    )
    folds = per_fold.groupBy(*keys).agg(
        F.count("mse").alias("outer_fold_count"), F.sum("n").alias("valid_prediction_count"), F.avg("mse").alias("mean_validation_mse"), F.stddev_samp("mse").alias("fold_mse_std"),
        F.try_divide(F.stddev_samp("mse"), F.sqrt(F.count("mse"))).alias("standard_error_mse"),
        (F.lit(1.0) - F.try_divide(F.sum("sse"), F.sum("benchmark_sse"))).alias("oos_r2"),
    )
    flat_a, flat_p = F.min(a) == F.max(a), F.min(p) == F.max(p)
    whole = predictions.groupBy(*keys).agg(
        F.avg(F.abs(a - p)).alias("mae"), F.avg((F.signum(a) == F.signum(p)).cast("double")).alias("directional_accuracy"),
        F.when(~flat_a & ~flat_p, corr_of(a, p)).alias("prediction_correlation"),
        F.when(F.count(p) == 0, "no_successful_outer_predictions").when(F.count(p) < 2, "fewer_than_two_predictions").when(flat_a, "actual_return_is_constant")
        .when(flat_p, "predicted_return_is_constant").otherwise("").alias("metric_notes"),
    )
    return folds.join(whole, list(keys))


def one_se_rule(metrics: DataFrame, keys: Sequence[str], order: Sequence[str] = COMPLEXITY) -> DataFrame:
    """Lowest error, then the simplest model within one standard error of it."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    part = Window.partitionBy(*keys)
    ok = (F.col("model_status") == "ok") & F.col("mean_validation_mse").isNotNull()
    ranked = metrics.withColumn("complexity_rank", rank).withColumn("_ok", ok)
    best = F.min(F.when(F.col("_ok"), F.struct("mean_validation_mse", "complexity_rank", "model", "standard_error_mse"))).over(part)
    ranked = ranked.withColumn("_best", best).withColumn(
        "one_se_threshold", F.col("_best.mean_validation_mse") + F.coalesce(F.col("_best.standard_error_mse"), F.lit(0.0))
    )
    within = F.coalesce(F.col("_ok") & (F.col("mean_validation_mse") <= F.col("one_se_threshold")), F.lit(False))
    ranked = ranked.withColumn("within_one_se", within)
    chosen = F.min(F.when(F.col("within_one_se"), F.struct("complexity_rank", "mean_validation_mse", "model"))).over(part)
    return ranked.withColumns(
        {
            "selected_by_minimum_mse": F.coalesce(F.col("model") == F.col("_best.model"), F.lit(False)),
            "selected_after_one_se_rule": F.coalesce(F.col("model") == chosen["model"], F.lit(False)),
            "selection_notes": F.when(F.col("_best").isNull(), "no model has the required successful outer folds")
            .when(F.col("_best.standard_error_mse").isNull(), "standard error unavailable; fell back to minimum MSE").otherwise("one-standard-error rule applied using best model fold MSE SE"),
        }
    ).drop("_ok", "_best")


def spark_ml_estimators(features: Sequence[str], label: str, seed: int = 42) -> dict:
    """The five estimators as Spark ML stages: median imputation, scaling for the linear ones, then the model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    filled = [f"{f}_filled" for f in features]
    prepare = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled, relativeError=1e-4),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
    ]
    scale = [StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]
    linear = lambda **kw: LinearRegression(featuresCol="features", labelCol=label, standardization=False, **kw)
    return {
        "OLS": Pipeline(stages=prepare + scale + [linear()]),
        "Ridge": Pipeline(stages=prepare + scale + [linear(regParam=0.001, elasticNetParam=0.0)]),
        "Lasso": Pipeline(stages=prepare + scale + [linear(regParam=0.001, elasticNetParam=1.0)]),
        "RandomForest": Pipeline(stages=prepare + [RandomForestRegressor(featuresCol="raw_features", labelCol=label, numTrees=20, maxDepth=3, minInstancesPerNode=10, featureSubsetStrategy="sqrt", seed=seed)]),
        "XGBoost": Pipeline(stages=prepare + [GBTRegressor(featuresCol="raw_features", labelCol=label, maxIter=10, maxDepth=2, stepSize=0.1, subsamplingRate=0.8, seed=seed)]),
    }
