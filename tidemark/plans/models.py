"""Model evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import features, models, nested
from tidemark.plans.registry import new_registry
from tidemark.plans.windows import model_features, selection_dates, training_rows
from tidemark.sources import panel

QUERIES, query = new_registry()
FEATURES = tuple(feature.name for feature in features.catalogue())
TARGET = "target_21d_return"
TASK = ["ticker", "selection_date"]
INNER_FOLDS = 2
#: Searched penalties; OLS has none.
PENALTIES = [("Ridge", a) for a in models.RIDGE_ALPHAS] + [("Lasso", a) for a in models.LASSO_ALPHAS]


#: Three outer folds of 21 days behind an embargo of five, two inner folds inside each training set.
OUTER = {"splits": 3, "validation_rows": 21, "embargo_rows": 5}
INNER = {"splits": INNER_FOLDS, "validation_rows": 21}
MIN_TRAIN_ROWS = 252


def feature_rows(spark, sf):
    return training_rows(spark, sf, dataset=model_features).select(*TASK, "feature_date", "label_end_date", TARGET, *FEATURES)


def moment_table(spark, sf):
    """Moments of every ticker, month, outer and inner fold."""
    return panel.kept(spark, ("fold_moments", sf), lambda: nested.fold_moments(feature_rows(spark, sf), TASK, FEATURES, TARGET, OUTER, INNER))


def search_table(spark, sf):
    def build():
        return models.search_summary(nested.inner_errors(moment_table(spark, sf), TASK, PENALTIES), [*TASK, "outer_fold"], INNER_FOLDS)

    return panel.kept(spark, ("inner_search", sf), build)


def fitted_predictions(spark, sf):
    """Five models refitted on each outer training set, one row per model and validation row.

    The penalty of Ridge and Lasso comes from the inner search of the same outer fold, else from the default; the
    forest and the boosted trees take their preset. A training set of fewer than 252 rows gives failed rows.
    """
    def build():
        moments = moment_table(spark, sf)
        chosen = search_table(spark, sf).where("selected").groupBy(*TASK, F.col("outer_fold").alias("fold")).agg(
            *[F.max(F.when(F.col("model") == m, F.col("alpha"))).alias(m) for m in models.DEFAULT_ALPHA]
        )
        wanted = moments.where("inner IS NULL").select(*TASK, "fold").join(chosen, [*TASK, "fold"], "left")
        wanted = wanted.select(*TASK, "fold", *[F.coalesce(m, F.lit(a)).alias(m) for m, a in models.DEFAULT_ALPHA.items()])
        linear = nested.outer_predictions(moments, wanted, TASK)
        rows = linear.unionByName(nested.tree_predictions(feature_rows(spark, sf), TASK, FEATURES, TARGET, OUTER, models.TREE_PRESETS))
        failed = F.col("train_rows") < MIN_TRAIN_ROWS
        return rows.select(
            *TASK, "fold", "model", "alpha", "feature_date", "label_end_date", "actual", F.when(~failed, F.col("predicted")).alias("predicted"), "benchmark",
            F.when(failed, "failed").otherwise("success").alias("prediction_status"),
        )

    return panel.kept(spark, ("fitted_predictions", sf), build)


def metric_table(spark, sf):
    metrics = models.model_metrics(fitted_predictions(spark, sf), [*TASK, "model"])
    return metrics.withColumn("model_status", F.when(F.col("outer_fold_count") >= 3, "ok").otherwise("failed_or_insufficient_outer_folds"))


@query
def ml_estimators(spark, sf):
    """The five Spark ML estimators fitted on rows labelled before the middle of the data's days and judged on later ones."""
    data = model_features(spark, sf).where(F.col("target_available")).select("ticker", "feature_date", "label_end_date", TARGET, *FEATURES)
    middle = data.agg(F.percentile(F.unix_date("feature_date"), 0.5)).first()[0]
    cut = F.date_from_unix_date(F.lit(int(middle or 0)))
    train, valid = data.where(F.col("label_end_date") < cut), data.where(F.col("feature_date") >= cut)
    out = None
    for name, stages in models.spark_ml_estimators(FEATURES, TARGET).items():
        scored = stages.fit(train).transform(valid).select(F.lit(name).alias("model"), "ticker", F.col(TARGET).alias("actual"), F.col("prediction").alias("predicted"))
        out = scored if out is None else out.unionByName(scored)
    error = F.col("predicted") - F.col("actual")
    return rounded(out.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae")), 5)


@query
def ml_grid(spark, sf):
    """Fits each ticker and month would need: its predeclared parameter sets per model."""
    rows = spark.createDataFrame(models.grid_rows(), "model string, parameter_set string, parameters string")
    sets = rows.groupBy("model").agg(F.count(F.lit(1)).alias("parameter_sets"), F.min("parameter_set").alias("first_set"), F.max("parameter_set").alias("last_set"))
    listed = sets.agg(F.collect_list(F.struct(*sets.columns))).scalar()
    tasks = selection_dates(spark, sf).withColumn("s", listed)
    return tasks.select("ticker", "selection_date", F.inline("s"))


@query
def ml_inner_search(spark, sf):
    return rounded(search_table(spark, sf))


@query
def ml_outer_eval(spark, sf):
    """Five models refitted per outer fold; every validation row keeps a prediction row."""
    return rounded(fitted_predictions(spark, sf))


@query
def agg_model_metrics(spark, sf):
    return rounded(metric_table(spark, sf), 5)


@query
def ml_one_se_rule(spark, sf):
    out = models.one_se_rule(metric_table(spark, sf), TASK)
    return rounded(out.select(
        *TASK, "model", "complexity_rank", "mean_validation_mse", "one_se_threshold", "selected_by_minimum_mse", "within_one_se", "selected_after_one_se_rule", "selection_notes"
    ), 5)


@query
def ml_monthly_selection(spark, sf):
    """One row per ticker and month: the model kept, the threshold and the folds behind it."""
    out = models.one_se_rule(metric_table(spark, sf), TASK)
    return rounded(out.groupBy(*TASK).agg(
        F.max(F.when(F.col("selected_by_minimum_mse"), F.col("model"))).alias("minimum_mse_model"), F.max("one_se_threshold").alias("one_se_threshold"),
        F.max(F.when(F.col("selected_after_one_se_rule"), F.col("model"))).alias("final_model"), F.max(F.when(F.col("selected_after_one_se_rule"), F.col("outer_fold_count"))).alias("folds"),
        F.count_if(F.col("model_status") != "ok").alias("failed_models"),
    ), 5)
