"""Walk-forward origins, purged folds and annual folds as columns and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import by_date, corr_over


def walk_forward_correlation(
    paired: DataFrame, windows: dict[str, int], horizon: int, step: int, keys: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Correlation of the W rows before an origin against the ``horizon`` rows from it on.

    Expects non-null ret and market_ret; every window length is one frame in the same
    sort, and only origin rows survive.
    """
    order = by_date(*keys)
    base = paired.withColumns(
        {
            "_pos": F.row_number().over(order) - 1,
            "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
            "testing_end_date": F.max("date").over(order.rowsBetween(0, horizon - 1)),
            "realized": corr_over(F.col("ret"), F.col("market_ret"), order.rowsBetween(0, horizon - 1)),
        }
    )
    cells = []
    for label, size in windows.items():
        frame = order.rowsBetween(-size, -1)
        base = base.withColumn(f"_est_{size}", corr_over(F.col("ret"), F.col("market_ret"), frame))
        base = base.withColumn(f"_from_{size}", F.min("date").over(frame))
        is_origin = (
            (F.col("_pos") >= size) & ((F.col("_pos") - size) % step == 0) & (F.col("_pos") <= F.col("_n") - horizon)
        )
        cells.append(
            F.when(
                is_origin,
                F.struct(
                    F.lit(label).alias("window"), F.lit(size).alias("estimation_rows"),
                    F.col(f"_from_{size}").alias("training_start_date"), F.col(f"_est_{size}").alias("estimated"),
                ),
            )
        )
    base = base.withColumn("training_end_date", F.lag("date").over(order))
    picked = base.select(
        *keys, "training_end_date", F.col("date").alias("testing_start_date"), "testing_end_date", "realized",
        F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"),
    ).select(*keys, "c.*", "training_end_date", "testing_start_date", "testing_end_date", "realized")
    return picked.withColumn("forecast_error", F.col("estimated") - F.col("realized"))


def forecast_error(forecasts: DataFrame, keys: Sequence[str] = ("window", "estimation_rows")) -> DataFrame:
    error = F.col("forecast_error")
    return forecasts.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count(F.lit(1)).alias("tests"), F.stddev_samp(error).alias("error_std"),
        F.avg("estimated").alias("mean_estimated"), F.avg("realized").alias("mean_realized"),
    )


def available_as_of(
    dataset: DataFrame, selections: DataFrame, years: int, keys: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Rows usable at each selection date: label known, feature inside the trailing years.

    A row lists the months in which it may be used, which turns the range condition
    into an equality on (key, month); the exact bounds are checked after the join.
    """
    usable = dataset.where(F.col("target_available") & F.col("target_21d_return").isNotNull())
    reach = F.sequence(
        F.trunc("label_end_date", "month"), F.trunc(F.add_months("feature_date", 12 * years), "month"), F.expr("interval 1 month")
    )
    spread = usable.where(F.col("label_end_date") <= F.add_months("feature_date", 12 * years)).select(
        "*", F.explode(F.transform(reach, lambda month: month.cast("date"))).alias("_month")
    )
    dated = selections.withColumn("_month", F.trunc("selection_date", "month").cast("date"))
    joined = spread.join(dated, [*keys, "_month"])
    return joined.where(
        (F.col("label_end_date") <= F.col("selection_date"))
        & (F.col("feature_date") >= F.add_months("selection_date", -12 * years))
        & (F.col("feature_date") <= F.col("selection_date"))
    ).drop("_month")


def purged_folds(
    rows: DataFrame,
    splits: int,
    validation_rows: int,
    min_train_rows: int,
    keys: Sequence[str] = ("ticker", "selection_date"),
    max_train_rows: int | None = None,
    embargo_rows: int = 0,
) -> DataFrame:
    """Membership (fold, role) of every row: the last splits x validation_rows rows validate.

    Training rows lie before the block, outside the embargo behind earlier blocks,
    inside the rolling cap, and carry a label that ends before the block starts.
    Each row is listed for the folds that can use it; a group holds one ticker as of one day.
    """
    order = Window.partitionBy(*keys).orderBy("feature_date")
    whole = Window.partitionBy(*keys)
    placed = rows.withColumns({"pos": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(whole)})
    first = F.col("n") - F.lit(splits * validation_rows)
    placed = placed.where(first > 0)
    starts = [
        F.max(F.when(F.col("pos") == first + k * validation_rows, F.col("feature_date"))).over(whole) for k in range(splits)
    ]
    placed = placed.withColumns({f"_start_{k}": column for k, column in enumerate(starts)})
    cells = []
    for k in range(splits):
        begin = first + F.lit(k * validation_rows)
        embargoed = F.lit(False)
        for earlier in range(k):
            end = first + F.lit((earlier + 1) * validation_rows)
            embargoed = embargoed | ((F.col("pos") >= end) & (F.col("pos") < end + F.lit(embargo_rows)))
        candidate = (F.col("pos") < begin) & ~embargoed
        label_ends_before = F.col("label_end_date") < F.col(f"_start_{k}")
        role = F.when((F.col("pos") >= begin) & (F.col("pos") < begin + validation_rows), F.lit("validation")).when(
            candidate, F.when(label_ends_before, F.lit("train")).otherwise(F.lit("purged"))
        )
        cells.append(F.when(role.isNotNull(), F.struct(F.lit(k).alias("fold"), role.alias("role"))))
    listed = placed.select(
        *rows.columns, "pos", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")
    ).select(*rows.columns, "pos", "c.fold", "c.role")
    if max_train_rows is not None:
        newest = Window.partitionBy(*keys, "fold", F.col("role") == "validation").orderBy(F.col("pos").desc())
        listed = listed.withColumn("_age", F.row_number().over(newest)).where(
            (F.col("role") == "validation") | (F.col("_age") <= max_train_rows)
        ).drop("_age")
    return listed


def fold_summary(
    members: DataFrame, min_train_rows: int, keys: Sequence[str] = ("ticker", "selection_date")
) -> DataFrame:
    train, validation = F.col("role") == "train", F.col("role") == "validation"
    out = members.groupBy(*keys, "fold").agg(
        F.min(F.when(train, F.col("feature_date"))).alias("train_feature_start"),
        F.max(F.when(train, F.col("feature_date"))).alias("train_feature_end"),
        F.max(F.when(train, F.col("label_end_date"))).alias("train_label_end_max"),
        F.min(F.when(validation, F.col("feature_date"))).alias("validation_feature_start"),
        F.max(F.when(validation, F.col("feature_date"))).alias("validation_feature_end"),
        F.max(F.when(validation, F.col("label_end_date"))).alias("validation_label_end_max"),
        F.count_if(~validation).alias("train_rows_before_purge"),
        F.count_if(train).alias("train_rows_after_purge"),
        F.count_if(F.col("role") == "purged").alias("purged_rows"),
        F.count_if(validation).alias("validation_rows"),
    )
    valid = F.coalesce(F.col("train_label_end_max") < F.col("validation_feature_start"), F.lit(True))
    return out.withColumn("purge_valid", valid).withColumn(
        "fold_status",
        F.when(valid & (F.col("train_rows_after_purge") >= min_train_rows), F.lit("ok")).otherwise(
            F.lit("insufficient_train_data")
        ),
    )


def monthly_members(rows: DataFrame, months: int) -> DataFrame:
    """List each dated row for every month that trains on it: those that start 1 to `months` months after its own."""
    last = rows.agg(F.trunc(F.max("date"), "month").cast("date")).scalar()
    ahead = F.transform(F.sequence(F.lit(1), F.lit(months)), lambda k: F.add_months(F.trunc("date", "month"), k).cast("date"))
    listed = rows.withColumn("_hi", last).withColumn("validation_month", F.explode(ahead))
    return listed.where(F.col("validation_month") <= F.col("_hi")).drop("_hi")


def annual_members(rows: DataFrame, train_years: int) -> DataFrame:
    """Role of each dated row for each validation year: one year validates, the years before train."""
    year = F.year("date")
    bounds = rows.agg(F.struct(F.min(year).alias("lo"), F.max(year).alias("hi"))).scalar()
    years = F.filter(
        F.sequence(year, year + train_years), lambda y: (y <= F.col("_hi")) & (y >= F.col("_lo") + train_years)
    )
    bounded = rows.withColumns({"_lo": bounds["lo"], "_hi": bounds["hi"]})
    listed = bounded.withColumn("validation_year", F.explode(years)).drop("_lo", "_hi")
    return listed.withColumn(
        "role", F.when(F.col("validation_year") == F.year("date"), F.lit("validation")).otherwise(F.lit("train"))
    )
