"""Islands on ordered rows: gaps, runs, drawdown episodes and stress events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import by_date, weekdays_between


def weekday_gaps(dates: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Weekdays missing between consecutive dates of a key."""
    previous = F.lag("date").over(by_date(*keys))
    return dates.withColumn("previous_date", previous).withColumn(
        "missing_weekdays",
        F.greatest(weekdays_between(F.col("previous_date"), F.col("date")) - 1, F.lit(0)).cast("bigint"),
    )


def runs(rows: DataFrame, flag: Column, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Maximal runs of consecutive true rows: first and last date, length."""
    order = by_date(*keys)
    marked = rows.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_pos", F.row_number().over(order))
    hits = marked.where("_flag").withColumn(
        "run_id", F.col("_pos") - F.row_number().over(order)
    )
    return hits.groupBy(*keys, "run_id").agg(
        F.min("date").alias("run_start"), F.max("date").alias("run_end"), F.count(F.lit(1)).alias("run_length")
    )


def drawdown_episodes(
    paths: DataFrame, threshold: float, keys: Sequence[str] = ("portfolio",), tolerance: float = 0.0
) -> DataFrame:
    """Peak, trough and recovery of ``market`` with the behaviour of ``value`` inside.

    A row at or above the running peak opens a new episode and closes the one before,
    so it belongs to both; the last episode stays open at the end of the sample.
    """
    order = by_date(*keys)
    before = F.max("market").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = paths.withColumn(
        "_peak", (before.isNull() | (F.col("market") >= before - F.lit(tolerance))).cast("int")
    )
    numbered = flagged.withColumn("_ep", F.sum("_peak").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    shared = F.when((F.col("_peak") == 1) & (F.col("_ep") > 1), F.array(F.col("_ep"), F.col("_ep") - 1)).otherwise(
        F.array(F.col("_ep"))
    )
    rows = numbered.select(
        *keys, "date", "market", "value", "_peak", F.col("_ep").alias("_own"), F.explode(shared).alias("episode")
    )
    inside = Window.partitionBy(*keys, "episode").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own_dd", F.try_divide(F.col("value"), F.max("value").over(inside)) - 1).withColumn(
        "_market_dd", F.try_divide(F.col("market"), F.max("market").over(inside)) - 1
    )
    trough = F.struct("market", "date")
    grouped = rows.groupBy(*keys, "episode").agg(
        F.min("date").alias("peak_date"),
        F.min_by("date", trough).alias("trough_date"),
        F.max("date").alias("end_date"),
        (F.max("_own") > F.col("episode")).alias("recovered"),
        F.count(F.lit(1)).alias("_rows"),
        F.min_by("market", "date").alias("_m0"), F.min_by("value", "date").alias("_v0"),
        F.min("market").alias("_mt"), F.min_by("value", trough).alias("_vt"),
        F.max_by("market", "date").alias("_m1"), F.max_by("value", "date").alias("_v1"),
        F.min("_own_dd").alias("portfolio_max_drawdown"),
        F.min("_market_dd").alias("market_max_drawdown"),
    )
    return grouped.where(
        (F.try_divide(F.col("_mt"), F.col("_m0")) - 1) <= threshold
    ).select(
        *keys, "peak_date", "trough_date", "end_date", "recovered", "market_max_drawdown", "portfolio_max_drawdown",
        (F.col("_mt") / F.col("_m0") - 1).alias("market_to_trough"),
        (F.col("_vt") / F.col("_v0") - 1).alias("portfolio_to_trough"),
        (F.col("_m1") / F.col("_m0") - 1).alias("market_full"),
        (F.col("_v1") / F.col("_v0") - 1).alias("portfolio_full"),
        F.datediff("end_date", "peak_date").cast("bigint").alias("calendar_days"),
    )


def stress_events(
    paths: DataFrame, window: int, threshold: float, keys: Sequence[str] = ("portfolio",)
) -> DataFrame:
    """Adjacent rows whose trailing market return breaches the threshold, as events."""
    order = by_date(*keys)
    moved = paths.withColumns(
        {
            "_pos": F.row_number().over(order),
            "market_move": F.try_divide(F.col("market"), F.lag("market", window).over(order)) - 1,
            "own_move": F.try_divide(F.col("value"), F.lag("value", window).over(order)) - 1,
            "window_start": F.lag("date", window).over(order),
        }
    )
    hits = moved.where(F.col("market_move") <= threshold).withColumn(
        "_event", F.col("_pos") - F.row_number().over(order)
    )
    worst = F.struct("market_move", "date")
    return hits.groupBy(*keys, "_event").agg(
        F.min("date").alias("breach_start"), F.max("date").alias("breach_end"),
        F.min_by("window_start", worst).alias("worst_window_start"), F.min_by("date", worst).alias("worst_window_end"),
        F.min("market_move").alias("market_return"), F.min_by("own_move", worst).alias("portfolio_return"),
        F.count(F.lit(1)).alias("breach_rows"),
    ).withColumn("portfolio_minus_market", F.col("portfolio_return") - F.col("market_return")).drop("_event")


def rebalance_flags(rows: DataFrame, frequency: str, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """True on the first row of a new month, quarter or year; never on the first row of a path."""
    if frequency == "none":
        return rows.withColumn("rebalance", F.lit(False))
    unit = {"monthly": "month", "quarterly": "quarter", "annual": "year"}[frequency]
    period = F.trunc("date", unit)
    return rows.withColumn(
        "rebalance", F.coalesce(period != F.lag(period).over(by_date(*keys)), F.lit(False))
    )
