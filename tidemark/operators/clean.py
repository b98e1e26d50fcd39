"""Cleaning, validity filters and anomaly classes. Rows fold per (ticker, date) before they move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import finite
from tidemark.operators.episodes import weekday_gaps

OHLC = ("open", "high", "low", "close")


def clean_prices(quotes: DataFrame, sequence: str) -> DataFrame:
    """Text quotes to one valid row per (ticker, date): the last in file order wins.

    Expects ticker, date_text, close_text, volume_text and a numeric ordering column, so
    the fold is a hash aggregation on the map side, however often a date repeats.
    """
    typed = quotes.select(
        F.upper(F.trim("ticker")).alias("ticker"),
        F.to_date(F.try_to_timestamp("date_text")).alias("date"),
        finite(F.expr("try_cast(close_text AS double)")).alias("close"),
        finite(F.expr("try_cast(volume_text AS double)")).alias("volume"),
        sequence,
    )
    usable = typed.where(F.col("date").isNotNull() & (F.col("close") > 0))
    return usable.groupBy("ticker", "date").agg(
        F.max_by("close", sequence).alias("close"), F.max_by("volume", sequence).alias("volume")
    )


def valid_window(prices: DataFrame, start: Column, end: Column) -> DataFrame:
    return prices.where(F.col("date").between(start, end) & (F.col("close") > 0) & (F.col("volume") >= 0))


def ohlcv_is_valid() -> Column:
    present = F.lit(True)
    for c in (*OHLC, "volume"):
        present = present & F.col(c).isNotNull()
    above_zero = F.least(*[F.col(c) for c in OHLC]) > 0
    inside = F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high"))
    return F.coalesce(present & above_zero & (F.col("volume") >= 0) & (F.col("high") >= F.col("low")) & inside, F.lit(False))


def anomaly_columns() -> dict[str, Column]:
    """Row-level flags; a comparison with a missing value is no error of its own."""
    missing = F.col("date").isNull()
    for c in (*OHLC, "volume"):
        missing = missing | F.col(c).isNull()
    any_low = F.lit(False)
    for c in OHLC:
        any_low = any_low | F.coalesce(F.col(c) <= 0, F.lit(False))
    logic = F.lit(False)
    for wrong in (
        F.col("high") < F.col("low"), F.col("open") < F.col("low"), F.col("open") > F.col("high"),
        F.col("close") < F.col("low"), F.col("close") > F.col("high"),
    ):
        logic = logic | F.coalesce(wrong, F.lit(False))
    return {
        "missing": missing, "nonpositive": any_low, "negative_volume": F.coalesce(F.col("volume") < 0, F.lit(False)), "logic": logic,
    }


def daily_anomalies(rows: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Flag counts per (ticker, date): bounded by the calendar, however many rows repeat a date."""
    flags = anomaly_columns()
    any_flag = F.lit(False)
    for column in flags.values():
        any_flag = any_flag | column
    return rows.groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(column).alias(name) for name, column in flags.items()],
        F.count_if(any_flag).alias("flagged"),
    ).withColumns(
        {
            "duplicate": F.when((F.col("rows") > 1) & F.col("date").isNotNull(), F.col("rows")).otherwise(F.lit(0)),
        }
    ).withColumn("invalid", F.when(F.col("duplicate") > 0, F.col("rows")).otherwise(F.col("flagged")))


def anomaly_report(rows: DataFrame, keys: Sequence[str] = ("ticker",), gap_limit: int = 5) -> DataFrame:
    """Types, dates and counts of anomalies per ticker, with the large gaps listed."""
    daily = daily_anomalies(rows, keys)
    gaps = weekday_gaps(daily.where(F.col("date").isNotNull()).select(*keys, "date"), keys)
    wide = F.col("missing_weekdays") > gap_limit
    text = F.format_string("gap:%s..%s", F.col("previous_date").cast("string"), F.col("date").cast("string"))
    gap_side = gaps.groupBy(*keys).agg(
        F.coalesce(F.max("missing_weekdays"), F.lit(0)).alias("max_gap"),
        F.array_sort(F.collect_list(F.when(wide, F.struct("date", text.alias("text"))))).alias("gaps"),
    )
    bad_day = F.when(F.col("invalid") > 0, F.coalesce(F.col("date").cast("string"), F.lit("unknown")))
    totals = daily.groupBy(*keys).agg(
        F.sum("rows").alias("total_rows"), F.sum("invalid").alias("invalid_rows"),
        *[F.sum(c).alias(c) for c in ("missing", "nonpositive", "negative_volume", "logic", "duplicate")],
        F.array_sort(F.collect_list(bad_day)).alias("days"),
    )
    out = totals.join(gap_side, list(keys), "left").withColumn("max_gap", F.coalesce("max_gap", F.lit(0)))
    types = F.concat_ws(
        "|",
        F.when(F.col("missing") > 0, "missing_ohlcv"), F.when(F.col("nonpositive") > 0, "nonpositive_price"),
        F.when(F.col("negative_volume") > 0, "negative_volume"), F.when(F.col("logic") > 0, "ohlc_logic_error"),
        F.when(F.col("duplicate") > 0, "duplicate_date"), F.when(F.col("max_gap") > gap_limit, "large_missing_gap"),
    )
    gap_texts = F.coalesce(F.transform("gaps", lambda g: g["text"]), F.array().cast("array<string>"))
    return out.select(
        *keys, F.when(types == "", "none").otherwise(types).alias("anomaly_types"),
        F.array_join(F.concat("days", gap_texts), "|").alias("anomaly_dates"), "total_rows", "invalid_rows", "max_gap",
    )


def _anomalous() -> Column:
    bad = F.lit(False)
    for column in anomaly_columns().values():
        bad = bad | column
    return F.coalesce(bad, F.lit(False))


def day_verdicts(rows: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Rows and verdict per key and date. A repeated date is set aside as a whole and any other has one row, so
    the verdict belongs to the date: one fold, and no raw row is joined."""
    days = rows.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("rows"), F.max(_anomalous()).alias("_bad"))
    aside = F.col("_bad") | (F.col("date").isNotNull() & (F.col("rows") > 1))
    return days.withColumn("verdict", F.when(aside, "quarantine").otherwise("valid")).drop("_bad")


def split_quarantine(rows: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Each row with the verdict of its own flags and of its date; nothing is filled or repaired.

    Rows meet repeated dates only. For counts use :func:`day_verdicts`.
    """
    bad = _anomalous()
    repeated = rows.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(repeated, [*keys, "date"], "left").withColumn(
        "verdict", F.when(bad | F.col("_n").isNotNull(), "quarantine").otherwise("valid")
    ).drop("_n")


def frame_violations(prices: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Counts that make a price frame unusable: null, repeated and unordered dates, by file order ``seq``."""
    per_day = prices.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    dated = per_day.withColumn("_late", F.col("date").isNotNull() & (F.max("hi").over(before) > F.col("lo")))
    return dated.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("date").isNull(), F.col("n"))), F.lit(0)).alias("null_dates"),
        F.coalesce(F.sum(F.when(F.col("date").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("repeated_rows"),
        F.count_if("_late").alias("out_of_order_dates"),
    )
