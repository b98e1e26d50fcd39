"""Price panels derived from the order tables.

A bar is keyed by (ticker, date). Money is summed as whole cents, so a bar does not
depend on the order in which partial sums meet. The partial aggregate on the map side
leaves at most one row per (ticker, date) and task, whatever share of the rows one
ticker holds; after it a ticker has at most one row per calendar day.
"""

from __future__ import annotations

import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import week_ending_friday
from tidemark.session import tune

SEQUENCE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
BENCHMARK = "MARKET"


_OPEN: dict[tuple, DataFrame] = {}
_DAYS: dict[tuple, datetime.date | None] = {}


def _once(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Reuse a DataFrame object within one application: saves listing files again."""
    full = (spark.sparkContext.applicationId, id(spark), *key)
    if full not in _OPEN:
        _OPEN[full] = build()
    return _OPEN[full]


def kept(spark: SparkSession, key: tuple, build) -> DataFrame:
    """A table bounded by tickers x calendar, shared by the branches of a session.

    Reserved for panels and what follows from them; never for trades. A lost executor
    recomputes its partitions from the lineage.
    """
    return _once(spark, key, lambda: build().persist(StorageLevel.MEMORY_AND_DISK))


def release(spark: SparkSession) -> None:
    """Drop every kept table of this session."""
    mine = [key for key in _OPEN if key[0] == spark.sparkContext.applicationId]
    for key in mine:
        _OPEN.pop(key).unpersist()
    _DAYS.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return _once(spark, ("table", path), lambda: spark.read.parquet(path))


def file_order() -> Column:
    """The four order columns packed into one decimal: 13, 4, 11 and 10 digits.

    A decimal fits a hash-aggregation buffer; ordering by a struct would make Spark
    sort every trade before its first fold.
    """
    line = line_order().cast("decimal(17,0)")
    part, supplier = F.col("l_partkey").cast("decimal(11,0)"), F.col("l_suppkey").cast("decimal(10,0)")
    return (line * F.lit("1" + "0" * 21).cast("decimal(22,0)") + part * F.lit("1" + "0" * 10).cast("decimal(11,0)") + supplier).cast("decimal(38,0)")


def line_order() -> Column:
    """Order and line number as one number; four digits are the line's own."""
    return F.col("l_orderkey").cast("bigint") * 10_000 + F.col("l_linenumber")


def ticker_of(level: str) -> Column:
    if level == "type":
        return F.col("p_type")
    if level == "instrument":
        return F.concat_ws("/", "p_brand", "p_type")
    raise ValueError(f"unknown level: {level}")


def bin_of(day: Column, freq: str) -> Column:
    if freq == "day":
        return day
    if freq == "week":
        return week_ending_friday(day)
    if freq == "month":
        return F.last_day(day)
    raise ValueError(f"unknown frequency: {freq}")


def trades(
    spark: SparkSession, sf_dir: str, level: str = "type", start: datetime.date | None = None, end: datetime.date | None = None
) -> DataFrame:
    """One row per order line with its instrument; bounds compare the stored column, so the scan can skip by them."""
    stored = table(spark, sf_dir, "lineitem")
    if start is not None:
        stored = stored.where(F.col("l_shipdate") >= F.lit(start))
    if end is not None:
        stored = stored.where(F.col("l_shipdate") < F.lit(end + datetime.timedelta(days=1)))
    lines = stored.select(
        *SEQUENCE, "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("day")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        ticker_of(level).alias("ticker"),
        F.col("p_type").alias("sector"),
        "day",
        F.col("l_quantity").alias("quantity"),
        F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint").alias("cents"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        file_order().alias("seq"),
        *SEQUENCE,
    )


def bars(spark: SparkSession, sf_dir: str, level: str = "type", freq: str = "day") -> DataFrame:
    """Open, high, low, close and volume per (ticker, date), read from the trades once.

    A panel holds tickers x calendar rows however many trades there are, and nearly
    every operator needs it in several branches, so it is kept: the trade table is
    scanned once, not once per branch. A lost executor recomputes its part.
    """
    return kept(spark, ("bars", sf_dir, level, freq), lambda: _build_bars(spark, sf_dir, level, freq))


def last_day(spark: SparkSession, sf_dir: str) -> datetime.date | None:
    """The last day with an order line: one value, from one column."""
    newest = lambda: table(spark, sf_dir, "lineitem").agg(F.max(F.to_date("l_shipdate"))).first()[0]
    full = (spark.sparkContext.applicationId, id(spark), "last_day", sf_dir)
    if full not in _DAYS:
        _DAYS[full] = newest()
    return _DAYS[full]


def recent_closes(spark: SparkSession, sf_dir: str, level: str, months: int) -> DataFrame:
    """Daily closes of the last months of the data; reads no older row. Kept apart from the whole panel."""
    end = last_day(spark, sf_dir)
    start = None if end is None else _months_before(end, months)
    rows = kept(spark, ("recent", sf_dir, level, months), lambda: _build_bars(spark, sf_dir, level, "day", start, end))
    return rows.select("ticker", "sector", "date", "close", "volume", "cents")


def _months_before(day: datetime.date, months: int) -> datetime.date:
    year, month = divmod(day.year * 12 + day.month - 1 - months, 12)
    following = datetime.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    return min(datetime.date(year, month + 1, 1) + datetime.timedelta(days=day.day - 1), following - datetime.timedelta(days=1))


def _build_bars(
    spark: SparkSession, sf_dir: str, level: str, freq: str, start: datetime.date | None = None, end: datetime.date | None = None
) -> DataFrame:
    return (
        trades(spark, sf_dir, level, start, end)
        .groupBy("ticker", "sector", bin_of(F.col("day"), freq).alias("date"))
        .agg(
            F.min_by("unit_price", "seq").alias("open"),
            F.max("unit_price").alias("high"),
            F.min("unit_price").alias("low"),
            (F.sum("cents") / F.lit(100.0) / F.sum("quantity")).alias("close"),
            F.sum("quantity").alias("volume"),
            F.sum("cents").alias("cents"),
            F.count(F.lit(1)).alias("trades"),
        )
    )


def closes(spark: SparkSession, sf_dir: str, level: str = "type", freq: str = "day") -> DataFrame:
    """Close and volume of a panel."""
    return bars(spark, sf_dir, level, freq).select("ticker", "sector", "date", "close", "volume", "cents")


def benchmark(prices: DataFrame) -> DataFrame:
    """The all-ticker bar per date, folded from bars, not from trades."""
    return prices.groupBy("date").agg(
        (F.sum("cents") / F.lit(100.0) / F.sum("volume")).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("cents").alias("cents"),
    ).select(F.lit(BENCHMARK).alias("ticker"), F.lit(BENCHMARK).alias("sector"), "date", "close", "volume", "cents")


def with_benchmark(prices: DataFrame) -> DataFrame:
    columns = ("ticker", "sector", "date", "close", "volume", "cents")
    return prices.select(*columns).unionByName(benchmark(prices).select(*columns))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument dimension with lifecycle facts: first and last trading day."""
    return (
        bars(spark, sf_dir, "instrument", "day")
        .groupBy("ticker", "sector")
        .agg(
            F.min("date").alias("listing_date"),
            F.max("date").alias("last_date"),
            F.sum("trades").alias("trade_rows"),
        )
        .withColumn("issuer", F.substring_index("ticker", "/", 1))
    )
