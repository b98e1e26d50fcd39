"""Date alignment, returns and estimation windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import by_date, positive


def align_inner(prices: DataFrame, price: str = "close") -> DataFrame:
    """Rows on the dates that every ticker of the table trades."""
    usable = prices.where(F.col(price) > 0)
    tickers = usable.agg(F.count_distinct("ticker")).scalar()
    common = (
        usable.groupBy("date")
        .agg(F.count_distinct("ticker").alias("tickers"))
        .where(F.col("tickers") == tickers)
        .select("date")
    )
    return usable.join(common, "date", "left_semi")


def align_outer(prices: DataFrame, price: str = "close") -> DataFrame:
    """Every (ticker, date) of the union calendar; a missing price stays NULL.

    The calendar is one array bounded by the number of trading days, exploded per
    ticker, so no pair join is planned.
    """
    calendar = prices.select("date").distinct().agg(F.array_sort(F.collect_list("date"))).scalar()
    grid = prices.select("ticker").distinct().select("ticker", F.explode(calendar).alias("date"))
    return grid.join(prices.select("ticker", "date", price), ["ticker", "date"], "left")


def returns(
    prices: DataFrame,
    k: int = 1,
    keys: Sequence[str] = ("ticker",),
    price: str = "close",
    name: str = "ret",
) -> DataFrame:
    """p_t / p_(t-k) - 1 on row positions; NULL when either price is not positive."""
    value = positive(price)
    return prices.withColumn(name, F.try_divide(value, F.lag(value, k).over(by_date(*keys))) - 1)


def estimation_tail(
    rows: DataFrame, windows: dict[str, int | None], keys: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Latest N rows per key for several named windows at once, in one pass.

    A row knows its age; the windows it belongs to are exploded from that age.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    aged = rows.withColumn("age", F.row_number().over(newest))
    labels = [
        F.lit(label) if size is None else F.when(F.col("age") <= size, F.lit(label))
        for label, size in windows.items()
    ]
    member = F.filter(F.array(*labels), lambda label: label.isNotNull())
    return aged.withColumn("grp", F.explode(member)).drop("age")


def last_per(rows: DataFrame, keys: Sequence[str], order: Column, value: Column, name: str) -> DataFrame:
    """Last value per key by an explicit order; aggregates, so no per-key task."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(name))


def asof_backward(
    events: DataFrame, facts: DataFrame, keys: Sequence[str], fact_columns: Sequence[str], on: str = "date"
) -> DataFrame:
    """Latest fact at or before each event: one sort per key, no range join."""
    return _asof(events, facts, keys, fact_columns, on, backward=True)


def asof_forward(
    events: DataFrame, facts: DataFrame, keys: Sequence[str], fact_columns: Sequence[str], on: str = "date"
) -> DataFrame:
    """First fact strictly after each event."""
    return _asof(events, facts, keys, fact_columns, on, backward=False)


def _asof(events, facts, keys, fact_columns, on, backward):
    payload = F.struct(*[F.col(c) for c in fact_columns]).alias("_fact")
    others = [c for c in events.columns if c not in keys and c != on]
    left = events.select(*keys, on, F.struct(*others, F.lit(1).alias("_e")).alias("_event"), F.lit(1).alias("_side"))
    right = facts.select(*keys, on, payload, F.lit(0).alias("_side"))
    both = left.unionByName(right, allowMissingColumns=True)
    # Both ways keep the last fact seen, one pass over the sorted key. Going down, an event comes before the
    # facts of its own date, so what was seen is strictly later.
    down = (F.col(on).desc(), F.col("_side").desc())
    ordered = Window.partitionBy(*keys).orderBy(*((on, "_side") if backward else down))
    found = F.last("_fact", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0 if backward else -1))
    return (
        both.withColumn("_found", found)
        .where(F.col("_side") == 1)
        .select(
            *keys, on,
            *[F.col(f"_event.{c}").alias(c) for c in others],
            *[F.col(f"_found.{c}").alias(c) for c in fact_columns],
        )
    )
