"""Wealth paths and performance statistics per portfolio."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import beta_of, by_date, corr_of

DAYS_PER_YEAR = 365.2425


def growth(ret: str | Column = "ret") -> Column:
    """Product of (1 + r) as an aggregate; NULL for a group with a return of -100 % or less."""
    column = F.col(ret) if isinstance(ret, str) else ret
    safe = F.when(column > -1, F.log1p(column))
    return F.when(F.min(column) > -1, F.exp(F.sum(safe)))


def annualized_return(periods: int, ret: str = "ret") -> Column:
    return F.pow(growth(ret), F.lit(float(periods)) / F.count(ret)) - 1


def annualized_volatility(periods: int, ret: str = "ret") -> Column:
    return F.stddev_samp(ret) * F.lit(math.sqrt(periods))


def downside_deviation(periods: int, ret: str = "ret") -> Column:
    return F.sqrt(F.avg(F.when(F.col(ret) < 0, F.col(ret) * F.col(ret)))) * F.lit(math.sqrt(periods))


def wealth(returns: DataFrame, keys: Sequence[str] = ("portfolio",), start: float = 100.0) -> DataFrame:
    """start * prod(1 + r) along each path."""
    path = by_date(*keys).rowsBetween(Window.unboundedPreceding, 0)
    log_step = F.when(F.col("ret") > -1, F.log1p("ret"))
    broken = F.count_if(F.col("ret") <= -1).over(path) > 0
    return returns.withColumn("value", F.when(~broken, F.lit(start) * F.exp(F.sum(log_step).over(path))))


def drawdown(path: DataFrame, keys: Sequence[str] = ("portfolio",), value: str = "value", base: float | None = None) -> DataFrame:
    """value / running peak - 1; ``base`` prepends a starting level to the peak."""
    frame = by_date(*keys).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(value).over(frame)
    if base is not None:
        peak = F.greatest(peak, F.lit(base))
    return path.withColumn("drawdown", F.try_divide(F.col(value), peak) - 1)


def max_drawdown(returns: DataFrame, keys: Sequence[str] = ("portfolio",), include_base: bool = False) -> DataFrame:
    path = drawdown(wealth(returns, keys, 1.0), keys, base=1.0 if include_base else None)
    return path.groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def performance_table(
    returns: DataFrame, market: DataFrame, periods: int, keys: Sequence[str] = ("portfolio",), include_base: bool = False
) -> DataFrame:
    """One row per portfolio: one window pass for the path, one aggregate for the rest."""
    path = drawdown(wealth(returns, keys, 1.0), keys, base=1.0 if include_base else None)
    joined = path.join(market.select("date", F.col("ret").alias("market_ret")), "date")
    return (
        joined.groupBy(*keys)
        .agg(
            (growth() - 1).alias("cumulative_return"),
            annualized_return(periods).alias("annualized_return"),
            annualized_volatility(periods).alias("annualized_volatility"),
            corr_of(F.col("ret"), F.col("market_ret")).alias("market_correlation"),
            F.min("drawdown").alias("max_drawdown"),
            F.count("ret").alias("observations"),
        )
        .withColumn("sharpe_ratio", F.try_divide(F.col("annualized_return"), F.col("annualized_volatility")))
    )


def calendar_cagr(value: str = "value", day: str = "date") -> Column:
    """(last / first) ^ (365.2425 / days) - 1 as an aggregate."""
    years = F.datediff(F.max(day), F.min(day)) / F.lit(DAYS_PER_YEAR)
    ratio = F.try_divide(F.max_by(value, day), F.min_by(value, day))
    return F.when(years > 0, F.pow(ratio, F.try_divide(F.lit(1.0), years)) - 1)


def downside_metrics(paired: DataFrame, keys: Sequence[str], periods: int) -> DataFrame:
    """Beta and behaviour in the months the market falls; expects ret and market_ret."""
    falling = F.col("market_ret") < 0
    own, market = F.when(falling, F.col("ret")), F.when(falling, F.col("market_ret"))
    return paired.groupBy(*keys).agg(
        beta_of(F.col("ret"), F.col("market_ret")).alias("beta"),
        F.count(market).alias("falling_periods"),
        beta_of(own, market).alias("downside_beta"),
        F.try_divide(F.avg(own), F.avg(market)).alias("downside_capture"),
        F.coalesce(F.avg(own - market) * F.lit(float(periods)), F.lit(0.0)).alias("downside_excess"),
    )


def sharpe_sortino(returns: DataFrame, keys: Sequence[str], periods: int) -> DataFrame:
    mean = F.avg("ret") * F.lit(float(periods))
    return returns.groupBy(*keys).agg(
        F.try_divide(mean, annualized_volatility(periods)).alias("sharpe"),
        F.try_divide(mean, downside_deviation(periods)).alias("sortino"),
    )


def nav_summary(nav: DataFrame, keys: Sequence[str], periods: int) -> DataFrame:
    """Cumulative, CAGR, volatility, Sharpe, Sortino, drawdown and month statistics."""
    ordered = by_date(*keys)
    daily = drawdown(nav, keys).withColumn("ret", F.try_divide(F.col("value"), F.lag("value").over(ordered)) - 1)
    mean = F.avg("ret") * F.lit(float(periods))
    by_day = daily.groupBy(*keys).agg(
        (F.try_divide(F.max_by("value", "date"), F.min_by("value", "date")) - 1).alias("cumulative_return"),
        calendar_cagr().alias("cagr"),
        annualized_volatility(periods).alias("volatility"),
        F.try_divide(mean, annualized_volatility(periods)).alias("sharpe"),
        F.try_divide(mean, downside_deviation(periods)).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
    )
    month_end = nav.groupBy(*keys, F.last_day("date").alias("month")).agg(F.max_by("value", "date").alias("value"))
    months = Window.partitionBy(*keys).orderBy("month")
    monthly = month_end.withColumn("month_ret", F.try_divide(F.col("value"), F.lag("value").over(months)) - 1)
    by_month = monthly.groupBy(*keys).agg(
        F.max("month_ret").alias("best_month"),
        F.min("month_ret").alias("worst_month"),
        F.avg(F.when(F.col("month_ret").isNotNull(), (F.col("month_ret") > 0).cast("double"))).alias("positive_months"),
    )
    return by_day.join(by_month, list(keys))
