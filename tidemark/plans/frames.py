"""Frames that several registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import align, performance, portfolio, risk
from tidemark.sources import panel

MONTHS, WEEKS, DAYS = 12, 52, 252
SECTORS = ("SMALL", "MEDIUM", "LARGE", "ECONOMY", "STANDARD", "PROMO")


def aligned(spark: SparkSession, sf: str, freq: str = "month") -> DataFrame:
    return align.align_inner(panel.closes(spark, sf, "type", freq))


def sector_returns(spark: SparkSession, sf: str, freq: str = "month") -> DataFrame:
    return panel.kept(
        spark, ("sector_returns", sf, freq),
        lambda: align.returns(aligned(spark, sf, freq)).where(F.col("ret").isNotNull()),
    )


def market_returns(spark: SparkSession, sf: str, freq: str = "month") -> DataFrame:
    return panel.kept(
        spark, ("market_returns", sf, freq),
        lambda: align.returns(panel.benchmark(aligned(spark, sf, freq))).where(F.col("ret").isNotNull()),
    )


def weight_sets(spark: SparkSession, sf: str, freq: str = "month") -> DataFrame:
    """Three portfolios over the sector tickers: equal, inverse volatility, volume share."""
    return panel.kept(spark, ("weight_sets", sf, freq), lambda: _weight_sets(spark, sf, freq))


def _weight_sets(spark: SparkSession, sf: str, freq: str) -> DataFrame:
    rets = sector_returns(spark, sf, freq)
    universe = rets.select("ticker").distinct()
    volume = aligned(spark, sf, freq).groupBy("ticker").agg(F.sum("volume").alias("coefficient"))
    share = portfolio.normalize(volume.withColumn("portfolio", F.lit("volume_share")))
    return (
        portfolio.equal_weights(universe)
        .unionByName(portfolio.inverse_volatility(risk.volatility(rets, MONTHS)))
        .unionByName(share)
    )


def portfolio_returns(spark: SparkSession, sf: str, freq: str = "month") -> DataFrame:
    return panel.kept(
        spark, ("portfolio_returns", sf, freq),
        lambda: portfolio.portfolio_returns(sector_returns(spark, sf, freq), weight_sets(spark, sf, freq)),
    )


def paired(spark: SparkSession, sf: str, freq: str = "week", level: str = "type") -> DataFrame:
    """Ticker returns next to the market return of the same date."""
    prices = panel.closes(spark, sf, level, freq)
    own = align.returns(prices).where(F.col("ret").isNotNull())
    market = align.returns(panel.benchmark(prices)).select("date", F.col("ret").alias("market_ret"))
    return own.join(market, "date").where(F.col("market_ret").isNotNull()).select("ticker", "sector", "date", "ret", "market_ret")


def nav_paths(spark: SparkSession, sf: str, freq: str = "week") -> DataFrame:
    """Wealth of each portfolio with the market wealth next to it."""
    own = performance.wealth(portfolio_returns(spark, sf, freq))
    market = market_returns(spark, sf, freq).withColumn("portfolio", F.lit("market"))
    market = performance.wealth(market.select("portfolio", "date", "ret")).select("date", F.col("value").alias("market"))
    return own.join(market, "date").select("portfolio", "date", "value", "market")
