"""The flagship query: price table to long-only most diversified portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import portfolio, risk
from tidemark.plans import frames

MONTHS = 12


def diversified_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = frames.sector_returns(spark, sf_dir, "month").withColumn("grp", F.lit("all"))
    cov = risk.covariance(rets, MONTHS, ["grp"])
    weights = portfolio.most_diversified(cov, ["grp"]).withColumn("portfolio", F.lit("most_diversified"))
    sigma = weights.select("grp", "ticker", "sigma")
    ratio = portfolio.diversification_ratio(
        weights.select("grp", "portfolio", "ticker", "weight"), sigma, cov, ["grp"]
    ).select("grp", "diversification_ratio")
    return rounded(weights.join(ratio, "grp").select("ticker", "sigma", "weight", "kkt_residual", "status", "diversification_ratio"))
