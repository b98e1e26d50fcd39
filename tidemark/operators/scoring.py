"""Utility of risk profiles, candidate scoring and the winner-takes-weight scorecard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import corr_of, is_close
from tidemark.operators import performance

# Coefficients of the risk profiles and of the validation utility.
PROFILES = {
    "Balanced": (1.00, 0.20, 0.35, 0.05, 0.05, 0.25, 1.00),
    "Defensive": (0.75, 0.45, 0.75, 0.08, 0.08, 0.35, 1.25),
    "Growth": (1.25, 0.10, 0.20, 0.03, 0.03, 0.15, 0.75),
}
VALIDATION = {"Validation": (1.00, 0.25, 0.50, 0.05, 0.05, 0.25, 0.0)}
COEFFICIENTS = (
    "return_reward", "volatility_penalty", "drawdown_penalty", "market_penalty", "second_penalty", "downside_reward", "equal_weight_penalty",
)
# Criterion, metric, weight, direction.
CRITERIA = (
    ("Long-term total return", "cagr", 0.20, "higher"),
    ("Low correlation with SPY", "correlation_market", 0.15, "lower"),
    ("Low correlation with SOXX", "correlation_second", 0.15, "lower"),
    ("Downside Beta", "downside_beta", 0.15, "lower"),
    ("Maximum Drawdown", "maximum_drawdown", 0.15, "higher"),
    ("Downside Capture Ratio", "downside_capture", 0.15, "lower"),
    ("3M avg dollar volume", "dollar_volume", 0.05, "higher"),
)


def profile_rows(profiles: dict[str, tuple]) -> Column:
    """The coefficient table as an array to explode: no join for a handful of rows."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("profile"), *[F.lit(v).alias(c) for c, v in zip(COEFFICIENTS, values)])
            for name, values in profiles.items()
        ]
    )


def path_metrics(paths: DataFrame, keys: Sequence[str], periods: int) -> DataFrame:
    """CAGR, volatility, drawdown, two correlations and downside excess; expects ret, market_ret, second_ret."""
    walked = performance.drawdown(performance.wealth(paths, keys, 1.0), keys)
    falling = F.when(F.col("market_ret") < 0, F.col("ret") - F.col("market_ret"))
    return walked.groupBy(*keys).agg(
        performance.annualized_return(periods).alias("cagr"), performance.annualized_volatility(periods).alias("volatility"),
        F.min("drawdown").alias("max_drawdown"), corr_of(F.col("ret"), F.col("market_ret")).alias("corr_market"),
        corr_of(F.col("ret"), F.col("second_ret")).alias("corr_second"),
        F.coalesce(F.avg(falling) * F.lit(float(periods)), F.lit(0.0)).alias("downside_excess"), F.count("ret").alias("observations"),
    )


def utility(metrics: DataFrame, profiles: dict[str, tuple], concentration: str | None = None) -> DataFrame:
    """Reward and penalties per profile; a missing metric scores far below any portfolio."""
    rows = metrics.select("*", F.explode(profile_rows(profiles)).alias("_p")).select(*metrics.columns, "_p.*")
    spread = F.col(concentration) if concentration else F.lit(0.0)
    value = (
        F.col("return_reward") * F.col("cagr") - F.col("volatility_penalty") * F.col("volatility")
        - F.col("drawdown_penalty") * F.abs("max_drawdown") - F.col("market_penalty") * F.greatest(F.col("corr_market"), F.lit(0.0))
        - F.col("second_penalty") * F.greatest(F.col("corr_second"), F.lit(0.0)) + F.col("downside_reward") * F.col("downside_excess")
        - F.col("equal_weight_penalty") * spread
    )
    known = F.col("corr_market").isNotNull() & F.col("corr_second").isNotNull()
    return rows.withColumn("utility", F.when(known, F.coalesce(value, F.lit(-1e6))).otherwise(F.lit(-1e6))).drop(*COEFFICIENTS)


def candidate_moments(weights: DataFrame, sigma: DataFrame, cov: DataFrame, to_market: DataFrame) -> DataFrame:
    """Diversification ratio and market correlation of each candidate from pair moments alone.

    ``weights``: candidate, ticker, weight. ``to_market``: ticker, market_cov, market_sigma.
    """
    own = weights.join(sigma, "ticker").join(to_market, "ticker").groupBy("candidate").agg(
        F.sum(F.col("weight") * F.col("sigma")).alias("weighted_sigma"), F.sum(F.col("weight") * F.col("market_cov")).alias("market_cov"),
        F.first("market_sigma").alias("market_sigma"),
    )
    half = weights.join(cov, weights.ticker == cov.i).groupBy("candidate", "j").agg(F.sum(F.col("weight") * F.col("cov")).alias("cw"))
    var = half.join(weights.select("candidate", F.col("ticker").alias("j"), "weight"), ["candidate", "j"]).groupBy("candidate").agg(
        F.sum(F.col("cw") * F.col("weight")).alias("variance")
    )
    return own.join(var, "candidate").select(
        "candidate", F.try_divide(F.col("weighted_sigma"), F.sqrt("variance")).alias("diversification_ratio"),
        F.try_divide(F.col("market_cov"), F.sqrt("variance") * F.col("market_sigma")).alias("market_correlation"),
    )


def scorecard(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per candidate and criterion: the best value takes the point, near-ties share it."""
    cells = F.array(
        *[
            F.struct(
                F.lit(label).alias("criterion"), F.lit(weight).alias("criterion_weight"), F.lit(1.0 if direction == "higher" else -1.0).alias("sign"),
                F.col(metric).alias("metric_value"),
            )
            for label, metric, weight, direction in CRITERIA
        ]
    )
    long = metrics.select(*keys, "ticker", F.inline(cells))
    part = Window.partitionBy(*keys, "criterion")
    best = F.max(F.col("metric_value") * F.col("sign")).over(part) * F.col("sign")
    scored = long.withColumn("best_value", best).withColumn("wins", is_close(F.col("metric_value"), F.col("best_value"), 1e-12, 1e-12))
    ties = F.sum(F.col("wins").cast("int")).over(part)
    return scored.withColumn("tie_count", ties).withColumn(
        "point", F.when(F.col("wins"), F.lit(1.0) / F.col("tie_count")).otherwise(F.lit(0.0))
    ).withColumn("weighted_score", F.col("point") * F.col("criterion_weight")).drop("wins", "sign")


def totals(scores: DataFrame, metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total score and rank; equal totals fall back to capture, beta, CAGR, liquidity and ticker."""
    summed = scores.groupBy(*keys, "ticker").agg(F.round(F.sum("weighted_score"), 12).alias("total_score"))
    joined = summed.join(metrics, [*keys, "ticker"])
    part = Window.partitionBy(*keys)
    order = part.orderBy(
        F.col("total_score").desc(), "downside_capture", "downside_beta", F.col("cagr").desc(), F.col("dollar_volume").desc(), "ticker"
    )
    top = F.max("total_score").over(part)
    tied = F.sum(is_close(F.col("total_score"), top, 1e-12, 1e-12).cast("int")).over(part)
    return joined.select(*keys, "ticker", "total_score", F.row_number().over(order).alias("selection_rank"), tied.alias("tie_count"))
