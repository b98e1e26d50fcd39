"""Aggregate queries over monthly, weekly and daily panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import by_date, corr_of, corr_over, rounded
from tidemark.operators import align, episodes, features, folds, performance, portfolio, risk
from tidemark.plans import frames
from tidemark.plans.frames import MONTHS, WEEKS
from tidemark.plans.registry import new_registry
from tidemark.sources import panel

QUERIES, query = new_registry()


@query
def agg_volatility(spark, sf):
    return rounded(risk.volatility(frames.sector_returns(spark, sf), MONTHS))


@query
def agg_covariance(spark, sf):
    return rounded(risk.covariance(frames.sector_returns(spark, sf), MONTHS))


@query
def agg_correlation_matrix(spark, sf):
    """Correlation of the portfolio series and the market on monthly returns."""
    own = frames.portfolio_returns(spark, sf).select(F.col("portfolio").alias("ticker"), "date", "ret")
    market = frames.market_returns(spark, sf).select("ticker", "date", "ret")
    return rounded(risk.correlation(own.unionByName(market)), 4)


@query
def agg_data_summary(spark, sf):
    """Rows per ticker before and after alignment of the daily panel."""
    prices = panel.closes(spark, sf, "type", "day")
    kept = align.align_inner(prices).groupBy("ticker").agg(F.count(F.lit(1)).alias("aligned_rows"))
    whole = prices.groupBy("ticker").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("rows")
    )
    out = whole.join(kept, "ticker", "left").withColumn("aligned_rows", F.coalesce("aligned_rows", F.lit(0)))
    return out.withColumn("removed_rows", F.col("rows") - F.col("aligned_rows"))


@query
def agg_cumulative_return(spark, sf):
    path = performance.wealth(frames.portfolio_returns(spark, sf))
    return rounded(
        path.groupBy("portfolio").agg((F.max_by("value", "date") / 100.0 - 1).alias("cumulative_return"))
    )


@query
def agg_annualized_return(spark, sf):
    return rounded(
        frames.portfolio_returns(spark, sf).groupBy("portfolio").agg(
            performance.annualized_return(MONTHS).alias("annualized_return"), F.count("ret").alias("observations")
        )
    )


@query
def agg_sharpe(spark, sf):
    return rounded(
        frames.portfolio_returns(spark, sf).groupBy("portfolio").agg(
            F.try_divide(performance.annualized_return(MONTHS), performance.annualized_volatility(MONTHS)).alias("sharpe_ratio")
        )
    )


@query
def agg_benchmark_corr(spark, sf):
    market = frames.market_returns(spark, sf).select("date", F.col("ret").alias("market_ret"))
    joined = frames.portfolio_returns(spark, sf).join(market, "date")
    return rounded(
        joined.groupBy("portfolio").agg(
            corr_of(F.col("ret"), F.col("market_ret")).alias("market_correlation"), F.count(F.lit(1)).alias("observations")
        )
    )


@query
def agg_max_drawdown(spark, sf):
    """Both conventions: the peak starts at the first wealth value, or at the invested capital."""
    rets = frames.portfolio_returns(spark, sf)
    plain = performance.max_drawdown(rets).withColumnRenamed("max_drawdown", "from_first_value")
    based = performance.max_drawdown(rets, include_base=True).withColumnRenamed("max_drawdown", "from_capital")
    return rounded(plain.join(based, "portfolio"))


@query
def agg_performance_table(spark, sf):
    return rounded(
        performance.performance_table(frames.portfolio_returns(spark, sf), frames.market_returns(spark, sf), MONTHS)
    )


@query
def agg_cagr_calendar(spark, sf):
    path = performance.wealth(frames.portfolio_returns(spark, sf))
    return rounded(path.groupBy("portfolio").agg(performance.calendar_cagr().alias("cagr")))


@query
def agg_downside(spark, sf):
    return rounded(performance.downside_metrics(frames.paired(spark, sf, "month", "instrument"), ["ticker"], MONTHS), 4)


@query
def agg_sharpe_sortino(spark, sf):
    rets = align.returns(panel.closes(spark, sf, "instrument", "month"))
    return rounded(performance.sharpe_sortino(rets, ["ticker"], MONTHS))


@query
def agg_nav_summary(spark, sf):
    return rounded(performance.nav_summary(frames.nav_paths(spark, sf), ["portfolio"], WEEKS))


@query
def agg_concentration(spark, sf):
    return rounded(portfolio.concentration(frames.weight_sets(spark, sf)))


@query
def agg_sector_allocation(spark, sf):
    """Weight per sector of a volume-share portfolio over all instruments."""
    volume = panel.closes(spark, sf, "instrument", "month").groupBy("ticker", "sector").agg(
        F.sum("volume").alias("coefficient")
    )
    weights = portfolio.normalize(volume.withColumn("portfolio", F.lit("volume_share")))
    return rounded(
        weights.groupBy("portfolio", "sector").agg(
            F.sum("weight").alias("sector_weight"), F.count(F.lit(1)).alias("holdings")
        )
    )


CORRELATION_WINDOWS = {"13 weeks": 13, "26 weeks": 26, "52 weeks": 52, "104 weeks": 104}


def weekly_forecasts(spark, sf):
    return folds.walk_forward_correlation(frames.paired(spark, sf), CORRELATION_WINDOWS, horizon=13, step=13)


@query
def agg_forecast_error(spark, sf):
    return rounded(folds.forecast_error(weekly_forecasts(spark, sf)))


@query
def agg_rolling_corr_stats(spark, sf):
    """Mean, maximum, minimum and deviation of the rolling correlation as metric rows."""
    window = by_date("ticker").rowsBetween(-51, 0)
    value = corr_over(F.col("ret"), F.col("market_ret"), window, F.lit(52))
    rolled = frames.paired(spark, sf).withColumn(
        "c", F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)))
    )
    stats = rolled.groupBy("ticker").agg(
        F.avg("c").alias("mean"), F.max("c").alias("maximum"), F.min("c").alias("minimum"),
        F.stddev_samp("c").alias("deviation"),
    )
    return rounded(stats.unpivot(["ticker"], ["mean", "maximum", "minimum", "deviation"], "metric", "value"), 5)


@query
def agg_fold_median(spark, sf):
    """Median inverse-volatility weight over annual folds."""
    rets = frames.sector_returns(spark, sf)
    yearly = risk.volatility(rets.withColumn("grp", F.year("date")), MONTHS, ["grp"])
    weights = portfolio.inverse_volatility(yearly, ["grp"])
    return rounded(
        weights.groupBy("ticker").agg(F.median("weight").alias("median_weight"), F.count(F.lit(1)).alias("folds"))
    )


def yearly_candidate_metrics(spark, sf):
    """Validation metrics of each weight set in each calendar year."""
    rets = frames.portfolio_returns(spark, sf).withColumn("validation_year", F.year("date"))
    market = frames.market_returns(spark, sf)
    return performance.performance_table(rets, market, MONTHS, ["portfolio", "validation_year"])


@query
def agg_candidate_oos(spark, sf):
    return rounded(
        yearly_candidate_metrics(spark, sf).groupBy("portfolio").agg(
            F.avg("annualized_return").alias("mean_return"), F.min("annualized_return").alias("worst_return"),
            F.avg("annualized_volatility").alias("mean_volatility"), F.min("max_drawdown").alias("worst_drawdown"),
            F.avg("market_correlation").alias("mean_market_correlation"),
        ),
        5,
    )


@query
def agg_feature_audit(spark, sf):
    return rounded(features.feature_audit(features.build_features(panel.bars(spark, sf, "type", "day"))))
