"""Window queries: features, targets, correlation, drawdowns, folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import by_date, corr_over, rounded
from tidemark.operators import align, episodes, features, folds, performance
from tidemark.plans import frames
from tidemark.plans.aggregates import weekly_forecasts
from tidemark.plans.registry import new_registry
from tidemark.sources import panel

QUERIES, query = new_registry()


def _picked(df, names):
    return rounded(df.select("ticker", "date", *names))


def _instrument_days(spark, sf):
    return panel.bars(spark, sf, "instrument", "day").select("ticker", "date", "open", "high", "low", "close", "volume")


def suspended(prices, least_volume=3):
    """Days with hardly any volume lose their open and close: rows for the error classes."""
    idle = F.col("volume") <= least_volume
    return prices.withColumns(
        {"open": F.when(idle, 0.0).otherwise(F.col("open")), "close": F.when(idle, 0.0).otherwise(F.col("close"))}
    )


@query
def win_returns(spark, sf):
    names = [f"return_{k}d" for k in features.RETURN_WINDOWS]
    return _picked(features.add_returns(_instrument_days(spark, sf)), names)


@query
def win_target(spark, sf):
    return rounded(features.build_targets(_instrument_days(spark, sf)))


@query
def win_sma(spark, sf):
    names = [f"{p}_{n}" for n in features.SMA_WINDOWS for p in ("sma", "price_to_sma")]
    return _picked(features.add_sma(_instrument_days(spark, sf)), names)


@query
def win_volatility(spark, sf):
    names = [f"volatility_{n}d" for n in features.VOLATILITY_WINDOWS]
    return _picked(features.add_volatility(_instrument_days(spark, sf)), names)


@query
def win_ohlc(spark, sf):
    return _picked(
        features.add_ohlc(_instrument_days(spark, sf)), ["high_low_range", "open_close_return", "overnight_gap"]
    )


@query
def win_volume(spark, sf):
    names = [
        "volume_change_1d", "volume_to_average_5d", "volume_to_average_21d", "dollar_volume", "adv20", "relative_adv20",
    ]
    return rounded(features.add_volume(_instrument_days(spark, sf)).select("ticker", "date", *names), 5)


@query
def win_rsi(spark, sf):
    return _picked(features.add_rsi(panel.bars(spark, sf, "type", "day")), ["rsi_14"])


@query
def win_rolling_mdd(spark, sf):
    names = [f"rolling_max_drawdown_{n}d" for n in features.DRAWDOWN_WINDOWS]
    return _picked(features.add_rolling_drawdown(panel.bars(spark, sf, "type", "day")), names)


@query
def win_missing_reason(spark, sf):
    """Every missing feature value of a panel with suspended days, with its reason."""
    reasons = features.missing_reasons(features.build_features(suspended(panel.bars(spark, sf, "type", "day"))))
    return reasons.where(F.col("reason") != "").select("ticker", "date", "feature", "reason")


@query
def win_rolling_corr(spark, sf):
    window = by_date("ticker").rowsBetween(-51, 0)
    value = corr_over(F.col("ret"), F.col("market_ret"), window, F.lit(52))
    clipped = F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0))
    out = frames.paired(spark, sf).withColumn("rolling_corr", F.when(value.isNotNull(), clipped))
    return rounded(out.where(F.col("rolling_corr").isNotNull()).select("ticker", "date", "rolling_corr"), 5)


@query
def win_wealth(spark, sf):
    return rounded(performance.wealth(frames.portfolio_returns(spark, sf, "week")).select("portfolio", "date", "value"), 5)


@query
def win_drawdown(spark, sf):
    path = performance.drawdown(performance.wealth(frames.portfolio_returns(spark, sf, "week")))
    return rounded(path.select("portfolio", "date", "drawdown"))


@query
def win_business_gap(spark, sf):
    """Weekday gaps of more than five between trading days of an instrument, with its maximum."""
    gaps = episodes.weekday_gaps(panel.closes(spark, sf, "instrument", "day").select("ticker", "date"))
    gaps = gaps.withColumn("max_gap", F.max("missing_weekdays").over(Window.partitionBy("ticker")))
    return gaps.where(F.col("missing_weekdays") > 5).select("ticker", "previous_date", "date", "missing_weekdays", "max_gap")


@query
def win_max_run(spark, sf):
    """Longest run of weeks without a trade per instrument on the union calendar."""
    grid = align.align_outer(panel.closes(spark, sf, "instrument", "week"))
    runs = episodes.runs(grid, F.col("close").isNull())
    longest = F.struct("run_length", F.col("run_start"))
    return rounded(
        runs.groupBy("ticker").agg(
            F.max("run_length").alias("max_run"), F.count(F.lit(1)).alias("runs"), F.min("run_start").alias("first_run_start"),
            F.max_by("run_end", longest).alias("longest_run_end"),
        )
    )


@query
def win_stress_events(spark, sf):
    return rounded(episodes.stress_events(frames.nav_paths(spark, sf), window=4, threshold=-0.10), 5)


@query
def win_drawdown_episodes(spark, sf):
    out = episodes.drawdown_episodes(frames.nav_paths(spark, sf), threshold=-0.15)
    return rounded(
        out.select(
            "portfolio", "peak_date", "trough_date", "end_date",
            F.when(F.col("recovered"), "Recovered").otherwise("Ongoing at sample end").alias("status"),
            F.col("market_to_trough").alias("market_drawdown"), "portfolio_to_trough", "portfolio_max_drawdown",
            "market_full", "portfolio_full", "calendar_days",
        ),
        5,
    )


@query
def win_drawdown_trigger(spark, sf):
    out = episodes.drawdown_episodes(frames.nav_paths(spark, sf), threshold=-0.15, tolerance=1e-12)
    numbered = out.withColumn("event", F.row_number().over(Window.partitionBy("portfolio").orderBy("peak_date")))
    return rounded(
        numbered.select(
            "portfolio", "event", "peak_date", "trough_date", "end_date", "recovered", "market_max_drawdown",
            "portfolio_max_drawdown", "market_to_trough", "portfolio_to_trough", "portfolio_full",
        ),
        5,
    )


@query
def win_rebalance_flag(spark, sf):
    days = panel.closes(spark, sf, "instrument", "day").select("ticker", "date")
    parts = [
        episodes.rebalance_flags(days, frequency, ["ticker"]).where("rebalance").select(
            "ticker", F.lit(frequency).alias("frequency"), "date"
        )
        for frequency in ("monthly", "quarterly", "annual")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def win_walk_forward(spark, sf):
    return rounded(weekly_forecasts(spark, sf), 5)


@query
def win_rank_min(spark, sf):
    """Windows ranked by RMSE and MAE with shared ranks, and the one selected."""
    errors = folds.forecast_error(weekly_forecasts(spark, sf), ["ticker", "window", "estimation_rows"])
    part = Window.partitionBy("ticker")
    best = F.row_number().over(part.orderBy("rmse", "mae", "estimation_rows")) == 1
    out = errors.select(
        "ticker", "window", "rmse", "mae",
        F.rank().over(part.orderBy("rmse")).alias("rank_rmse"), F.rank().over(part.orderBy("mae")).alias("rank_mae"),
        best.alias("selected"),
    )
    return rounded(out, 5)


def model_dataset(spark, sf):
    """Features and target of the sector tickers, one row per ticker and day."""
    return panel.kept(spark, ("model_dataset", sf), lambda: _model_dataset(spark, sf))


def _model_dataset(spark, sf):
    prices = panel.bars(spark, sf, "type", "day").select("ticker", "date", "open", "high", "low", "close", "volume")
    feats = features.add_volatility(features.add_sma(features.add_returns(prices, (5, 21)), (21,)), (21,))
    keep = ["return_5d", "return_21d", "price_to_sma_21", "volatility_21d"]
    return features.join_targets(feats.select("ticker", "date", *keep), features.build_targets(prices)).drop("matched_once")


def model_features(spark, sf):
    """All features of the catalogue and the target, one row per sector ticker and day: what models are fitted on."""
    def build():
        prices = panel.bars(spark, sf, "type", "day")
        return features.join_targets(features.feature_table(prices), features.build_targets(prices)).drop("matched_once")

    return panel.kept(spark, ("model_features", sf), build)


#: Years of rows a model may be trained on.
TRAINING_YEARS = 5


def selection_dates(spark, sf):
    """Last observed trading day of each complete month of a ticker."""
    days = panel.closes(spark, sf, "type", "day")
    ends = days.groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.max("date").alias("selection_date"))
    newest = Window.partitionBy("ticker").orderBy(F.col("month").desc())
    ranked = ends.withColumn("rk", F.row_number().over(newest))
    return ranked.where(F.col("rk") > 1).select("ticker", "selection_date")


def training_rows(spark, sf, years=TRAINING_YEARS, dataset=model_dataset):
    return folds.available_as_of(dataset(spark, sf), selection_dates(spark, sf), years)


@query
def win_purged_folds(spark, sf):
    members = folds.purged_folds(training_rows(spark, sf), splits=3, validation_rows=21, min_train_rows=252, embargo_rows=5)
    return folds.fold_summary(members, 252)


@query
def win_label_audit(spark, sf):
    return features.label_audit(features.build_targets(_instrument_days(spark, sf)))


@query
def win_annual_folds(spark, sf):
    """Five training years before each validation year, with validation metrics of each portfolio."""
    rets = frames.portfolio_returns(spark, sf, "week")
    members = folds.annual_members(rets, 5)
    train, valid = F.col("role") == "train", F.col("role") == "validation"
    counted = members.groupBy("portfolio", "validation_year").agg(
        F.min(F.when(train, F.col("date"))).alias("train_start"), F.max(F.when(train, F.col("date"))).alias("train_end"),
        F.count_if(train).alias("train_rows"), F.count_if(valid).alias("validation_rows"),
        (F.stddev_samp(F.when(valid, F.col("ret"))) * F.sqrt(F.lit(52.0))).alias("validation_volatility"),
        (F.exp(F.sum(F.when(valid, F.log1p("ret")))) - 1).alias("validation_return"),
    )
    return rounded(counted.where((F.col("train_rows") >= 200) & (F.col("validation_rows") >= 12)), 5)


@query
def win_group_total(spark, sf):
    """Each instrument's share of its sector's volume in a month."""
    prices = panel.closes(spark, sf, "instrument", "month")
    part = Window.partitionBy("date", "sector")
    out = prices.select(
        "ticker", "sector", "date", "volume", F.sum("volume").over(part).alias("sector_volume"),
        F.try_divide(F.col("volume"), F.sum("volume").over(part)).alias("share"),
    )
    return rounded(out)
