"""Ranking, top-k, sampling and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hex_uniform, is_close, rounded
from tidemark.operators import align, features, folds, universe
from tidemark.plans import frames
from tidemark.plans.aggregates import weekly_forecasts
from tidemark.plans.registry import new_registry
from tidemark.sources import panel

QUERIES, query = new_registry()


def liquidity(spark, sf):
    """Dollar volume per instrument over the last two years of the panel."""
    end = F.lit(panel.last_day(spark, sf)).cast("date")
    return universe.average_dollar_volume(panel.recent_closes(spark, sf, "instrument", 24), F.add_months(end, -24), end, 40)


@query
def agg_adv(spark, sf):
    return rounded(liquidity(spark, sf), 4)


@query
def win_rank_sector(spark, sf):
    """Instruments by sector order, dollar volume and ticker, with the rank in their sector."""
    order = F.array_position(F.array(*[F.lit(s) for s in frames.SECTORS]), F.col("sector"))
    part = Window.partitionBy("sector").orderBy(F.col("adv").desc(), "ticker")
    return rounded(liquidity(spark, sf).select(order.alias("sector_order"), "sector", F.row_number().over(part).alias("rank"), "ticker", "adv"), 4)


@query
def topk_sector_one(spark, sf):
    part = Window.partitionBy("sector").orderBy(F.col("adv").desc(), "ticker")
    top = liquidity(spark, sf).withColumn("rk", F.row_number().over(part)).where("rk = 1")
    return rounded(top.select("sector", "ticker", "adv", "observation_period"), 4)


@query
def topk_with_ties(spark, sf):
    """Highest monthly volume per sector; small whole numbers tie often enough to show the rule."""
    months = panel.bars(spark, sf, "instrument", "month")
    rows = months.select(
        "date", "sector", "ticker", F.floor(F.col("volume") / 100).cast("double").alias("adv20"), F.col("trades").alias("adv_valid_observations"),
        F.lit(0.0).alias("available_history_months"),
    )
    return rounded(universe.pick_highest(rows, ["date", "sector"]).select("date", "sector", "ticker", "adv20", "tie_break_used", "tie_break_reason"))


@query
def topk_three(spark, sf):
    """Three most traded instruments per sector and month; at least two make the sector ready."""
    part = Window.partitionBy("date", "sector").orderBy(F.col("volume").desc(), "ticker")
    top = panel.closes(spark, sf, "instrument", "month").withColumn("rk", F.row_number().over(part)).where("rk <= 3")
    out = top.groupBy("date", "sector").agg(F.array_sort(F.collect_list(F.struct("rk", "ticker"))).alias("t"), F.count(F.lit(1)).alias("selected_count"))
    return out.select(
        "date", "sector", F.array_join(F.transform("t", lambda x: x["ticker"]), ", ").alias("selected_symbols"), "selected_count",
        F.when(F.col("selected_count") >= 2, "READY").otherwise("ERROR_NEEDS_2_OR_3_ETFS").alias("status"),
    )


@query
def topk_min_tiebreak(spark, sf):
    """Estimation window with the lowest RMSE, then MAE, then length, per ticker."""
    errors = folds.forecast_error(weekly_forecasts(spark, sf), ["ticker", "window", "estimation_rows"])
    best = F.min_by(F.struct("window", "rmse", "mae"), F.struct("rmse", "mae", "estimation_rows"))
    return rounded(errors.groupBy("ticker").agg(best.alias("b")).select("ticker", "b.*"), 5)


@query
def sample_checks(spark, sf):
    """Five keyed draws per instrument, their return and target derived again."""
    prices = panel.bars(spark, sf, "instrument", "day").select("ticker", "date", "open", "high", "low", "close", "volume")
    order = Window.partitionBy("ticker").orderBy("date")
    sides = prices.select("ticker", "date", F.col("close").alias("close_t"), F.lag("close", 21).over(order).alias("close_before"), F.lead("close", 21).over(order).alias("close_after"))
    valid = sides.where(F.col("close_before").isNotNull() & F.col("close_after").isNotNull())
    draw = F.md5(F.concat_ws("|", F.lit("42"), "ticker", F.col("date").cast("string")))
    picked = valid.withColumn("rk", F.row_number().over(Window.partitionBy("ticker").orderBy(draw, "date"))).where("rk <= 5")
    stored = features.join_targets(features.add_returns(prices, (21,)).select("ticker", "date", "return_21d"), features.build_targets(prices))
    joined = picked.join(stored.select("ticker", F.col("feature_date").alias("date"), "return_21d", "target_21d_return"), ["ticker", "date"])
    again, ahead = F.col("close_t") / F.col("close_before") - 1, F.col("close_after") / F.col("close_t") - 1
    ok = is_close(again, F.col("return_21d"), 1e-5, 1e-8) & is_close(ahead, F.col("target_21d_return"), 1e-5, 1e-8)
    return rounded(joined.select("ticker", "date", "close_t", again.alias("return_21d"), ahead.alias("target_21d"), F.when(ok, "PASS").otherwise("FAIL").alias("status")))


@query
def limit_head(spark, sf):
    return panel.instruments(spark, sf).select("ticker", "sector", "listing_date").orderBy("ticker").limit(25)


@query
def set_union_frames(spark, sf):
    """Daily, weekly and monthly bars as one table; a column one of them lacks is NULL."""
    day = panel.closes(spark, sf, "type", "day").select(F.lit("day").alias("freq"), "ticker", "date", "close")
    week = panel.closes(spark, sf, "type", "week").select(F.lit("week").alias("freq"), "ticker", "date", "close")
    month = panel.closes(spark, sf, "type", "month").select(F.lit("month").alias("freq"), "ticker", "date", "close", "volume")
    both = day.unionByName(week).unionByName(month, allowMissingColumns=True)
    return rounded(both.groupBy("freq", "ticker").agg(F.count(F.lit(1)).alias("rows"), F.count("volume").alias("with_volume"), F.avg("close").alias("mean_close")), 5)


@query
def set_except_keys(spark, sf):
    """(ticker, month) keys of the grid without a bar."""
    prices = panel.closes(spark, sf, "instrument", "month")
    grid = align.align_outer(prices).select("ticker", "date")
    return grid.exceptAll(prices.select("ticker", "date"))


@query
def set_dedupe(spark, sf):
    """First and last trade of each instrument and day by order key: a repeated key keeps one row."""
    key = F.col("seq")
    rows = panel.trades(spark, sf, "instrument").groupBy("ticker", "day").agg(
        F.min_by("quantity", key).alias("first_quantity"), F.max_by("quantity", key).alias("last_quantity"), (F.count(F.lit(1)) - 1).alias("dropped")
    )
    return rounded(rows.where("dropped > 0"))


@query
def set_signature_compare(spark, sf):
    """Does every estimation window test the same observations: an order-free digest per window.

    Digests of the single observations add up, so no task holds a whole set.
    """
    cell = F.concat_ws("|", "ticker", F.col("testing_start_date").cast("string"), F.col("testing_end_date").cast("string"))
    part = F.conv(F.substring(F.md5(cell), 1, 8), 16, 10).cast("bigint")
    per = weekly_forecasts(spark, sf).groupBy("window").agg(F.sum(part).alias("signature"), F.count(F.lit(1)).alias("tests"))
    distinct = per.agg(F.count_distinct("signature")).scalar()
    return per.withColumn("distinct_signatures", distinct)
