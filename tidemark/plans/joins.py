"""Join queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import align, features, folds, portfolio, risk, universe
from tidemark.plans import frames
from tidemark.plans.registry import new_registry
from tidemark.plans.windows import model_dataset
from tidemark.sources import panel

QUERIES, query = new_registry()


@query
def join_align_inner(spark, sf):
    return rounded(align.align_inner(panel.closes(spark, sf, "type", "day")).select("ticker", "date", "close"))


@query
def join_align_outer(spark, sf):
    """Weekly returns on the union calendar: a week without a trade is NULL on both sides."""
    grid = align.returns(align.align_outer(panel.closes(spark, sf, "instrument", "week")))
    return rounded(grid.select("ticker", "date", "close", "ret"))


@query
def join_universe_diff(spark, sf):
    """Instruments traded in the first but not the last quarter of the panel, and the reverse."""
    days = panel.closes(spark, sf, "instrument", "day").select("ticker", "date")
    first, last = days.agg(F.trunc(F.min("date"), "quarter")).scalar(), days.agg(F.trunc(F.max("date"), "quarter")).scalar()
    early = days.where(F.col("date") < F.add_months(first, 3)).select("ticker").distinct().withColumn("in_first", F.lit(True))
    late = days.where(F.col("date") >= last).select("ticker").distinct().withColumn("in_last", F.lit(True))
    both = early.join(late, "ticker", "full_outer")
    status = F.when(F.col("in_last").isNull(), "missing").when(F.col("in_first").isNull(), "extra").otherwise("both")
    return both.select("ticker", status.alias("status"))


@query
def join_feature_target(spark, sf):
    """One-to-one feature and target rows per ticker, tail kept."""
    prices = panel.bars(spark, sf, "instrument", "day").select("ticker", "date", "open", "high", "low", "close", "volume")
    feats = features.add_returns(prices, (5, 21)).select("ticker", "date", "return_5d", "return_21d")
    return rounded(features.join_targets(feats, features.build_targets(prices)).select(
        "ticker", "feature_date", "return_5d", "return_21d", "label_end_date", "target_available", "target_21d_return", "matched_once"
    ))


@query
def join_enrich(spark, sf):
    """Instrument rows with issuer evidence and price facts; the first evidence row per ticker counts."""
    parts = panel.table(spark, sf, "part")
    ticker = F.concat_ws("/", "p_brand", "p_type").alias("ticker")
    first = F.min_by(F.struct("p_name", "p_retailprice"), F.struct("p_name", "p_partkey"))
    evidence = parts.groupBy(ticker).agg(first.alias("e")).select("ticker", F.col("e.p_name").alias("objective"), F.col("e.p_retailprice").alias("list_price"))
    audit = panel.closes(spark, sf, "instrument", "day").groupBy("ticker").agg(F.count(F.lit(1)).alias("price_days"))
    known = panel.instruments(spark, sf).select("ticker", "sector", "listing_date")
    return rounded(known.join(evidence, "ticker").join(audit, "ticker", "left"))


@query
def join_month_grid(spark, sf):
    """Every completed month for every instrument, with its age at that month end."""
    months = universe.month_ends(panel.closes(spark, sf, "instrument", "day"))
    grid = universe.month_grid(panel.instruments(spark, sf).select("ticker", "listing_date"), months)
    return grid.withColumn("listed", F.col("listing_date") <= F.col("selection_date"))


@query
def join_asof_backward(spark, sf):
    """Last close on or before the first day of each month."""
    prices = panel.closes(spark, sf, "instrument", "day")
    firsts = prices.groupBy(F.trunc("date", "month").alias("date")).agg(F.count(F.lit(1)).alias("rows")).select("date")
    grid = universe.month_grid(panel.instruments(spark, sf).select("ticker"), firsts)
    facts = prices.select("ticker", "date", F.col("date").alias("price_date"), "close")
    return rounded(align.asof_backward(grid, facts, ["ticker"], ["price_date", "close"]))


@query
def join_asof_forward(spark, sf):
    """First trading day of each instrument after every month end."""
    days = panel.closes(spark, sf, "instrument", "day")
    months = universe.month_ends(days).select(F.col("selection_date").alias("date"))
    grid = universe.month_grid(panel.instruments(spark, sf).select("ticker"), months)
    facts = days.select("ticker", "date", F.col("date").alias("next_date"), F.col("close").alias("next_close"))
    return rounded(align.asof_forward(grid, facts, ["ticker"], ["next_date", "next_close"]))


@query
def join_purge_theta(spark, sf):
    """Labelled rows that end before each quarter starts, against those that overlap it."""
    return purge_by_quarter(model_dataset(spark, sf).where("target_available"))


def purge_by_quarter(rows):
    """Per ticker and quarter with rows: earlier rows kept (label ended before it) and purged (label reaches into it).

    The inequality join becomes running counts: a date lies before a quarter start exactly if its own quarter
    starts earlier, so rows are counted by the quarters of their two dates and summed up to the one before.
    """
    ends = F.array(
        F.struct(F.trunc("feature_date", "quarter").alias("validation_start"), F.lit(1).alias("began"), F.lit(0).alias("ended")),
        F.struct(F.trunc("label_end_date", "quarter").alias("validation_start"), F.lit(0).alias("began"), F.lit(1).alias("ended")),
    )
    counts = rows.select("ticker", F.inline(ends)).groupBy("ticker", "validation_start").agg(F.sum("began").alias("began"), F.sum("ended").alias("ended"))
    earlier = Window.partitionBy("ticker").orderBy("validation_start").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name: F.coalesce(F.sum(name).over(earlier), F.lit(0))
    running = counts.select("ticker", F.col("validation_start").cast("date"), "began", before("ended").alias("kept"), (before("began") - before("ended")).alias("purged"))
    return running.where(F.col("began") > 0).drop("began")


@query
def join_self_pairs(spark, sf):
    """Weekly ticker pairs with their shared weeks and co-movement."""
    pairs = risk.pair_moments(frames.sector_returns(spark, sf, "week"))
    return rounded(pairs.select("i", "j", F.col("n").alias("weeks"), "mean_product"))


# Estimation windows in weeks: even the shortest has more returns than there are tickers.
WINDOWS = {"3 months": 13, "6 months": 26, "1 year": 52, "2 years": 104, "3 years": 156, "full": None}


def window_tails(spark, sf):
    return align.estimation_tail(frames.sector_returns(spark, sf, "week"), WINDOWS)


def window_covariance(spark, sf):
    return panel.kept(spark, ("window_covariance", sf), lambda: risk.covariance(window_tails(spark, sf), frames.WEEKS, ["grp"]))


def window_weights(spark, sf):
    """Long-only most diversified weights of six estimation windows."""
    return panel.kept(spark, ("window_weights", sf), lambda: portfolio.most_diversified(window_covariance(spark, sf), ["grp"]))


def weight_distances(weights):
    """Pairwise L1 distance of named weight vectors, folded per ticker."""
    left = weights.select(F.col("grp").alias("w1"), "ticker", F.col("weight").alias("a"))
    right = weights.select(F.col("grp").alias("w2"), "ticker", F.col("weight").alias("b"))
    return left.join(right, "ticker").groupBy("w1", "w2").agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("l1_distance"))


@query
def join_self_windows(spark, sf):
    return rounded(weight_distances(window_weights(spark, sf)), 4)


@query
def join_anti_snapshot(spark, sf):
    """Instruments of one year's snapshot that the next year's lacks, and the reverse."""
    yearly = panel.closes(spark, sf, "instrument", "week").where(F.col("volume") >= 100).select(F.year("date").alias("y"), "ticker").distinct()
    following = yearly.select((F.col("y") - 1).alias("y"), "ticker")
    preceding = yearly.select((F.col("y") + 1).alias("y"), "ticker")
    gone = yearly.join(following, ["y", "ticker"], "left_anti").withColumn("change", F.lit("not_in_next_year"))
    new = yearly.join(preceding, ["y", "ticker"], "left_anti").withColumn("change", F.lit("not_in_previous_year"))
    return rounded(gone.unionByName(new).select(F.col("y").alias("snapshot_year"), "ticker", "change"))


@query
def join_group_max_check(spark, sf):
    """Monthly sector winners equal the maximum of their sector."""
    prices = panel.closes(spark, sf, "instrument", "month").withColumn("dollars", F.col("cents") / F.lit(100.0))
    part = Window.partitionBy("date", "sector")
    winners = prices.withColumn("rk", F.row_number().over(part.orderBy(F.col("dollars").desc(), "ticker"))).where("rk = 1")
    best = prices.groupBy("date", "sector").agg(F.max("dollars").alias("best"), F.count(F.lit(1)).alias("candidates"))
    joined = winners.join(best, ["date", "sector"])
    return rounded(joined.select("date", "sector", "ticker", "dollars", "candidates", (F.col("dollars") == F.col("best")).alias("is_maximum")), 2)
