"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import is_close
from tidemark.operators import checks, features, risk, scoring, universe
from tidemark.plans import frames
from tidemark.plans import universe as uni
from tidemark.plans.joins import window_covariance
from tidemark.plans.portfolios import monthly_nav, monthly_targets, scorable
from tidemark.plans.rankings import liquidity
from tidemark.plans.registry import new_registry
from tidemark.plans.scalars import eligibility_table
from tidemark.sources import panel

QUERIES, query = new_registry()


@query
def chk_matrix(spark, sf):
    """Finite, symmetric, positive diagonal, for each estimation window."""
    return risk.matrix_checks(window_covariance(spark, sf), ["grp"])


@query
def chk_selection(spark, sf):
    """Row counts, uniqueness, set equality and the winner rule of the liquidity selection."""
    ranking = liquidity(spark, sf)
    picked = ranking.groupBy("sector").agg(F.min_by(F.struct("ticker", "adv"), F.struct(-F.col("adv"), F.col("ticker"))).alias("p")).select("sector", "p.*")
    top = ranking.groupBy("sector").agg(F.max("adv").alias("best"))
    known = panel.instruments(spark, sf).select("ticker")
    copies = ranking.groupBy("ticker").agg((F.count(F.lit(1)) - 1).alias("extra"))
    lone = ranking.select("ticker", F.lit(1).alias("a")).join(known.select("ticker", F.lit(1).alias("b")), "ticker", "full_outer")
    return checks.union([
        checks.check_row(copies, 1, "unique_tickers", F.sum("extra")),
        checks.check_row(lone, 2, "ticker_sets_equal", F.count_if(F.col("a").isNull() | F.col("b").isNull())),
        checks.check_row(ranking, 3, "adv_finite_and_positive", F.count_if(F.coalesce(F.col("adv") <= 0, F.lit(True)))),
        checks.check_row(picked.join(top, "sector"), 4, "winner_is_maximum", F.count_if(~is_close(F.col("adv"), F.col("best"), 1e-12, 0.01))),
        checks.check_row(picked, 5, "one_winner_per_sector", F.count(F.lit(1)) - F.count_distinct("sector")),
    ])


@query
def chk_pit_17(spark, sf):
    monthly = uni.eligible_table(spark, sf)
    return checks.point_in_time_checks(
        monthly, universe.representatives(monthly), universe.monthly_coverage(monthly, uni.NAMES), uni.REAL_ESTATE_DATES[1], uni.COMMUNICATION_DATES[1]
    )


@query
def chk_scorecard(spark, sf):
    """Criterion weights are paid out in full, totals add to one, nothing looks past the cutoff."""
    metrics = scorable(spark, sf)
    keys = ["holding_month", "sector"]
    scores = scoring.scorecard(metrics, keys)
    paid = scores.groupBy(*keys, "criterion").agg(F.sum("weighted_score").alias("paid"), F.max("criterion_weight").alias("due"))
    total = scoring.totals(scores, metrics, keys).groupBy(*keys).agg(F.sum("total_score").alias("total"))
    return checks.union([
        checks.check_row(paid, 1, "criterion_weights_paid", F.count_if(~is_close(F.col("paid"), F.col("due"), 1e-5, 1e-8))),
        checks.check_row(total, 2, "group_totals_are_one", F.count_if(~is_close(F.col("total"), F.lit(1.0), 1e-5, 1e-8))),
        checks.check_row(metrics, 3, "no_future_data", F.count_if(F.col("last_price_used") >= F.col("holding_month"))),
    ])


@query
def chk_walkforward(spark, sf):
    """Monthly weights add to one, base dates precede their month, daily and monthly NAV end alike."""
    tables = monthly_nav(spark, sf)
    sums = monthly_targets(spark, sf).groupBy("month").agg(F.sum("weight").alias("w"))
    last_day = tables["daily"].groupBy(F.trunc("date", "month").cast("date").alias("month")).agg(F.max_by("net_nav", "date").alias("daily_nav"))
    tied = tables["monthly"].join(last_day, "month", "left")
    return checks.union([
        checks.check_row(sums, 1, "weights_sum_to_one", F.count_if(F.abs(F.col("w") - 1) > 1e-9)),
        checks.check_row(tables["monthly"], 2, "base_precedes_month", F.count_if(F.col("base_date") >= F.col("month"))),
        checks.check_row(tied, 3, "daily_monthly_nav_tie_out", F.count_if(F.coalesce(~is_close(F.col("net_nav"), F.col("daily_nav"), 1e-9, 1e-8), F.lit(True)))),
    ])


@query
def chk_clean_universe(spark, sf):
    """No unknown, prohibited or conflicting row in the clean set."""
    clean = eligibility_table(spark, sf).where("review_status = 'clean'")
    off = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(True)))
    flags = ("leveraged_flag", "inverse_flag", "single_stock_flag", "etn_flag", "option_overlay_flag", "thematic_flag", "lifecycle_conflict")
    listed = [(k, f"{name}_is_false", off(name)) for k, name in enumerate(flags, start=1)]
    return checks.checks_in_one_pass(clean, listed + [
        (8, "instrument_type_is_etf", F.count_if(F.col("instrument_type") != "ETF")), (9, "asset_class_is_equity", F.count_if(F.col("asset_class") != "equity")),
        (10, "scope_is_united_states", F.count_if(F.col("geographic_scope") != "United States")), (11, "eligible", F.count_if(~F.col("eligible"))),
    ])


@query
def chk_audit_refresh(spark, sf):
    """Tickers the prices of the last month audit, against the tickers of the metadata."""
    meta = eligibility_table(spark, sf).select("ticker").distinct().withColumn("known", F.lit(True))
    audit = panel.recent_closes(spark, sf, "instrument", 1).select("ticker").distinct().withColumn("audited", F.lit(True))
    both = audit.join(meta, "ticker", "full_outer")
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("audited").isNull()).alias("only_in_metadata"), F.count_if(F.col("known").isNull()).alias("only_in_audit")
    )


@query
def chk_no_lookahead(spark, sf):
    """Prices after a cutoff are changed; no feature up to it may differ."""
    prices = panel.bars(spark, sf, "type", "day").select("ticker", "date", "open", "high", "low", "close", "volume")
    cutoff = F.lit("1999-06-30").cast("date")
    bent = prices.withColumns({c: F.when(F.col("date") > cutoff, F.col(c) * 1.7).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    digest = lambda frame: frame.where(F.col("date") <= cutoff).select(
        "ticker", "date", F.xxhash64(*[c for c in frame.columns if c not in ("ticker", "date")]).alias("digest")
    )
    one = digest(features.feature_table(prices))
    two = digest(features.feature_table(bent)).withColumnRenamed("digest", "other")
    joined = one.join(two, ["ticker", "date"], "full_outer")
    return joined.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("digest").eqNullSafe(F.col("other"))).alias("changed"))
