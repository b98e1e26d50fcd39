"""Portfolio queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import beta_of, corr_of, is_close, rnd, rounded
from tidemark.operators import align, folds, nav, performance, portfolio, risk, scoring, universe
from tidemark.plans import frames
from tidemark.plans.frames import MONTHS, WEEKS
from tidemark.plans.joins import weight_distances, window_covariance, window_tails, window_weights
from tidemark.plans.registry import new_registry
from tidemark.session import landing_path
from tidemark.sources import panel

QUERIES, query = new_registry()
#: Seed and number of the draws a candidate search scores, share of a draw in a candidate, and the weight bounds
#: outside which a draw is rejected. The functions below take another number as an argument.
SEED, CANDIDATES, DRAW_SHARE = 20260808, 60, 0.30
LEAST_WEIGHT, MOST_WEIGHT = 0.05, 0.25
#: Refinement: each round draws CANDIDATES times around the best so far, moving it by this share.
REFINE_STEPS = (0.20, 0.05)
OBJECTIVES = ("max_diversification", "min_market_correlation")
#: Starts of the bounded solver in each group.
STARTS = 64
#: Walk-forward: months of training, months of validation, least weekly returns of a training window.
TRAIN_MONTHS, VALIDATION_MONTHS, LEAST_WEEKS = 36, 24, 140


@query
def pf_returns(spark, sf):
    return rounded(frames.portfolio_returns(spark, sf))


@query
def pf_equal_weight(spark, sf):
    return rounded(portfolio.equal_weights(panel.instruments(spark, sf).select("sector", "ticker"), ["sector"]))


@query
def pf_normalize(spark, sf):
    """Volume coefficients per month to weights over all instruments."""
    rows = panel.closes(spark, sf, "instrument", "month").select("date", "ticker", F.col("volume").alias("coefficient"))
    return rounded(portfolio.normalize(rows, ["date"]))


@query
def pf_inverse_vol(spark, sf):
    """Inverse-volatility weights inside each sector from weekly instrument returns."""
    rets = align.returns(panel.closes(spark, sf, "instrument", "week"))
    return rounded(portfolio.inverse_volatility(risk.volatility(rets, WEEKS, ["sector"]), ["sector"]))


def sector_risk(spark, sf):
    rets = frames.sector_returns(spark, sf)
    return risk.volatility(rets, MONTHS), panel.kept(spark, ("sector_covariance", sf), lambda: risk.covariance(rets, MONTHS))


@query
def pf_diversification_ratio(spark, sf):
    sigma, cov = sector_risk(spark, sf)
    return rounded(portfolio.diversification_ratio(frames.weight_sets(spark, sf), sigma, cov))


@query
def pf_constraints(spark, sf):
    """Which candidates are fully invested and inside 5 % to 25 %."""
    grid = portfolio.candidate_grid(frames.sector_returns(spark, sf).select("ticker").distinct(), CANDIDATES, SEED)
    return portfolio.constraint_report(grid, ["candidate"], 0.05, 0.25)


@query
def pf_mdp_analytic(spark, sf):
    """Unconstrained maximum diversification per estimation window."""
    return rounded(portfolio.analytic_weights(window_covariance(spark, sf), ["grp"]), 5)


@query
def pf_mdp_long_only(spark, sf):
    """Long-only maximum diversification per estimation window, with its optimality residual."""
    out = window_weights(spark, sf)
    return out.select("grp", "ticker", rnd("sigma", 5).alias("sigma"), rnd("weight", 4).alias("weight"), rnd("kkt_residual", 5).alias("kkt_residual"), "status")


@query
def pf_candidate_grid(spark, sf):
    """Equal weights and seeded draws under a 30 % cap."""
    return rounded(portfolio.candidate_grid(frames.sector_returns(spark, sf).select("ticker").distinct(), CANDIDATES, SEED, cap=0.30))


def candidate_weights(spark, sf, count=CANDIDATES):
    """Feasible candidates: equal weights mixed with draws, all inside the bounds."""
    universe_ = frames.sector_returns(spark, sf).select("ticker").distinct()
    return portfolio.candidate_grid(universe_, count, SEED, cap=MOST_WEIGHT, blend=DRAW_SHARE, floor=LEAST_WEIGHT)


def candidate_paths(spark, sf, freq="week"):
    """Returns of every candidate with the market and a second benchmark."""
    rets = frames.sector_returns(spark, sf, freq)
    own = rets.join(candidate_weights(spark, sf), "ticker").groupBy("candidate", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    market = frames.market_returns(spark, sf, freq).select("date", F.col("ret").alias("market_ret"))
    second = rets.where(F.col("ticker") == "PROMO").select("date", F.col("ret").alias("second_ret"))
    return own.join(market, "date").join(second, "date")


def candidate_spread(spark, sf):
    weights = candidate_weights(spark, sf)
    size = F.count(F.lit(1)).over(Window.partitionBy("candidate"))
    gap = F.col("weight") - F.lit(1.0) / F.col("size")
    return weights.withColumn("size", size).groupBy("candidate").agg(F.sum(gap * gap).alias("spread"))


def moment_scores(spark, sf, weights):
    """Diversification ratio and market correlation of candidates on monthly sector returns."""
    sigma, cov = sector_risk(spark, sf)
    market = frames.market_returns(spark, sf).select("date", F.col("ret").alias("market_ret"))
    to_market = frames.sector_returns(spark, sf).join(market, "date").groupBy("ticker").agg(
        (F.covar_samp("ret", "market_ret") * float(MONTHS)).alias("market_cov"), (F.stddev_samp("market_ret") * F.sqrt(F.lit(float(MONTHS)))).alias("market_sigma")
    )
    return scoring.candidate_moments(weights, sigma, cov, to_market)


def landed(frame, label):
    """Write a small table to the shared folder and read it back: a round does not plan the rounds before it again."""
    path = landing_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def best_held(spark, sf, grid):
    """objective, ticker, weight, value of the best candidate of each objective; ties to the smaller number."""
    keyed = grid.withColumn("candidate", F.struct("objective", "candidate"))
    value = F.when(F.col("objective") == OBJECTIVES[0], F.col("diversification_ratio")).otherwise(-F.col("market_correlation"))
    scored = moment_scores(spark, sf, keyed.select("candidate", "ticker", "weight")).select("candidate.*", "diversification_ratio", "market_correlation").withColumn("value", value)
    best = scored.groupBy("objective").agg(F.max_by(F.struct("candidate", "value"), F.struct("value", -F.col("candidate"))).alias("b")).select("objective", "b.*")
    return grid.join(best, ["objective", "candidate"]).select("objective", "ticker", "weight", "value")


@query
def pf_candidate_refined(spark, sf):
    """Weights of the best candidate of each objective after rounds of draws around the best so far."""
    first = candidate_weights(spark, sf).withColumn("objective", F.explode(F.array(*map(F.lit, OBJECTIVES))))
    start = held = landed(best_held(spark, sf, first), "candidates")
    for number, step in enumerate(REFINE_STEPS, 1):
        grid = portfolio.around(held, CANDIDATES, SEED + number, step, MOST_WEIGHT, LEAST_WEIGHT)
        held = landed(best_held(spark, sf, grid), "candidates")
    sign = F.when(F.col("objective") == OBJECTIVES[0], 1.0).otherwise(-1.0)
    before = start.select("objective", F.col("value").alias("start")).distinct()
    return rounded(held.join(before, "objective").select("objective", "ticker", "weight", (sign * F.col("value")).alias("value"), (sign * F.col("start")).alias("start_value")), 5)


@query
def pf_bounded_optimum(spark, sf):
    """Both moment objectives solved inside the bounds, for all months and six weekly windows, with residual and starts."""
    def with_market(rets, market):
        columns = [c for c in rets.columns if c in ("grp", "ticker", "date", "ret")]
        dates = rets.select(*[c for c in columns if c in ("grp", "date")]).distinct()
        return rets.select(*columns).unionByName(dates.join(market.select("date", "ret"), "date").withColumn("ticker", F.lit("MARKET")).select(*columns))

    months = with_market(frames.sector_returns(spark, sf), frames.market_returns(spark, sf)).withColumn("grp", F.lit("months"))
    weeks = with_market(window_tails(spark, sf), frames.market_returns(spark, sf, "week"))
    cov = risk.covariance(months.unionByName(weeks), WEEKS, ["grp"])
    return rounded(portfolio.bounded_optimum(cov, ["grp"], "MARKET", LEAST_WEIGHT, MOST_WEIGHT, STARTS, SEED).drop("agreeing"), 4)


@query
def pf_candidate_scoring(spark, sf):
    """Best candidate per objective: largest diversification ratio, lowest market correlation, highest utility."""
    moments = moment_scores(spark, sf, candidate_weights(spark, sf))
    metrics = scoring.path_metrics(candidate_paths(spark, sf), ["candidate"], WEEKS).join(candidate_spread(spark, sf), "candidate")
    scores = scoring.utility(metrics, {"Balanced": scoring.PROFILES["Balanced"]}, "spread").select("candidate", "utility")
    joined = moments.join(scores, "candidate")
    best = joined.agg(
        F.max_by(F.struct("candidate", F.col("diversification_ratio").alias("value")), F.struct("diversification_ratio", -F.col("candidate"))).alias("a"),
        F.min_by(F.struct("candidate", F.col("market_correlation").alias("value")), F.struct("market_correlation", "candidate")).alias("b"),
        F.max_by(F.struct("candidate", F.col("utility").alias("value")), F.struct("utility", -F.col("candidate"))).alias("c"),
    )
    rows = F.array(
        F.struct(F.lit("max_diversification").alias("objective"), F.col("a.candidate").alias("candidate"), F.col("a.value").alias("value")),
        F.struct(F.lit("min_market_correlation").alias("objective"), F.col("b.candidate").alias("candidate"), F.col("b.value").alias("value")),
        F.struct(F.lit("max_utility").alias("objective"), F.col("c.candidate").alias("candidate"), F.col("c.value").alias("value")),
    )
    return rounded(best.select(F.inline(rows)), 5)


@query
def pf_utility(spark, sf):
    """Utility of every candidate under the three risk profiles."""
    metrics = scoring.path_metrics(candidate_paths(spark, sf), ["candidate"], WEEKS).join(candidate_spread(spark, sf), "candidate")
    return rounded(scoring.utility(metrics, scoring.PROFILES, "spread").select("candidate", "profile", "utility"), 5)


@query
def pf_profile_select(spark, sf):
    """Per holding month: the profile whose monthly choices did best over 24 validation months, and its candidate.

    For every month each profile picks a candidate on the 36 months before it; the picks' returns in 24 months form
    a validation path. The candidate of a holding month is the pick made on its own 36 months before.
    """
    members = folds.monthly_members(candidate_paths(spark, sf), TRAIN_MONTHS)
    metrics = scoring.path_metrics(members, ["validation_month", "candidate"], WEEKS).where(F.col("observations") >= LEAST_WEEKS)
    train = scoring.utility(metrics.join(candidate_spread(spark, sf), "candidate"), scoring.PROFILES, "spread")
    picked = train.groupBy("validation_month", "profile").agg(
        F.max_by(F.struct("candidate", "utility"), F.struct("utility", -F.col("candidate"))).alias("p")
    ).select("validation_month", "profile", "p.candidate", F.col("p.utility").alias("training_utility"))
    monthly = candidate_paths(spark, sf, "month").withColumn("validation_month", F.trunc("date", "month").cast("date"))
    held = picked.join(monthly, ["validation_month", "candidate"])
    ahead = F.transform(F.sequence(F.lit(1), F.lit(VALIDATION_MONTHS)), lambda k: F.add_months("validation_month", k))
    listed = held.withColumn("holding_month", F.explode(ahead)).select("holding_month", "profile", "date", "ret", "market_ret", "second_ret")
    validated = scoring.path_metrics(listed, ["holding_month", "profile"], MONTHS).where(F.col("observations") == VALIDATION_MONTHS)
    scored = scoring.utility(validated.withColumnRenamed("profile", "_profile"), scoring.VALIDATION).select(
        "holding_month", F.col("_profile").alias("profile"), F.col("utility").alias("validation_utility"), "max_drawdown", "volatility"
    )
    joined = picked.withColumnRenamed("validation_month", "holding_month").join(scored, ["holding_month", "profile"])
    order = Window.partitionBy("holding_month").orderBy(
        F.round("validation_utility", 9).desc(), F.round("max_drawdown", 9).desc(), F.round("volatility", 9), "profile"
    )
    return rounded(joined.select(
        "holding_month", "profile", "candidate", "training_utility", "validation_utility", "max_drawdown", "volatility",
        (F.row_number().over(order) == 1).alias("selected"),
    ), 5)


@query
def pf_box_projection(spark, sf):
    """Volume-share and candidate targets projected on 5 % to 25 % weights."""
    targets = portfolio.candidate_grid(frames.sector_returns(spark, sf).select("ticker").distinct(), CANDIDATES, SEED)
    return rounded(portfolio.project_to_box(targets, ["candidate"], 0.05, 0.25), 5)


@query
def pf_round_units(spark, sf):
    """Projected candidates rounded to whole per cents."""
    targets = portfolio.candidate_grid(frames.sector_returns(spark, sf).select("ticker").distinct(), CANDIDATES, SEED)
    projected = portfolio.project_to_box(targets, ["candidate"], 0.05, 0.25).withColumn("weight", F.round("weight", 9))
    return rounded(portfolio.round_units(projected, ["candidate"], 0.01, 0.05, 0.25))


@query
def pf_nav_rebalanced(spark, sf):
    """Quarterly reset of the three weight sets on weekly prices."""
    prices = frames.aligned(spark, sf, "week").select("ticker", "date", "close")
    return rounded(nav.nav_rebalanced(prices, frames.weight_sets(spark, sf, "week"), "quarterly"), 5)


def monthly_targets(spark, sf):
    """Each month holds the three sectors most traded in the month before, by their volume."""
    volume = panel.closes(spark, sf, "type", "month").select("ticker", F.add_months(F.trunc("date", "month"), 1).alias("month"), "volume")
    part = Window.partitionBy("month").orderBy(F.col("volume").desc(), "ticker")
    top = volume.withColumn("rk", F.row_number().over(part)).where("rk <= 3")
    share = F.col("volume") / F.sum("volume").over(Window.partitionBy("month"))
    return top.select(F.lit("momentum").alias("portfolio"), "month", "ticker", share.alias("weight"))


def monthly_nav(spark, sf):
    prices = frames.aligned(spark, sf, "day").select("ticker", "date", "close")
    return nav.nav_monthly_costs(prices, monthly_targets(spark, sf), bps=10.0)


def log_levels(table):
    """NAV levels as log growth: synthetic prices compound to sizes no decimal rounding suits."""
    return table.withColumns({f"log_{c}": F.log(F.col(c) / 100.0) for c in ("gross_nav", "net_nav")}).drop("gross_nav", "net_nav")


@query
def pf_nav_monthly_costs(spark, sf):
    return rounded(log_levels(monthly_nav(spark, sf)["monthly"]), 5)


@query
def pf_nav_daily_path(spark, sf):
    return rounded(log_levels(monthly_nav(spark, sf)["daily"]), 5)


@query
def pf_weights_long(spark, sf):
    """Wide monthly weight rows (sleeve ticker, sleeve weight) to long form."""
    top = monthly_targets(spark, sf)
    slot = F.row_number().over(Window.partitionBy("month").orderBy(F.col("weight").desc(), "ticker"))
    wide = top.withColumn("slot", slot).groupBy("month").pivot("slot", [1, 2, 3]).agg(F.first("ticker").alias("ticker"), F.first("weight").alias("weight"))
    cells = F.array(*[F.struct(F.lit(k).alias("sleeve"), F.col(f"{k}_ticker").alias("ticker"), F.col(f"{k}_weight").alias("weight")) for k in (1, 2, 3)])
    return rounded(wide.select("month", F.inline(cells)).where(F.col("ticker").isNotNull()))


@query
def pf_stability_l1(spark, sf):
    """Distances between window portfolios, with the symmetry and zero-diagonal checks."""
    d = weight_distances(window_weights(spark, sf))
    flipped = d.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), F.col("l1_distance").alias("other"))
    ok = is_close(F.col("l1_distance"), F.col("other"), 1e-10, 1e-12) & ((F.col("w1") != F.col("w2")) | (F.col("l1_distance") == 0))
    return rounded(d.join(flipped, ["w1", "w2"]).select("w1", "w2", "l1_distance", ok.alias("valid")), 4)


@query
def pf_window_robustness(spark, sf):
    """Six estimation windows judged on one evaluation set: risk, ratio and performance in one job."""
    rets = frames.sector_returns(spark, sf, "week")
    weights = window_weights(spark, sf).select("grp", "ticker", "weight", F.lit("most_diversified").alias("portfolio"))
    sigma, cov = risk.volatility(window_tails(spark, sf), WEEKS, ["grp"]), window_covariance(spark, sf)
    ratio = portfolio.diversification_ratio(weights, sigma, cov, ["grp"]).select("grp", "diversification_ratio")
    path = rets.join(weights.select("grp", "ticker", "weight"), "ticker").groupBy("grp", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    table = performance.performance_table(path, frames.market_returns(spark, sf, "week"), WEEKS, ["grp"])
    return rounded(table.join(ratio, "grp"), 3)


HISTORY = 60
#: A variance or mean of falling months this small counts as none.
NO_SPREAD = 1e-8


def month_summaries(prices):
    """One row per instrument and month: what a window of whole months needs of its daily bars."""
    market = panel.benchmark(prices).select("date", F.col("close").alias("market"))
    second = prices.groupBy("sector", "date").agg((F.sum("cents") / F.lit(100.0) / F.sum("volume")).alias("second"))
    rows = prices.join(market, "date").join(second, ["sector", "date"]).withColumn("month", F.trunc("date", "month").cast("date"))
    walked = performance.drawdown(rows.withColumnRenamed("close", "value"), ["ticker", "month"])
    last = lambda c: F.max_by(c, "date")
    return walked.groupBy("ticker", "sector", "month").agg(
        F.max("value").alias("peak"), F.min("value").alias("low"), F.min("drawdown").alias("fall"), F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.min_by("value", "date").alias("first_close"), last("value").alias("close"), last("market").alias("market"), last("second").alias("second"),
    )


def window_metrics(spark, sf):
    """Metrics of each instrument over the 60 months before every month, with a status.

    Days fold into months first, and a month is listed once for each of the 60 months that look back on it: the
    range becomes an equality over tickers x months. The worst fall of a window is that inside a month or from the
    peak of the months before. Candidates younger than 60 months are NOT_RUN, those without a metric FAILED; both
    stay, with a reason and null metrics.
    """
    prices = panel.closes(spark, sf, "instrument", "day")
    span = prices.agg(F.max("date")).scalar()
    ahead = F.transform(F.sequence(F.lit(1), F.lit(HISTORY)), lambda k: F.add_months("month", k))
    held = month_summaries(prices).withColumn("_hi", span).withColumn("holding_month", F.explode(ahead)).where(F.col("holding_month") <= F.col("_hi"))
    keys = ["holding_month", "sector", "ticker"]
    order = Window.partitionBy(*keys).orderBy("month")
    peak = F.max("peak").over(order.rowsBetween(Window.unboundedPreceding, -1))
    step = lambda c: F.col(c) / F.lag(c).over(order) - 1
    months = held.select(
        "*", step("close").alias("ret"), step("market").alias("market_ret"), step("second").alias("second_ret"), F.least(F.col("fall"), F.try_divide(F.col("low"), peak) - 1).alias("drawdown")
    )
    falling = F.col("market_ret") < 0
    own, down = F.when(falling, F.col("ret")), F.when(falling, F.col("market_ret"))
    years = F.datediff(F.max("last_date"), F.min("first_date")) / F.lit(performance.DAYS_PER_YEAR)
    grown = F.try_divide(F.max_by("close", "month"), F.min_by("first_close", "month"))
    stats = months.groupBy(*keys).agg(
        F.when(years > 0, F.pow(grown, F.try_divide(F.lit(1.0), years)) - 1).alias("cagr"), F.min("drawdown").alias("maximum_drawdown"), F.sum("rows").alias("price_rows"),
        F.max("last_date").alias("last_price_used"), F.count("ret").alias("monthly_returns"), F.count(down).alias("falling_months"),
        corr_of(F.col("ret"), F.col("market_ret")).alias("correlation_market"), corr_of(F.col("ret"), F.col("second_ret")).alias("correlation_second"),
        F.when(F.var_samp(down) > NO_SPREAD, beta_of(own, down)).alias("downside_beta"), F.when(F.abs(F.avg(down)) > NO_SPREAD, F.try_divide(F.avg(own), F.avg(down))).alias("downside_capture"),
    )
    cutoffs = stats.select("ticker", "holding_month", F.date_sub("holding_month", 1).alias("date"))
    liquid = align.asof_backward(
        cutoffs, universe.trailing_liquidity(prices, 63), ["ticker"], ["mean_dollars"]
    ).select("ticker", "holding_month", F.col("mean_dollars").alias("dollar_volume"))
    listed = prices.groupBy("ticker").agg(F.min("date").alias("_first"))
    out = stats.join(liquid, ["ticker", "holding_month"]).join(listed, "ticker")
    age = (F.year("holding_month") - F.year("_first")) * 12 + F.month("holding_month") - F.month("_first")
    metrics = [metric for _, metric, _, _ in scoring.CRITERIA]
    unknown = F.lit(False)
    for metric in metrics:
        unknown = unknown | F.col(metric).isNull()
    reason = (
        F.when(F.col("history_age_months") < HISTORY, F.format_string(f"History age %d months; requires {HISTORY}", "history_age_months"))
        .when(F.col("price_rows") < 2, "fewer than two prices").when(F.col("monthly_returns") < 2, "fewer than two monthly returns")
        .when((F.col("falling_months") < 2) | F.col("downside_beta").isNull(), "too few falling market months").when(unknown, "metric without a value").otherwise("")
    )
    status = F.when(F.col("history_age_months") < HISTORY, "NOT_RUN").when(F.col("exclusion_reason") != "", "FAILED").otherwise("OK")
    out = out.withColumn("history_age_months", age.cast("bigint")).withColumn("exclusion_reason", reason).withColumn("calculation_status", status).drop("_first")
    return out.withColumns({m: F.when(F.col("calculation_status") == "OK", F.col(m)) for m in metrics})


def scorable(spark, sf):
    """Metrics of the candidates the scorecard can rank."""
    return panel.kept(spark, ("window_metrics", sf), lambda: window_metrics(spark, sf)).where("calculation_status = 'OK'")


@query
def pf_metrics_5y(spark, sf):
    return rounded(panel.kept(spark, ("window_metrics", sf), lambda: window_metrics(spark, sf)), 4)


@query
def pf_scorecard(spark, sf):
    """Totals and ranks of the seven-criterion scorecard per month and sector."""
    metrics = scorable(spark, sf)
    keys = ["holding_month", "sector"]
    return rounded(scoring.totals(scoring.scorecard(metrics, keys), metrics, keys))


@query
def pf_tieout(spark, sf):
    """Portfolio returns derived twice, from returns and from the value of units bought at the previous close, agree."""
    rets, weights = frames.sector_returns(spark, sf), frames.weight_sets(spark, sf)
    one = portfolio.portfolio_returns(rets, weights)
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    closes = frames.aligned(spark, sf).select("ticker", "date", "close", before.alias("before")).where("before IS NOT NULL")
    held = closes.join(weights, "ticker").select("portfolio", "date", "before", "close", (F.col("weight") / F.col("before")).alias("units"))
    value = lambda price: F.sum(F.col("units") * F.col(price))
    two = held.groupBy("portfolio", "date").agg((value("close") - value("before")).alias("again"))
    joined = one.join(two, ["portfolio", "date"])
    return joined.groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(is_close(F.col("ret"), F.col("again"), 1e-8, 1e-9)).alias("matching")
    )
