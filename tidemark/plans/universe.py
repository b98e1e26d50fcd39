"""Point-in-time universe queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import clean, universe
from tidemark.plans.cleaning import raw_ohlcv
from tidemark.plans.portfolios import scorable, window_metrics
from tidemark.plans.registry import new_registry
from tidemark.operators import scoring
from tidemark.sources import panel

QUERIES, query = new_registry()

# The panel covers 1995 to 2001, so the two name changes are placed inside it.
REAL_ESTATE_DATES = ("2000-08-31", "2000-09-01")
COMMUNICATION_DATES = ("2001-02-26", "2001-03-01")
LEGACY = ("Brand#1/MEDIUM", "Brand#2/MEDIUM")
SECTOR_OF_TYPE = {
    "SMALL": "Real Estate", "MEDIUM": "Communication Services", "LARGE": "Energy", "ECONOMY": "Utilities", "STANDARD": "Financials", "PROMO": "Information Technology",
}
NAMES = ("Real Estate", "Communication Services", "Telecommunication Services", "Energy", "Utilities", "Financials", "Information Technology", "Materials")
MIN_MONTHS, ADV_DAYS = 60, 20


def candidates(spark, sf):
    """Instruments as fund candidates with lifecycle facts and product flags."""
    n = F.regexp_extract("ticker", r"#(\d+)", 1).cast("int")
    sector = F.create_map(*[F.lit(x) for pair in SECTOR_OF_TYPE.items() for x in pair])[F.col("sector")]
    return panel.instruments(spark, sf).select(
        "ticker", sector.alias("current_sector"), "listing_date", F.when(n % 5 == 0, F.add_months("last_date", -6)).alias("delisting_date"),
        F.col("listing_date").alias("first_valid_price_date"), (n % 11 == 0).alias("lifecycle_conflict"), (n == 13).alias("leveraged"), (n == 17).alias("inverse"),
        F.lit(False).alias("single_stock"), F.lit(False).alias("etn"), F.lit(False).alias("thematic"), F.concat(F.lit("issuer "), F.col("issuer")).alias("source"),
    )


def eligible_table(spark, sf):
    def build():
        prices = panel.closes(spark, sf, "instrument", "day")
        return universe.monthly_eligible(
            candidates(spark, sf), universe.month_ends(prices), prices, MIN_MONTHS, ADV_DAYS,
            real_estate=REAL_ESTATE_DATES, communication=COMMUNICATION_DATES, legacy=LEGACY,
        )

    return panel.kept(spark, ("monthly_eligible", sf), build)


@query
def agg_adv_asof(spark, sf):
    """Trailing 20-row dollar volume of every instrument at every month end, with reason codes."""
    prices = panel.closes(spark, sf, "instrument", "day").where((F.col("volume") != 7) | (F.dayofmonth("date") < 25)).withColumn(
        "close", F.when(F.col("volume") != 13, F.col("close"))
    )
    grid = universe.month_grid(panel.instruments(spark, sf).select("ticker"), universe.month_ends(panel.closes(spark, sf, "instrument", "day")))
    return rounded(universe.adv_as_of(prices, grid.select("ticker", "selection_date"), ADV_DAYS), 4)


def shortlist_screen(spark, sf):
    prices = panel.closes(spark, sf, "instrument", "day")
    months = universe.month_ends(prices).select(F.last_day("selection_date").alias("cutoff"))
    return universe.liquidity_screen(prices, universe.month_grid(candidates(spark, sf).select("ticker", "current_sector", "listing_date", "delisting_date"), months), 63, 40, 20.0)


@query
def agg_liquidity_63(spark, sf):
    return rounded(shortlist_screen(spark, sf).select("ticker", "cutoff", "max_observation_used", "trailing_rows", "mean_shares", "mean_dollars", "passes", "failure_reason"), 4)


def shortlist(spark, sf):
    """Top three by share volume per sector and month among funds alive and liquid."""
    rows = shortlist_screen(spark, sf)
    alive = (F.col("listing_date") <= F.col("cutoff")) & (F.col("delisting_date").isNull() | (F.col("delisting_date") > F.col("cutoff")))
    passing = F.coalesce(alive, F.lit(False)) & F.col("passes")
    part = Window.partitionBy("cutoff", "current_sector").orderBy(passing.desc(), F.round("mean_shares", 9).desc(), "ticker")
    ranked = rows.withColumn("passing", passing).withColumn("rk", F.row_number().over(part))
    chosen = F.col("passing") & (F.col("rk") <= 3)
    return ranked.groupBy("cutoff", "current_sector").agg(
        F.array_sort(F.collect_list(F.when(chosen, F.struct("rk", "ticker")))).alias("t"), F.count_if(chosen).alias("selected_count"), F.count_if("passing").alias("eligible_count")
    ).select(
        F.date_add("cutoff", 1).alias("holding_month"), "cutoff", F.col("current_sector").alias("sleeve"), F.array_join(F.transform("t", lambda x: x["ticker"]), ", ").alias("selected_symbols"),
        "selected_count", "eligible_count", F.when(F.col("selected_count") >= 2, "READY").otherwise("ERROR_NEEDS_2_OR_3_ETFS").alias("sleeve_status"),
    )


@query
def uni_monthly_shortlist(spark, sf):
    return shortlist(spark, sf)


@query
def agg_readiness(spark, sf):
    ready = shortlist(spark, sf).groupBy("holding_month").agg(
        F.count_if(F.col("sleeve_status") == "READY").alias("ready_sleeves"), F.count_distinct("sleeve").alias("total_sleeves")
    )
    wanted = candidates(spark, sf).agg(F.count_distinct("current_sector")).scalar()
    return ready.withColumn("_n", wanted).withColumn("all_ready", (F.col("ready_sleeves") == F.col("_n")) & (F.col("total_sleeves") == F.col("_n"))).drop("_n")


@query
def uni_candidate_5y(spark, sf):
    """Shortlisted tickers unpacked again, with their age, status and exclusion reason."""
    listed = shortlist(spark, sf).select("holding_month", "sleeve", F.posexplode(F.split("selected_symbols", ", ")).alias("pos", "ticker")).where("ticker != ''")
    first = panel.instruments(spark, sf).select("ticker", F.col("listing_date").alias("first_trade_date"))
    months = (F.year("holding_month") - F.year("first_trade_date")) * 12 + F.month("holding_month") - F.month("first_trade_date")
    out = listed.join(first, "ticker", "left").withColumn("history_age_months", months.cast("bigint"))
    ok = F.coalesce(F.col("history_age_months") >= 60, F.lit(False))
    return out.select(
        "holding_month", "sleeve", (F.col("pos") + 1).cast("bigint").alias("liquidity_rank"), "ticker", "history_age_months", ok.alias("eligible_5y"),
        F.when(ok, "").otherwise(F.format_string("History age %d months; requires 60", "history_age_months")).alias("exclusion_reason"),
    )


@query
def uni_monthly_eligible(spark, sf):
    out = eligible_table(spark, sf).select(
        "selection_date", "effective_trade_date", "ticker", "historical_sector_name", "available_history_months", "history_valid", "classification_valid", "lifecycle_valid",
        "price_data_valid", "eligible", "ineligibility_reason", "adv20", "adv_window_start", "adv_window_end", "adv_valid_observations",
    )
    return rounded(out, 4)


@query
def uni_representatives(spark, sf):
    out = universe.representatives(eligible_table(spark, sf)).select(
        "selection_date", "effective_trade_date", F.col("historical_sector_name").alias("sector"), "ticker", "adv20", "candidate_count", "candidate_tickers", "tie_break_used",
        "representative_changed", "switch_reason",
    )
    return rounded(out, 4)


@query
def win_switch_reason(spark, sf):
    """How often a representative changed, by sector and reason."""
    return universe.representatives(eligible_table(spark, sf)).groupBy(F.col("historical_sector_name").alias("sector"), "switch_reason").agg(
        F.count(F.lit(1)).alias("months"), F.count_if("representative_changed").alias("changes")
    )


@query
def agg_monthly_coverage(spark, sf):
    return rounded(universe.monthly_coverage(eligible_table(spark, sf), NAMES).select(
        "selection_date", "sector", "eligible_count", "eligible_tickers", "coverage_available", "missing_reason", "eligible_total", "available_sectors"
    ))


def clean_list(spark, sf):
    """Candidates without conflict or prohibited flag, joined to their price audit."""
    return candidates(spark, sf).where(~F.col("lifecycle_conflict") & ~F.col("leveraged") & ~F.col("inverse"))


@query
def agg_sector_coverage(spark, sf):
    """Candidates per sector of the full list, empty sectors included."""
    names = spark.createDataFrame([(s,) for s in universe.CURRENT_SECTORS], "sector string")
    found = clean_list(spark, sf).groupBy(F.col("current_sector").alias("sector")).agg(
        F.count(F.lit(1)).alias("candidates"), F.array_join(F.array_sort(F.collect_list("ticker")), "|").alias("tickers"), F.min("first_valid_price_date").alias("earliest")
    )
    out = names.join(found, "sector", "left")
    return out.select(
        "sector", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("tickers", F.lit("")).alias("tickers"),
        F.coalesce(F.col("earliest").cast("string"), F.lit("unknown")).alias("earliest_available_date"), F.when(F.col("candidates") > 0, "covered").otherwise("missing").alias("status"),
    )


@query
def uni_clean_candidates(spark, sf):
    """Active candidates with evidence and a price audit; what fails is named, not dropped."""
    report = clean.anomaly_report(raw_ohlcv(spark, sf)).select("ticker", "anomaly_types")
    rows = candidates(spark, sf).join(report, "ticker", "left").where(F.col("delisting_date").isNull())
    start = F.when(F.col("current_sector") == "Real Estate", F.greatest("listing_date", F.lit(REAL_ESTATE_DATES[0]).cast("date"))).when(
        F.col("current_sector") == "Communication Services", F.greatest("listing_date", F.lit(COMMUNICATION_DATES[0]).cast("date"))
    ).otherwise(F.col("listing_date"))
    problem = F.when(F.col("lifecycle_conflict"), "lifecycle_conflict").when(F.col("leveraged") | F.col("inverse"), "prohibited_product").otherwise("")
    return rows.select("ticker", F.col("current_sector").alias("sector"), "listing_date", start.alias("classification_start"), "anomaly_types", problem.alias("problem"))


@query
def uni_update_metadata(spark, sf):
    """Instrument metadata with candidate values laid over it; every lifecycle stays."""
    rows = panel.instruments(spark, sf).select("ticker", "sector", "listing_date")
    over = clean_list(spark, sf).where(F.col("delisting_date").isNull()).select("ticker", F.col("current_sector").alias("new_sector"), "source")
    merged = rows.join(over, "ticker", "left")
    hit = F.col("new_sector").isNotNull()
    return merged.select(
        "ticker", "listing_date", F.coalesce("new_sector", F.lit("unknown")).alias("sector_or_industry"), F.when(hit, "sector").otherwise("unknown").alias("classification_level"),
        F.when(hit, "clean_sector_candidate").otherwise("needs_review").alias("review_status"), F.coalesce("source", F.lit("unknown")).alias("source"),
        F.when(hit, "high").otherwise("low").alias("classification_confidence"),
    )


@query
def uni_priority_review(spark, sf):
    """Candidates outside the clean list, oldest and most traded first within a sector."""
    liquid = universe.trailing_liquidity(panel.closes(spark, sf, "instrument", "day"), 20)
    latest = liquid.groupBy("ticker").agg(F.max_by(F.when(F.col("window_rows") == 20, F.col("mean_dollars")), "date").alias("latest_adv20"))
    rows = candidates(spark, sf).where(F.col("lifecycle_conflict") | F.col("leveraged") | F.col("inverse") | F.col("delisting_date").isNotNull())
    joined = rows.join(latest, "ticker")
    order = Window.partitionBy("current_sector").orderBy("listing_date", F.round("latest_adv20", 6).desc(), "ticker")
    return rounded(joined.select(
        F.col("current_sector").alias("target_sector"), F.row_number().over(order).alias("priority_rank"), "ticker", "listing_date",
        F.last_day(F.add_months("first_valid_price_date", 60)).alias("first_eligible_month_end"), "latest_adv20",
    ), 4)


@query
def uni_clean_detail(spark, sf):
    """Clean candidates with price facts: valid span, months of history, latest liquidity."""
    prices = panel.closes(spark, sf, "instrument", "day")
    liquid = universe.trailing_liquidity(prices, 20)
    facts = liquid.groupBy("ticker").agg(
        F.min("date").alias("first_valid"), F.max("date").alias("latest"), F.max_by(F.when(F.col("window_rows") == 20, F.col("mean_dollars")), "date").alias("latest_adv20")
    )
    months = F.datediff("latest", "first_valid") / F.lit(30.436875)
    return rounded(clean_list(spark, sf).join(facts, "ticker", "left").select(
        "ticker", F.col("current_sector").alias("likely_sector"), "first_valid", "latest", months.alias("valid_history_months"), "latest_adv20", "source"
    ), 4)


@query
def uni_winner_matrix(spark, sf):
    """Winners of the scorecard per holding month, one column per sector of the data; no winner, no value."""
    metrics = scorable(spark, sf)
    keys = ["holding_month", "sector"]
    won = scoring.totals(scoring.scorecard(metrics, keys), metrics, keys).where("selection_rank = 1")
    months = panel.kept(spark, ("window_metrics", sf), lambda: window_metrics(spark, sf)).select("holding_month", "sector").distinct()
    cells = months.join(won.select(*keys, "ticker"), keys, "left")
    return cells.groupBy("holding_month").pivot("sector").agg(F.first("ticker"))


@query
def agg_run_summary(spark, sf):
    """Counts of the eligible table by status."""
    rows = eligible_table(spark, sf)
    return rows.groupBy(F.when(F.col("eligible"), "eligible").otherwise(F.substring_index("ineligibility_reason", "|", 1)).alias("status")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers"), F.count_distinct("selection_date").alias("months")
    )
