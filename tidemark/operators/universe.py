"""Point-in-time universe: liquidity as of a date, eligibility, representatives, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import by_date, reasons_text, trailing
from tidemark.operators.align import asof_backward


def average_dollar_volume(prices: DataFrame, start: Column, end: Column, min_rows: int) -> DataFrame:
    """Mean close x volume over the window with the text of the observed period."""
    valid = prices.where(F.col("date").between(start, end) & (F.col("close") > 0) & (F.col("volume") >= 0))
    out = valid.groupBy("ticker", "sector").agg(
        F.avg(F.col("close") * F.col("volume")).alias("adv"), F.count(F.lit(1)).alias("days"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )
    text = F.format_string("%s to %s (%d trading days)", F.col("first").cast("string"), F.col("last").cast("string"), F.col("days"))
    status = F.when(F.col("days") < min_rows, "too_few_days").when(F.col("adv") > 0, "ok").otherwise("not_positive")
    return out.select("ticker", "sector", "adv", "days", text.alias("observation_period"), status.alias("status"))


def month_ends(calendar: DataFrame) -> DataFrame:
    """Last observed day of each completed month and the first trading day after it."""
    months = calendar.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("selection_date"), F.min("date").alias("first"))
    # One row per month; the newest month has no successor and is not complete.
    following = F.lead("first").over(Window.orderBy("month"))
    return months.select("selection_date", following.alias("effective_trade_date")).where(F.col("effective_trade_date").isNotNull())


def month_grid(candidates: DataFrame, months: DataFrame) -> DataFrame:
    """Every month for every candidate: the month list is one array, exploded per candidate."""
    listed = months.agg(F.array_sort(F.collect_list(F.struct(*months.columns)))).scalar()
    return candidates.withColumn("_m", F.explode(listed)).select(*candidates.columns, "_m.*")


def trailing_liquidity(prices: DataFrame, window: int) -> DataFrame:
    """Per row: size, validity, mean dollar and share volume of its trailing window."""
    frame = trailing(window, "ticker")
    ok = (F.col("close") > 0) & (F.col("volume") >= 0)
    return prices.select(
        "ticker", "date", F.col("date").alias("window_end"), F.count(F.lit(1)).over(frame).alias("window_rows"),
        F.count_if(F.coalesce(ok, F.lit(False))).over(frame).alias("valid_rows"), F.min("date").over(frame).alias("window_start"),
        F.avg(F.col("close") * F.col("volume")).over(frame).alias("mean_dollars"), F.avg("volume").over(frame).alias("mean_shares"),
    )


def adv_as_of(prices: DataFrame, grid: DataFrame, window: int = 20) -> DataFrame:
    """Trailing mean dollar volume at each (ticker, selection_date), with ordered reasons.

    The window is computed once per price row; a month then looks up the last row at
    or before its date. Repeated dates fold to one row first and are remembered.
    """
    daily = prices.groupBy("ticker", "date").agg(
        F.max_by("close", "close").alias("close"), F.max_by("volume", "close").alias("volume"), F.count(F.lit(1)).alias("copies")
    )
    repeated = F.max("copies").over(by_date("ticker").rowsBetween(Window.unboundedPreceding, 0)) > 1
    facts = trailing_liquidity(daily, window).join(
        daily.select("ticker", "date", repeated.alias("has_duplicates")), ["ticker", "date"]
    )
    events = grid.withColumn("date", F.col("selection_date"))
    columns = ["window_end", "window_rows", "valid_rows", "window_start", "mean_dollars", "has_duplicates"]
    found = asof_backward(events, facts, ["ticker"], columns)
    priced = daily.select("ticker").distinct().withColumn("has_prices", F.lit(True))
    found = found.join(priced, "ticker", "left")
    rows = F.coalesce("window_rows", F.lit(0))
    reason = (
        F.when(F.col("has_prices").isNull(), "no_cached_prices")
        .when(F.col("has_duplicates"), "duplicate_price_dates")
        .when(rows < window, f"fewer_than_{window}_observations")
        .when(F.col("window_end") != F.col("selection_date"), "no_valid_price_on_selection_date")
        .when(F.col("valid_rows") < window, "invalid_close_or_volume_in_adv_window")
        .otherwise("")
    )
    out = found.withColumn("adv_reason", reason)
    usable = F.col("adv_reason") == ""
    dated = usable | F.col("adv_reason").isin("no_valid_price_on_selection_date", "invalid_close_or_volume_in_adv_window")
    observations = F.when(F.col("adv_reason").isin("no_cached_prices", "duplicate_price_dates"), F.lit(0)).when(
        F.col("adv_reason") == "invalid_close_or_volume_in_adv_window", F.col("valid_rows")
    ).otherwise(rows)
    return out.select(
        *grid.columns, F.when(usable, F.col("mean_dollars")).alias("adv20"), F.when(dated, F.col("window_start")).alias("adv_window_start"),
        F.when(dated, F.col("window_end")).alias("adv_window_end"), observations.alias("adv_valid_observations"),
        usable.alias("price_data_valid"), "adv_reason",
    )


def liquidity_screen(prices: DataFrame, grid: DataFrame, window: int, min_rows: int, min_shares: float) -> DataFrame:
    """Trailing share and dollar volume at a month-end cutoff, with the reasons of a failure."""
    events = grid.withColumn("date", F.col("cutoff"))
    columns = ["window_end", "window_rows", "mean_shares", "mean_dollars"]
    found = asof_backward(events, trailing_liquidity(prices, window), ["ticker"], columns)
    rows = F.coalesce("window_rows", F.lit(0))
    current = F.coalesce(F.trunc("window_end", "month") == F.trunc("cutoff", "month"), F.lit(False))
    enough, liquid = rows >= min_rows, F.coalesce(F.col("mean_shares") >= min_shares, F.lit(False))
    reasons = F.concat_ws(
        " | ", F.when(~current, "NO_DATA_IN_FORMATION_MONTH"), F.when(~enough, "INSUFFICIENT_TRAILING_OBSERVATIONS"),
        F.when(~liquid, "LIQUIDITY_THRESHOLD_FAILED"),
    )
    return found.select(
        *grid.columns, F.col("window_end").alias("max_observation_used"), rows.alias("trailing_rows"), "mean_shares", "mean_dollars",
        (current & enough & liquid).alias("passes"), reasons.alias("failure_reason"),
    )


def pick_highest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest adv20, then observations, history, ticker; says whether the first place was tied."""
    part = Window.partitionBy(*keys)
    order = part.orderBy(
        F.col("adv20").desc(), F.col("adv_valid_observations").desc(), F.col("available_history_months").desc(), "ticker"
    )
    top = F.max("adv20").over(part)
    ranked = rows.withColumns(
        {"_rk": F.row_number().over(order), "_tied": F.sum((F.col("adv20") == top).cast("int")).over(part) > 1}
    )
    # Fixed value: text of the output.
    reason = "ADV20 tied exactly; selected by valid ADV observations, then longer listing history, then ticker alphabetical order"
    return ranked.where(F.col("_rk") == 1).withColumns(
        {"tie_break_used": F.col("_tied"), "tie_break_reason": F.when(F.col("_tied"), reason).otherwise("")}
    ).drop("_rk", "_tied")


# Dates from which a sector name applies, and the funds that carried the older name.
REAL_ESTATE = {"name": "Real Estate", "classified": "2016-08-31", "trades": "2016-09-01"}
COMMUNICATION = {
    "name": "Communication Services", "older": "Telecommunication Services", "classified": "2018-09-28", "trades": "2018-10-01",
}
LEGACY_TELECOM = ("VOX", "FCOM")
CURRENT_SECTORS = (
    "Energy", "Materials", "Industrials", "Consumer Discretionary", "Consumer Staples", "Health Care", "Financials",
    "Information Technology", "Communication Services", "Utilities", "Real Estate",
)


def sector_timeline(spark, real_estate: str = REAL_ESTATE["trades"], communication: str = COMMUNICATION["trades"]) -> DataFrame:
    """Effective-dated dimension: current sector, its name in a period and the trade dates it covers."""
    rows = []
    for sector in CURRENT_SECTORS:
        if sector == REAL_ESTATE["name"]:
            rows.append((sector, sector, real_estate, "9999-12-31", "all"))
        elif sector == COMMUNICATION["name"]:
            rows.append((sector, COMMUNICATION["older"], "0001-01-01", communication, "legacy"))
            rows.append((sector, sector, communication, "9999-12-31", "all"))
        else:
            rows.append((sector, sector, "0001-01-01", "9999-12-31", "all"))
    frame = spark.createDataFrame(rows, "current_sector string, period_name string, from_text string, until_text string, applies_to string")
    return frame.select("current_sector", "period_name", F.to_date("from_text").alias("valid_from"), F.to_date("until_text").alias("valid_until"), "applies_to")


def classify_sector(
    grid: DataFrame, real_estate: tuple[str, str] = (REAL_ESTATE["classified"], REAL_ESTATE["trades"]),
    communication: tuple[str, str] = (COMMUNICATION["classified"], COMMUNICATION["trades"]), legacy: Sequence[str] = LEGACY_TELECOM,
) -> DataFrame:
    """Sector name valid at the effective trade date; current labels are never cast back.

    Expects ticker, current_sector, listing_date, selection_date, effective_trade_date.
    """
    day = lambda text: F.lit(text).cast("date")
    listed = F.coalesce(F.col("selection_date") >= F.col("listing_date"), F.lit(False))
    estate, telecom = F.col("current_sector") == REAL_ESTATE["name"], F.col("current_sector") == COMMUNICATION["name"]
    estate_on = F.col("effective_trade_date") >= day(real_estate[1])
    telecom_on = F.col("effective_trade_date") >= day(communication[1])
    old_fund = F.col("ticker").isin(*legacy)
    name = F.when(listed & telecom & ~telecom_on, COMMUNICATION["older"]).otherwise(F.col("current_sector"))
    valid = F.when(~listed, False).when(estate, estate_on).when(telecom, telecom_on | old_fund).otherwise(True)
    level = F.when(listed & estate & ~estate_on, "industry_group").when(
        listed & telecom & ~telecom_on & ~old_fund, "unclassified"
    ).otherwise("sector")
    since = F.when(valid, F.when(estate, day(real_estate[0])).when(telecom & telecom_on, day(communication[0])).otherwise(F.col("listing_date")))
    return grid.withColumns(
        {
            "historical_sector_name": name, "classification_valid": valid, "classification_level_at_date": level,
            "classification_effective_date": since,
        }
    )


PROHIBITED = ("leveraged", "inverse", "single_stock", "etn", "thematic")


def monthly_eligible(candidates: DataFrame, months: DataFrame, prices: DataFrame, min_months: int, adv_days: int, **sector_dates) -> DataFrame:
    """Every candidate in every month: lifecycle, history, classification, price and product rules."""
    grid = classify_sector(month_grid(candidates, months), **sector_dates)
    dated = adv_as_of(prices, grid, adv_days)
    listed = F.coalesce(F.col("selection_date") >= F.col("listing_date"), F.lit(False))
    gone = F.coalesce(F.col("selection_date") >= F.col("delisting_date"), F.lit(False))
    history = F.coalesce(F.add_months("first_valid_price_date", min_months) <= F.col("selection_date"), F.lit(False))
    conflict = F.col("lifecycle_conflict")
    banned = F.lit(False)
    for flag in PROHIBITED:
        banned = banned | F.col(flag)
    reason = reasons_text(
        (~listed, "not_yet_listed"), (listed & gone, "already_delisted"), (~history, f"less_than_{min_months}_months_valid_history"),
        (~F.col("classification_valid"), "classification_not_valid_at_effective_trade_date"),
        (~F.col("price_data_valid"), F.col("adv_reason")), (conflict, "unresolved_lifecycle_conflict"), (banned, "prohibited_product_flag"),
    )
    months_known = F.when(
        F.col("first_valid_price_date") <= F.col("selection_date"),
        F.datediff("selection_date", "first_valid_price_date") / F.lit(30.436875),
    ).otherwise(F.lit(0.0))
    return dated.withColumns(
        {
            "available_history_months": F.round(months_known, 2), "history_valid": history,
            "lifecycle_valid": listed & ~gone & ~conflict, "ineligibility_reason": reason,
        }
    ).withColumn(
        "eligible",
        F.col("lifecycle_valid") & F.col("history_valid") & F.col("classification_valid") & F.col("price_data_valid") & ~banned,
    )


def representatives(monthly: DataFrame) -> DataFrame:
    """Highest-ADV eligible ticker per sector name and month, with the reason of a switch.

    The one before is the last selected, whatever empty months lie between.
    """
    eligible = monthly.where("eligible")
    keys = ["selection_date", "historical_sector_name"]
    pool = eligible.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_count"), F.array_sort(F.collect_list("ticker")).alias("pool")
    )
    top = pick_highest(eligible, keys).join(pool, keys)
    current = F.when(F.col("historical_sector_name") == COMMUNICATION["older"], COMMUNICATION["name"]).otherwise(F.col("historical_sector_name"))
    order = Window.partitionBy("_current").orderBy("selection_date").rowsBetween(Window.unboundedPreceding, -1)
    chained = top.withColumn("_current", current).withColumn("_previous", F.last("ticker", ignorenulls=True).over(order))
    switch = (
        F.when(F.col("_previous").isNull(), "initial_selection")
        .when(F.col("_previous") == F.col("ticker"), "unchanged_highest_ADV20")
        .when(F.array_contains("pool", F.col("_previous")), "higher_ADV20_than_previous_representative")
        .otherwise("previous_representative_ineligible")
    )
    return chained.withColumns(
        {
            "switch_reason": switch, "representative_changed": F.coalesce(F.col("_previous") != F.col("ticker"), F.lit(False)),
            "candidate_tickers": F.array_join("pool", "|"),
        }
    ).drop("_previous", "_current", "pool")


def monthly_coverage(monthly: DataFrame, sectors: Sequence[str]) -> DataFrame:
    """Month x sector grid with eligible counts, tickers, and sectors available in the month."""
    names = F.explode(F.array(*[F.lit(s) for s in sectors]))
    grid = monthly.select("selection_date", "effective_trade_date").distinct().select("*", names.alias("sector"))
    counts = monthly.where("eligible").groupBy("selection_date", F.col("historical_sector_name").alias("sector")).agg(
        F.count(F.lit(1)).alias("eligible_count"), F.array_join(F.array_sort(F.collect_list("ticker")), "|").alias("eligible_tickers")
    )
    out = grid.join(counts, ["selection_date", "sector"], "left").withColumns(
        {"eligible_count": F.coalesce("eligible_count", F.lit(0)), "eligible_tickers": F.coalesce("eligible_tickers", F.lit(""))}
    )
    month = Window.partitionBy("selection_date")
    covered = F.col("eligible_count") > 0
    return out.withColumns(
        {
            "coverage_available": covered,
            # Fixed value: text of the output.
            "missing_reason": F.when(covered, "").otherwise("no ETF satisfied all point-in-time eligibility rules"),
            "eligible_total": F.sum("eligible_count").over(month), "available_sectors": F.sum(covered.cast("int")).over(month),
        }
    )
