"""Queries of scalar and classification functions and of instrument metadata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.columns import add_weekdays, finite, is_close, non_negative, positive, rounded, weekdays_between
from tidemark.operators import align, clean, metadata, risk, universe
from tidemark.plans import frames
from tidemark.plans.cleaning import raw_ohlcv
from tidemark.plans.registry import new_registry
from tidemark.sources import panel

QUERIES, query = new_registry()

# Name endings that raise the classification rules on the synthetic instruments.
ENDINGS = (
    "Gold Trust", "US Equity ETF", "Treasury Bond Fund", "Global Index ETF", "2X Daily Bull ETF", "Bitcoin Strategy", "Covered Call Income ETF",
    "S&P 500 ETF", "Innovation Stock ETF", "Short Daily ETF", "Energy Fund", "Utilities Shares", "Insurance ETF",
)


def number():
    return F.regexp_extract("ticker", r"#(\d+)", 1).cast("int")


def named(spark, sf):
    """Instruments with a fund name built from sector, brand and an ending."""
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("n") % len(ENDINGS)) + 1)
    known = panel.instruments(spark, sf).withColumn("n", number())
    return known.withColumn("fund_name", F.concat_ws(" ", F.initcap("sector"), F.col("n").cast("string"), ending))


def listing_rows(spark, sf):
    """Active rows for every instrument and older, delisted entities for some."""
    base = named(spark, sf)
    active = base.select(
        "ticker", "fund_name", F.col("listing_date").cast("string").alias("ipo_date"), F.lit("unknown").alias("delisting_date"),
        F.when(F.col("n") % 9 == 0, "Active_Needs_Review").otherwise("Active").alias("status"), F.lit("active_listing").alias("source"),
    )
    ends = F.when(F.col("n") % 10 == 0, F.date_add("listing_date", 30)).otherwise(F.date_sub("listing_date", 30))
    old = base.where(F.col("n") % 5 == 0).select(
        "ticker", F.concat(F.lit("Former "), F.col("fund_name")).alias("fund_name"), F.add_months("listing_date", -120).cast("string").alias("ipo_date"),
        ends.cast("string").alias("delisting_date"), F.lit("Delisted").alias("status"), F.lit("delisted_listing").alias("source"),
    )
    return active.unionByName(old)


def lifecycle(spark, sf):
    return panel.kept(spark, ("lifecycle", sf), lambda: metadata.lifecycles(listing_rows(spark, sf)))


def current_snapshot(spark, sf):
    renamed = F.when(F.col("n") % 3 == 0, F.concat(F.lit("Entirely Different "), F.col("sector"))).otherwise(F.concat(F.col("fund_name"), F.lit(" Shares")))
    return named(spark, sf).where(F.col("n") % 7 != 0).select("ticker", renamed.alias("fund_name"))


def price_audit(spark, sf):
    early = F.when(F.col("n") % 4 == 0, F.date_sub("listing_date", 60)).otherwise(F.col("listing_date"))
    return named(spark, sf).select("ticker", early.cast("string").alias("first_price_date"), (F.col("n") % 8 != 0).alias("price_clean"))


def other_entities(spark, sf):
    rows = named(spark, sf).where(F.col("n") % 6 == 0)
    alive = F.col("n") % 12 == 0
    return rows.select(
        "ticker", F.concat(F.lit("Company "), F.col("ticker")).alias("name"), F.when(alive, "active").otherwise("delisted").alias("snapshot"),
        F.when(alive, "Active").otherwise("Delisted").alias("status"), F.when(~alive, F.date_sub("listing_date", 400).cast("string")).otherwise("unknown").alias("delisting_date"),
    )


def official_evidence(spark, sf):
    flag = lambda on: F.when(on, "true").otherwise("false")
    n = F.col("n")
    return named(spark, sf).where(n % 2 == 1).select(
        "ticker", F.lit("ETF").alias("instrument_type"), F.lit("equity").alias("asset_class"), F.lit("United States").alias("geographic_scope"),
        flag(n == 13).alias("leveraged_flag"), flag(n == 17).alias("inverse_flag"), F.lit("false").alias("single_stock_flag"), F.lit("false").alias("etn_flag"),
        F.when(n == 19, "maybe").otherwise("false").alias("option_overlay_flag"), F.lit("false").alias("thematic_flag"),
    )


def conflicts(spark, sf):
    def build():
        return metadata.vendor_conflicts(lifecycle(spark, sf), current_snapshot(spark, sf), price_audit(spark, sf), other_entities(spark, sf))

    return panel.kept(spark, ("vendor_conflicts", sf), build)


@query
def fn_clean_text(spark, sf):
    """Text and date cleaning on order priorities and dates with null tokens mixed in."""
    orders = panel.table(spark, sf, "orders")
    raw = F.when(F.col("o_orderstatus") == "P", F.lit(" NaN ")).otherwise(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")))
    day = F.when(F.col("o_orderstatus") == "F", F.lit("none")).otherwise(F.to_date("o_orderdate").cast("string"))
    return orders.groupBy(text.clean_text(raw).alias("priority"), F.substring(text.clean_date(day), 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("orders"))


@query
def fn_norm_name(spark, sf):
    parts = panel.table(spark, sf, "part")
    raw = F.concat(F.lit("The "), "p_name", F.lit(" & "), "p_brand", F.lit(" ETF-Trust"))
    return parts.groupBy(text.normalized_name(raw).alias("name")).agg(F.count(F.lit(1)).alias("parts"), F.max("p_size").cast("bigint").alias("max_size"))


@query
def fn_lifecycle_id(spark, sf):
    return lifecycle(spark, sf).select("lifecycle_id", "ticker", "entity_key", "status")


@query
def fn_rule_labels(spark, sf):
    name = F.col("fund_name")
    rows = named(spark, sf).select("ticker", "fund_name", text.exclusion_labels(name).alias("labels"))
    return rows.select(
        "ticker", "fund_name", F.array_join("labels", "|").alias("labels"), text.asset_class(F.col("labels"), name).alias("asset_class"),
        text.geography(F.col("labels"), name).alias("geographic_scope"), text.is_thematic(name).alias("thematic"),
    )


@query
def fn_sleeve_rule(spark, sf):
    """First sleeve, exclusions and lifecycle window decide whether an instrument is in the pool."""
    name = F.col("fund_name")
    rows = named(spark, sf).select(
        "ticker", "fund_name", text.sleeve(name).alias("sleeve"), name.rlike(f"(?i){text.COMMON_EXCLUSION}").alias("common_exclusion"),
        name.rlike(f"(?i){text.FOREIGN_EXCLUSION}").alias("foreign_exclusion"), (F.col("listing_date") <= F.lit("1995-02-01").cast("date")).alias("in_window"),
    )
    return rows.withColumn("included", (F.col("sleeve") != "") & ~F.col("common_exclusion") & ~F.col("foreign_exclusion") & F.col("in_window"))


@query
def fn_tristate(spark, sf):
    lines = panel.table(spark, sf, "lineitem")
    raw = F.when(F.col("l_linestatus") == "F", " TRUE ").when(F.col("l_returnflag") == "R", "no").when(F.col("l_returnflag") == "A", "False").otherwise("maybe")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count_if(text.tristate(raw)).alias("true_rows"), F.count_if(~text.tristate(raw)).alias("false_rows"), F.count_if(text.tristate(raw).isNull()).alias("unknown_rows"),
        F.count_if(text.truth(raw, True)).alias("truthy_rows"),
    )


@query
def fn_history_months(spark, sf):
    known = panel.instruments(spark, sf)
    exact = F.datediff("last_date", "listing_date") / F.lit(30.436875)
    calendar = (F.year("last_date") - F.year("listing_date")) * 12 + F.month("last_date") - F.month("listing_date")
    return rounded(known.select(
        "ticker", exact.alias("history_months"), calendar.cast("bigint").alias("month_distance"), (F.add_months("listing_date", 60) <= F.col("last_date")).alias("has_60_months")
    ), 4)


@query
def fn_business_days(spark, sf):
    """Weekdays between order and shipping, and the third weekday after each order, by month."""
    orders = panel.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered"))
    lines = panel.table(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("shipped"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).where(F.col("shipped") >= F.col("ordered"))
    return joined.groupBy(F.last_day("ordered").alias("month")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(weekdays_between(F.col("ordered"), F.col("shipped"))).alias("weekdays"),
        F.max(add_weekdays(F.col("ordered"), 3)).alias("latest_third_weekday"), F.min(add_weekdays(F.col("ordered"), -1)).alias("earliest_previous_weekday"),
    )


@query
def fn_month_end_dates(spark, sf):
    """Last observed day of each completed month per instrument."""
    days = panel.closes(spark, sf, "instrument", "day")
    newest = days.agg(F.trunc(F.max("date"), "month")).scalar()
    return days.groupBy("ticker", F.trunc("date", "month").alias("m")).agg(F.max("date").alias("month_end")).where(F.col("m") < newest).select("ticker", "month_end")


@query
def fn_resample(spark, sf):
    """Month-end and Friday-week bins of the last close that is present; empty bins stay empty."""
    days = panel.closes(spark, sf, "instrument", "day").withColumn("close", F.when(F.col("volume") > 3, F.col("close")))
    week = days.groupBy("ticker", panel.bin_of(F.col("date"), "week").alias("bin")).agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("close"))
    month = days.groupBy("ticker", F.last_day("date").alias("bin")).agg(F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("close"))
    spine = lambda frame: align.align_outer(frame.withColumnRenamed("bin", "date"))
    both = spine(week).withColumn("rule", F.lit("W-FRI")).unionByName(spine(month).withColumn("rule", F.lit("ME")))
    return rounded(both.groupBy("rule", "ticker").agg(F.count(F.lit(1)).alias("bins"), F.count("close").alias("filled"), F.avg("close").alias("mean_close")), 5)


@query
def fn_partition_key(spark, sf):
    days = panel.closes(spark, sf, "instrument", "day")
    return days.groupBy(
        text.safe_file_name(F.col("ticker")).alias("file_name"), F.concat_ws("Q", F.year("date").cast("string"), F.quarter("date").cast("string")).alias("quarter")
    ).agg(F.count(F.lit(1)).alias("days"))


@query
def fn_math(spark, sf):
    """Sign, clip, root, power, logarithm, finiteness and closeness over customer balances."""
    c = panel.table(spark, sf, "customer")
    b = F.col("c_acctbal")
    return rounded(c.groupBy("c_mktsegment").agg(
        F.sum(F.signum(b)).alias("signs"), F.avg(F.least(F.greatest(b, F.lit(0.0)), F.lit(5000.0))).alias("clipped"), F.avg(F.sqrt(F.abs(b))).alias("roots"),
        F.avg(F.log1p(F.abs(b))).alias("logs"), F.count_if(is_close(b, F.round(b, 0), 0.0, 0.1)).alias("near_whole"), F.count(finite(b)).alias("finite_rows"),
    ), 4)


@query
def fn_positive_mask(spark, sf):
    """Ratios with masked denominators: no division by zero, no negative base."""
    lines = panel.table(spark, sf, "lineitem")
    q, t = F.col("l_quantity") - 25, F.col("l_tax")
    return rounded(lines.groupBy("l_returnflag").agg(
        F.count(positive(q)).alias("positive_rows"), F.count(non_negative(q)).alias("non_negative_rows"), F.avg(F.try_divide(F.col("l_discount"), positive(t))).alias("ratio"),
        F.count(F.try_divide(q, positive(t))).alias("ratios"),
    ), 5)


@query
def fn_reason_concat(spark, sf):
    lines = panel.table(spark, sf, "lineitem")
    reasons = F.concat_ws("|", F.when(F.col("l_quantity") > 40, "large"), F.when(F.col("l_discount") == 0, "no_discount"), F.when(F.col("l_tax") > 0.05, "taxed"), F.when(F.col("l_quantity") > 45, "large"))
    unique = F.array_join(F.array_distinct(F.filter(F.split(reasons, r"\|"), lambda r: r != "")), "|")
    return lines.groupBy(unique.alias("reasons")).agg(F.count(F.lit(1)).alias("lines"))


@query
def fn_json_cols(spark, sf):
    """Weights of each portfolio as one sorted JSON object."""
    entry = F.struct("ticker", F.format_string("%.4f", F.col("weight") + 1e-9).alias("weight"))
    return frames.weight_sets(spark, sf).groupBy("portfolio").agg(text.weights_json(F.collect_list(entry)).alias("weights"))


@query
def fn_string_agg(spark, sf):
    return panel.instruments(spark, sf).groupBy("sector").agg(F.array_join(F.array_sort(F.collect_list("ticker")), "|").alias("tickers"))


@query
def fn_name_similarity(spark, sf):
    a = named(spark, sf).select("ticker", "fund_name")
    b = current_snapshot(spark, sf).select("ticker", F.col("fund_name").alias("current_name"))
    score = text.name_similarity(F.col("fund_name"), F.col("current_name"))
    return rounded(a.join(b, "ticker").select("ticker", score.alias("similarity"), (score >= metadata.SIMILARITY_THRESHOLD).alias("same")), 5)


@query
def fn_gics_pit(spark, sf):
    """Sector name of each instrument's sleeve at the first trade of every month."""
    from tidemark.plans.universe import COMMUNICATION_DATES, LEGACY, REAL_ESTATE_DATES, candidates

    months = universe.month_ends(panel.closes(spark, sf, "instrument", "day"))
    grid = universe.month_grid(candidates(spark, sf).select("ticker", "current_sector", "listing_date"), months)
    out = universe.classify_sector(grid, REAL_ESTATE_DATES, COMMUNICATION_DATES, LEGACY)
    return out.select("ticker", "selection_date", "historical_sector_name", "classification_valid", "classification_level_at_date", "classification_effective_date")


@query
def agg_ticker_reuse(spark, sf):
    return metadata.ticker_reuse(lifecycle(spark, sf))


@query
def agg_lifecycle(spark, sf):
    """Per symbol over three snapshots: preferred name, first listing, last delisting, where seen."""
    from tidemark.plans.sources import listing_files
    from tidemark.sources import files

    rows = files.read_listing_snapshots(spark, listing_files(spark, sf))
    rank = F.when(F.col("snapshot") == "START_ACTIVE", 0).when(F.col("snapshot") == "END_DELISTED", 1).otherwise(2)
    seen = lambda name: F.bool_or(F.col("snapshot") == name)
    return rows.groupBy("symbol").agg(
        F.min_by("name", rank).alias("name"), F.min("ipo_date").alias("ipo_date"), F.max("delisting_date").alias("delisting_date"),
        seen("START_ACTIVE").alias("seen_start"), seen("END_ACTIVE").alias("seen_active"), seen("END_DELISTED").alias("seen_delisted"), F.count(F.lit(1)).alias("records"),
    )


@query
def vendor_conflicts(spark, sf):
    return conflicts(spark, sf)


@query
def vendor_resolution(spark, sf):
    return metadata.vendor_resolution(conflicts(spark, sf), lifecycle(spark, sf), other_entities(spark, sf), official_evidence(spark, sf))


def eligibility_table(spark, sf):
    resolved = conflicts(spark, sf).withColumn(
        "resolution_status", F.when(F.col("conflict_types") == "active_name_mismatch", "resolved_by_official_issuer_evidence").otherwise(F.col("resolution_status"))
    )
    return panel.kept(
        spark, ("eligibility", sf),
        lambda: metadata.eligibility(lifecycle(spark, sf), current_snapshot(spark, sf), official_evidence(spark, sf), price_audit(spark, sf), resolved),
    )


@query
def meta_eligibility(spark, sf):
    return eligibility_table(spark, sf)


@query
def meta_rejections(spark, sf):
    table = eligibility_table(spark, sf)
    n = number()
    out = metadata.rejections(table, table.where("review_status = 'clean'"), table.where(n % 4 == 1), table.where(n % 11 == 0))
    return out.select("lifecycle_id", "ticker", "status", "review_status", "rejection_reason")


@query
def meta_review_priority(spark, sf):
    table = eligibility_table(spark, sf)
    n = number()
    out = metadata.rejections(table, table.where("review_status = 'clean'"), table.where(n % 4 == 1), table.where(n % 11 == 0))
    return metadata.priority(out, table.where(n % 10 == 5))


@query
def agg_price_audit(spark, sf):
    """Price audit per instrument over its raw rows: counts, history, gaps, runs, status."""
    rows = raw_ohlcv(spark, sf)
    report = clean.anomaly_report(rows).select("ticker", "max_gap", "invalid_rows", "total_rows")
    daily = clean.daily_anomalies(rows)
    first, last = F.min("date"), F.max("date")
    sums = daily.groupBy("ticker").agg(
        first.alias("first_price_date"), last.alias("last_price_date"), F.sum("missing").alias("missing_rows"), F.sum("duplicate").alias("duplicate_rows"),
        F.sum("nonpositive").alias("nonpositive_rows"), F.sum("logic").alias("logic_error_rows"), F.sum("negative_volume").alias("negative_volume_rows"),
        (F.add_months(first, 60) <= last).alias("sufficient_history"),
    )
    order = Window.partitionBy("ticker").orderBy("date")
    hit = daily.withColumn("_p", F.row_number().over(order)).where("missing > 0")
    runs = hit.withColumn("_g", F.col("_p") - F.row_number().over(order)).groupBy("ticker", "_g").agg(F.count(F.lit(1)).alias("n")).groupBy("ticker").agg(F.max("n").alias("max_missing_run"))
    out = sums.join(report, "ticker").join(runs, "ticker", "left").withColumn("max_missing_run", F.coalesce("max_missing_run", F.lit(0)))
    out = out.withColumn("large_missing_gap", (F.col("max_gap") > 5) | (F.col("max_missing_run") > 5))
    return out.withColumn("clean", (F.col("invalid_rows") == 0) & ~F.col("large_missing_gap")).drop("invalid_rows")
