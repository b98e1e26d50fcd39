"""Cleaning and filter queries. Raw quotes are the order lines themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import align, clean, features, folds
from tidemark.plans import frames
from tidemark.plans.registry import new_registry
from tidemark.plans.windows import TRAINING_YEARS, model_dataset, model_features, selection_dates
from tidemark.sources import panel

QUERIES, query = new_registry()


def text_quotes(spark, sf):
    """Order lines as untyped quotes; some prices and dates do not parse."""
    rows = panel.trades(spark, sf, "instrument")
    return rows.select(
        F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"),
        F.when(F.col("l_linenumber") == 6, "not a date").otherwise(F.concat(F.col("day").cast("string"), F.lit("T00:00:00Z"))).alias("date_text"),
        F.when(F.col("l_linenumber") == 7, "n/a").when(F.col("quantity") == 1, F.lit("-1")).when(F.col("quantity") == 2, F.lit("NaN"))
        .otherwise(F.col("cents").cast("string")).alias("close_text"),
        F.col("quantity").cast("bigint").cast("string").alias("volume_text"), "seq",
    )


def raw_ohlcv(spark, sf):
    """One OHLCV row per order line, with every class of error at some quantity."""
    q, u = F.col("quantity"), F.col("unit_price")
    rows = panel.trades(spark, sf, "instrument").withColumn("date", F.col("day"))
    return rows.select(
        "ticker", "date", u.alias("open"), F.when(q == 47, u / 4).otherwise(u * 2).alias("high"), (u / 2).alias("low"),
        F.when(q == 48, 0.0).otherwise(u).alias("close"), F.when(q == 49, -q).when(q != 50, q).alias("volume"),
    )


@query
def clean_prices(spark, sf):
    return rounded(clean.clean_prices(text_quotes(spark, sf), "seq"))


@query
def filter_valid_window(spark, sf):
    end = F.lit(panel.last_day(spark, sf)).cast("date")
    rows = clean.valid_window(panel.recent_closes(spark, sf, "instrument", 12), F.add_months(end, -12), end)
    return rounded(rows.select("ticker", "date", "close", "volume"))


@query
def filter_valid_ohlcv(spark, sf):
    rows = raw_ohlcv(spark, sf)
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.count_if(clean.ohlcv_is_valid()).alias("valid_rows"))


@query
def resolve_window(spark, sf):
    """Observation window ending at each month's last trading day, N months back."""
    ends = panel.closes(spark, sf, "type", "day").groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("end_date"))
    spans = F.explode(F.array(F.lit(1), F.lit(3), F.lit(12))).alias("months")
    return rounded(ends.select("end_date", spans).withColumn("start_date", F.add_months("end_date", -F.col("months"))))


@query
def filter_lifecycle_slice(spark, sf):
    """Prices inside each instrument's lifecycle; the last year of a delisted one is cut off."""
    number = F.regexp_extract("ticker", r"#(\d+)", 1).cast("int")
    life = panel.instruments(spark, sf).select(
        "ticker", F.add_months("listing_date", 6).alias("from_date"), F.when(number % 5 == 0, F.add_months("last_date", -12)).alias("until_date")
    )
    rows = panel.closes(spark, sf, "instrument", "day").join(life, "ticker").where(
        (F.col("date") >= F.col("from_date")) & (F.col("until_date").isNull() | (F.col("date") <= F.col("until_date")))
    )
    return rounded(rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("volume").alias("volume")))


@query
def filter_eligible_asof(spark, sf):
    """Known listing on or before the day and no delisting by then, for the first of each year."""
    number = F.regexp_extract("ticker", r"#(\d+)", 1).cast("int")
    life = panel.instruments(spark, sf).select(
        "ticker", F.when(number % 6 != 0, F.col("listing_date")).alias("listing_date"), F.when(number % 5 == 0, F.add_months("last_date", -18)).alias("delisting_date")
    )
    days = F.explode(F.transform(F.sequence(F.lit(1995), F.lit(2002)), lambda y: F.make_date(y, F.lit(1), F.lit(5)))).alias("as_of")
    return life.select("*", days).where(
        (F.col("listing_date") <= F.col("as_of")) & (F.col("delisting_date").isNull() | (F.col("delisting_date") > F.col("as_of")))
    )


@query
def filter_available_asof(spark, sf):
    rows = folds.available_as_of(model_dataset(spark, sf), selection_dates(spark, sf), TRAINING_YEARS)
    return rounded(rows.groupBy("ticker", "selection_date").agg(
        F.count(F.lit(1)).alias("rows"), F.min("feature_date").alias("first_feature"), F.max("label_end_date").alias("last_label_end"), F.avg("target_21d_return").alias("mean_target"),
    ))


@query
def validate_price_frame(spark, sf):
    """Violations of the raw frame in the order of its order keys."""
    rows = panel.trades(spark, sf, "instrument").select(
        "ticker", F.when(F.col("quantity") != 50, F.col("day")).alias("date"), panel.line_order().alias("seq")
    )
    return clean.frame_violations(rows)


@query
def estimation_tail(spark, sf):
    """Row counts and bounds of six trailing samples taken in one pass."""
    windows = {"3 months": 3, "6 months": 6, "1 year": 12, "2 years": 24, "3 years": 36, "full": None}
    tails = align.estimation_tail(frames.sector_returns(spark, sf), windows)
    return rounded(tails.groupBy("grp", "ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.avg("ret").alias("mean_ret")
    ))


@query
def select_features(spark, sf):
    """The numeric columns a model may see, with their observed ranges per ticker."""
    data = model_features(spark, sf)
    names = features.model_columns(data)
    long = data.unpivot(["ticker"], names, "feature", "value")
    return rounded(long.groupBy("ticker", "feature").agg(F.count("value").alias("present"), F.min("value").alias("low"), F.max("value").alias("high")))


@query
def project_sector_sort(spark, sf):
    """Fixed sector order as a rank next to each sector's traded volume."""
    order = F.array_position(F.array(*[F.lit(s) for s in frames.SECTORS]), F.col("sector"))
    rows = panel.closes(spark, sf, "type", "month").groupBy("sector").agg(F.sum("volume").alias("volume"))
    return rounded(rows.select(order.alias("sector_order"), "sector", "volume").orderBy("sector_order"))


@query
def anomaly_flags(spark, sf):
    return clean.anomaly_report(raw_ohlcv(spark, sf))


@query
def anomaly_quarantine(spark, sf):
    """Rows kept and rows set aside, per ticker."""
    parts = clean.day_verdicts(raw_ohlcv(spark, sf))
    return rounded(parts.groupBy("ticker", "verdict").agg(F.sum("rows").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")))


@query
def anomaly_second_source(spark, sf):
    """How many anomalous dates a second source covers, and with complete rows."""
    days = clean.daily_anomalies(raw_ohlcv(spark, sf)).where((F.col("invalid") > 0) & F.col("date").isNotNull()).select("ticker", "date")
    second = panel.bars(spark, sf, "instrument", "day").where(F.dayofmonth("date") <= 20).withColumn(
        "volume", F.when(F.col("volume") > 5, F.col("volume"))
    )
    matched = second.join(days, ["ticker", "date"], "left_semi").groupBy("ticker").agg(
        F.count(F.lit(1)).alias("found"), F.count("volume").alias("complete")
    )
    total = second.groupBy("ticker").agg(F.count(F.lit(1)).alias("second_rows"))
    wanted = days.groupBy("ticker").agg(F.count(F.lit(1)).alias("anomaly_dates"))
    out = wanted.join(total, "ticker", "left").join(matched, "ticker", "left")
    return out.select("ticker", "anomaly_dates", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("second_rows", "found", "complete")])
