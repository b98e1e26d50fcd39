"""Source and sink queries: panels are landed as files in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import add_weekdays, rounded
from tidemark.plans.registry import new_registry
from tidemark.session import landing_path
from tidemark.sources import files, panel, sinks

QUERIES, query = new_registry()


def _land_csv(spark, df, label, sep=","):
    path = landing_path(spark, label)
    df.write.options(header=True, sep=sep).csv(path)
    return path


def _months(spark, sf):
    return panel.closes(spark, sf, "type", "month").select("ticker", "date", "cents", "volume")


@query
def scan_dim_csv(spark, sf):
    raw = panel.instruments(spark, sf).select(
        F.concat(F.lit("  "), F.lower("ticker"), F.lit(" ")).alias("ticker"),
        F.concat_ws(" ", "issuer", "sector", F.lit("Fund")).alias("etf_name"), "issuer",
        F.when(F.col("issuer") == "Brand#13", "  ").otherwise(F.concat("sector", F.lit(" Index"))).alias("underlying_index"),
        F.col("sector").alias("gics_sector"), F.lit("issuer page").alias("source"),
    )
    columns = ("ticker", "etf_name", "issuer", "underlying_index", "gics_sector", "source")
    return files.read_dimension(spark, _land_csv(spark, raw, "dimension"), columns, "ticker")


@query
def scan_price_files(spark, sf):
    """Two header layouts of one-folder-per-ticker files."""
    months = _months(spark, sf)
    title = months.select("ticker", F.col("date").alias("Date"), (F.col("cents") / F.lit(100.0)).alias("Close"), F.col("volume").alias("Volume"))
    snake = months.select("ticker", "date", (F.col("cents") / F.lit(100.0)).alias("adj_close"), F.when(F.col("volume") < 60, "n/a").otherwise(F.col("volume").cast("string")).alias("volume"))
    paths = []
    for label, frame in (("title", title), ("snake", snake)):
        path = landing_path(spark, f"prices-{label}")
        frame.repartition("ticker").write.partitionBy("ticker").option("header", True).csv(path)
        paths.append((label, path))
    first = files.read_price_files(spark, paths[0][1]).select(F.lit("title").alias("layout"), "ticker", "date", F.col("close").alias("price"), "volume")
    second = files.read_price_files(spark, paths[1][1]).select(F.lit("snake").alias("layout"), "ticker", "date", F.col("adj_close").alias("price"), "volume")
    return rounded(first.unionByName(second), 2)


@query
def scan_provider_json(spark, sf):
    """Three payload shapes, written as text and parsed: object array, symbol map, parallel arrays."""
    months = _months(spark, sf).withColumn("year", F.year("date"))
    quote = F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("datetime"), (F.col("cents") / F.lit(100.0)).cast("decimal(20,2)").cast("string").alias("close"),
        F.col("volume").cast("bigint").cast("string").alias("volume"),
    )
    quotes = months.groupBy("ticker", "year").agg(F.array_sort(F.collect_list(quote)).alias("values"))
    by_array = quotes.select(F.lit("array").alias("shape"), "ticker", F.to_json("values").alias("payload"))
    failed = F.col("year") == 1997
    result = F.struct(
        F.when(failed, "error").otherwise("ok").alias("status"), F.when(failed, "quota exceeded").alias("message"),
        F.when(~failed, F.col("values")).alias("values"),
    )
    by_symbol = quotes.select(F.lit("map").alias("shape"), "ticker", F.to_json(F.create_map(F.lower("ticker"), result)).alias("payload"))
    arrays = F.struct(
        F.transform("values", lambda q: F.unix_timestamp(q["datetime"], "yyyy-MM-dd")).alias("timestamp"),
        F.transform("values", lambda q: q["close"]).alias("close"),
        F.slice(F.transform("values", lambda q: q["volume"]), F.lit(1), F.size("values") - 1).alias("volume"),
    )
    parallel = quotes.select(F.lit("parallel").alias("shape"), "ticker", F.to_json(arrays).alias("payload"))
    path = landing_path(spark, "payloads")
    by_array.unionByName(by_symbol).unionByName(parallel).write.partitionBy("shape").json(path)
    landed = spark.read.schema("shape string, ticker string, payload string").json(path)
    parsed = (
        files.parse_object_array(landed.where("shape = 'array'")).withColumn("shape", F.lit("array"))
        .unionByName(files.parse_symbol_map(landed.where("shape = 'map'")).withColumn("shape", F.lit("map")))
        .unionByName(files.parse_parallel_arrays(landed.where("shape = 'parallel'")).withColumn("shape", F.lit("parallel")))
    )
    return rounded(parsed.select("shape", "ticker", "date", "close", "volume", "reject_reason"), 2)


@query
def parse_event_props(spark, sf):
    """The JSON attribute of events, folded per type."""
    events = panel.table(spark, sf, "events")
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count(k).alias("parsed"), F.min(k).alias("min_k"), F.max(k).alias("max_k"), F.sum(k).alias("sum_k")
    )


def listing_files(spark, sf):
    """Three listing snapshots derived from instrument lifecycles."""
    known = panel.instruments(spark, sf)
    number = F.regexp_extract("issuer", r"#(\d+)", 1).cast("int")
    base = known.select(
        F.lower("ticker").alias("symbol"), F.concat_ws(" ", "issuer", "sector", F.lit("ETF")).alias("name"),
        F.when(number % 2 == 0, "NYSE Arca").otherwise("NASDAQ").alias("exchange"),
        F.when(number % 7 == 0, "Stock").otherwise("ETF").alias("assetType"),
        F.col("listing_date").alias("ipoDate"), "last_date", "sector", number.alias("n"),
    )
    gone = F.col("n") % 5 == 0
    pick = ("symbol", "name", "exchange", "assetType", "ipoDate", "delistingDate", "status")
    start = base.where(F.col("ipoDate") <= F.lit("1995-01-15").cast("date")).withColumns(
        {"name": F.concat("name", F.lit(" Old")), "delistingDate": F.lit(None).cast("date"), "status": F.lit("Active")}
    )
    active = base.where(~gone).withColumns({"delistingDate": F.lit(None).cast("date"), "status": F.lit("Active")})
    dead = base.where(gone).withColumns({"delistingDate": F.col("last_date"), "status": F.lit("Delisted")})
    return {
        name: _land_csv(spark, frame.select(*pick), f"listing-{name}")
        for name, frame in (("START_ACTIVE", start), ("END_ACTIVE", active), ("END_DELISTED", dead))
    }


@query
def scan_listing_snapshots(spark, sf):
    return files.read_listing_snapshots(spark, listing_files(spark, sf))


@query
def scan_pipe_directory(spark, sf):
    """A symbol directory with header and trailer rows, written as parts and read back."""
    known = panel.instruments(spark, sf)
    number = F.regexp_extract("issuer", r"#(\d+)", 1).cast("int")
    code = F.element_at(F.array(*[F.lit(c) for c in ("A", "N", "P", "Z", "V", "Q")]), (number % 6) + 1)
    lines = known.select(
        F.col("ticker").alias("ACT Symbol"), F.concat_ws(" ", "issuer", "sector").alias("Security Name"), code.alias("Exchange"),
        F.when(number % 4 == 0, "N").otherwise("Y").alias("ETF"), F.when(number % 9 == 0, "Y").otherwise("N").alias("Test Issue"),
    )
    trailer = lines.agg(F.concat(F.lit("File Creation Time: "), F.count(F.lit(1)).cast("string")).alias("ACT Symbol"))
    path = landing_path(spark, "directory")
    # every part has the header, the last one is the trailer: no row meets all others in one task
    lines.unionByName(trailer, allowMissingColumns=True).write.option("header", True).option("sep", "|").csv(path)
    return files.read_pipe_directory(spark, path, "ACT Symbol", None)


@query
def scan_source_manifest(spark, sf):
    lines = _months(spark, sf).select("ticker", "date", "cents", F.col("volume").cast("bigint").alias("volume"))
    path = landing_path(spark, "manifest")
    lines.repartition("ticker").sortWithinPartitions("ticker", "date").write.partitionBy("ticker").option("header", True).csv(path)
    return files.source_manifest(spark, path)


@query
def merge_incremental(spark, sf):
    """History up to mid-2000 and a fresh load from early 2000 with corrected closes."""
    prices = panel.closes(spark, sf, "instrument", "day").select("ticker", "date", "close", "volume")
    history = prices.where(F.col("date") <= F.lit("2000-06-30").cast("date"))
    fresh = prices.where(F.col("date") >= F.lit("2000-01-01").cast("date")).withColumn("close", F.col("close") + 1)
    merged = files.merge_incremental(history, fresh)
    return rounded(
        merged.groupBy("ticker").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("origin") == "fresh").alias("fresh_rows"), F.sum("close").alias("close_sum"),
            F.date_add(F.max("date"), 1).alias("next_start"),
        ),
        4,
    )


@query
def cache_coverage(spark, sf):
    """Does each instrument cover the last two years: enough rows, early start, late end."""
    end = F.lit(panel.last_day(spark, sf)).cast("date")
    dated = panel.recent_closes(spark, sf, "instrument", 24).withColumns({"window_end": end, "window_start": F.add_months(end, -24)}).where(
        (F.col("date") >= F.col("window_start")) & (F.col("close") > 0) & (F.col("volume") >= 0)
    )
    out = dated.groupBy("ticker", "window_start", "window_end").agg(
        F.count(F.lit(1)).alias("valid_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    latest_start, earliest_end = add_weekdays(F.col("window_start"), 3), add_weekdays(F.col("window_end"), -1)
    out = out.withColumns({"latest_start": latest_start, "earliest_end": earliest_end})
    return out.withColumn(
        "covered",
        (F.col("valid_rows") >= 40) & (F.col("first_date") <= F.col("latest_start")) & (F.col("last_date") >= F.col("earliest_end")),
    )


@query
def scan_wide_matrix(spark, sf):
    path = landing_path(spark, "wide")
    months = _months(spark, sf).withColumn("dollars", F.col("cents") / F.lit(100.0))
    # One name per column of the written file.
    tickers = [row.ticker for row in months.select("ticker").distinct().orderBy("ticker").collect()]
    sinks.write_wide_csv(months, path, tickers, "dollars", 2)
    wide = spark.read.option("header", True).csv(path).withColumn("date", F.to_date("date"))
    return rounded(files.unpivot_matrix(wide), 2)


def _reviewed(spark, sf):
    known = panel.instruments(spark, sf)
    number = F.regexp_extract("issuer", r"#(\d+)", 1).cast("int")
    fresh = known.select(
        "ticker", F.when(number % 3 == 0, "unknown").otherwise(F.lower("sector")).alias("asset_class"),
        F.when(number % 4 == 0, "unknown").otherwise(F.lit("US")).alias("scope"),
    )
    prior = known.where(number % 2 == 0).select(
        "ticker", F.lit("reviewed").alias("asset_class"), F.when(number % 8 == 0, "unknown").otherwise("Global").alias("scope")
    )
    return fresh, prior


@query
def merge_reviewed(spark, sf):
    fresh, prior = _reviewed(spark, sf)
    return files.merge_reviewed(fresh, prior, "ticker", ["asset_class", "scope"])


@query
def merge_missing_keys(spark, sf):
    """Instruments traded in 2001 that the reviewed table does not list."""
    _, prior = _reviewed(spark, sf)
    requested = panel.closes(spark, sf, "instrument", "day").where(F.year("date") == 2001).select("ticker")
    return files.merge_missing_keys(prior, requested, "ticker", {"asset_class": "unknown", "scope": "needs_review"})


@query
def sink_csv_fixed(spark, sf):
    path = landing_path(spark, "fixed")
    sinks.write_fixed_csv(panel.closes(spark, sf, "type", "month").select("ticker", "date", "close"), path, 10)
    return rounded(
        spark.read.schema("ticker string, date date, close string").option("header", True).csv(path).select(
            "ticker", "date", F.length(F.substring_index("close", ".", -1)).alias("decimals"), F.col("close").cast("double").alias("close")
        )
    )


@query
def sink_parquet(spark, sf):
    path = landing_path(spark, "parquet")
    sinks.write_partitioned(panel.closes(spark, sf, "type", "day").select("ticker", "date", "close", "volume"), path)
    back = spark.read.parquet(path)
    return rounded(back.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"), F.max("date").alias("last_date")))


@query
def sink_json(spark, sf):
    path = landing_path(spark, "json")
    frame = panel.closes(spark, sf, "type", "month").select("ticker", "date", F.when(F.col("volume") > 100, F.col("volume")).alias("volume"))
    sinks.write_json(frame, path)
    back = spark.read.schema("ticker string, date date, volume double").json(path)
    return rounded(back.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.count("volume").alias("present"), F.sum("volume").alias("volume")))


@query
def sink_guard(spark, sf):
    """A second write to the same folder is refused; the first stays readable."""
    frame = panel.closes(spark, sf, "type", "month").select("ticker", "date", "volume")
    path = landing_path(spark, "guard")
    first = sinks.guarded(sinks.write_json, frame, path)
    second = sinks.guarded(sinks.write_json, frame, path)
    back = spark.read.schema("ticker string, date date, volume double").json(path)
    return back.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows")).withColumns(
        {"first_write": F.lit(first), "second_write": F.lit(second)}
    )
