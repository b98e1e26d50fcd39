"""Readers for landed files: dimension tables, price files, provider payloads, directories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header spellings of a price file after folding case, blanks and underscores.
PRICE_HEADERS = {
    "date": "date", "datetime": "date", "open": "open", "high": "high", "low": "low", "close": "close",
    "adj close": "adj_close", "adjusted close": "adj_close", "adjclose": "adj_close", "volume": "volume",
}
# Exchange codes of the symbol directory.
EXCHANGE_CODES = {"A": "NYSE American", "N": "NYSE", "P": "NYSE Arca", "Z": "Cboe BZX", "V": "IEX"}
TRAILER = "File Creation Time"


def folded_header(name: str) -> str:
    return " ".join(name.replace("_", " ").strip().lower().split())


def _strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.options(header=True, sep=sep, inferSchema=False).csv(path)


def dimension_rows(raw: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Trimmed strings with the key in upper case and, per row, what breaks the contract."""
    missing = sorted(set(columns) - set(raw.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    clean = raw.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])
    clean = clean.withColumn(key, F.upper(key))
    counts = clean.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows"))
    blank = F.filter(F.array(*[F.when(F.col(c) == "", F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    return clean.join(counts, key).withColumn("blank_columns", F.array_join(blank, ",")).select(
        *columns, "blank_columns", (F.col("key_rows") > 1).alias("duplicate_key")
    )


def read_dimension(spark: SparkSession, path: str, columns: Sequence[str], key: str) -> DataFrame:
    return dimension_rows(_strings(spark, path), columns, key)


def _folded(cell: Column) -> Column:
    """folded_header on the Spark side, without quotes and a byte order mark."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(cell, "[\ufeff\"]", "")), r"[_\s]+", " "))


def price_layouts(spark: SparkSession, path: str) -> DataFrame:
    """Per file: `_path`, its folded header cells and, for each known column, the place of the first cell that names it."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), "value"
    )
    first = lines.where((F.col("at.block") == 0) & (F.trim("value") != "")).groupBy("_path").agg(F.min_by("value", "at").alias("header"))
    cells = first.select("_path", F.transform(F.split("header", ","), _folded).alias("cells"))
    known = sorted(set(PRICE_HEADERS.values()))
    spellings = {name: [k for k, v in PRICE_HEADERS.items() if v == name] for name in known}
    place = [
        F.array_min(F.filter(F.array(*[F.array_position("cells", spelling) for spelling in spellings[name]]), lambda at: at > 0)).cast("int").alias(name)
        for name in known
    ]
    return cells.select("_path", "cells", F.struct(*place).alias("place"))


def read_price_files(spark: SparkSession, path: str, ticker_pattern: str = r"ticker=([^/]+)/", file_column: str | None = None) -> DataFrame:
    """Price files of any mix of header layouts in one folder; the ticker comes from the file path, headers are folded.

    Each file is read by its own header: one pass takes the first line of every file, one scan reads the rows by
    position, and a join on the file gives each row its places. The columns are those that any file has; they are
    null in files without them, and cells beyond the widest header are ignored. Only the number of cells and the
    known names that occur reach the driver. ``file_column`` names an extra column with the path of each row's file.
    """
    layouts = price_layouts(spark, path)
    known = layouts.schema["place"].dataType.names
    width, *found = layouts.agg(F.max(F.size("cells")), *[F.max(F.col(f"place.{name}")) for name in known]).first()
    names = [name for name, at in zip(known, found) if at is not None and name != "date"]
    schema = ", ".join(f"c{i} string" for i in range(width or 1))
    rows = spark.read.schema(schema).options(header=False, recursiveFileLookup=True).csv(path)
    cells = rows.select(F.col("_metadata.file_path").alias("_path"), F.array(*rows.columns).alias("_row"))
    placed = cells.join(layouts, "_path").where(~F.coalesce(_folded(F.col("_row")[0]) == F.col("cells")[0], F.lit(False)))
    value = {name: F.get("_row", F.col(f"place.{name}") - 1) for name in ["date", *names]}
    return placed.select(
        *([F.col("_path").alias(file_column)] if file_column else []),
        F.regexp_extract("_path", ticker_pattern, 1).alias("ticker"), F.to_date(F.try_to_timestamp(value["date"])).alias("date"),
        *[value[name].try_cast("double").alias(name) for name in names],
    )


QUOTE = "struct<datetime:string,close:string,volume:string>"


def parse_symbol_map(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """{symbol: {status, message, values: [...]}} to rows; an error object becomes a reject."""
    kind = f"map<string,struct<status:string,message:string,values:array<{QUOTE}>>>"
    symbols = payloads.select(F.explode(F.from_json(column, kind)).alias("ticker", "result"))
    rows = symbols.select(F.upper("ticker").alias("ticker"), "result", F.explode_outer("result.values").alias("q"))
    reject = F.when(F.col("result.status") == "error", F.coalesce("result.message", F.lit("unknown API error"))).when(
        F.col("q").isNull(), F.lit("no time-series values")
    )
    return _quote_rows(rows.withColumn("reject_reason", reject))


def parse_object_array(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One array of quote objects per ticker."""
    rows = payloads.select("ticker", F.explode_outer(F.from_json(column, f"array<{QUOTE}>")).alias("q"))
    return _quote_rows(rows.withColumn("reject_reason", F.when(F.col("q").isNull(), F.lit("no time-series values"))))


def parse_parallel_arrays(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """{timestamp: [...], close: [...], volume: [...]}: shorter arrays are padded with NULL."""
    kind = "struct<timestamp:array<bigint>,close:array<string>,volume:array<string>>"
    zipped = F.arrays_zip("p.timestamp", "p.close", "p.volume")
    rows = payloads.select("ticker", F.from_json(column, kind).alias("p")).select("ticker", F.explode_outer(zipped).alias("z"))
    q = F.struct(
        F.from_unixtime("z.timestamp", "yyyy-MM-dd").alias("datetime"), F.col("z.close").alias("close"), F.col("z.volume").alias("volume")
    )
    return _quote_rows(rows.select("ticker", q.alias("q"), F.lit(None).cast("string").alias("reject_reason")))


def _quote_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "ticker", F.to_date(F.try_to_timestamp("q.datetime")).alias("date"),
        F.expr("try_cast(q.close AS double)").alias("close"), F.expr("try_cast(q.volume AS double)").alias("volume"),
        "reject_reason",
    )


def read_listing_snapshots(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Listing files tagged with their snapshot; only exchange-traded funds stay."""
    out = None
    for snapshot, path in paths.items():
        raw = _strings(spark, path)
        frame = raw.where(F.upper("assetType") == "ETF").select(
            F.upper(F.trim("symbol")).alias("symbol"), F.trim("name").alias("name"), F.trim("exchange").alias("exchange"),
            F.expr("try_to_date(ipoDate)").alias("ipo_date"), F.expr("try_to_date(delistingDate)").alias("delisting_date"),
            F.trim("status").alias("status"), F.lit(snapshot).alias("snapshot"),
        )
        out = frame if out is None else out.unionByName(frame)
    return out


def read_pipe_directory(spark: SparkSession, path: str, symbol: str, exchange: str | None) -> DataFrame:
    """Pipe-delimited symbol directory: no trailer, no test issues, funds only, one row per ticker."""
    raw = _strings(spark, path, "|")
    first = raw.columns[0]
    rows = raw.where(~F.coalesce(F.col(f"`{first}`"), F.lit("")).startswith(TRAILER)).where(
        (F.col("ETF") == "Y") & (F.col("`Test Issue`") == "N")
    )
    code = F.lit(exchange) if exchange else code_name(F.col("Exchange"))
    named = rows.select(F.upper(F.trim(F.col(f"`{symbol}`"))).alias("ticker"), F.trim(F.col("`Security Name`")).alias("fund_name"), code.alias("exchange"))
    return named.where(F.col("ticker") != "").groupBy("ticker").agg(
        F.min_by("fund_name", F.struct("fund_name", "exchange")).alias("fund_name"),
        F.min_by("exchange", F.struct("fund_name", "exchange")).alias("exchange"),
    )


def code_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in EXCHANGE_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.lit("unknown"))


def source_manifest(spark: SparkSession, path: str, ticker_pattern: str = r"ticker=([^/]+)/") -> DataFrame:
    """Digest, size, row count and dates of each landed price file. Spark lists no file of zero length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    digests = files.select(
        F.col("_metadata.file_path").alias("_file"), F.regexp_extract("path", ticker_pattern, 1).alias("ticker"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")
    )
    rows = read_price_files(spark, path, ticker_pattern, "_file").groupBy("_file").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    return digests.join(rows, "_file", "left").drop("_file").withColumn("status", F.when(F.col("rows") > 0, "OK").otherwise("INVALID"))


def unpivot_matrix(wide: DataFrame, key: str = "date", value: str = "value") -> DataFrame:
    """Wide date x ticker table to long rows, with upper-case tickers, plus a date uniqueness flag."""
    tickers = [c for c in wide.columns if c != key]
    counts = wide.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    long = wide.unpivot([key], tickers, "ticker", value)
    return long.join(counts, key).select(
        F.col(key), F.upper("ticker").alias("ticker"), F.col(value).cast("double").alias(value), (F.col("_n") == 1).alias("unique_date")
    )


def merge_incremental(history: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """History plus fresh rows; a fresh row replaces a historic one, and one whole row wins among equals. Folds on the map side."""
    columns = [c for c in history.columns if c not in keys]
    both = history.select(*keys, *columns, F.lit(0).alias("_p")).unionByName(fresh.select(*keys, *columns, F.lit(1).alias("_p")))
    won = both.groupBy(*keys).agg(F.max(F.struct("_p", *columns)).alias("_won"))
    return won.select(*keys, *[F.col(f"_won.{c}").alias(c) for c in columns], F.when(F.col("_won._p") == 1, "fresh").otherwise("history").alias("origin"))


def merge_reviewed(fresh: DataFrame, reviewed: DataFrame, key: str, columns: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """A fresh value wins unless it is unknown; then an earlier reviewed value stays."""
    prior = reviewed.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    joined = fresh.join(prior, key, "left")
    known = {c: F.coalesce(F.nullif(F.col(c), F.lit(unknown)), F.nullif(F.col(f"_old_{c}"), F.lit(unknown)), F.lit(unknown)) for c in columns}
    return joined.select(key, *[known[c].alias(c) for c in columns])


def merge_missing_keys(existing: DataFrame, requested: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Requested keys that are absent join with default review values."""
    added = requested.select(key).distinct().join(existing.select(key), key, "left_anti")
    return existing.unionByName(added.select(key, *[F.lit(v).alias(c) for c, v in defaults.items()]))
