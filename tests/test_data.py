import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import day
from tidemark.functions import text
from tidemark.functions.columns import add_weekdays, weekdays_between
from tidemark.operators import align, clean, metadata, universe
from tidemark.session import landing_path
from tidemark.sources import files, sinks


def test_weekday_arithmetic_equals_the_calendar(spark):
    days = pd.date_range("1999-12-20", periods=40)
    pairs = [(a.date(), b.date()) for a in days[:10] for b in days[10:]]
    got = spark.createDataFrame(pairs, "a date, b date").select("a", "b", weekdays_between(F.col("a"), F.col("b")).alias("n"), add_weekdays(F.col("a"), 3).alias("plus"), add_weekdays(F.col("a"), -1).alias("minus")).collect()
    for row in got:
        assert row.n == np.busday_count(row.a, row.b)
        stamp = pd.Timestamp(row.a)
        assert row.plus == (stamp + pd.offsets.BDay(3)).date() and row.minus == (stamp - pd.offsets.BDay(1)).date()


def test_clean_prices_keeps_the_last_valid_row(spark):
    rows = [
        (" aaa", "2024-01-02", "10", "5", 1), ("AAA", "2024-01-02T15:00:00Z", "11", "x", 2), ("AAA", "2024-01-02", "n/a", "9", 3), ("AAA", "2024-01-03", "-4", "1", 4),
        ("AAA", "bad", "3", "1", 5), ("AAA", "2024-01-04", "NaN", "1", 6), ("AAA", "2024-01-05", "Infinity", "1", 7),
    ]
    out = clean.clean_prices(spark.createDataFrame(rows, "ticker string, date_text string, close_text string, volume_text string, seq bigint"), "seq").collect()
    assert [(r.ticker, r.date, r.close, r.volume) for r in out] == [("AAA", day("2024-01-02"), 11.0, None)]


def test_one_ticker_with_most_rows_is_folded_before_it_moves(spark):
    hot = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), (F.col("id") % 97).cast("string"))).alias("ticker"), F.lit("2024-01-02").alias("date_text"),
        F.col("id").cast("string").alias("close_text"), F.lit("1").alias("volume_text"), F.col("id").alias("seq"),
    )
    out = clean.clean_prices(hot, "seq")
    assert {r.ticker: r.close for r in out.collect()}["HOT"] == 59997.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_max_by" in plan


def test_anomalies_and_quarantine(spark):
    d = day("2024-01-02")
    schema = "ticker string, date date, open double, high double, low double, close double, volume double"
    rows = [("A", d, 1.0, 2.0, 0.5, 1.0, 5.0), ("A", d, 1.0, 2.0, 0.5, 1.0, 5.0), ("A", day("2024-01-15"), 1.0, 0.4, 0.5, 0.0, -1.0), ("B", d, 1.0, 2.0, 0.5, 1.0, 5.0)]
    out = {r.ticker: r for r in clean.anomaly_report(spark.createDataFrame(rows, schema)).collect()}
    assert out["A"].anomaly_types == "nonpositive_price|negative_volume|ohlc_logic_error|duplicate_date|large_missing_gap"
    assert out["A"].anomaly_dates == "2024-01-02|2024-01-15|gap:2024-01-02..2024-01-15" and out["A"].invalid_rows == 3
    assert out["B"].anomaly_types == "none" and out["B"].anomaly_dates == ""
    split = clean.split_quarantine(spark.createDataFrame(rows, schema)).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in split} == {"quarantine": 3, "valid": 1}


def test_merge_prefers_fresh_rows(spark):
    schema = "ticker string, date date, close double"
    old = spark.createDataFrame([("A", day("2024-01-03"), 1.0), ("A", day("2024-01-02"), 2.0)], schema)
    new = spark.createDataFrame([("A", day("2024-01-03"), 9.0), ("A", day("2024-01-04"), 3.0)], schema)
    out = files.merge_incremental(old, new).orderBy("date").collect()
    assert [(r.date.day, r.close, r.origin) for r in out] == [(2, 2.0, "history"), (3, 9.0, "fresh"), (4, 3.0, "fresh")]


def test_provider_errors_become_rejects_and_arrays_are_padded(spark):
    payloads = ['{"aaa": {"status": "ok", "values": [{"datetime": "2024-01-02", "close": "1.5", "volume": "7"}]}, "bbb": {"status": "error", "message": "limit"}}']
    out = files.parse_symbol_map(spark.createDataFrame([(p,) for p in payloads], "payload string")).orderBy("ticker").collect()
    assert (out[0].ticker, out[0].close, out[0].reject_reason) == ("AAA", 1.5, None) and out[1].reject_reason == "limit"
    arrays = spark.createDataFrame([("X", '{"timestamp": [1704153600, 1704240000], "close": ["1", "2"], "volume": ["5"]}')], "ticker string, payload string")
    padded = files.parse_parallel_arrays(arrays).orderBy("date").collect()
    assert [(r.close, r.volume) for r in padded] == [(1.0, 5.0), (2.0, None)]


def test_dimension_reports_blank_and_duplicate_keys(spark):
    raw = spark.createDataFrame([(" aaa ", "x"), ("AAA", " "), ("b", "y")], "ticker string, issuer string")
    out = files.dimension_rows(raw, ("ticker", "issuer"), "ticker").collect()
    assert sum(r.duplicate_key for r in out) == 2 and [r.blank_columns for r in out if r.issuer == ""] == ["issuer"]
    with pytest.raises(ValueError):
        files.dimension_rows(raw, ("ticker", "missing"), "ticker")


def test_writers_refuse_to_overwrite_and_fix_decimals(spark):
    path = landing_path(spark, "test")
    df = spark.createDataFrame([("A", 1.23456)], "ticker string, v double")
    assert sinks.guarded(sinks.write_fixed_csv, df, path, 2) == "written"
    assert sinks.guarded(sinks.write_fixed_csv, df, path, 2) == "refused"
    assert spark.read.option("header", True).csv(path).first().v == "1.23"


def test_gap_yields_null_returns_on_both_sides(spark):
    d = [day(f"2024-01-0{k}") for k in range(1, 6)]
    rows = [("A", x, float(k + 1)) for k, x in enumerate(d)] + [("B", x, 1.0) for k, x in enumerate(d) if k != 2]
    grid = align.returns(align.align_outer(spark.createDataFrame(rows, "ticker string, date date, close double")))
    b = [r.ret for r in grid.where("ticker = 'B'").orderBy("date").collect()]
    assert b == [None, 0.0, None, None, 0.0]
    inner = align.align_inner(spark.createDataFrame(rows, "ticker string, date date, close double"))
    assert inner.select("date").distinct().count() == 4


def test_adv_reasons(spark):
    days = [d.date() for d in pd.bdate_range("2024-01-01", periods=30)]
    rows = [("OK", d, 2.0, 3.0) for d in days] + [("SHORT", d, 2.0, 3.0) for d in days[-5:]] + [("STALE", d, 2.0, 3.0) for d in days[:-1]]
    rows += [("BAD", d, 0.0 if d == days[-3] else 2.0, 3.0) for d in days] + [("TWICE", d, 2.0, 3.0) for d in days] + [("TWICE", days[4], 2.5, 3.0)]
    prices = spark.createDataFrame(rows, "ticker string, date date, close double, volume double")
    grid = spark.createDataFrame([(t, days[-1]) for t in ("OK", "SHORT", "STALE", "BAD", "TWICE", "NONE")], "ticker string, selection_date date")
    out = {r.ticker: r for r in universe.adv_as_of(prices, grid).collect()}
    assert out["OK"].adv20 == 6.0 and out["OK"].adv_reason == ""
    assert {t: r.adv_reason for t, r in out.items() if t != "OK"} == {
        "SHORT": "fewer_than_20_observations", "STALE": "no_valid_price_on_selection_date", "BAD": "invalid_close_or_volume_in_adv_window",
        "TWICE": "duplicate_price_dates", "NONE": "no_cached_prices",
    }
    assert out["BAD"].adv_valid_observations == 19 and out["SHORT"].adv_valid_observations == 5


def test_sector_names_follow_their_effective_dates(spark):
    rows = [
        ("VOX", "Communication Services", "2018-09-27"), ("NEW", "Communication Services", "2018-09-27"), ("NEW", "Communication Services", "2018-10-01"),
        ("RE", "Real Estate", "2016-08-31"), ("RE", "Real Estate", "2016-09-01"), ("XLE", "Energy", "2016-08-31"),
    ]
    data = [(t, s, datetime.date(2010, 1, 1), day(d), day(d)) for t, s, d in rows]
    grid = spark.createDataFrame(data, "ticker string, current_sector string, listing_date date, selection_date date, effective_trade_date date")
    out = universe.classify_sector(grid).collect()
    assert [(r.historical_sector_name, r.classification_valid, r.classification_level_at_date) for r in out] == [
        ("Telecommunication Services", True, "sector"), ("Telecommunication Services", False, "unclassified"), ("Communication Services", True, "sector"),
        ("Real Estate", False, "industry_group"), ("Real Estate", True, "sector"), ("Energy", True, "sector"),
    ]


def test_tied_first_place_is_reported(spark):
    schema = "m string, ticker string, adv20 double, adv_valid_observations int, available_history_months double"
    rows = [("x", "B", 5.0, 20, 60.0), ("x", "A", 5.0, 20, 60.0), ("x", "C", 4.0, 20, 90.0), ("y", "C", 4.0, 20, 90.0)]
    out = {r.m: r for r in universe.pick_highest(spark.createDataFrame(rows, schema), ["m"]).collect()}
    assert (out["x"].ticker, out["x"].tie_break_used) == ("A", True) and (out["y"].ticker, out["y"].tie_break_used) == ("C", False)


def test_text_rules(spark):
    names = [("3X Long Stock ETN",), ("Acme Global Bond Fund",), ("S&P 500 Covered Call ETF",), ("Robot Space Fund",)]
    df = spark.createDataFrame(names, "n string")
    out = [r.l for r in df.select(text.exclusion_labels(F.col("n")).alias("l")).collect()]
    assert out == [["etn", "leveraged"], ["fixed_income", "international_or_global"], ["option_or_defined_outcome"], []]
    row = df.limit(1).select(
        text.clean_text(F.lit(" NaN ")).alias("a"), text.normalized_name(F.lit("The Big-Cap ETF Trust")).alias("b"), text.tristate(F.lit("maybe")).alias("c"),
        text.name_similarity(F.lit("Alpha ETF"), F.lit("alpha fund")).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == ("unknown", "BIG CAP", None, 1.0)


def test_name_ratio_is_that_of_matching_blocks(spark):
    """Spark and the SQL both equal Python's ratio: ties, repeats, empty names and both orders."""
    import random
    from difflib import SequenceMatcher

    import duckdb

    from oracles.scalars import sims

    draw = random.Random(4)
    words = [" ".join(draw.choice(["ALPHA", "ALP", "BETA", "ABAB", "A", "GROWTH"]) for _ in range(draw.randint(1, 4))) for _ in range(60)]
    pairs = [(str(i), a, b) for i, (a, b) in enumerate(zip(words, words[7:] + words[:7]))] + [("x", "", ""), ("y", "BETA", ""), ("z", None, "BETA")]
    frame = spark.createDataFrame(pairs, "ticker string, a string, b string")
    got = {r.ticker: r.s for r in frame.select("ticker", text._block_ratio(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got.pop("z") is None and got == {i: SequenceMatcher(None, a, b).ratio() for i, a, b in pairs[:-1]}
    con = duckdb.connect()
    con.execute("CREATE TABLE pairs (ticker VARCHAR, a VARCHAR, b VARCHAR)")
    normal = [(i, a, b) for i, a, b in frame.select("ticker", text.normalized_name(F.col("a")), text.normalized_name(F.col("b"))).collect() if a and b]
    con.executemany("INSERT INTO pairs VALUES (?, ?, ?)", normal)
    found = dict(con.execute(f"SELECT ticker, s FROM {sims('a', 'b', 'pairs')}").fetchall())
    assert len(found) > 50 and all(abs(found[i] - SequenceMatcher(None, a, b).ratio()) < 1e-12 for i, a, b in normal)


def test_numbering_by_groups_equals_one_order(spark):
    rows = [(f"r{i % 3}", f"{'ABCÄ'[i % 4]}{i % 5}x{i % 7}", i) for i in range(200)]
    frame = spark.createDataFrame(rows, "rejection_reason string, ticker string, lifecycle_id int")
    got = metadata.numbered(frame, ("rejection_reason", "ticker", "lifecycle_id"), F.substring("ticker", 1, 2), "no").collect()
    assert [(r.rejection_reason, r.ticker, r.lifecycle_id) for r in sorted(got, key=lambda r: r.no)] == sorted(rows) and {r.no for r in got} == set(range(1, 201))


def test_order_key_keeps_lines_of_one_order_together(spark):
    """A tenth or a hundredth line comes after the ninth and before the next order."""
    from tidemark.sources import panel

    rows = [(1, 9, 5, 5), (1, 10, 1, 1), (1, 100, 1, 1), (2, 1, 1, 1), (600_000_000_000, 9_999, 20_000_000_000, 1_000_000_000)]
    frame = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    found = [tuple(r) for r in frame.orderBy(panel.file_order()).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect()]
    assert found == rows and frame.where(panel.file_order().isNull()).count() == 0


def test_price_files_of_several_layouts_in_one_folder(spark, tmp_path):
    given = {
        "AAA": "Date,Open,Adj Close,Volume\n2020-01-02,1.0,1.5,100\n2020-01-03,1.1,1.6,n/a\n",
        "BBB": "volume,adj_close,date\n7,2.5,2020-01-02\n",
        "CCC": '\ufeff"  DateTime ","ADJUSTED_CLOSE","note","Close"\n2020-01-02 00:00:00,3.5,"a, b",3.4\n\nbad,x,,\n',
        "DDD": "Date,Close\n",
        "EEE": "",
    }
    for ticker, text in given.items():
        folder = tmp_path / f"ticker={ticker}"
        folder.mkdir()
        (folder / "part.csv").write_text(text, encoding="utf-8")
    out = files.read_price_files(spark, str(tmp_path))
    assert out.columns == ["ticker", "date", "adj_close", "close", "open", "volume"]
    found = sorted((r.ticker, str(r.date), r.adj_close, r.close, r.open, r.volume) for r in out.collect())
    assert found == [
        ("AAA", "2020-01-02", 1.5, None, 1.0, 100.0), ("AAA", "2020-01-03", 1.6, None, 1.1, None),
        ("BBB", "2020-01-02", 2.5, None, None, 7.0), ("CCC", "2020-01-02", 3.5, 3.4, None, None), ("CCC", "None", None, None, None, None),
    ]
    manifest = {r.ticker: (r.rows, r.status) for r in files.source_manifest(spark, str(tmp_path)).collect()}
    assert manifest == {"AAA": (2, "OK"), "BBB": (1, "OK"), "CCC": (2, "OK"), "DDD": (None, "INVALID")}  # Spark lists no file of zero length
    empty = tmp_path / "none"
    empty.mkdir()
    assert files.read_price_files(spark, str(empty)).collect() == []
