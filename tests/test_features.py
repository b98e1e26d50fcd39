import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import ohlcv, wavy
from tidemark.operators import features


def run(spark, pdf, build=features.feature_table):
    return build(spark.createDataFrame(pdf)).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)


def test_warm_up_rows(spark):
    out = run(spark, ohlcv())
    assert out["return_21d"].isna().sum() == 21 and out["return_21d"].notna()[21]
    assert out["sma_21"].isna().sum() == 20 and out["volatility_21d"].isna().sum() == 21
    assert out["adv20"].isna().sum() == 19


def test_values_match_pandas(spark):
    pdf = wavy()
    out = run(spark, pdf)
    close, volume = pdf["close"], pdf["volume"]
    np.testing.assert_allclose(out["sma_63"], close.rolling(63).mean(), rtol=1e-10)
    np.testing.assert_allclose(out["volatility_21d"], close.pct_change().rolling(21).std(), rtol=1e-9)
    np.testing.assert_allclose(out["volume_to_average_5d"], volume / volume.rolling(5).mean(), rtol=1e-10)
    fall = lambda v: np.min(v / np.maximum.accumulate(v) - 1)
    np.testing.assert_allclose(out["rolling_max_drawdown_21d"], close.rolling(21).apply(fall, raw=True), rtol=1e-9, atol=1e-12)


def wilder(close, n=14):
    delta = close.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    loss = (-delta.clip(upper=0)).ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    return 100 - 100 / (1 + gain / loss)


@pytest.mark.parametrize(("n", "span"), [(14, 300.0), (14, 40.0), (2, 300.0), (252, 300.0)])
def test_rsi_matches_recursion_across_blocks(spark, n, span):
    pdf = wavy(rows=1500)
    out = run(spark, pdf, lambda df: features.add_rsi(df, n=n, span=span))
    np.testing.assert_allclose(out[f"rsi_{n}"], wilder(pdf["close"], n), rtol=1e-8)


def test_rsi_decays_over_missing_changes(spark):
    pdf = wavy(rows=300)
    pdf.loc[[40, 41, 42, 100, 200, 201], "close"] = np.nan
    out = run(spark, pdf, lambda df: features.add_rsi(df.withColumn("close", F.nanvl("close", F.lit(None)))))
    np.testing.assert_allclose(out["rsi_14"], wilder(pdf["close"]), rtol=1e-8)


def test_rsi_of_one_sided_and_flat_prices(spark):
    up = run(spark, ohlcv(rows=40))
    assert (up["rsi_14"].dropna() == 100.0).all() and up["rsi_14"].notna().sum() == 26
    flat = ohlcv(rows=40).assign(close=50.0)
    assert (run(spark, flat)["rsi_14"].dropna() == 50.0).all()


def test_invalid_price_is_classified_not_filled(spark):
    pdf = ohlcv()
    pdf.loc[30, "open"] = 0.0
    pdf.loc[40, "close"] = 0.0
    built = features.build_features(spark.createDataFrame(pdf))
    reasons = features.missing_reasons(built, ["open_close_return", "return_1d", "sma_5"]).toPandas()
    at = lambda name, row: reasons[(reasons.feature == name) & (reasons.date == pdf.date[row])].iloc[0]
    assert np.isnan(at("open_close_return", 30).value) and at("open_close_return", 30).reason == "calculation_invalid"
    assert at("return_1d", 41).reason == "calculation_invalid" and at("return_1d", 0).reason == "expected_missing"
    assert at("sma_5", 44).reason == "calculation_invalid" and at("sma_5", 45).reason == ""


def test_future_and_other_tickers_change_nothing(spark):
    one, two = wavy("AAA", 120), wavy("BBB", 120, seed=9)
    alone = run(spark, one)
    both = run(spark, pd.concat([one, two]))
    pd.testing.assert_frame_equal(both[both.ticker == "AAA"].reset_index(drop=True), alone)
    bent = one.copy()
    bent.loc[80:, ["open", "high", "low", "close", "volume"]] *= 3
    pd.testing.assert_frame_equal(run(spark, bent)[:80], alone[:80])


def test_target_is_exactly_the_horizon_row(spark):
    pdf = ohlcv(rows=80)
    targets = features.build_targets(spark.createDataFrame(pdf))
    out = targets.orderBy("feature_date").toPandas()
    assert len(out) == 80 and (~out.target_available).sum() == 21 and out.target_21d_return.isna().sum() == 21
    assert out.label_end_date[0] == pdf.date[21]
    audit = features.label_audit(targets)
    assert audit.where(~F.col("alignment_valid")).count() == 0
    broken = targets.withColumn("label_end_date", F.date_add("label_end_date", 1))
    assert features.label_audit(broken).where(~F.col("alignment_valid")).count() > 0


def test_join_keeps_tail_and_flags_duplicates(spark):
    df = spark.createDataFrame(ohlcv(rows=60))
    targets = features.build_targets(df)
    feats = features.add_returns(df, (5,)).select("ticker", "date", "return_5d")
    joined = features.join_targets(feats, targets)
    assert joined.count() == 60 and joined.where("matched_once").count() == 60
    doubled = features.join_targets(feats, targets.unionByName(targets.limit(1)))
    assert doubled.count() == 60 and doubled.where(~F.col("matched_once")).count() == 1


def test_model_columns_reject_label_semantics(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0, 3.0, 1)], "ticker string, ret double, target_x double, future_y double, n int")
    assert features.model_columns(df) == ["ret", "n"]
