import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import day, model_rows
from tidemark.operators import folds, models


def brute_folds(rows, splits, size, cap, embargo):
    rows = rows.sort_values("feature_date").reset_index(drop=True)
    first = len(rows) - splits * size
    blocked, out = set(), []
    for k in range(splits):
        start = first + k * size
        candidates = [p for p in range(start) if p not in blocked]
        if cap:
            candidates = candidates[-cap:]
        opens = rows.feature_date[start]
        train = [p for p in candidates if rows.label_end_date[p] < opens]
        out.append((k, len(candidates), len(train), len(candidates) - len(train)))
        blocked.update(range(start + size, min(start + size + embargo, len(rows))))
    return out


@pytest.mark.parametrize("cap,embargo", [(None, 0), (150, 0), (150, 7), (None, 12)])
def test_purged_folds_match_brute_force(spark, cap, embargo):
    pdf = model_rows()
    pdf = pdf[pdf.target_available].assign(selection_date=day("2024-01-31"))
    members = folds.purged_folds(spark.createDataFrame(pdf), 3, 10, 100, max_train_rows=cap, embargo_rows=embargo)
    got = folds.fold_summary(members, 100).orderBy("fold").toPandas()
    want = brute_folds(pdf, 3, 10, cap, embargo)
    assert [(r.fold, r.train_rows_before_purge, r.train_rows_after_purge, r.purged_rows) for r in got.itertuples()] == want
    assert (got.train_label_end_max < got.validation_feature_start).all() and (got.validation_rows == 10).all() and got.purge_valid.all()


def test_too_few_rows_give_no_fold_and_short_training_is_flagged(spark):
    pdf = model_rows(rows=60)
    pdf = pdf[pdf.target_available].assign(selection_date=day("2024-01-31"))
    df = spark.createDataFrame(pdf)
    assert folds.purged_folds(df, 4, 10, 100).count() == 0
    summary = folds.fold_summary(folds.purged_folds(df, 2, 10, 100), 100).toPandas()
    assert (summary.fold_status == "insufficient_train_data").all()


def test_available_rows_match_brute_force(spark):
    pdf = pd.concat([model_rows("AAA"), model_rows("BBB", shift=0.3)])
    picks = pd.DataFrame({"ticker": ["AAA", "AAA", "BBB"], "selection_date": [day("2022-09-30"), day("2023-10-31"), day("2023-12-29")]})
    got = folds.available_as_of(spark.createDataFrame(pdf), spark.createDataFrame(picks), 1)
    counts = {(r.ticker, r.selection_date): r.n for r in got.groupBy("ticker", "selection_date").agg(F.count(F.lit(1)).alias("n")).collect()}
    for ticker, chosen in picks.itertuples(index=False):
        low = (pd.Timestamp(chosen) - pd.DateOffset(years=1)).date()
        rows = pdf[(pdf.ticker == ticker) & pdf.target_available]
        want = ((rows.feature_date >= low) & (rows.feature_date <= chosen) & (rows.label_end_date <= chosen)).sum()
        assert counts[(ticker, chosen)] == want


def test_walk_forward_matches_pandas(spark):
    rng = np.random.default_rng(5)
    n = 120
    pdf = pd.DataFrame({"ticker": "AAA", "date": pd.bdate_range("2020-01-01", periods=n).date, "ret": rng.normal(size=n), "market_ret": rng.normal(size=n)})
    out = folds.walk_forward_correlation(spark.createDataFrame(pdf), {"short": 20, "long": 50}, 10, 10).toPandas()
    for size, label in ((20, "short"), (50, "long")):
        origins = list(range(size, n - 10 + 1, 10))
        part = out[out.window == label].sort_values("testing_start_date").reset_index(drop=True)
        assert len(part) == len(origins)
        for row, o in zip(part.itertuples(), origins):
            assert row.estimated == pytest.approx(pdf.ret[o - size:o].corr(pdf.market_ret[o - size:o]))
            assert row.realized == pytest.approx(pdf.ret[o:o + 10].corr(pdf.market_ret[o:o + 10]))
            assert row.training_end_date == pdf.date[o - 1] and row.testing_end_date == pdf.date[o + 9]


def test_ridge_fits_match_direct_solution(spark):
    rng = np.random.default_rng(11)
    frames = []
    for group in ("a", "b"):
        x = rng.normal(size=(80, 2)) * [1.0, 5.0] + [0.5, -2.0]
        frames.append(pd.DataFrame({"g": group, "x1": x[:, 0], "x2": x[:, 1], "y": 0.3 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(0, 0.1, 80)}))
    pdf = pd.concat(frames)
    fits = models.ridge_fits(spark.createDataFrame(pdf), ["x1", "x2"], "y", ["g"], (0.0, 10.0)).toPandas()
    for row in fits.itertuples():
        part = pdf[pdf.g == row.g]
        x, y = part[["x1", "x2"]].to_numpy(), part.y.to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        beta = np.linalg.solve(z.T @ z + row.alpha * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
        np.testing.assert_allclose(row.coefficients, beta, rtol=1e-8)
        assert row.intercept == pytest.approx(y.mean() - beta @ x.mean(0))


def test_lasso_and_missing_features_meet_their_optimality_conditions(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(150, 3))
    pdf = pd.DataFrame({"g": "a", "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "x4": None, "y": x[:, 0] - 0.02 * x[:, 1] + rng.normal(0, 0.1, 150)}).astype({"x4": float})
    frame = spark.createDataFrame(pdf).withColumn("x4", F.when(~F.isnan("x4"), F.col("x4")))
    fits = models.linear_fits(frame, ["x1", "x2", "x3", "x4"], "y", ["g"], [("OLS", 0.0), ("Lasso", 0.1)]).toPandas().set_index("model")
    z, y = (x - x.mean(0)) / x.std(0), pdf.y - pdf.y.mean()
    np.testing.assert_allclose(fits.coefficients["OLS"][:3], np.linalg.lstsq(z, y, rcond=None)[0] / x.std(0), rtol=1e-8)
    beta = np.array(fits.coefficients["Lasso"][:3]) * x.std(0)
    slope = z.T @ (y - z @ beta) / len(y)
    assert all(abs(s - 0.1 * np.sign(b)) < 1e-8 if b else abs(s) <= 0.1 + 1e-8 for s, b in zip(slope, beta)) and beta[1] == 0
    assert fits.coefficients["OLS"][3] == 0


def test_forward_lookup_is_strictly_later(spark):
    from tidemark.operators import align

    events = spark.createDataFrame([("a", d) for d in range(0, 20, 3)], "ticker string, date int")
    facts = spark.createDataFrame([("a", d, d) for d in range(0, 18, 2)], "ticker string, date int, seen int")
    found = {r.date: r.seen for r in align.asof_forward(events, facts, ["ticker"], ["seen"]).collect()}
    assert found == {d: next((f for f in range(0, 18, 2) if f > d), None) for d in range(0, 20, 3)}


def test_purge_counts_equal_the_inequality_join(spark):
    from tidemark.plans.joins import purge_by_quarter

    days = pd.date_range("2020-01-01", periods=400, freq="2D")
    pdf = pd.DataFrame({"ticker": "a", "feature_date": days.date, "label_end_date": (days + pd.Timedelta(days=40)).date})
    found = {r.validation_start: (r.kept, r.purged) for r in purge_by_quarter(spark.createDataFrame(pdf)).collect()}
    assert len(found) == 9 and sum(k for k, _ in found.values()) > 0
    for start, (kept, purged) in found.items():
        assert kept == (pdf.label_end_date < start).sum() and purged == ((pdf.feature_date < start) & (pdf.label_end_date >= start)).sum()


def metric_rows(errors):
    mse = [1.08, 1.06, 1.04, 1.02, 1.00]
    return [("T", m, v, e, "ok") for m, v, e in zip(models.COMPLEXITY, mse, errors)]


SCHEMA = "ticker string, model string, mean_validation_mse double, standard_error_mse double, model_status string"


def test_one_standard_error_rule(spark):
    out = models.one_se_rule(spark.createDataFrame(metric_rows([0.02, 0.02, 0.03, 0.05, 0.10]), SCHEMA), ["ticker"]).toPandas().set_index("model")
    assert out.selected_by_minimum_mse["XGBoost"] and out.one_se_threshold.iloc[0] == pytest.approx(1.10)
    assert out.index[out.selected_after_one_se_rule].tolist() == ["OLS"]
    no_error = models.one_se_rule(spark.createDataFrame(metric_rows([0.02, 0.02, 0.03, 0.05, None]), SCHEMA), ["ticker"]).toPandas().set_index("model")
    assert no_error.index[no_error.selected_after_one_se_rule].tolist() == ["XGBoost"]


PREDICTIONS = "m string, fold int, actual double, predicted double, benchmark double, prediction_status string"


def test_metrics_use_the_fold_benchmark(spark):
    rows = [("m", 0, 1.0, 1.1, 0.5, "success"), ("m", 0, 2.0, 1.9, 0.5, "success"), ("m", 1, 3.0, 3.1, 2.5, "success"), ("m", 1, 4.0, 3.9, 2.5, "success")]
    out = models.model_metrics(spark.createDataFrame(rows, PREDICTIONS), ["m"]).first()
    assert out.oos_r2 == pytest.approx(1 - 0.04 / 5.0) and out.outer_fold_count == 2 and out.directional_accuracy == 1.0


def test_constant_and_failed_predictions_have_reasons(spark):
    rows = [("flat", 0, 1.0, 0.5, 0.0, "success"), ("flat", 0, 2.0, 0.5, 0.0, "success"), ("bad", 0, 1.0, None, 0.0, "failed")]
    out = {r.m: r for r in models.model_metrics(spark.createDataFrame(rows, PREDICTIONS), ["m"]).collect()}
    assert out["flat"].prediction_correlation is None and out["flat"].metric_notes == "predicted_return_is_constant"
    assert out["bad"].outer_fold_count == 0 and out["bad"].metric_notes == "no_successful_outer_predictions"
