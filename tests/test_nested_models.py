"""Nested selection: folds, moments, exact penalised fits and trees against direct computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, nested, trees

OUTER, INNER = {"splits": 3, "validation_rows": 6, "embargo_rows": 2}, {"splits": 2, "validation_rows": 5}
NAMES = ["f1", "f2", "f3", "f4"]


def table(spark, groups=3, days=90, seed=1):
    rng = np.random.default_rng(seed)
    parts = []
    for g in range(groups):
        dates = pd.date_range("2020-01-01", periods=days + g, freq="B")
        x = rng.normal(size=(len(dates), 3)) * [1, 10, 0.01] + [5, 1000, 0]
        frame = pd.DataFrame({"ticker": f"t{g}", "feature_date": dates.date, "label_end_date": (dates + pd.Timedelta(days=9)).date, "y": x[:, 0] * 0.1 + rng.normal(size=len(dates)) * 0.1})
        frame["f1"], frame["f2"], frame["f3"], frame["f4"] = x[:, 0], x[:, 1], x[:, 2], np.nan
        frame.loc[:15, "f2"] = np.nan
        parts.append(frame.sample(frac=1, random_state=g))
    made = spark.createDataFrame(pd.concat(parts))
    return made.select("ticker", "feature_date", "label_end_date", "y", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in NAMES])


def members(frame, outer, inner):
    outer_rows = folds.purged_folds(frame, outer["splits"], outer["validation_rows"], 0, ["ticker"], embargo_rows=outer["embargo_rows"])
    train = outer_rows.where("role = 'train'").withColumnRenamed("fold", "outer_fold").drop("pos", "role")
    return outer_rows.toPandas(), folds.purged_folds(train, inner["splits"], inner["validation_rows"], 0, ["ticker", "outer_fold"]).toPandas()


def test_fold_moments_equal_the_folds_and_numpy(spark):
    frame = table(spark)
    outer, inner = members(frame, OUTER, INNER)
    found = nested.fold_moments(frame, ["ticker"], NAMES, "y", OUTER, INNER).toPandas()
    assert len(found) == 3 * 3 * 3
    for row in found.itertuples():
        pool = outer[(outer.ticker == row.ticker) & (outer.fold == row.fold)] if pd.isna(row.inner) else inner[(inner.ticker == row.ticker) & (inner.outer_fold == row.fold) & (inner.fold == row.inner)]
        train, valid = (pool[pool.role == role].sort_values("feature_date") for role in ("train", "validation"))
        assert row.n == len(train) and list(row.v_feature_date) == list(valid.feature_date) and list(row.v_label_end_date) == list(valid.label_end_date)
        filled = train[NAMES].astype(float).fillna(train[NAMES].astype(float).median()).fillna(0.0).to_numpy()
        scales = filled.std(axis=0)
        scales[scales == 0] = 1.0
        z = (filled - filled.mean(axis=0)) / scales
        np.testing.assert_allclose(row.gram, (z.T @ z / len(z))[np.triu_indices(4)], atol=1e-10)
        np.testing.assert_allclose(row.side, z.T @ (train.y - train.y.mean()) / len(z), atol=1e-12)
        np.testing.assert_allclose(np.reshape(row.v_x, (-1, 4))[:, 0], (valid.f1 - filled[:, 0].mean()) / scales[0], atol=1e-10)


@pytest.mark.parametrize("shape", [(60, 5), (50, 12), (200, 38)])
def test_lasso_path_meets_its_optimality_conditions(shape):
    rng = np.random.default_rng(shape[1])
    base = rng.normal(size=shape)
    base[:, 1] = base[:, 0] + 0.01 * base[:, 1]
    if shape[1] > 10:
        base[:, 3], base[:, 4] = base[:, 2], 0.0  # a copy, and a constant
    scale = base.std(axis=0)
    z = (base - base.mean(axis=0)) / np.where(scale > 0, scale, 1.0)
    y = z[:, 0] * 0.02 - z[:, 2] * 0.01 + rng.normal(size=shape[0]) * 0.03
    gram, side = z.T @ z / len(z), z.T @ (y - y.mean()) / len(z)
    alphas = np.array([1e-6, 0.1, 1e-3, 1e-5, 1e-2, 1e-4])
    for alpha, beta in zip(alphas, nested.lasso_path(gram, side, alphas)):
        assert nested.violation(gram, side, beta, alpha) < 1e-9
    assert not nested.lasso_path(gram, side, np.array([1.0])).any()


def test_search_and_refit_equal_direct_fits(spark):
    frame = table(spark)
    penalties = [("Ridge", 0.1), ("Ridge", 10.0), ("Lasso", 0.001), ("Lasso", 0.05)]
    moments = nested.fold_moments(frame, ["ticker"], NAMES, "y", OUTER, INNER).cache()
    errors = nested.inner_errors(moments, ["ticker"], penalties).toPandas()
    assert len(errors) == 3 * 3 * 2 * 4
    _, inner = members(frame, OUTER, INNER)
    for row in errors.itertuples():
        pool = inner[(inner.ticker == row.ticker) & (inner.outer_fold == row.outer_fold) & (inner.fold == row.fold)]
        train, valid = (pool[pool.role == role] for role in ("train", "validation"))
        medians = train[NAMES[:3]].astype(float).median()
        x, v = (part[NAMES[:3]].astype(float).fillna(medians).to_numpy() for part in (train, valid))
        z, zv = (x - x.mean(0)) / x.std(0), (v - x.mean(0)) / x.std(0)
        centred = train.y - train.y.mean()
        beta = np.linalg.solve(z.T @ z + row.alpha * np.eye(3), z.T @ centred) if row.model == "Ridge" else nested.descended(z.T @ z / len(z), np.asarray(z.T @ centred / len(z)), row.alpha, np.zeros(3))
        assert row.mse == pytest.approx(((train.y.mean() + zv @ beta - valid.y) ** 2).mean(), rel=1e-8)
    chosen = moments.where("inner IS NULL").select("ticker", "fold", F.lit(0.1).alias("Ridge"), F.lit(0.001).alias("Lasso"))
    rows = nested.outer_predictions(moments, chosen, ["ticker"]).toPandas()
    assert rows.groupby("model").size().to_dict() == {"OLS": 54, "Ridge": 54, "Lasso": 54} and rows.predicted.notna().all()
    ols = rows[rows.model == "OLS"]
    assert ((ols.predicted - ols.actual) ** 2).mean() < ((ols.benchmark - ols.actual) ** 2).mean()


def tree_directly(x, y, w, valid, depth, least, penalty=0.0, least_weight=0.0, level=0):
    """Exhaustive recursive tree on the same bins; values of the validation rows."""
    inside = w > 0
    value = (w * y).sum() / (w.sum() + penalty) if w.sum() + penalty > 0 else 0.0
    best = None
    if depth is None or level < depth:
        for j in range(x.shape[1]):
            for cut in range(x[:, j].max()):
                left = x[:, j] <= cut
                if (left & inside).sum() < least or (~left & inside).sum() < least or w[left].sum() < least_weight or w[~left].sum() < least_weight:
                    continue
                gain = sum((w[side] * y[side]).sum() ** 2 / (w[side].sum() + penalty) for side in (left, ~left))
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, j, cut)
    if best is None or best[0] - (w * y).sum() ** 2 / (w.sum() + penalty) <= 1e-12 * max(abs((w * y).sum()), 1e-300):
        return np.full(len(valid), value)
    _, j, cut = best
    out, left, go = np.empty(len(valid)), x[:, j] <= cut, valid[:, j] <= cut
    out[go] = tree_directly(x[left], y[left], w[left], valid[go], depth, least, penalty, least_weight, level + 1)
    out[~go] = tree_directly(x[~left], y[~left], w[~left], valid[~go], depth, least, penalty, least_weight, level + 1)
    return out


@pytest.mark.parametrize("depth,least,penalty", [(1, 1, 0.0), (3, 5, 0.0), (None, 4, 0.0), (2, 1, 1.0), (3, 2, 10.0)])
def test_trees_equal_a_brute_force_tree(depth, least, penalty):
    rng = np.random.default_rng(least)
    raw = rng.normal(size=(140, 5))
    y = np.sin(raw[:, 0] * 2) + (raw[:, 1] > 0.3) * 0.7 + rng.normal(size=140) * 0.1
    bins = trees.binned(raw[:100], raw, 16)
    w = np.zeros((3, 140))
    w[:, :100] = rng.integers(0, 3, (3, 100))
    found = trees.grown(bins, w, np.r_[y[:100], np.zeros(40)][None, :], lambda owner: np.tile(np.arange(5), (len(owner), 1)), depth, least, 1.0 if penalty else 0.0, penalty)
    for t in range(3):
        direct = tree_directly(bins[:100], y[:100], w[t, :100], bins[100:], depth, least, penalty, 1.0 if penalty else 0.0)
        np.testing.assert_allclose(found[t, 100:], direct, atol=1e-9)


def test_boosting_equals_direct_rounds():
    rng = np.random.default_rng(5)
    raw = rng.normal(size=(120, 6))
    y = raw[:, 0] - 0.5 * raw[:, 1] ** 2
    bins, train = trees.binned(raw[:90], raw), 90
    found = trees.boosted(bins, y[:90], train, 3, 12, 2, 0.1, 0.8, 0.8, 1.0)
    draw, out = np.random.default_rng(3), np.full(120, y[:90].mean())
    for _ in range(12):
        w = (draw.random(train) < 0.8).astype(float)
        columns = np.sort(draw.permutation(6)[:4])
        out += 0.1 * tree_directly(bins[:90][:, columns], y[:90] - out[:90], w, bins[:, columns], 2, 1, 1.0, 1.0)
    np.testing.assert_allclose(found, out, atol=1e-9)


def test_ensembles_learn_and_repeat():
    rng = np.random.default_rng(6)
    raw = rng.normal(size=(400, 8))
    y = np.sign(raw[:, 0]) + 0.5 * raw[:, 1]
    bins = trees.binned(raw[:300], raw)
    forest = lambda: trees.forest(bins, y[:300], 300, 7, 40, None, 5, 0.5)
    boosted = trees.boosted(bins, y[:300], 300, 7, 100, 2, 0.1, 0.8, 0.8, 1.0)
    mean = ((y[300:] - y[:300].mean()) ** 2).mean()
    assert (forest() == forest()).all()
    assert ((forest()[300:] - y[300:]) ** 2).mean() < 0.4 * mean and ((boosted[300:] - y[300:]) ** 2).mean() < 0.2 * mean
    few = trees.binned(np.zeros((5, 2)), np.array([[0.0, 1.0], [-1.0, 0.0]]))
    assert (few == 0).all()


def test_tree_rows_of_every_fold(spark):
    frame = table(spark, days=70)
    presets = {"RandomForest": {"n_estimators": 10, "max_depth": 3, "min_samples_leaf": 3, "max_features": "sqrt"}, "XGBoost": {"n_estimators": 10, "max_depth": 2, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8, "reg_lambda": 1.0}}
    run = lambda: nested.tree_predictions(frame.repartition(3), ["ticker"], NAMES, "y", OUTER, presets).toPandas().sort_values(["ticker", "model", "fold", "feature_date"]).reset_index(drop=True)
    found = run()
    assert found.groupby("model").size().to_dict() == {"RandomForest": 54, "XGBoost": 54} and found.predicted.notna().all() and found.alpha.isna().all()
    pd.testing.assert_frame_equal(found, run())
    short = table(spark, groups=1, days=18)
    assert nested.tree_predictions(short, ["ticker"], NAMES, "y", OUTER, presets).count() == 0
    assert nested.fold_moments(short, ["ticker"], NAMES, "y", OUTER, INNER).count() == 0
