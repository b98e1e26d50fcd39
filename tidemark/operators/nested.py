"""Nested selection of models for many tickers and months: purged folds, linear fits and trees in grouped passes.

The rows of one ticker as of one month are a group; it never exceeds the trading days of the training years.
One pass turns a group into a row for each outer fold and each of its inner folds: medians, means, deviations,
the packed matrix of second moments, and the validation rows, all in terms of that fold's training rows. Linear
models of all folds are then solved from these rows in stacks; trees need the training rows and grow in a pass
of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import spread
from tidemark.operators import trees

#: Fold rows that are solved together.
STACK = 256
NUMBERS, DATES = pa.list_(pa.float64()), pa.list_(pa.date32())


def purged(dates: np.ndarray, label_ends: np.ndarray, splits: int, validation_rows: int, embargo_rows: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fold, training places, validation places) of rows in date order, by the rule of folds.purged_folds."""
    n = len(dates)
    first, at = n - splits * validation_rows, np.arange(n)
    if first <= 0:
        return
    for k in range(splits):
        begin = first + k * validation_rows
        kept = at < begin
        for earlier in range(k):
            end = first + (earlier + 1) * validation_rows
            kept &= (at < end) | (at >= end + embargo_rows)
        yield k, np.flatnonzero(kept & (label_ends < dates[begin])), np.arange(begin, begin + validation_rows)


def nested_folds(dates: np.ndarray, label_ends: np.ndarray, outer: dict, inner: dict | None) -> Iterator[tuple[int, int | None, np.ndarray, np.ndarray]]:
    """(fold, inner fold or None, training places, validation places); inner folds lie inside the outer training rows."""
    for fold, train, valid in purged(dates, label_ends, **outer):
        yield fold, None, train, valid
        for number, part, check in purged(dates[train], label_ends[train], **inner) if inner else ():
            yield fold, number, train[part], train[check]


def filled(x: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Missing values take the median of the training rows, or 0 where the feature has no training value; and the medians."""
    known = ~np.isnan(x[train])
    medians = np.zeros(x.shape[1])
    some = known.any(axis=0)
    if some.any():
        medians[some] = np.nanmedian(x[train][:, some], axis=0)
    # A feature without a training value takes no part, whatever the validation rows have.
    return np.where(some, np.where(np.isnan(x), medians, x), 0.0), medians


def group_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dates, label ends, targets and the matrix of features of a group, by date."""
    dates = table.column("feature_date").to_numpy()
    order = np.argsort(dates, kind="stable")
    flat = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return dates[order], table.column("label_end_date").to_numpy()[order], table.column("y").to_numpy()[order], flat.reshape(len(order), -1)[order]


def grouped(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str):
    """Groups of rows with their features in one array, spread over the cores: few bytes, but much work per row."""
    picked = rows.select(*keys, "feature_date", "label_end_date", F.col(target).cast("double").alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.select(*keys).schema.fields)
    return spread(picked, *keys).groupBy(*keys), schema


def fold_moments(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, outer: dict, inner: dict | None = None) -> DataFrame:
    """One row per group, outer fold and inner fold (null for the outer fold itself).

    n, y_mean, medians, means, scales (population deviation, 1 for a constant feature), gram (upper triangle of
    the correlations, row by row), side (covariance of scaled features and target), and the validation rows:
    v_x (scaled, one after the other), v_y, v_feature_date, v_label_end_date. A fold without training rows has
    no row.
    """
    grouping, key_schema = grouped(rows, keys, features, target)
    upper = np.triu_indices(len(features))

    def run(table: pa.Table) -> pa.Table:
        dates, ends, y, x = group_rows(table)
        out: dict[str, list] = {c: [] for c in ("fold", "inner", "n", "y_mean", "medians", "means", "scales", "gram", "side", "v_x", "v_y", "v_feature_date", "v_label_end_date")}
        for fold, number, train, valid in nested_folds(dates, ends, outer, inner):
            if not len(train):
                continue
            values, medians = filled(x, train)
            means = values[train].mean(axis=0)
            scales = values[train].std(axis=0)
            scales[scales <= 1e-12 * np.maximum(np.abs(means), 1e-300)] = 1.0
            z, centre = (values - means) / scales, y[train].mean()
            gram = z[train].T @ z[train] / len(train)
            for name, value in zip(out, (fold, number, len(train), centre, medians, means, scales, gram[upper], z[train].T @ (y[train] - centre) / len(train), z[valid].ravel(), y[valid], dates[valid].tolist(), ends[valid].tolist())):
                out[name].append(value)
        kinds = {"fold": pa.int32(), "inner": pa.int32(), "n": pa.int64(), "y_mean": pa.float64(), "v_feature_date": DATES, "v_label_end_date": DATES}
        made = {name: pa.array(values, kinds.get(name, NUMBERS)) for name, values in out.items()}
        return pa.table({k: pa.array([table.column(k)[0].as_py()] * len(out["n"]), table.schema.field(k).type) for k in keys} | made)

    numbers = ", ".join(f"{c} array<double>" for c in ("medians", "means", "scales", "gram", "side", "v_x", "v_y"))
    return grouping.applyInArrow(run, f"{key_schema}, fold int, inner int, n bigint, y_mean double, {numbers}, v_feature_date array<date>, v_label_end_date array<date>")


def lasso_path(gram: np.ndarray, side: np.ndarray, alphas: Sequence[float]) -> np.ndarray:
    """Exact coefficients at each penalty: the solution is linear between the penalties at which a feature enters or leaves.

    Minimises b'Gb/2 - side'b + alpha |b|. Columns that hang on those already in stay out.
    """
    p = len(side)
    order = np.argsort(alphas)[::-1]
    out = np.zeros((len(alphas), p))
    beta, c = np.zeros(p), side.copy()
    level, todo, barred = float(np.abs(c).max(initial=0.0)), list(order), np.diag(gram) <= 0
    active: list[int] = []
    gone = None  # has just left: it keeps the full correlation for this step and must not come back in it
    while todo and alphas[todo[0]] >= level:
        todo.pop(0)
    for _ in range(40 * p + 40):
        if not todo:
            break
        free = [j for j in range(p) if j not in active and j != gone and not barred[j] and abs(c[j]) >= level * (1 - 1e-10) - 1e-15]
        for j in free:
            trial = [*active, j]
            if np.linalg.matrix_rank(gram[np.ix_(trial, trial)], tol=1e-10) < len(trial):
                barred[j] = True
            else:
                active.append(j)
        if not active:
            break
        signs = np.sign(np.where(beta[active] != 0, beta[active], c[active]))
        move = np.linalg.solve(gram[np.ix_(active, active)], signs)
        slope = gram[:, active] @ move
        step, leaves = level - max(alphas[todo[0]], 0.0), None
        for j in range(p):
            if j in active or barred[j]:
                continue
            for gap, rate in ((level - c[j], 1 - slope[j]), (level + c[j], 1 + slope[j])):
                if rate > 1e-12 and (1e-9 * level if j == gone else 1e-14) < gap / rate < step:
                    step, leaves = gap / rate, None
        for i, j in enumerate(active):
            if move[i] * beta[j] < 0 and 0 < -beta[j] / move[i] < step:
                step, leaves = -beta[j] / move[i], j
        beta[active] += step * move
        c, level = c - step * slope, level - step
        gone = leaves
        if leaves is not None:
            beta[leaves] = 0.0
            active.remove(leaves)
            barred = (np.diag(gram) <= 0) | (barred & (np.abs(gram[leaves]) > 1 - 1e-9))
        while todo and alphas[todo[0]] >= level - 1e-15:
            out[todo.pop(0)] = beta
    for i in todo:
        out[i] = beta
    for i, alpha in enumerate(alphas):
        if violation(gram, side, out[i], alpha) > 1e-8 * max(1.0, float(np.abs(side).max(initial=0.0))):
            out[i] = descended(gram, side, alpha, out[i])
    return out


def violation(gram: np.ndarray, side: np.ndarray, beta: np.ndarray, alpha: float) -> float:
    """Largest departure from the optimality conditions of the penalised problem."""
    slope = side - gram @ beta
    return float(np.where(beta != 0, np.abs(slope - alpha * np.sign(beta)), np.maximum(np.abs(slope) - alpha, 0.0)).max(initial=0.0))


def descended(gram: np.ndarray, side: np.ndarray, alpha: float, start: np.ndarray, sweeps: int = 20_000) -> np.ndarray:
    """Coordinate descent, for the rare case that rounding breaks the path."""
    beta, own = start.copy(), np.where(np.diag(gram) > 0, np.diag(gram), 1.0)
    for _ in range(sweeps):
        before = beta.copy()
        for j in range(len(beta)):
            rest = side[j] - gram[j] @ beta + gram[j, j] * beta[j]
            beta[j] = np.sign(rest) * max(abs(rest) - alpha, 0.0) / own[j]
        if np.abs(beta - before).max() < 1e-12:
            break
    return beta


def stacks(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch with their matrices: gram, side, n, validation rows and targets."""
    for start in range(0, len(pdf), STACK):
        part = pdf.iloc[start : start + STACK]
        side = np.stack(part["side"].to_numpy())
        p = side.shape[1]
        upper = np.triu_indices(p)
        gram = np.zeros((len(part), p, p))
        gram[:, upper[0], upper[1]] = gram[:, upper[1], upper[0]] = np.stack(part["gram"].to_numpy())
        checks = np.stack(part["v_x"].to_numpy()).reshape(len(part), -1, p)
        yield part, gram, side, part["n"].to_numpy(float), checks, np.stack(part["v_y"].to_numpy())


def coefficients(gram: np.ndarray, side: np.ndarray, n: np.ndarray, model: str, alphas: np.ndarray) -> np.ndarray:
    """(fold rows, penalties, features) in scaled terms; alphas is (fold rows, penalties)."""
    if model == "Lasso":
        return np.stack([lasso_path(g, s, a) for g, s, a in zip(gram, side, alphas)])
    if model == "OLS":
        solved = (np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ side[:, :, None])[:, :, 0]
        return np.repeat(solved[:, None, :], alphas.shape[1], axis=1)
    eye = np.eye(side.shape[1])
    return np.stack([np.linalg.solve(gram + eye * (alphas[:, k] / n)[:, None, None], side[:, :, None])[:, :, 0] for k in range(alphas.shape[1])], axis=1)


def inner_errors(moments: DataFrame, keys: Sequence[str], penalties: Sequence[tuple[str, float]]) -> DataFrame:
    """Validation error of each inner fold, model and penalty: keys, outer_fold, fold, model, alpha, mse."""
    models = list(dict.fromkeys(m for m, _ in penalties))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, gram, side, n, checks, actual in stacks(pdf):
                for model in models:
                    alphas = np.array([a for m, a in penalties if m == model])
                    beta = coefficients(gram, side, n, model, np.tile(alphas, (len(part), 1)))
                    predicted = part["y_mean"].to_numpy()[:, None, None] + np.einsum("bvp,bkp->bkv", checks, beta)
                    mse = ((predicted - actual[:, None, :]) ** 2).mean(axis=2)
                    for k, alpha in enumerate(alphas):
                        out = part[list(keys)].copy()
                        out["outer_fold"], out["fold"], out["model"], out["alpha"], out["mse"] = part["fold"], part["inner"], model, float(alpha), mse[:, k]
                        yield out

    kept = moments.where("inner IS NOT NULL").select(*keys, "fold", "inner", "n", "y_mean", "gram", "side", "v_x", "v_y")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*keys).schema.fields)
    return kept.mapInPandas(run, f"{schema}, outer_fold int, fold int, model string, alpha double, mse double")


PREDICTED = "fold int, model string, alpha double, feature_date date, label_end_date date, actual double, predicted double, benchmark double, train_rows bigint"


def outer_predictions(moments: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per validation row of each outer fold and linear model, refitted at the penalty chosen for it.

    `chosen` has keys, fold and one column of the penalty for each penalised model, named like the model.
    """
    models = [c for c in chosen.columns if c not in (*keys, "fold")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, gram, side, n, checks, actual in stacks(pdf):
                for model in ("OLS", *models):
                    alphas = part[model].to_numpy(float)[:, None] if model in models else np.zeros((len(part), 1))
                    beta = coefficients(gram, side, n, model, alphas)[:, 0]
                    predicted = part["y_mean"].to_numpy()[:, None] + np.einsum("bvp,bp->bv", checks, beta)
                    width = actual.shape[1]
                    out = part[list(keys)].loc[part.index.repeat(width)].reset_index(drop=True)
                    for name, values in (("fold", part["fold"]), ("alpha", alphas[:, 0]), ("benchmark", part["y_mean"]), ("train_rows", part["n"])):
                        out[name] = np.repeat(np.asarray(values), width)
                    out["model"], out["actual"], out["predicted"] = model, actual.ravel(), predicted.ravel()
                    out["feature_date"], out["label_end_date"] = (np.concatenate(part[c].to_numpy()) for c in ("v_feature_date", "v_label_end_date"))
                    yield out

    kept = moments.where("inner IS NULL").drop("inner", "medians", "means", "scales").join(chosen, [*keys, "fold"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*keys).schema.fields)
    return kept.mapInPandas(run, f"{schema}, {PREDICTED}")


def seed_of(*parts) -> int:
    """A digest, so that a lost task grows the same trees again."""
    return zlib.crc32("|".join(map(str, parts)).encode())


def tree_predictions(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, outer: dict, presets: dict[str, dict]) -> DataFrame:
    """Forest and boosted trees refitted on each outer training set; rows as in outer_predictions, alpha null."""
    grouping, key_schema = grouped(rows, keys, features, target)
    fit = {"RandomForest": trees.forest, "XGBoost": trees.boosted}

    def run(table: pa.Table) -> pa.Table:
        dates, ends, y, x = group_rows(table)
        held = [table.column(k)[0].as_py() for k in keys]
        out: dict[str, list] = {c: [] for c in ("fold", "model", "feature_date", "label_end_date", "actual", "predicted", "benchmark", "train_rows")}
        for fold, _, train, valid in nested_folds(dates, ends, outer, None):
            if not len(train):
                continue
            values, _ = filled(x, train)
            bins = trees.binned(values[train], values[np.concatenate([train, valid])])
            for model, parameters in presets.items():
                predicted = fit[model](bins, y[train], len(train), seed_of(*held, fold, model), **parameters)[len(train) :]
                for name, value in zip(out, (np.full(len(valid), fold), np.full(len(valid), model, object), dates[valid], ends[valid], y[valid], predicted, np.full(len(valid), y[train].mean()), np.full(len(valid), len(train)))):
                    out[name].append(value)
        kinds = {"fold": pa.int32(), "model": pa.string(), "feature_date": pa.date32(), "label_end_date": pa.date32(), "train_rows": pa.int64()}
        made = {name: pa.array(np.concatenate(values) if values else [], kinds.get(name, pa.float64())) for name, values in out.items()}
        size = len(made["fold"])
        made["alpha"] = pa.nulls(size, pa.float64())
        table_keys = {k: pa.array([v] * size, table.schema.field(k).type) for k, v in zip(keys, held)}
        return pa.table(table_keys | {c.split()[0]: made[c.split()[0]] for c in PREDICTED.split(", ")})

    return grouping.applyInArrow(run, f"{key_schema}, {PREDICTED}")
