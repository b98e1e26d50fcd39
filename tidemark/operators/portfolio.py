"""Weight tables: construction, validation, risk and returns, for many portfolios at once."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hex_uniform


def equal_weights(universe: DataFrame, groups: Sequence[str] = (), name: str = "equal") -> DataFrame:
    size = F.count(F.lit(1)).over(Window.partitionBy(*groups)) if groups else universe.agg(F.count(F.lit(1))).scalar()
    return universe.select(*groups, F.lit(name).alias("portfolio"), "ticker", (F.lit(1.0) / size).alias("weight"))


def normalize(coefficients: DataFrame, keys: Sequence[str] = ("portfolio",), value: str = "coefficient") -> DataFrame:
    """Non-negative coefficients to weights; a group with a negative or no mass yields NULL."""
    part = Window.partitionBy(*keys)
    usable = F.min(value).over(part) >= 0
    share = F.try_divide(F.col(value), F.sum(value).over(part))
    return coefficients.withColumn("weight", F.when(usable, share)).drop(value)


def inverse_volatility(sigma: DataFrame, groups: Sequence[str] = (), name: str = "inverse_vol") -> DataFrame:
    raw = sigma.select(
        *groups, F.lit(name).alias("portfolio"), "ticker",
        F.coalesce(F.try_divide(F.lit(1.0), F.col("sigma")), F.lit(1.0)).alias("coefficient"),
    )
    return normalize(raw, [*groups, "portfolio"])


def portfolio_returns(returns: DataFrame, weights: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """sum(w * r) per portfolio and date; the map side folds a date before it moves."""
    return (
        returns.join(weights, [*groups, "ticker"])
        .groupBy(*groups, "portfolio", "date")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    )


def diversification_ratio(weights: DataFrame, sigma: DataFrame, cov: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """w'sigma / sqrt(w' Cov w) for any number of portfolios."""
    keys = [*groups, "portfolio"]
    average = weights.join(sigma, [*groups, "ticker"]).groupBy(*keys).agg(
        F.sum(F.col("weight") * F.col("sigma")).alias("weighted_sigma")
    )
    left = weights.select(*keys, F.col("ticker").alias("i"), F.col("weight").alias("wi"))
    right = weights.select(*keys, F.col("ticker").alias("j"), F.col("weight").alias("wj"))
    variance = (
        left.join(cov, [*groups, "i"]).join(right, [*keys, "j"])
        .groupBy(*keys).agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov")).alias("variance"))
    )
    return average.join(variance, keys).withColumn(
        "diversification_ratio", F.try_divide(F.col("weighted_sigma"), F.sqrt("variance"))
    )


def constraint_report(
    weights: DataFrame, keys: Sequence[str], lower: float, upper: float, tolerance: float = 1e-8
) -> DataFrame:
    """Finite, fully invested and inside the bounds, per portfolio."""
    w = F.col("weight")
    low, high = F.lit(lower - tolerance), F.lit(upper + tolerance)
    out = weights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("assets"),
        F.count_if(w.isNull() | F.isnan(w)).alias("not_finite"),
        (F.abs(F.sum(w) - 1) <= tolerance).alias("sums_to_one"),
        F.count_if(w < low).alias("below_lower"),
        F.count_if(w > high).alias("above_upper"),
    )
    return out.withColumn(
        "satisfied",
        (F.col("not_finite") == 0) & F.col("sums_to_one") & (F.col("below_lower") == 0) & (F.col("above_upper") == 0),
    )


def concentration(weights: DataFrame, keys: Sequence[str] = ("portfolio",), active: float = 1e-6) -> DataFrame:
    top = F.slice(F.sort_array(F.collect_list("weight"), asc=False), 1, 3)
    return (
        weights.groupBy(*keys)
        .agg(
            F.max("weight").alias("max_weight"),
            F.sum(F.col("weight") * F.col("weight")).alias("hhi"),
            F.count_if(F.col("weight") > active).alias("active_count"),
            F.aggregate(top, F.lit(0.0), lambda total, w: total + w).alias("top3_weight"),
        )
        .withColumn("effective_n", F.try_divide(F.lit(1.0), F.col("hhi")))
    )


def pack_matrix(cov: DataFrame, groups: Sequence[str], value: str = "cov") -> DataFrame:
    """Long K x K form to one row per group with the tickers and an array of arrays."""
    rows = cov.groupBy(*groups, "i").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", value))), lambda c: c[value]).alias("row")
    )
    cells = rows.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("rows"))
    return cells.select(
        *groups,
        F.transform("rows", lambda c: c["i"]).alias("tickers"),
        F.transform("rows", lambda c: c["row"]).alias("matrix"),
    )


def long_only_optimum(corr: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """y >= 0 that minimises y'Cy/2 - sum(y): an asset enters while its gradient is negative, and leaves at zero."""
    size = len(corr)
    y, free = np.zeros(size), np.zeros(size, dtype=bool)
    for _ in range(10 * size + 10):
        gain = np.where(free, -np.inf, 1.0 - corr @ y)
        if gain.max() <= tolerance:
            break
        free[gain.argmax()] = True
        while free.any():
            target = np.zeros(size)
            target[free] = np.linalg.lstsq(corr[np.ix_(free, free)], np.ones(int(free.sum())), rcond=None)[0]
            falling = free & (target <= tolerance)
            if not falling.any():
                y = target
                break
            y = y + (y[falling] / (y[falling] - target[falling])).min() * (target - y)
            free &= y > tolerance
            y[~free] = 0.0
    return y


def _solved(cov: DataFrame, groups: Sequence[str], columns: str, solve) -> DataFrame:
    """One matrix per group goes to `solve(sigma, corr)`, which returns the columns next to ticker.

    A matrix holds one group's selected universe, K x K by definition; groups are spread over tasks.
    """
    schema = ", ".join([f"{g} {cov.schema[g].dataType.simpleString()}" for g in groups] + ["ticker string", columns])

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                matrix = np.array([list(r) for r in row.matrix], dtype=float)
                sigma = np.sqrt(np.diag(matrix))
                usable = bool(np.isfinite(matrix).all() and (sigma > 0).all())
                frame = pd.DataFrame({g: getattr(row, g) for g in groups}, index=range(len(sigma)))
                frame["ticker"] = list(row.tickers)
                corr = matrix / np.outer(sigma, sigma) if usable else np.zeros_like(matrix)
                out.append(frame.assign(**solve(sigma, corr)))
            if out:
                yield pd.concat(out, ignore_index=True)

    return pack_matrix(cov, groups).mapInPandas(run, schema)


def most_diversified(cov: DataFrame, groups: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Long-only weights of maximum diversification ratio for every group.

    Minimise y'Cy/2 - sum(y) over y >= 0 with C the correlation matrix by an active set; then w_i is
    proportional to y_i / sigma_i. Next to the weights stand the largest violation of the optimality conditions
    and a status: ``optimal``, ``singular`` (C has no full rank, so weights may not be unique) or ``no_optimum``,
    whose weights are null. No group is dropped.
    """
    def solve(sigma, corr):
        y = long_only_optimum(corr)
        residual = float(np.abs(np.minimum(y, corr @ y - 1)).max())
        full = np.linalg.matrix_rank(corr, hermitian=True) == len(corr)
        raw = y / np.where(sigma > 0, sigma, 1.0)
        found = residual < tolerance and raw.sum() > 0
        return {"sigma": sigma, "weight": raw / raw.sum() if found else np.nan, "kkt_residual": residual, "status": ("optimal" if full else "singular") if found else "no_optimum"}

    out = _solved(cov, groups, "sigma double, weight double, kkt_residual double, status string", solve)
    return out.withColumn("weight", F.nanvl("weight", F.lit(None)))


def analytic_weights(cov: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Unconstrained inverse(Cov) * sigma, normalised, one small solve per group.

    A matrix without full rank has status ``singular`` and null weights.
    """
    def solve(sigma, corr):
        if np.linalg.matrix_rank(corr, hermitian=True) < len(corr):
            return {"weight": np.nan, "analytic_dr": np.nan, "status": "singular"}
        y = np.linalg.solve(corr, np.ones(len(corr)))
        raw = y / sigma
        return {"weight": raw / raw.sum(), "analytic_dr": float(np.sqrt(y.sum())), "status": "solved"}

    out = _solved(cov, groups, "weight double, analytic_dr double, status string", solve)
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("weight", "analytic_dr")})


def project_rows(points: np.ndarray, lower: float, upper: float) -> np.ndarray:
    """Each vector along the last axis to the nearest one with sum 1 inside the bounds.

    Bisection finds the shift closely enough to know which entries are free; these then give it exactly.
    """
    low, high = points.min(-1, keepdims=True) - upper, points.max(-1, keepdims=True) - lower
    for _ in range(50):
        mid = (low + high) / 2
        heavy = np.clip(points - mid, lower, upper).sum(-1, keepdims=True) > 1
        low, high = np.where(heavy, mid, low), np.where(heavy, high, mid)
    near = points - (low + high) / 2
    free = (near > lower) & (near < upper)
    missing = 1.0 - np.clip(near, lower, upper).sum(-1, keepdims=True)
    return np.clip(near + missing / np.maximum(free.sum(-1, keepdims=True), 1), lower, upper)


def ratio_ascent(gain: np.ndarray, cov: np.ndarray, starts: np.ndarray, lower: float, upper: float, rounds: int = 3000, tolerance: float = 1e-8):
    """Projected gradient ascent of w'gain / sqrt(w'Cov w) from many starts of many problems at once.

    gain: problems x K, cov: problems x K x K, starts: problems x starts x K. A start whose step does not raise its value
    enough takes a quarter of it; after a step the next one follows from the change of the slope. Returns the points,
    their values and the length of a projected step of one along the slope, which is zero at a stationary point. The ratio
    is not concave where the gain is negative, so a point is the best one only as far as the starts reach.
    """
    scale = np.abs(gain).max(-1)[:, None, None]
    size = np.trace(cov, axis1=-2, axis2=-1)[:, None, None] / cov.shape[-1]
    c, matrix = gain[:, None, :] / scale, cov / size

    def valued(w):
        pull = w @ matrix
        deviation = np.sqrt((pull * w).sum(-1, keepdims=True))
        value = (w * c).sum(-1, keepdims=True) / deviation
        return value[..., 0], (c - value * pull / deviation) / deviation

    w = project_rows(starts, lower, upper)
    value, slope = valued(w)
    residual = np.abs(project_rows(w + slope, lower, upper) - w).max(-1)
    step = np.ones(value.shape)
    for _ in range(rounds):
        live = (residual > tolerance) & (step > 1e-12)
        if not live.any():
            break
        moved = project_rows(w + step[..., None] * slope, lower, upper)
        change = moved - w
        new, new_slope = valued(moved)
        better = live & (new >= value + 1e-4 * (slope * change).sum(-1) - 1e-15 * (1 + np.abs(value)))
        bend = -(change * (new_slope - slope)).sum(-1)
        length = (change * change).sum(-1)
        following = np.where(bend > 0, np.clip(length / np.where(bend > 0, bend, 1.0), 1e-6, 1e6), np.minimum(step * 4, 1e6))
        w, slope = np.where(better[..., None], moved, w), np.where(better[..., None], new_slope, slope)
        value, step = np.where(better, new, value), np.where(better, following, np.where(live, step / 4, step))
        residual = np.abs(project_rows(w + slope, lower, upper) - w).max(-1)
    return w, value * scale[..., 0] / np.sqrt(size[..., 0]), residual


def bounded_optimum(
    cov: DataFrame, groups: Sequence[str], market: str, lower: float, upper: float, starts: int = 64, seed: int = 0, tolerance: float = 1e-6
) -> DataFrame:
    """Fully invested weights inside the bounds with the largest diversification ratio and the least market correlation.

    ``cov`` is the long covariance of each group with the benchmark ``market`` as one of its tickers. Per group, objective
    and ticker: weight, the objective's value, the best value among the projected starts, the residual of the optimality
    condition, how many starts there were and how many reach the same value, and a status: ``stationary``, ``unfinished``
    (residual above the tolerance), ``infeasible`` (bounds leave no portfolio) or ``no_optimum`` (a moment is missing or no
    variance); the last two have null weights. No group is dropped. Starts are equal weights and draws seeded by the
    group, so a lost task finds the same point. Matrices of a batch with equally many tickers are solved together.
    """
    schema = ", ".join(
        [f"{g} {cov.schema[g].dataType.simpleString()}" for g in groups]
        + ["objective string, ticker string, weight double, value double, start_value double, residual double, starts int, agreeing int, status string"]
    )

    def drawn(key, size):
        rng = np.random.default_rng(int.from_bytes(sha256(repr((seed, key)).encode()).digest()[:8], "big"))
        return np.vstack([np.full(size, 1.0 / size), rng.dirichlet(np.ones(size), starts - 1)])

    def run(batches):
        for pdf in batches:
            out, problems = [], {}
            for row in pdf.itertuples(index=False):
                matrix, tickers = np.array([list(r) for r in row.matrix], dtype=float), list(row.tickers)
                key = tuple(getattr(row, g) for g in groups)
                own = [i for i, t in enumerate(tickers) if t != market]
                names = [tickers[i] for i in own]
                usable = len(own) < len(tickers) and len(own) > 0 and matrix.shape == (len(tickers),) * 2 and bool(np.isfinite(matrix).all() and (np.diag(matrix) > 0).all())
                feasible = len(own) * lower <= 1 + 1e-12 and len(own) * upper >= 1 - 1e-12
                for objective in ("max_diversification", "min_market_correlation"):
                    if not usable or not feasible:
                        out.append((key, objective, names, None, None, None, None, 0, "infeasible" if usable else "no_optimum"))
                        continue
                    at = tickers.index(market)
                    gain = np.sqrt(np.diag(matrix))[own] if objective == "max_diversification" else -matrix[own, at] / np.sqrt(matrix[at, at])
                    if not np.abs(gain).max() > 0:
                        out.append((key, objective, names, None, None, None, None, 0, "no_optimum"))
                        continue
                    problems.setdefault(len(own), []).append((key, objective, names, gain, matrix[np.ix_(own, own)], drawn((key, objective), len(own))))
            for same in problems.values():
                gain, matrix, first = (np.stack([p[i] for p in same]) for i in (3, 4, 5))
                at_start = project_rows(first, lower, upper)
                before = (at_start * gain[:, None, :]).sum(-1) / np.sqrt(((at_start @ matrix) * at_start).sum(-1))
                points, values, residuals = ratio_ascent(gain, matrix, first, lower, upper)
                for i, (key, objective, names, *_) in enumerate(same):
                    best, sign = int(values[i].argmax()), 1.0 if objective == "max_diversification" else -1.0
                    agreeing = int((values[i] >= values[i, best] - 1e-7 * max(1.0, abs(values[i, best]))).sum())
                    status = "stationary" if residuals[i, best] <= tolerance else "unfinished"
                    out.append((key, objective, names, points[i, best], sign * values[i, best], sign * before[i].max(), residuals[i, best], agreeing, status))
            frames = [
                pd.DataFrame({
                    **dict(zip(groups, key)), "objective": objective, "ticker": names, "weight": np.nan if weight is None else weight, "value": np.nan if value is None else value,
                    "start_value": np.nan if first is None else first, "residual": np.nan if residual is None else residual, "starts": starts, "agreeing": agreeing, "status": status,
                })
                for key, objective, names, weight, value, first, residual, agreeing, status in out
                if names
            ]
            if frames:
                yield pd.concat(frames, ignore_index=True)

    solved = pack_matrix(cov, groups).mapInPandas(run, schema)
    return solved.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("weight", "value", "start_value", "residual")})


def candidate_grid(
    universe: DataFrame, count: int, seed: int, cap: float = 1.0, groups: Sequence[str] = (), blend: float = 1.0, floor: float = 0.0
) -> DataFrame:
    """Equal weights plus `count` seeded flat-Dirichlet draws; a draw outside floor and cap is rejected as a whole.

    A draw depends on (seed, candidate, ticker) alone, so a lost task recreates it.
    ``blend`` mixes the draw with equal weights.
    """
    ids = F.explode(F.sequence(F.lit(0), F.lit(count)))
    cells = universe.select(*groups, "ticker", ids.alias("candidate"))
    draw = -F.log(hex_uniform(F.concat_ws("|", F.lit(str(seed)), F.col("candidate"), F.col("ticker"))))
    cells = cells.withColumn("e", F.when(F.col("candidate") == 0, F.lit(1.0)).otherwise(draw))
    part = Window.partitionBy(*groups, "candidate")
    share = F.col("e") / F.sum("e").over(part)
    equal = F.lit(1.0) / F.count(F.lit(1)).over(part)
    cells = cells.withColumn("weight", F.lit(blend) * share + F.lit(1.0 - blend) * equal)
    cells = cells.withColumns({"largest": F.max("weight").over(part), "smallest": F.min("weight").over(part)})
    return cells.where((F.col("largest") <= cap) & (F.col("smallest") >= floor)).select(*groups, "candidate", "ticker", "weight")


def around(held: DataFrame, count: int, seed: int, step: float, cap: float, floor: float, keys: Sequence[str] = ("objective",)) -> DataFrame:
    """The held weights of each key as candidate 0, and `count` draws that move them by `step` towards a flat-Dirichlet
    draw; a draw outside floor and cap is rejected as a whole. Draws depend on (seed, candidate, ticker) alone.
    """
    cells = held.select(*keys, "ticker", F.col("weight").alias("base"), F.explode(F.sequence(F.lit(0), F.lit(count))).alias("candidate"))
    part = Window.partitionBy(*keys, "candidate")
    cells = cells.withColumn("e", -F.log(hex_uniform(F.concat_ws("|", F.lit(str(seed)), F.col("candidate"), F.col("ticker")))))
    moved = F.lit(1.0 - step) * F.col("base") + F.lit(step) * F.col("e") / F.sum("e").over(part)
    cells = cells.withColumn("weight", F.when(F.col("candidate") == 0, F.col("base")).otherwise(moved))
    cells = cells.withColumns({"largest": F.max("weight").over(part), "smallest": F.min("weight").over(part)})
    inside = (F.col("largest") <= cap) & (F.col("smallest") >= floor)
    return cells.where(inside | (F.col("candidate") == 0)).select(*keys, "candidate", "ticker", "weight")


def project_to_box(
    targets: DataFrame, keys: Sequence[str], lower: float, upper: float, iterations: int = 100
) -> DataFrame:
    """Euclidean projection on {sum w = 1, lower <= w <= upper}: bisection on the shift, as a fold."""
    packed = targets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ticker", "weight"))).alias("v"))

    def clip(shift: Column) -> Column:
        return F.transform("v", lambda c: F.least(F.greatest(c["weight"] - shift, F.lit(lower)), F.lit(upper)))

    def total(shift: Column) -> Column:
        return F.aggregate(clip(shift), F.lit(0.0), lambda acc, w: acc + w)

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        high = total(mid) > 1
        return F.struct(
            F.when(high, mid).otherwise(state["lo"]).alias("lo"),
            F.when(high, state["hi"]).otherwise(mid).alias("hi"),
        )

    smallest = F.array_min(F.transform("v", lambda c: c["weight"]))
    largest = F.array_max(F.transform("v", lambda c: c["weight"]))
    start = F.struct((smallest - F.lit(upper)).alias("lo"), (largest - F.lit(lower)).alias("hi"))
    found = packed.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, halve))
    shift = (F.col("s.lo") + F.col("s.hi")) / 2
    cells = F.arrays_zip(F.transform("v", lambda c: c["ticker"]).alias("ticker"), clip(shift).alias("weight"))
    feasible = (F.lit(lower) * F.size("v") <= 1) & (F.lit(upper) * F.size("v") >= 1)
    return found.where(feasible).select(*keys, F.inline(cells))


def round_units(weights: DataFrame, keys: Sequence[str], step: float, lower: float, upper: float) -> DataFrame:
    """Largest-remainder rounding to whole steps under bounds.

    Each unit added to an asset lowers its residual by one, so the greedy choice is
    the top of a ranking over all possible unit steps of the portfolio.
    """
    total = round(1.0 / step)
    low, high = F.lit(lower), F.lit(upper)
    min_units = F.ceil(low / step - 1e-12)
    max_units = F.floor(high / step + 1e-12)
    part = Window.partitionBy(*keys)
    base = (
        weights.withColumn("raw", F.col("weight") / F.lit(step))
        .withColumn("units", F.least(F.greatest(F.floor("raw"), min_units), max_units))
        .withColumn("missing", F.lit(total) - F.sum("units").over(part))
    )
    move = F.signum("missing")
    room = F.when(F.col("missing") > 0, max_units - F.col("units")).when(
        F.col("missing") < 0, F.col("units") - min_units
    ).otherwise(F.lit(0))
    steps = base.withColumn("n", F.explode(F.sequence(F.lit(0), room.cast("bigint"))))
    residual = (F.col("raw") - F.col("units")) * move - F.col("n") + 1
    candidates = steps.where(F.col("n") > 0).withColumn("residual", residual)
    ranked = candidates.withColumn(
        "rk", F.row_number().over(part.orderBy(F.col("residual").desc(), F.col("ticker"), F.col("n")))
    ).where(F.col("rk") <= F.abs("missing"))
    moved = ranked.groupBy(*keys, "ticker").agg(F.count(F.lit(1)).alias("moves"))
    final = base.join(moved, [*keys, "ticker"], "left").withColumn(
        "units", F.col("units") + F.coalesce(F.col("moves"), F.lit(0)) * move
    )
    return final.select(*keys, "ticker", F.col("units").cast("bigint").alias("units"), (F.col("units") * F.lit(step)).alias("rounded_weight"))
