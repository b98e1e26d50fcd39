"""Volatility, covariance and correlation for any number of groups in one job."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import is_close


def volatility(returns: DataFrame, periods: int, groups: Sequence[str] = (), name: str = "sigma") -> DataFrame:
    return returns.groupBy(*groups, "ticker").agg(
        (F.stddev_samp("ret") * F.lit(math.sqrt(periods))).alias(name)
    )


#: Tickers of one block, about; a task holds two blocks over the calendar.
BLOCK_TICKERS = 256


def moments_of_blocks(frame: pd.DataFrame, groups: Sequence[str]) -> pd.DataFrame:
    """Pair moments between the tickers of block lo and those of block hi, as matrix products over the dates."""
    names, column = np.unique(frame["ticker"].to_numpy(dtype=str), return_inverse=True)
    row, dates = pd.factorize(frame["date"])
    x, seen = np.zeros((len(dates), len(names))), np.zeros((len(dates), len(names)))
    x[row, column], seen[row, column] = frame["ret"], 1.0
    low, high = np.where(seen > 0, x, np.inf).min(axis=0), np.where(seen > 0, x, -np.inf).max(axis=0)
    # Centred, so that sums of squares lose no digits; a constant series becomes exactly zero.
    z = np.where(seen > 0, x - np.where(low == high, low, x.sum(axis=0) / seen.sum(axis=0)), 0.0)
    side = np.zeros(len(names), dtype=int)
    side[column] = frame["side"]
    first, second = np.flatnonzero(side == frame["lo"].iloc[0]), np.flatnonzero(side == frame["hi"].iloc[0])
    at = lambda left, right: left[:, first].T @ right[:, second]
    n, product, both = at(seen, seen), at(x, x), at(z, z)
    sum_i, sum_j, square_i, square_j = at(z, seen), at(seen, z), at(z * z, seen), at(seen, z * z)
    raw_i, raw_j = at(x * x, seen), at(seen, x * x)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = np.where(n > 1, (both - sum_i * sum_j / n) / (n - 1), np.nan)
        var_i, var_j = (square_i - sum_i**2 / n) / (n - 1), (square_j - sum_j**2 / n) / (n - 1)
        constant = (var_i <= 1e-24 * raw_i) | (var_j <= 1e-24 * raw_j)
        corr = np.where((n > 1) & ~constant, cov / np.sqrt(np.where(constant, 1.0, var_i * var_j)), np.nan)
        mean = product / n
    kept = n > 0
    if frame["lo"].iloc[0] == frame["hi"].iloc[0]:
        kept &= first[:, None] <= second[None, :]
    u, v = np.nonzero(kept)
    i, j = np.minimum(first[u], second[v]), np.maximum(first[u], second[v])  # names are sorted
    out = pd.DataFrame({g: frame[g].iloc[0] for g in groups}, index=range(len(u)))
    return out.assign(i=names[i], j=names[j], n=n[u, v].astype("int64"), mean_product=mean[u, v], cov=cov[u, v], corr=corr[u, v])


def pair_moments(returns: DataFrame, groups: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Per group and pair i <= j of tickers with a common date: n, mean_product, cov (sample), corr.

    Tickers are dealt to blocks and each block meets every block of its group once, with all its dates: a return
    moves once per block, and no row is made for a pair and a date. `blocks` follows from the number of tickers,
    which is the one number that reaches the driver. Null returns count as missing; a pair with one common date
    has no covariance, a series constant on the common dates no correlation. A ticker has one return a date.
    """
    usable = returns.where(F.col("ret").isNotNull()).select(*groups, "ticker", "date", "ret")
    if blocks is None:
        blocks = max(1, math.ceil(usable.agg(F.approx_count_distinct("ticker")).first()[0] / BLOCK_TICKERS))
    dealt = usable.withColumn("side", F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    paired = dealt.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).drop("other")
    kinds = [f"`{g}` {returns.schema[g].dataType.simpleString()}" for g in groups]
    schema = ", ".join([*kinds, "i string, j string, n long, mean_product double, cov double, corr double"])
    out = paired.groupBy(*groups, "lo", "hi").applyInPandas(lambda frame: moments_of_blocks(frame, groups), schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("cov", "corr")})


def _mirror(half: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    return half.select(*groups, value, F.explode(both).alias("p")).select(*groups, "p.i", "p.j", value)


def covariance(returns: DataFrame, periods: int, groups: Sequence[str] = ()) -> DataFrame:
    """Annualised sample covariance, long form, both triangles."""
    half = pair_moments(returns, groups).withColumn("cov", F.col("cov") * F.lit(float(periods)))
    return _mirror(half, groups, "cov")


def correlation(returns: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return _mirror(pair_moments(returns, groups), groups, "corr")


def matrix_checks(cov: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Finite, symmetric and positive-diagonal counts per group, by a transpose join."""
    flipped = cov.select(*groups, F.col("j").alias("i"), F.col("i").alias("j"), F.col("cov").alias("cov_t"))
    return (
        cov.join(flipped, [*groups, "i", "j"], "left")
        .groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.count_if(F.col("cov").isNull() | F.isnan("cov")).alias("not_finite"),
            F.count_if(
                F.col("cov_t").isNull() | ~is_close(F.col("cov"), F.col("cov_t"), 1e-10, 1e-12)
            ).alias("not_symmetric"),
            F.count_if((F.col("i") == F.col("j")) & (F.col("cov") <= 0)).alias("bad_diagonal"),
        )
    )
