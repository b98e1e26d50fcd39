"""Small frames with known answers."""

import datetime

import numpy as np
import pandas as pd


def weekdays(start, n):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def ohlcv(ticker="AAA", rows=330, start="2020-01-02"):
    k = np.arange(rows, dtype=float)
    adjusted = 100 + 0.25 * k
    close = adjusted + 0.10
    return pd.DataFrame({
        "ticker": ticker, "date": weekdays(start, rows), "open": close - 0.20, "high": close + 0.50, "low": close - 0.50, "close": close,
        "volume": 1_000_000 + 1_000 * k,
    })


def wavy(ticker="AAA", rows=330, seed=3, start="2020-01-02"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, rows)))
    return pd.DataFrame({
        "ticker": ticker, "date": weekdays(start, rows), "open": close * 0.99, "high": close * 1.02, "low": close * 0.98, "close": close,
        "volume": rng.integers(100, 1000, rows).astype(float),
    })


def model_rows(ticker="AAA", rows=500, shift=0.0, horizon=21):
    k = np.arange(rows, dtype=float)
    days = weekdays("2022-01-03", rows)
    one, two = np.sin(k / 20) + shift, np.cos(k / 15)
    target = 0.02 * one - 0.01 * two
    ends = [days[i + horizon] if i + horizon < rows else None for i in range(rows)]
    return pd.DataFrame({
        "ticker": ticker, "feature_date": days, "label_end_date": pd.Series(ends, dtype=object), "target_21d_return": [t if e is not None else None for t, e in zip(target, ends)],
        "target_available": [e is not None for e in ends], "feature_one": one, "feature_two": two,
    })


def day(text):
    return datetime.date.fromisoformat(text)
