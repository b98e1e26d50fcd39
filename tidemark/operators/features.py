"""Backward-looking features on row windows, one partition per ticker.

Every frame ends at the current row. A value is NULL until its window is full, and
missing values are classified, never filled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import by_date, non_negative, positive, spread, trailing

# Window lengths of the published feature set.
RETURN_WINDOWS = (1, 5, 10, 21, 63, 126, 252)
SMA_WINDOWS = (5, 10, 21, 63, 126, 252)
VOLATILITY_WINDOWS = (5, 10, 21, 63, 126, 252)
DRAWDOWN_WINDOWS = (21, 63, 252)
RSI_WINDOW = 14
ADV_WINDOW = 20
# Thresholds of the feature audit by category.
EXTREME_THRESHOLDS = {
    "return": 5.0, "moving_average": 1000000.0, "price_distance": 5.0, "volatility": 2.0,
    "ohlc": 5.0, "volume_liquidity": 1000000000000000.0, "rsi": 100.0, "drawdown": 1.0,
}
KEY = ("ticker",)


@dataclass(frozen=True)
class Feature:
    name: str
    category: str
    lookback: int
    warmup: int


def _bad_price(column: str = "close") -> Column:
    return F.col(column).isNotNull() & (F.col(column) <= 0)


def _with_runs(prices: DataFrame) -> DataFrame:
    placed = prices.withColumn("_row", F.row_number().over(by_date(*KEY)))
    order = by_date(*KEY).rowsBetween(Window.unboundedPreceding, 0)

    def run(ok: Column) -> Column:
        broken = F.when(~F.coalesce(ok, F.lit(False)), F.col("_row"))
        return F.col("_row") - F.coalesce(F.last(broken, ignorenulls=True).over(order), F.lit(0))

    price_ok, volume_ok = F.col("close") > 0, F.col("volume") >= 0
    bad_price, bad_volume = _bad_price("close"), F.col("volume").isNotNull() & (F.col("volume") < 0)
    return placed.withColumns(
        {
            "_run_price": run(price_ok), "_run_volume": run(volume_ok), "_run_dollars": run(price_ok & volume_ok),
            "_since_bad_price": run(~bad_price), "_since_bad_volume": run(~bad_volume),
            "_since_bad_dollars": run(~(bad_price | bad_volume)),
        }
    )


def _need_runs(prices: DataFrame) -> DataFrame:
    return prices if "_row" in prices.columns else _with_runs(spread(prices, *KEY))


def add_returns(prices: DataFrame, windows: Sequence[int] = RETURN_WINDOWS) -> DataFrame:
    p, w = positive("close"), by_date(*KEY)
    return prices.withColumns(
        {f"return_{k}d": F.try_divide(p, F.lag(p, k).over(w)) - 1 for k in windows}
    )


def add_sma(prices: DataFrame, windows: Sequence[int] = SMA_WINDOWS) -> DataFrame:
    p = positive("close")
    out = _need_runs(prices).withColumns(
        {f"sma_{n}": F.when(F.col("_run_price") >= n, F.avg(p).over(trailing(n, *KEY))) for n in windows}
    )
    return out.withColumns(
        {f"price_to_sma_{n}": F.try_divide(p, positive(F.col(f"sma_{n}"))) - 1 for n in windows}
    )


def add_volatility(prices: DataFrame, windows: Sequence[int] = VOLATILITY_WINDOWS, annualize: bool = False) -> DataFrame:
    p = positive("close")
    step = _need_runs(prices).withColumn("_r", F.try_divide(p, F.lag(p).over(by_date(*KEY))) - 1)
    scale = F.lit(math.sqrt(252.0) if annualize else 1.0)
    return step.withColumns(
        {
            f"volatility_{n}d": F.when(F.col("_run_price") > n, F.stddev_samp("_r").over(trailing(n, *KEY))) * scale
            for n in windows
        }
    ).drop("_r")


def add_ohlc(prices: DataFrame) -> DataFrame:
    c, o = positive("close"), positive("open")
    previous = positive(F.lag("close").over(by_date(*KEY)))
    return prices.withColumns(
        {
            "high_low_range": F.try_divide(F.col("high") - F.col("low"), c),
            "open_close_return": F.try_divide(c, o) - 1,
            "overnight_gap": F.try_divide(o, previous) - 1,
        }
    )


def add_volume(prices: DataFrame, adv_window: int = ADV_WINDOW) -> DataFrame:
    v = non_negative("volume")
    previous = positive(F.lag("volume").over(by_date(*KEY)))
    out = _need_runs(prices).withColumns(
        {"volume_change_1d": F.try_divide(v, previous) - 1, "dollar_volume": positive("close") * v}
    )
    means = {n: F.when(F.col("_run_volume") >= n, F.avg(v).over(trailing(n, *KEY))) for n in (5, 21)}
    out = out.withColumns({f"_mean_volume_{n}": mean for n, mean in means.items()})
    out = out.withColumns({f"volume_to_average_{n}d": F.try_divide(v, positive(f"_mean_volume_{n}")) for n in means})
    dollars = F.col("dollar_volume")
    mean = F.when(F.col("_run_dollars") >= adv_window, F.avg(dollars).over(trailing(adv_window, *KEY)))
    out = out.withColumn("adv20", mean)
    return out.withColumn("relative_adv20", F.try_divide(dollars, positive("adv20")))


def add_rsi(prices: DataFrame, n: int = RSI_WINDOW, span: float = 300.0) -> DataFrame:
    """Wilder RSI with alpha = 1/n, seeded by the first price change, as column ``rsi_{n}``.

    A missing change decays the weight of what came before by (n-1)/n; its row keeps the last value. With decay d
    since the last change, a step is mean = a * mean + b * change, a = d / (d + 1/n), b = 1 - a. The recursion is a
    running sum of changes scaled by exp(sum of -log a): all terms are non-negative, so nothing cancels. The
    exponent restarts every ``span``, and the carry of the block before suffices: older rows weigh below exp(-span).
    """
    keep, rate = (n - 1) / n, 1.0 / n
    order = by_date(*KEY)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    p = positive("close")
    rows = prices.withColumn("_delta", p - F.lag(p).over(order)).withColumn("_row", F.row_number().over(order))
    changes = rows.where(F.col("_delta").isNotNull()).withColumn("_pos", F.row_number().over(order) - 1)
    decay = F.pow(F.lit(keep), F.col("_row") - F.lag("_row").over(order))
    out = changes.withColumn("_share", F.when(F.col("_pos") > 0, rate / (decay + rate)).otherwise(F.lit(1.0)))
    step = F.when(F.col("_pos") == 0, F.lit(0.0)).otherwise(F.least(F.coalesce(-F.log(1.0 - F.col("_share")), F.lit(span)), F.lit(span)))
    out = out.withColumn("_sum", F.sum(step).over(upto)).withColumn("_block", F.floor(F.col("_sum") / span)).withColumn("_in", F.col("_sum") - F.col("_block") * span)
    inside = Window.partitionBy(*KEY, "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    sides = {"gain": F.greatest(F.col("_delta"), F.lit(0.0)), "loss": F.greatest(-F.col("_delta"), F.lit(0.0))}
    for side, value in sides.items():
        out = out.withColumn(f"_m_{side}", F.sum(value * F.col("_share") * F.exp("_in")).over(inside) * F.exp(-F.col("_in")))
    closing = F.lead("_block").over(order) != F.col("_block")
    ended = F.when(closing, F.struct(F.col("_m_gain").alias("gain"), F.col("_m_loss").alias("loss"), F.col("_sum").alias("sum")))
    out = out.withColumn("_ended", ended)
    out = out.withColumn("_e", F.last("_ended", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    for side in sides:
        carry = F.coalesce(F.col(f"_e.{side}") * F.exp(F.col("_e.sum") - F.col("_sum")), F.lit(0.0))
        out = out.withColumn(f"_a_{side}", F.col(f"_m_{side}") + carry)
    rs = F.try_divide(F.col("_a_gain"), F.col("_a_loss"))
    rsi = (
        F.when((F.col("_a_loss") == 0) & (F.col("_a_gain") > 0), F.lit(100.0))
        .when((F.col("_a_loss") == 0) & (F.col("_a_gain") == 0), F.lit(50.0))
        .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs))
    )
    name = f"rsi_{n}"
    ready = out.withColumn(name, F.when(F.col("_pos") >= n - 1, rsi)).select("ticker", "date", name)
    joined = prices.join(ready, ["ticker", "date"], "left")
    return joined.withColumn(name, F.last(name, ignorenulls=True).over(upto))


def add_rolling_drawdown(prices: DataFrame, windows: Sequence[int] = DRAWDOWN_WINDOWS) -> DataFrame:
    """Largest fall from a peak inside the trailing window, folded over its prices."""
    p = positive("close")
    widest = max(windows)
    packed = _need_runs(prices).withColumn("_v", F.collect_list(F.coalesce(p, F.lit(-1.0))).over(trailing(widest, *KEY)))

    def fold(values: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

        def step(state, value):
            peak = F.greatest(state["peak"], value)
            return F.struct(peak.alias("peak"), F.least(state["worst"], F.try_divide(value, peak) - 1).alias("worst"))

        return F.aggregate(values, start, step, lambda state: state["worst"])

    outs = {}
    for n in windows:
        tail = F.slice(F.col("_v"), F.greatest(F.size("_v") - n + 1, F.lit(1)), F.lit(n))
        complete = F.col("_run_price") >= n
        outs[f"rolling_max_drawdown_{n}d"] = F.when(complete, fold(tail))
    return packed.withColumns(outs).drop("_v")


def catalogue() -> list[Feature]:
    """Names, categories and warm-up rows of the feature set."""
    out: list[Feature] = []
    out += [Feature(f"return_{k}d", "return", k, k) for k in RETURN_WINDOWS]
    for n in SMA_WINDOWS:
        out.append(Feature(f"sma_{n}", "moving_average", n, n - 1))
        out.append(Feature(f"price_to_sma_{n}", "price_distance", n, n - 1))
    out += [Feature(f"volatility_{n}d", "volatility", n, n) for n in VOLATILITY_WINDOWS]
    out += [Feature("high_low_range", "ohlc", 1, 0), Feature("open_close_return", "ohlc", 1, 0), Feature("overnight_gap", "ohlc", 1, 1)]
    out.append(Feature("volume_change_1d", "volume_liquidity", 1, 1))
    out += [Feature(f"volume_to_average_{n}d", "volume_liquidity", n, n - 1) for n in (5, 21)]
    out.append(Feature("dollar_volume", "volume_liquidity", 1, 0))
    out += [Feature(name, "volume_liquidity", ADV_WINDOW, ADV_WINDOW - 1) for name in ("adv20", "relative_adv20")]
    out.append(Feature("rsi_14", "rsi", RSI_WINDOW, RSI_WINDOW))
    out += [Feature(f"rolling_max_drawdown_{n}d", "drawdown", n, n - 1) for n in DRAWDOWN_WINDOWS]
    return out


def build_features(prices: DataFrame) -> DataFrame:
    """The whole feature set; expects ticker, date, open, high, low, close, volume.

    Helper columns start with an underscore; :func:`feature_table` drops them.
    """
    picked = prices.select("ticker", "date", "open", "high", "low", "close", "volume")
    base = _with_runs(spread(picked, *KEY))
    out = add_rolling_drawdown(add_rsi(add_volume(add_ohlc(add_volatility(add_sma(add_returns(base)))))))
    return out


def invalid_masks() -> dict[str, Column]:
    """Which rows make a feature invalid rather than merely early or missing."""
    bad, bad_open = _bad_price("close"), _bad_price("open")
    bad_volume = F.col("volume").isNotNull() & (F.col("volume") < 0)
    order = by_date(*KEY)

    def recent(column: str, n: int) -> Column:
        return (F.col(column) < n) & (F.col(column) < F.col("_row"))

    masks: dict[str, Column] = {}
    for k in RETURN_WINDOWS:
        masks[f"return_{k}d"] = bad | F.coalesce(F.lag(bad, k).over(order), F.lit(False))
    for n in SMA_WINDOWS:
        masks[f"sma_{n}"] = recent("_since_bad_price", n)
        masks[f"price_to_sma_{n}"] = recent("_since_bad_price", n)
    for n in VOLATILITY_WINDOWS:
        masks[f"volatility_{n}d"] = recent("_since_bad_price", n + 1)
    masks["high_low_range"] = bad
    masks["open_close_return"] = bad_open | bad
    masks["overnight_gap"] = bad_open | F.coalesce(F.lag(bad).over(order), F.lit(False))
    masks["volume_change_1d"] = bad_volume | F.coalesce(F.lag("volume").over(order) <= 0, F.lit(False))
    for n in (5, 21):
        masks[f"volume_to_average_{n}d"] = recent("_since_bad_volume", n) | F.coalesce(
            F.col(f"_mean_volume_{n}") <= 0, F.lit(False)
        )
    masks["dollar_volume"] = bad | bad_volume
    masks["adv20"] = recent("_since_bad_dollars", ADV_WINDOW)
    masks["relative_adv20"] = recent("_since_bad_dollars", ADV_WINDOW) | F.coalesce(F.col("adv20") <= 0, F.lit(False))
    masks["rsi_14"] = recent("_since_bad_price", RSI_WINDOW + 1)
    for n in DRAWDOWN_WINDOWS:
        masks[f"rolling_max_drawdown_{n}d"] = recent("_since_bad_price", n)
    return masks


def feature_table(prices: DataFrame) -> DataFrame:
    names = [feature.name for feature in catalogue()]
    return build_features(prices).select("ticker", "date", *names)


def missing_reasons(features: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Long table (ticker, date, feature, value, reason); reason is empty for a present value."""
    picked = [f for f in catalogue() if names is None or f.name in names]
    masks = invalid_masks()
    flagged = features.withColumn("_pos", F.col("_row") - 1)
    flagged = flagged.withColumns({f"_bad_{f.name}": F.coalesce(masks[f.name], F.lit(False)) for f in picked})
    cells = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("feature"), F.lit(f.category).alias("category"),
                F.col(f.name).cast("double").alias("value"),
                F.when(F.col(f.name).isNotNull(), F.lit(""))
                .when(F.col(f"_bad_{f.name}"), F.lit("calculation_invalid"))
                .when(F.col("_pos") < f.warmup, F.lit("expected_missing"))
                .otherwise(F.lit("source_missing")).alias("reason"),
            )
            for f in picked
        ]
    )
    return flagged.select("ticker", "date", F.inline(cells))


def feature_audit(features: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Per ticker and feature: first valid date, missing counts by reason, constancy, extremes."""
    long = missing_reasons(features, names)
    threshold = F.create_map(*[F.lit(x) for pair in EXTREME_THRESHOLDS.items() for x in pair])[F.col("category")]
    present = F.col("value").isNotNull()
    return long.groupBy("ticker", "feature", "category").agg(
        F.min(F.when(present, F.col("date"))).alias("first_valid_date"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~present).alias("missing_count"),
        F.avg((~present).cast("double")).alias("missing_rate"),
        F.count_if(F.col("reason") == "expected_missing").alias("expected_missing_count"),
        F.count_if(F.col("reason") == "source_missing").alias("source_missing_count"),
        F.count_if(F.col("reason") == "calculation_invalid").alias("calculation_invalid_count"),
        F.coalesce(F.min("value") == F.max("value"), F.lit(False)).alias("constant_feature"),
        F.count_if(F.abs("value") > threshold).alias("extreme_value_count"),
    )


def build_targets(prices: DataFrame, horizon: int = 21) -> DataFrame:
    """Return over the next ``horizon`` rows; tail rows stay, unavailable."""
    order = by_date(*KEY)
    now, ahead = F.col("close"), F.lead("close", horizon).over(order)
    out = prices.select(
        "ticker", F.col("date").alias("feature_date"), F.col("date").alias("label_start_date"),
        F.lead("date", horizon).over(order).alias("label_end_date"),
        now.alias("current_close"), ahead.alias("future_close"),
    )
    available = F.coalesce(
        (F.col("current_close") > 0) & (F.col("future_close") > 0) & F.col("label_end_date").isNotNull(), F.lit(False)
    )
    return out.withColumn("target_available", available).withColumn(
        "target_21d_return",
        F.when(F.col("target_available"), F.try_divide(F.col("future_close"), F.col("current_close")) - 1),
    )


def label_audit(targets: DataFrame, horizon: int = 21, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Each available label must end exactly ``horizon`` rows later and re-derive its return."""
    order = Window.partitionBy("ticker").orderBy("feature_date")
    placed = targets.withColumn("pos", F.row_number().over(order)).withColumn(
        "expected_end", F.lead("feature_date", horizon).over(order)
    )
    ends = placed.select("ticker", F.col("feature_date").alias("label_end_date"), F.col("pos").alias("end_pos"))
    joined = placed.join(ends, ["ticker", "label_end_date"], "left").withColumn(
        "trading_day_distance", (F.col("end_pos") - F.col("pos")).cast("bigint")
    )
    structural = (F.col("label_start_date") == F.col("feature_date")) & F.col("label_end_date").eqNullSafe(F.col("expected_end"))
    derived = F.try_divide(F.col("future_close"), F.col("current_close")) - 1
    formula = F.abs(derived - F.col("target_21d_return")) <= F.lit(atol) + F.lit(rtol) * F.abs("target_21d_return")
    exact = F.coalesce((F.col("trading_day_distance") == horizon) & (F.col("label_end_date") > F.col("feature_date")) & formula, F.lit(False))
    return joined.withColumn("alignment_valid", structural & (~F.col("target_available") | exact)).select(
        "ticker", "feature_date", "label_end_date", "target_available", "trading_day_distance", "alignment_valid"
    )


def model_columns(dataset: DataFrame) -> list[str]:
    """Numeric columns that carry neither identifiers nor anything about the label."""
    hidden = {"ticker", "sector", "date", "feature_date", "current_close"}
    forbidden = ("target", "future", "label")
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [
        field.name
        for field in dataset.schema.fields
        if field.name not in hidden
        and not any(token in field.name.lower() for token in forbidden)
        and field.dataType.simpleString() in numeric
    ]


def join_targets(features: DataFrame, targets: DataFrame) -> DataFrame:
    """One-to-one on (ticker, feature_date); tail rows stay, duplicates are counted on both sides."""
    left = features.withColumnRenamed("date", "feature_date")
    twins = targets.groupBy("ticker", "feature_date").agg(
        F.count(F.lit(1)).alias("target_matches"),
        *[F.first(c).alias(c) for c in targets.columns if c not in ("ticker", "feature_date")],
    )
    return left.join(twins, ["ticker", "feature_date"], "left").withColumn(
        "matched_once", F.coalesce(F.col("target_matches") == 1, F.lit(False))
    ).drop("target_matches")
