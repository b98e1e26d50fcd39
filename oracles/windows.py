"""SQL of the window queries."""

import re

from oracles.aggregates import NAV, base, forecasts, paired
from oracles.base import bars, r, weekdays_before

INSTR = bars("instrument", "day")
TYPED = bars("type", "day")
W = "PARTITION BY ticker ORDER BY date"


def cols(pairs, digits=6):
    return ", ".join(f"{r(expr, digits)} AS {name}" for name, expr in pairs)


def pos(x):
    return f"CASE WHEN {x} > 0 THEN {x} END"


def frame(n):
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RETURNS = [(f"return_{k}d", f"p / lag(p, {k}) OVER ({W}) - 1") for k in (1, 5, 10, 21, 63, 126, 252)]
SMAS = []
for n in (5, 10, 21, 63, 126, 252):
    full = f"CASE WHEN count(p) OVER {frame(n)} = {n} THEN avg(p) OVER {frame(n)} END"
    SMAS += [(f"sma_{n}", full), (f"price_to_sma_{n}", f"p / ({full}) - 1")]
VOLS = [
    (f"volatility_{n}d", f"CASE WHEN count(r1) OVER {frame(n)} = {n} THEN stddev_samp(r1) OVER {frame(n)} END")
    for n in (5, 10, 21, 63, 126, 252)
]
OHLC = [
    ("high_low_range", "(high - low) / p"),
    ("open_close_return", f"p / ({pos('open')}) - 1"),
    ("overnight_gap", f"({pos('open')}) / lag(p) OVER ({W}) - 1"),
]


def avg_full(x, n):
    return f"(CASE WHEN count({x}) OVER {frame(n)} = {n} THEN avg({x}) OVER {frame(n)} END)"


VOLUME = [
    ("volume_change_1d", f"v / nullif(lag(v) OVER ({W}), 0) - 1"),
    ("volume_to_average_5d", f"v / nullif({avg_full('v', 5)}, 0)"),
    ("volume_to_average_21d", f"v / nullif({avg_full('v', 21)}, 0)"),
    ("dollar_volume", "p * v"),
    ("adv20", avg_full("(p * v)", 20)),
    ("relative_adv20", f"p * v / nullif({avg_full('(p * v)', 20)}, 0)"),
]
MDD = [
    (f"rolling_max_drawdown_{n}d", f"""CASE WHEN count(p) OVER {frame(n)} = {n} THEN
      list_reduce(list_transform(list(p) OVER {frame(n)}, lambda x: {{'p': x, 'm': 0.0::DOUBLE}}),
        lambda a, b: {{'p': greatest(a.p, b.p), 'm': least(a.m, b.p / greatest(a.p, b.p) - 1)}}).m END""")
    for n in (21, 63, 252)
]


def src(source="bars"):
    return f"""src AS (SELECT *, {pos('close')} AS p, CASE WHEN volume >= 0 THEN volume END AS v FROM {source}),
    s1 AS (SELECT *, p / lag(p) OVER ({W}) - 1 AS r1 FROM src)"""


RSI = f"""d AS (SELECT ticker, date, p - lag(p) OVER ({W}) AS delta FROM src),
    d0 AS (SELECT *, count(delta) OVER ({W}) AS k FROM d),
    dd AS (SELECT ticker, date, k, list({{'g': greatest(delta, 0.0), 'l': greatest(-delta, 0.0), 'w': CASE WHEN delta IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END}}) OVER
        ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs FROM (SELECT ticker, date, k, delta FROM d0 WHERE k > 0)),
    em AS (SELECT ticker, date, k, list_reduce(xs, lambda a, b: CASE WHEN b.w = 0 THEN {{'g': a.g, 'l': a.l, 'w': a.w * 13.0::DOUBLE / 14}} ELSE
        {{'g': (a.w * 13 * a.g + b.g) / (a.w * 13 + 1), 'l': (a.w * 13 * a.l + b.l) / (a.w * 13 + 1), 'w': 1.0::DOUBLE}} END) AS e FROM dd),
    rsi AS (SELECT ticker, date, CASE WHEN k < 14 THEN NULL WHEN e.l = 0 AND e.g > 0 THEN 100.0 WHEN e.l = 0 THEN 50.0
        ELSE 100.0 - 100.0 / (1 + e.g / e.l) END AS rsi_14 FROM em)"""

ALL_FEATURES = RETURNS + SMAS + VOLS + OHLC + VOLUME + MDD
CATEGORY = {"return": "return", "sma": "moving_average", "price": "price_distance", "volatility": "volatility", "high": "ohlc",
            "open": "ohlc", "overnight": "ohlc", "volume": "volume_liquidity", "dollar": "volume_liquidity",
            "adv20": "volume_liquidity", "relative": "volume_liquidity", "rsi": "rsi", "rolling": "drawdown"}
THRESHOLD = {"return": 5.0, "moving_average": 1e6, "price_distance": 5.0, "volatility": 2.0, "ohlc": 5.0,
             "volume_liquidity": 1e15, "rsi": 100.0, "drawdown": 1.0}


def length(name):
    found = re.search(r"_(\d+)d?$", name)
    return int(found.group(1)) if found else 0


def warmup(name):
    n = length(name)
    if name.startswith("return") or name.startswith("volatility"):
        return n
    if name in ("overnight_gap", "volume_change_1d"):
        return 1
    if name == "rsi_14":
        return 14
    if name in ("adv20", "relative_adv20"):
        return 19
    if name.startswith(("sma", "price_to", "volume_to", "rolling")):
        return n - 1
    return 0


def invalid(name):
    n = length(name)
    any_bad = lambda k: f"bool_or(close <= 0) OVER {frame(k)}"
    if name.startswith("return"):
        return f"close <= 0 OR coalesce(lag(close, {n}) OVER ({W}) <= 0, false)"
    if name.startswith(("sma", "price_to", "rolling")):
        return any_bad(n)
    if name.startswith("volatility"):
        return any_bad(n + 1)
    if name == "rsi_14":
        return any_bad(15)
    if name in ("adv20", "relative_adv20"):
        return any_bad(20)
    if name in ("high_low_range", "dollar_volume"):
        return "close <= 0"
    if name == "open_close_return":
        return "open <= 0 OR close <= 0"
    if name == "overnight_gap":
        return f"open <= 0 OR coalesce(lag(close) OVER ({W}) <= 0, false)"
    return "false"


def long_features(source):
    wide = ", ".join(f"({expr})::DOUBLE AS {name}" for name, expr in ALL_FEATURES)
    flags = ", ".join(f"({invalid(name)}) AS bad_{name}" for name in [n for n, _ in ALL_FEATURES] + ["rsi_14"])
    names = [n for n, _ in ALL_FEATURES] + ["rsi_14"]
    parts = " UNION ALL ".join(
        f"""SELECT ticker, date, '{n}' AS feature, '{CATEGORY[n.split('_')[0]]}' AS category, {THRESHOLD[CATEGORY[n.split('_')[0]]]} AS lim,
        {n} AS value, CASE WHEN {n} IS NOT NULL THEN '' WHEN bad_{n} THEN 'calculation_invalid'
          WHEN k < {warmup(n)} THEN 'expected_missing' ELSE 'source_missing' END AS reason FROM wide"""
        for n in names
    )
    return f"""{src(source)}, {RSI},
      w0 AS (SELECT ticker, date, row_number() OVER ({W}) - 1 AS k, {wide}, {flags} FROM s1),
      wide AS (SELECT w0.*, rsi.rsi_14 FROM w0 LEFT JOIN rsi USING (ticker, date)),
      long AS ({parts})"""


EPISODES = f"""WITH {base('week')}, {NAV},
  f AS (SELECT *, CASE WHEN market >= coalesce(max(market) OVER (PARTITION BY portfolio ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS peak FROM nav),
  n AS (SELECT *, sum(peak) OVER (PARTITION BY portfolio ORDER BY date) AS ep FROM f),
  rows2 AS (SELECT portfolio, date, market, value, ep AS own, ep FROM n UNION ALL
            SELECT portfolio, date, market, value, ep, ep - 1 FROM n WHERE peak = 1 AND ep > 1),
  x AS (SELECT *, value / max(value) OVER w - 1 AS odd, market / max(market) OVER w - 1 AS mdd FROM rows2
        WINDOW w AS (PARTITION BY portfolio, ep ORDER BY date)),
  g AS (SELECT portfolio, ep, min(date) AS peak_date, arg_min(date, row(market, date)) AS trough_date, max(date) AS end_date,
        max(own) > ep AS recovered, arg_min(market, date) AS m0, arg_min(value, date) AS v0, min(market) AS mt,
        arg_min(value, row(market, date)) AS vt, arg_max(market, date) AS m1, arg_max(value, date) AS v1,
        min(odd) AS odd, min(mdd) AS mdd FROM x GROUP BY portfolio, ep HAVING min(market) / arg_min(market, date) - 1 <= -0.15)"""

DATASET = f"""{TYPED}, {src()}, ds AS (
   SELECT ticker, date AS feature_date, p / lag(p, 5) OVER ({W}) - 1 AS return_5d, p / lag(p, 21) OVER ({W}) - 1 AS return_21d,
     p / {avg_full('p', 21)} - 1 AS price_to_sma_21,
     CASE WHEN count(r1) OVER {frame(21)} = 21 THEN stddev_samp(r1) OVER {frame(21)} END AS volatility_21d,
     lead(date, 21) OVER ({W}) AS label_end_date, lead(close, 21) OVER ({W}) / close - 1 AS target FROM s1),
  ends AS (SELECT ticker, date_trunc('month', date) AS m, max(date) AS selection_date FROM bars GROUP BY ALL),
  sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY m DESC) AS rk FROM ends) WHERE rk >= 2),
  avail AS (SELECT d.*, s.selection_date FROM ds d JOIN sel s ON d.ticker = s.ticker AND d.label_end_date <= s.selection_date
     AND d.feature_date BETWEEN CAST(s.selection_date - INTERVAL 60 MONTH AS DATE) AND s.selection_date WHERE target IS NOT NULL)"""

FOLDS = f"""{DATASET}, pl AS (SELECT *, row_number() OVER (PARTITION BY ticker, selection_date ORDER BY feature_date) - 1 AS pos,
     count(*) OVER (PARTITION BY ticker, selection_date) AS n FROM avail),
  ks AS (SELECT unnest([0, 1, 2]) AS fold),
  st AS (SELECT ticker, selection_date, fold, feature_date AS vstart FROM pl, ks WHERE n > 63 AND pos = n - 63 + fold * 21),
  mem0 AS (SELECT p.*, s.fold, CASE WHEN pos >= n - 63 + fold * 21 AND pos < n - 63 + fold * 21 + 21 THEN 'validation'
       WHEN pos < n - 63 + fold * 21 AND NOT (fold >= 1 AND pos >= n - 42 AND pos < n - 37) AND NOT (fold >= 2 AND pos >= n - 21 AND pos < n - 16)
         THEN CASE WHEN label_end_date < vstart THEN 'train' ELSE 'purged' END END AS role
     FROM pl p JOIN st s USING (ticker, selection_date)),
  mem AS (SELECT * FROM mem0 WHERE role IS NOT NULL)"""

SQL = {
    "agg_feature_audit": f"""WITH {TYPED}, {long_features('bars')}
       SELECT ticker, feature, category, min(date) FILTER (value IS NOT NULL) AS first_valid_date, count(*) AS total_rows,
         count(*) FILTER (value IS NULL) AS missing_count, {r('avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_rate,
         count(*) FILTER (reason = 'expected_missing') AS expected_missing_count,
         count(*) FILTER (reason = 'source_missing') AS source_missing_count,
         count(*) FILTER (reason = 'calculation_invalid') AS calculation_invalid_count,
         coalesce(min(value) = max(value), false) AS constant_feature,
         count(*) FILTER (abs(value) > lim) AS extreme_value_count FROM long GROUP BY ticker, feature, category""",
    "win_missing_reason": f"""WITH {TYPED}, idle AS (SELECT * REPLACE (CASE WHEN volume <= 3 THEN 0.0 ELSE open END AS open,
         CASE WHEN volume <= 3 THEN 0.0 ELSE close END AS close) FROM bars), {long_features('idle')}
       SELECT ticker, date, feature, reason FROM long WHERE reason <> ''""",
    "win_returns": f"WITH {INSTR}, {src()} SELECT ticker, date, {cols(RETURNS)} FROM s1",
    "win_target": f"""WITH {INSTR}, t AS (SELECT ticker, date, close, lead(close, 21) OVER ({W}) AS f, lead(date, 21) OVER ({W}) AS e FROM bars)
       SELECT ticker, date AS feature_date, date AS label_start_date, e AS label_end_date, {r('close')} AS current_close,
         {r('f')} AS future_close, e IS NOT NULL AS target_available, {r('f / close - 1')} AS target_21d_return FROM t""",
    "win_sma": f"WITH {INSTR}, {src()} SELECT ticker, date, {cols(SMAS)} FROM s1",
    "win_volatility": f"WITH {INSTR}, {src()} SELECT ticker, date, {cols(VOLS)} FROM s1",
    "win_ohlc": f"WITH {INSTR}, {src()} SELECT ticker, date, {cols(OHLC)} FROM s1",
    "win_volume": f"WITH {INSTR}, {src()} SELECT ticker, date, {cols(VOLUME, 5)} FROM s1",
    "win_rsi": f"WITH {TYPED}, {src()}, {RSI} SELECT b.ticker, b.date, {r('rsi_14')} AS rsi_14 FROM bars b LEFT JOIN rsi USING (ticker, date)",
    "win_rolling_mdd": f"WITH {TYPED}, {src()} SELECT ticker, date, {cols(MDD)} FROM s1",
    "win_rolling_corr": f"""WITH {paired()}, c AS (SELECT ticker, date, count(*) OVER w AS n,
         covar_samp(ret, mret) OVER w / (stddev_samp(ret) OVER w * stddev_samp(mret) OVER w) AS c FROM paired
         WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
       SELECT ticker, date, {r('least(greatest(c, -1), 1)', 5)} AS rolling_corr FROM c WHERE n = 52""",
    "win_wealth": f"WITH {base('week')} SELECT portfolio, date, {r('100 * v', 5)} AS value FROM wealth",
    "win_drawdown": f"WITH {base('week')} SELECT portfolio, date, {r('d')} AS drawdown FROM dd",
    "win_business_gap": f"""WITH {INSTR}, g AS (SELECT ticker, lag(date) OVER ({W}) AS previous_date, date FROM bars),
       h AS (SELECT *, greatest({weekdays_before('date')} - {weekdays_before('previous_date')} - 1, 0) AS m FROM g)
       SELECT ticker, previous_date, date, CAST(m AS BIGINT) AS missing_weekdays, mx AS max_gap FROM (
         SELECT *, CAST(max(m) OVER (PARTITION BY ticker) AS BIGINT) AS mx FROM h) WHERE previous_date IS NOT NULL AND m > 5""",
    "win_max_run": f"""WITH {bars('instrument', 'week')}, cal AS (SELECT DISTINCT date FROM bars), tk AS (SELECT DISTINCT ticker FROM bars),
       g AS (SELECT tk.ticker, cal.date, b.close FROM tk CROSS JOIN cal LEFT JOIN bars b ON b.ticker = tk.ticker AND b.date = cal.date),
       p AS (SELECT *, row_number() OVER ({W}) AS pos FROM g),
       i AS (SELECT ticker, date, pos - row_number() OVER ({W}) AS k FROM p WHERE close IS NULL),
       u AS (SELECT ticker, k, min(date) AS s, max(date) AS e, count(*) AS n FROM i GROUP BY ALL)
       SELECT ticker, max(n) AS max_run, count(*) AS runs, min(s) AS first_run_start, arg_max(e, row(n, s)) AS longest_run_end FROM u GROUP BY ticker""",
    "win_stress_events": f"""WITH {base('week')}, {NAV}, m AS (SELECT *, row_number() OVER w AS pos, market / lag(market, 4) OVER w - 1 AS mm,
         value / lag(value, 4) OVER w - 1 AS om, lag(date, 4) OVER w AS ws FROM nav WINDOW w AS (PARTITION BY portfolio ORDER BY date)),
       h AS (SELECT *, pos - row_number() OVER (PARTITION BY portfolio ORDER BY date) AS e FROM m WHERE mm <= -0.10)
       SELECT portfolio, min(date) AS breach_start, max(date) AS breach_end, arg_min(ws, row(mm, date)) AS worst_window_start,
         arg_min(date, row(mm, date)) AS worst_window_end, {r('min(mm)', 5)} AS market_return, {r('arg_min(om, row(mm, date))', 5)} AS portfolio_return,
         count(*) AS breach_rows, {r('arg_min(om, row(mm, date)) - min(mm)', 5)} AS portfolio_minus_market FROM h GROUP BY portfolio, e""",
    "win_drawdown_episodes": EPISODES + f""" SELECT portfolio, peak_date, trough_date, end_date,
         CASE WHEN recovered THEN 'Recovered' ELSE 'Ongoing at sample end' END AS status, {r('mt / m0 - 1', 5)} AS market_drawdown,
         {r('vt / v0 - 1', 5)} AS portfolio_to_trough, {r('odd', 5)} AS portfolio_max_drawdown, {r('m1 / m0 - 1', 5)} AS market_full,
         {r('v1 / v0 - 1', 5)} AS portfolio_full, CAST(end_date - peak_date AS BIGINT) AS calendar_days FROM g""",
    "win_drawdown_trigger": EPISODES + f""" SELECT portfolio, row_number() OVER (PARTITION BY portfolio ORDER BY peak_date) AS event,
         peak_date, trough_date, end_date, recovered, {r('mdd', 5)} AS market_max_drawdown, {r('odd', 5)} AS portfolio_max_drawdown,
         {r('mt / m0 - 1', 5)} AS market_to_trough, {r('vt / v0 - 1', 5)} AS portfolio_to_trough, {r('v1 / v0 - 1', 5)} AS portfolio_full FROM g""",
    "win_rebalance_flag": " UNION ALL ".join(
        (f"WITH {INSTR} " if i == 0 else "") + f"""SELECT ticker, '{name}' AS frequency, date FROM (
          SELECT ticker, date, date_trunc('{unit}', date) <> lag(date_trunc('{unit}', date)) OVER ({W}) AS f FROM bars) WHERE f"""
        for i, (name, unit) in enumerate((("monthly", "month"), ("quarterly", "quarter"), ("annual", "year")))
    ),
    "win_walk_forward": f"""WITH {forecasts()} SELECT ticker, "window", estimation_rows, training_start_date, {r('estimated', 5)} AS estimated,
         training_end_date, date AS testing_start_date, testing_end_date, {r('realized', 5)} AS realized,
         {r('estimated - realized', 5)} AS forecast_error FROM forecasts""",
    "win_rank_min": f"""WITH {forecasts()}, e AS (SELECT ticker, "window", estimation_rows, sqrt(avg(pow(estimated - realized, 2))) AS rmse,
         avg(abs(estimated - realized)) AS mae FROM forecasts GROUP BY ALL)
       SELECT ticker, "window", {r('rmse', 5)} AS rmse, {r('mae', 5)} AS mae, rank() OVER (PARTITION BY ticker ORDER BY rmse) AS rank_rmse,
         rank() OVER (PARTITION BY ticker ORDER BY mae) AS rank_mae,
         row_number() OVER (PARTITION BY ticker ORDER BY rmse, mae, estimation_rows) = 1 AS selected FROM e""",
    "win_purged_folds": f"""WITH {FOLDS}, s AS (SELECT ticker, selection_date, fold,
         min(feature_date) FILTER (role = 'train') AS train_feature_start, max(feature_date) FILTER (role = 'train') AS train_feature_end,
         max(label_end_date) FILTER (role = 'train') AS train_label_end_max,
         min(feature_date) FILTER (role = 'validation') AS validation_feature_start,
         max(feature_date) FILTER (role = 'validation') AS validation_feature_end,
         max(label_end_date) FILTER (role = 'validation') AS validation_label_end_max,
         count(*) FILTER (role <> 'validation') AS train_rows_before_purge, count(*) FILTER (role = 'train') AS train_rows_after_purge,
         count(*) FILTER (role = 'purged') AS purged_rows, count(*) FILTER (role = 'validation') AS validation_rows FROM mem GROUP BY ALL)
       SELECT *, coalesce(train_label_end_max < validation_feature_start, true) AS purge_valid,
         CASE WHEN coalesce(train_label_end_max < validation_feature_start, true) AND train_rows_after_purge >= 252 THEN 'ok'
           ELSE 'insufficient_train_data' END AS fold_status FROM s""",
    "win_label_audit": f"""WITH {INSTR}, n AS (SELECT ticker, date, row_number() OVER ({W}) AS pos FROM bars),
       t AS (SELECT ticker, date, lead(date, 21) OVER ({W}) AS e, lead(pos, 21) OVER ({W}) - pos AS distance FROM n)
       SELECT ticker, date AS feature_date, e AS label_end_date, e IS NOT NULL AS target_available,
         distance AS trading_day_distance, (e IS NULL OR distance = 21) AS alignment_valid FROM t""",
    "win_annual_folds": f"""WITH {base('week')}, yrs AS (SELECT unnest(range(min(year(date)) + 5, max(year(date)) + 1)) AS validation_year FROM prets),
       j AS (SELECT p.*, y.validation_year, year(date) = validation_year AS isv FROM prets p JOIN yrs y
             ON year(date) BETWEEN validation_year - 5 AND validation_year)
       SELECT portfolio, CAST(validation_year AS BIGINT) AS validation_year, min(date) FILTER (NOT isv) AS train_start, max(date) FILTER (NOT isv) AS train_end,
         count(*) FILTER (NOT isv) AS train_rows, count(*) FILTER (isv) AS validation_rows,
         {r('(stddev_samp(ret) FILTER (isv)) * sqrt(52.0)', 5)} AS validation_volatility, {r('exp(sum(ln(1 + ret)) FILTER (isv)) - 1', 5)} AS validation_return
       FROM j GROUP BY ALL HAVING count(*) FILTER (NOT isv) >= 200 AND count(*) FILTER (isv) >= 12""",
    "win_group_total": f"""WITH {bars('instrument', 'month')} SELECT ticker, sector, date, {r('volume')} AS volume,
         {r('sum(volume) OVER (PARTITION BY date, sector)')} AS sector_volume, {r('volume / sum(volume) OVER (PARTITION BY date, sector)')} AS share FROM bars""",
}
