"""SQL of the aggregate queries."""

from oracles.base import bars, market, r

ALIGNED = """aligned AS (
  SELECT * FROM bars WHERE date IN (
    SELECT date FROM bars GROUP BY date
    HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars)))"""
RETS = """rets AS (
  SELECT * FROM (SELECT ticker, sector, date, close, volume,
      close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM aligned) WHERE ret IS NOT NULL)"""
MRETS = """mrets AS (
  SELECT * FROM (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM market) WHERE ret IS NOT NULL)"""
WEIGHTS = """weights AS (
  SELECT 'equal' AS portfolio, ticker, 1.0::DOUBLE / count(*) OVER () AS weight FROM (SELECT DISTINCT ticker FROM rets)
  UNION ALL
  SELECT 'inverse_vol', ticker, (1 / s) / sum(1 / s) OVER ()
  FROM (SELECT ticker, stddev_samp(ret) * sqrt(12.0) AS s FROM rets GROUP BY ticker)
  UNION ALL
  SELECT 'volume_share', ticker, v / sum(v) OVER () FROM (SELECT ticker, sum(volume) AS v FROM aligned GROUP BY ticker))"""
PRETS = """prets AS (
  SELECT portfolio, date, sum(weight * ret) AS ret FROM rets JOIN weights USING (ticker) GROUP BY ALL)"""
WEALTH = """wealth AS (
  SELECT portfolio, date, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio ORDER BY date)) AS v FROM prets)"""
DD = """dd AS (
  SELECT *, v / max(v) OVER (PARTITION BY portfolio ORDER BY date) - 1 AS d,
         v / greatest(max(v) OVER (PARTITION BY portfolio ORDER BY date), 1.0) - 1 AS d1 FROM wealth)"""


def base(freq="month"):
    return ",\n".join([bars("type", freq), ALIGNED, market("aligned"), RETS, MRETS, WEIGHTS, PRETS, WEALTH, DD])


def corr(x, y):
    return f"(covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0))"


def paired(level="type", freq="week"):
    return ",\n".join([bars(level, freq), market("bars"), """paired AS (
      SELECT * FROM (
        SELECT ticker, sector, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars) o
      JOIN (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS mret FROM market) m USING (date)
      WHERE ret IS NOT NULL AND mret IS NOT NULL)"""])


NAV = """nav AS (
  SELECT p.portfolio, p.date, 100 * p.v AS value, 100 * m.v AS market
  FROM wealth p JOIN (SELECT date, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS v FROM mrets) m USING (date))"""


def forecasts():
    parts = []
    for label, w in (("13 weeks", 13), ("26 weeks", 26), ("52 weeks", 52), ("104 weeks", 104)):
        before = f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        after = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)"
        parts.append(f"""SELECT * FROM (
          SELECT ticker, '{label}' AS "window", {w} AS estimation_rows, date,
            row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n,
            min(date) OVER {before} AS training_start_date, max(date) OVER {before} AS training_end_date,
            max(date) OVER {after} AS testing_end_date,
            covar_samp(ret, mret) OVER {before} / (stddev_samp(ret) OVER {before} * stddev_samp(mret) OVER {before}) AS estimated,
            covar_samp(ret, mret) OVER {after} / (stddev_samp(ret) OVER {after} * stddev_samp(mret) OVER {after}) AS realized
          FROM paired) WHERE pos >= {w} AND (pos - {w}) % 13 = 0 AND pos <= n - 13""")
    return paired() + ",\nforecasts AS (" + "\nUNION ALL\n".join(parts) + ")"


CUM = "exp(sum(ln(1 + ret)))"
ANN = f"pow({CUM}, 12.0 / count(*)) - 1"
VOL = "stddev_samp(ret) * sqrt(12.0)"

SQL = {
    "agg_volatility": f"WITH {base()} SELECT ticker, {r(VOL)} AS sigma FROM rets GROUP BY ticker",
    "agg_covariance": f"""WITH {base()} SELECT a.ticker AS i, b.ticker AS j, {r('covar_samp(a.ret, b.ret) * 12')} AS cov
        FROM rets a JOIN rets b USING (date) GROUP BY ALL""",
    "agg_correlation_matrix": f"""WITH {base()}, s AS (SELECT portfolio AS ticker, date, ret FROM prets
        UNION ALL SELECT 'MARKET', date, ret FROM mrets)
        SELECT a.ticker AS i, b.ticker AS j, {r(corr('a.ret', 'b.ret'), 4)} AS corr FROM s a JOIN s b USING (date) GROUP BY ALL""",
    "agg_data_summary": f"""WITH {bars('type', 'day')}, {ALIGNED}
        SELECT b.ticker, min(b.date) AS first_date, max(b.date) AS last_date, count(*) AS rows,
               count(a.date) AS aligned_rows, count(*) - count(a.date) AS removed_rows
        FROM bars b LEFT JOIN aligned a ON a.ticker = b.ticker AND a.date = b.date GROUP BY b.ticker""",
    "agg_cumulative_return": f"WITH {base()} SELECT portfolio, {r(CUM + ' - 1')} AS cumulative_return FROM prets GROUP BY portfolio",
    "agg_annualized_return": f"""WITH {base()} SELECT portfolio, {r(ANN)} AS annualized_return, count(*) AS observations
        FROM prets GROUP BY portfolio""",
    "agg_sharpe": f"WITH {base()} SELECT portfolio, {r(f'({ANN}) / ({VOL})')} AS sharpe_ratio FROM prets GROUP BY portfolio",
    "agg_benchmark_corr": f"""WITH {base()} SELECT portfolio, {r(corr('p.ret', 'm.ret'))} AS market_correlation, count(*) AS observations
        FROM prets p JOIN mrets m USING (date) GROUP BY portfolio""",
    "agg_max_drawdown": f"""WITH {base()} SELECT portfolio, {r('min(d)')} AS from_first_value, {r('min(d1)')} AS from_capital
        FROM dd GROUP BY portfolio""",
    "agg_performance_table": f"""WITH {base()}, x AS (SELECT dd.*, m.ret AS mret FROM dd JOIN mrets m USING (date))
        SELECT portfolio, {r(CUM + ' - 1')} AS cumulative_return, {r(ANN)} AS annualized_return,
          {r(VOL)} AS annualized_volatility, {r(corr('ret', 'mret'))} AS market_correlation, {r('min(d)')} AS max_drawdown,
          count(*) AS observations, {r(f'({ANN}) / ({VOL})')} AS sharpe_ratio FROM x GROUP BY portfolio""",
    "agg_cagr_calendar": f"""WITH {base()} SELECT portfolio,
        {r("pow(arg_max(v, date) / arg_min(v, date), 365.2425 / (max(date) - min(date))) - 1")} AS cagr FROM wealth GROUP BY portfolio""",
    "agg_downside": f"""WITH {paired('instrument', 'month')}
        SELECT ticker, {r('covar_samp(ret, mret) / nullif(var_samp(mret), 0)', 4)} AS beta,
          count(*) FILTER (mret < 0) AS falling_periods,
          {r('(covar_samp(ret, mret) FILTER (mret < 0)) / nullif(var_samp(mret) FILTER (mret < 0), 0)', 4)} AS downside_beta,
          {r('(avg(ret) FILTER (mret < 0)) / nullif(avg(mret) FILTER (mret < 0), 0)', 4)} AS downside_capture,
          {r('coalesce((avg(ret - mret) FILTER (mret < 0)) * 12, 0)', 4)} AS downside_excess
        FROM paired GROUP BY ticker""",
    "agg_sharpe_sortino": f"""WITH {bars('instrument', 'month')}, x AS (
          SELECT ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars)
        SELECT ticker, {r('avg(ret) * 12 / nullif(stddev_samp(ret) * sqrt(12.0), 0)')} AS sharpe,
          {r('avg(ret) * 12 / nullif(sqrt(avg(ret * ret) FILTER (ret < 0)) * sqrt(12.0), 0)')} AS sortino
        FROM x GROUP BY ticker""",
    "agg_nav_summary": f"""WITH {base('week')}, {NAV}, d AS (
          SELECT *, value / lag(value) OVER (PARTITION BY portfolio ORDER BY date) - 1 AS ret,
            value / max(value) OVER (PARTITION BY portfolio ORDER BY date) - 1 AS dd FROM nav),
        m AS (SELECT portfolio, last_day(date) AS month, arg_max(value, date) AS value FROM nav GROUP BY ALL),
        mr AS (SELECT portfolio, value / lag(value) OVER (PARTITION BY portfolio ORDER BY month) - 1 AS x FROM m),
        a AS (SELECT portfolio, {r('arg_max(value, date) / arg_min(value, date) - 1')} AS cumulative_return,
          {r('pow(arg_max(value, date) / arg_min(value, date), 365.2425 / (max(date) - min(date))) - 1')} AS cagr,
          {r('stddev_samp(ret) * sqrt(52.0)')} AS volatility, {r('avg(ret) * 52 / (stddev_samp(ret) * sqrt(52.0))')} AS sharpe,
          {r('avg(ret) * 52 / (sqrt(avg(ret * ret) FILTER (ret < 0)) * sqrt(52.0))')} AS sortino, {r('min(dd)')} AS max_drawdown
          FROM d GROUP BY portfolio),
        b AS (SELECT portfolio, {r('max(x)')} AS best_month, {r('min(x)')} AS worst_month,
          {r('avg(CASE WHEN x IS NULL THEN NULL WHEN x > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_months FROM mr GROUP BY portfolio)
        SELECT * FROM a JOIN b USING (portfolio)""",
    "agg_concentration": f"""WITH {base()} SELECT portfolio, {r('max(weight)')} AS max_weight, {r('sum(weight * weight)')} AS hhi,
          count(*) FILTER (weight > 1e-6) AS active_count,
          {r('list_sum(list_slice(list_reverse_sort(list(weight)), 1, 3))')} AS top3_weight,
          {r('1 / sum(weight * weight)')} AS effective_n FROM weights GROUP BY portfolio""",
    "agg_sector_allocation": f"""WITH {bars('instrument', 'month')}, v AS (
          SELECT ticker, sector, sum(volume) AS v FROM bars GROUP BY ALL)
        SELECT 'volume_share' AS portfolio, sector, {r('sum(v) / (SELECT sum(v) FROM v)')} AS sector_weight, count(*) AS holdings
        FROM v GROUP BY sector""",
    "agg_forecast_error": f"""WITH {forecasts()} SELECT "window", estimation_rows, {r('avg(abs(estimated - realized))')} AS mae,
          {r('sqrt(avg(pow(estimated - realized, 2)))')} AS rmse, count(*) AS tests,
          {r('stddev_samp(estimated - realized)')} AS error_std, {r('avg(estimated)')} AS mean_estimated,
          {r('avg(realized)')} AS mean_realized FROM forecasts GROUP BY ALL""",
    "agg_rolling_corr_stats": f"""WITH {paired()}, c AS (
          SELECT ticker, CASE WHEN count(*) OVER w = 52 THEN least(greatest(
            covar_samp(ret, mret) OVER w / (stddev_samp(ret) OVER w * stddev_samp(mret) OVER w), -1), 1) END AS c
          FROM paired WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))
        SELECT ticker, 'mean' AS metric, {r('avg(c)', 5)} AS value FROM c GROUP BY ticker
        UNION ALL SELECT ticker, 'maximum', {r('max(c)', 5)} FROM c GROUP BY ticker
        UNION ALL SELECT ticker, 'minimum', {r('min(c)', 5)} FROM c GROUP BY ticker
        UNION ALL SELECT ticker, 'deviation', {r('stddev_samp(c)', 5)} FROM c GROUP BY ticker""",
    "agg_fold_median": f"""WITH {base()}, y AS (SELECT year(date) AS g, ticker, 1 / (stddev_samp(ret) * sqrt(12.0)) AS c FROM rets GROUP BY ALL),
        w AS (SELECT ticker, c / sum(c) OVER (PARTITION BY g) AS w FROM y)
        SELECT ticker, {r('median(w)')} AS median_weight, count(*) AS folds FROM w GROUP BY ticker""",
    "agg_candidate_oos": f"""WITH {base()}, y AS (SELECT p.portfolio, year(p.date) AS y, p.date, p.ret, m.ret AS mret
            FROM prets p JOIN mrets m USING (date)),
        q AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio, y ORDER BY date)) AS v FROM y),
        d AS (SELECT *, v / max(v) OVER (PARTITION BY portfolio, y ORDER BY date) - 1 AS d FROM q),
        g AS (SELECT portfolio, y, {ANN} AS a, {VOL} AS s, min(d) AS md, {corr('ret', 'mret')} AS c FROM d GROUP BY ALL)
        SELECT portfolio, {r('avg(a)', 5)} AS mean_return, {r('min(a)', 5)} AS worst_return, {r('avg(s)', 5)} AS mean_volatility,
          {r('min(md)', 5)} AS worst_drawdown, {r('avg(c)', 5)} AS mean_market_correlation FROM g GROUP BY portfolio""",
}
