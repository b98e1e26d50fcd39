"""SQL of the join queries."""

from oracles.aggregates import base
from oracles.base import bars, instruments, r
from oracles.windows import DATASET, W

D = bars("instrument", "day")
MONTH_ENDS = """me AS (SELECT max(date) AS selection_date FROM bars WHERE date < (SELECT date_trunc('month', max(date)) FROM bars) GROUP BY date_trunc('month', date)),
  months AS (SELECT selection_date, (SELECT min(date) FROM bars b WHERE b.date > me.selection_date) AS effective_trade_date FROM me)"""
COV = f"""a0 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM rets),
  tails AS (SELECT grp, ticker, date, ret FROM a0 JOIN (VALUES ('3 months', 13), ('6 months', 26), ('1 year', 52), ('2 years', 104), ('3 years', 156), ('full', 100000)) w(grp, size) ON age <= size),
  cov AS (SELECT a.grp, a.ticker AS i, b.ticker AS j, covar_samp(a.ret, b.ret) * 52 AS cov FROM tails a JOIN tails b ON a.grp = b.grp AND a.date = b.date GROUP BY ALL),
  sg AS (SELECT grp, i AS ticker, sqrt(cov) AS s FROM cov WHERE i = j),
  cr AS (SELECT c.grp, i, j, cov, cov / (x.s * y.s) AS c, x.s FROM cov c JOIN sg x ON x.grp = c.grp AND x.ticker = i JOIN sg y ON y.grp = c.grp AND y.ticker = j),
  mr AS (SELECT grp, i, any_value(s) AS s, list(cov ORDER BY j) AS cv, list(c ORDER BY j) AS c, list(greatest(c, 0.0) ORDER BY j) AS up, list(greatest(-c, 0.0) ORDER BY j) AS dn FROM cr GROUP BY ALL),
  mm AS (SELECT grp, list(i ORDER BY i) AS tk, list(s ORDER BY i) AS s, list(cv ORDER BY i) AS cv, list(c ORDER BY i) AS c, list(up ORDER BY i) AS up, list(dn ORDER BY i) AS dn, sum(s * s) AS tr FROM mr GROUP BY grp)"""

# The multiplicative update for non-negative quadratic programs, many small steps.
WINDOW_WEIGHTS = f"""{base('week')}, {COV}, ys AS (SELECT grp, tk, s, c, list_reduce(list_transform(range(0, 6001), lambda i: list_transform(s, lambda z: 1.0::DOUBLE)),
    lambda y, z: list_transform(list_zip(y, up, dn), lambda t: t[1] * (1 + sqrt(1 + 4 * list_dot_product(t[2], y) * list_dot_product(t[3], y))) / (2 * list_dot_product(t[2], y)))) AS y FROM mm),
  yr AS (SELECT *, list_transform(list_zip(y, s), lambda t: t[1] / t[2]) AS raw, list_max(list_transform(list_zip(y, c), lambda t: abs(least(t[1], list_dot_product(t[2], y) - 1)))) AS residual FROM ys),
  ww AS MATERIALIZED (SELECT grp, unnest(tk) AS ticker, unnest(s) AS sigma, unnest(list_transform(raw, lambda v: v / list_sum(raw))) AS weight, residual FROM yr)"""
L1 = f"WITH {WINDOW_WEIGHTS} SELECT x.grp AS w1, y.grp AS w2, {r('sum(abs(x.weight - y.weight))', 4)} AS l1_distance FROM ww x JOIN ww y USING (ticker) GROUP BY ALL"

SQL = {
    "join_align_inner": f"""WITH {bars()} SELECT ticker, date, {r('close')} AS close FROM bars WHERE date IN (SELECT date FROM bars GROUP BY date
        HAVING count(*) = (SELECT count(DISTINCT ticker) FROM bars))""",
    "join_align_outer": f"""WITH {bars('instrument', 'week')}, g AS (SELECT t.ticker, c.date, b.close FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT DISTINCT date FROM bars) c
        LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = c.date) SELECT ticker, date, {r('close')} AS close, {r(f'close / lag(close) OVER ({W}) - 1')} AS ret FROM g""",
    "join_universe_diff": f"""WITH {D}, e AS (SELECT DISTINCT ticker FROM bars WHERE date < (SELECT date_trunc('quarter', min(date)) + INTERVAL 3 MONTH FROM bars)), l AS (SELECT DISTINCT ticker FROM bars WHERE date >= (SELECT date_trunc('quarter', max(date)) FROM bars))
        SELECT coalesce(e.ticker, l.ticker) AS ticker, CASE WHEN l.ticker IS NULL THEN 'missing' WHEN e.ticker IS NULL THEN 'extra' ELSE 'both' END AS status
        FROM e FULL JOIN l ON e.ticker = l.ticker""",
    "join_feature_target": f"""WITH {D} SELECT ticker, date AS feature_date, {r(f'close / lag(close, 5) OVER ({W}) - 1')} AS return_5d, {r(f'close / lag(close, 21) OVER ({W}) - 1')} AS return_21d,
        lead(date, 21) OVER ({W}) AS label_end_date, lead(date, 21) OVER ({W}) IS NOT NULL AS target_available, {r(f'lead(close, 21) OVER ({W}) / close - 1')} AS target_21d_return, true AS matched_once FROM bars""",
    "join_enrich": f"""WITH {instruments()}, e AS (SELECT p_brand || '/' || p_type AS ticker, arg_min(p_name, row(p_name, p_partkey)) AS objective,
          arg_min(p_retailprice, row(p_name, p_partkey)) AS p FROM part GROUP BY 1), {D}, d AS (SELECT ticker, count(*) AS price_days FROM bars GROUP BY ticker)
        SELECT i.ticker, sector, listing_date, objective, {r('p')} AS list_price, price_days FROM instruments i JOIN e USING (ticker) LEFT JOIN d USING (ticker)""",
    "join_month_grid": f"""WITH {D}, {instruments()}, {MONTH_ENDS} SELECT ticker, listing_date, selection_date, effective_trade_date, listing_date <= selection_date AS listed
        FROM instruments CROSS JOIN months""",
    "join_asof_backward": f"""WITH {D}, g AS (SELECT t.ticker, m.date FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS date FROM bars) m)
        SELECT g.ticker, g.date, b.date AS price_date, {r('b.close')} AS close FROM g ASOF LEFT JOIN bars b ON b.ticker = g.ticker AND g.date >= b.date""",
    "join_asof_forward": f"""WITH {D}, {MONTH_ENDS}, g AS (SELECT t.ticker, m.selection_date AS date FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN months m)
        SELECT g.ticker, g.date, b.date AS next_date, {r('b.close')} AS next_close FROM g ASOF LEFT JOIN bars b ON b.ticker = g.ticker AND g.date < b.date""",
    "join_purge_theta": f"""WITH {DATASET}, x AS MATERIALIZED (SELECT ticker, feature_date, label_end_date FROM ds WHERE target IS NOT NULL),
        v AS (SELECT DISTINCT ticker, CAST(date_trunc('quarter', feature_date) AS DATE) AS validation_start FROM x)
        SELECT v.ticker, v.validation_start, count(*) FILTER (x.label_end_date < v.validation_start) AS kept,
          count(*) FILTER (x.feature_date < v.validation_start AND x.label_end_date >= v.validation_start) AS purged
        FROM v JOIN x ON v.ticker = x.ticker GROUP BY ALL""",
    "join_self_pairs": f"""WITH {base('week')} SELECT a.ticker AS i, b.ticker AS j, count(*) AS weeks, {r('avg(a.ret * b.ret)')} AS mean_product
        FROM rets a JOIN rets b ON a.date = b.date AND a.ticker <= b.ticker GROUP BY ALL""",
    "join_self_windows": L1,
    "join_anti_snapshot": f"""WITH {bars('instrument', 'week')}, y AS (SELECT DISTINCT year(date) AS y, ticker FROM bars WHERE volume >= 100)
        SELECT y AS snapshot_year, ticker, 'not_in_next_year' AS change FROM y a WHERE NOT EXISTS (SELECT 1 FROM y b WHERE b.ticker = a.ticker AND b.y = a.y + 1)
        UNION ALL SELECT y, ticker, 'not_in_previous_year' FROM y a WHERE NOT EXISTS (SELECT 1 FROM y b WHERE b.ticker = a.ticker AND b.y = a.y - 1)""",
    "join_group_max_check": f"""WITH {bars('instrument', 'month')} SELECT date, sector, arg_min(ticker, row(-cents, ticker)) AS ticker, {r('max(cents / 100.0)', 2)} AS dollars,
        count(*) AS candidates, true AS is_maximum FROM bars GROUP BY date, sector""",
}
