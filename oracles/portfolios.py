"""SQL of the portfolio queries."""

from oracles.aggregates import base, corr
from oracles.base import bars, instruments, market, r
from oracles.joins import COV, L1, WINDOW_WEIGHTS

M = bars("instrument", "month")
SEED, COUNT = 20260808, 60
U = f"(CAST('0x' || substr(md5('{SEED}|' || c || '|' || ticker), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"


def grid(blend=1.0, cap=1.0, low=0.0):
    return f"""tk AS (SELECT DISTINCT p_type AS ticker FROM part WHERE p_type IN (SELECT ticker FROM rets)),
      e AS (SELECT c, ticker, CASE WHEN c = 0 THEN 1.0 ELSE -ln({U}) END AS e FROM tk, range(0, {COUNT + 1}) t(c)),
      g0 AS (SELECT c AS candidate, ticker, {blend} * e / sum(e) OVER (PARTITION BY c) + {1 - blend} / count(*) OVER (PARTITION BY c) AS weight FROM e),
      grid AS (SELECT * FROM (SELECT *, max(weight) OVER (PARTITION BY candidate) AS mx, min(weight) OVER (PARTITION BY candidate) AS mn FROM g0) WHERE mx <= {cap} AND mn >= {low})"""


#: Shares by which two rounds move the best weights so far.
STEPS = (0.20, 0.05)


def best_of(source, target):
    return f"""{target}v AS (SELECT w.objective, w.candidate, sum(w.weight * x.weight * cov) AS v FROM {source} w JOIN {source} x ON w.objective = x.objective AND w.candidate = x.candidate JOIN c ON i = w.ticker AND j = x.ticker GROUP BY ALL),
      {target}o AS (SELECT objective, candidate, sum(weight * s) AS sw, sum(weight * mc) AS mw, any_value(ms) AS ms FROM {source} JOIN mc USING (ticker) GROUP BY ALL),
      {target}k AS (SELECT objective, candidate, CASE WHEN objective = 'max_diversification' THEN sw / sqrt(v) ELSE -mw / (sqrt(v) * ms) END AS value FROM {target}o JOIN {target}v USING (objective, candidate)),
      {target} AS MATERIALIZED (SELECT objective, ticker, weight, value FROM {source} JOIN (SELECT objective, arg_max(candidate, row(value, -candidate)) AS candidate, max(value) AS value FROM {target}k GROUP BY objective) USING (objective, candidate))"""


def moved(source, target, number, step):
    draw = U.replace(str(SEED), str(SEED + number))
    return f"""{target}e AS (SELECT objective, c AS candidate, ticker, weight AS base, -ln({draw}) AS e FROM {source}, range(0, {COUNT + 1}) t(c)),
      {target}w AS (SELECT objective, candidate, ticker, CASE WHEN candidate = 0 THEN base ELSE {1 - step} * base + {step} * e / sum(e) OVER (PARTITION BY objective, candidate) END AS weight FROM {target}e),
      {target} AS MATERIALIZED (SELECT objective, candidate, ticker, weight FROM (SELECT *, max(weight) OVER p AS mx, min(weight) OVER p AS mn FROM {target}w WINDOW p AS (PARTITION BY objective, candidate)) WHERE mx <= 0.25 AND mn >= 0.05 OR candidate = 0)"""


PATHS = f"""cp AS (SELECT candidate, date, sum(weight * ret) AS ret FROM rets JOIN grid USING (ticker) GROUP BY ALL),
  paths AS (SELECT cp.*, m.ret AS mret, s.ret AS sret FROM cp JOIN mrets m USING (date) JOIN (SELECT date, ret FROM rets WHERE ticker = 'PROMO') s USING (date)),
  spread AS (SELECT candidate, sum(pow(weight - 1.0 / n, 2)) AS spread FROM (SELECT *, count(*) OVER (PARTITION BY candidate) AS n FROM grid) GROUP BY candidate)"""


def metrics(source, keys, per=52.0):
    return f"""SELECT {keys}, count(*) AS obs, pow(exp(sum(ln(1 + ret))), {per} / count(*)) - 1 AS cagr, stddev_samp(ret) * sqrt({per}) AS vol, min(d) AS mdd,
      {corr('ret', 'mret')} AS cm, {corr('ret', 'sret')} AS cs, coalesce(avg(ret - mret) FILTER (mret < 0) * {per}, 0) AS de
      FROM (SELECT *, wv / max(wv) OVER (PARTITION BY {keys} ORDER BY date) - 1 AS d FROM (
        SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY {keys} ORDER BY date)) AS wv FROM {source})) GROUP BY {keys}"""


PROFILES = """(VALUES ('Balanced', 1.00, 0.20, 0.35, 0.05, 0.05, 0.25, 1.00), ('Defensive', 0.75, 0.45, 0.75, 0.08, 0.08, 0.35, 1.25),
  ('Growth', 1.25, 0.10, 0.20, 0.03, 0.03, 0.15, 0.75)) p(profile, rr, vp, dp, mp, sp, dr, ew)"""
UTIL = "rr * cagr - vp * vol - dp * abs(mdd) - mp * greatest(cm, 0) - sp * greatest(cs, 0) + dr * de - ew * spread"

RESET = """cal AS (SELECT date, coalesce(date_trunc('quarter', date) <> lag(date_trunc('quarter', date)) OVER (ORDER BY date), false) AS f FROM (SELECT DISTINCT date FROM aligned)),
  cb AS (SELECT date, f, coalesce(max(CASE WHEN f THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(date) OVER ()) AS bd FROM cal)"""

MONTHLY = f"""{bars('type', 'month', 'mb')}, vol AS (SELECT ticker, CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS month, volume FROM mb),
  tp AS (SELECT month, ticker, volume / sum(volume) OVER (PARTITION BY month) AS weight FROM (SELECT * FROM vol QUALIFY row_number() OVER (PARTITION BY month ORDER BY volume DESC, ticker) <= 3)),
  px AS (SELECT ticker, date, close, CAST(date_trunc('month', date) AS DATE) AS month FROM aligned),
  en AS (SELECT month, ticker, arg_max(close, date) AS ec, max(date) AS ed FROM px GROUP BY ALL),
  eb AS (SELECT *, lag(ec) OVER (PARTITION BY ticker ORDER BY month) AS bc, lag(ed) OVER (PARTITION BY ticker ORDER BY month) AS bd FROM en),
  held AS (SELECT t.month, t.ticker, t.weight, ec, ed, bc, bd, t.weight * ec / bc AS g FROM tp t JOIN eb USING (month, ticker) WHERE bc IS NOT NULL),
  dr AS (SELECT *, g / sum(g) OVER (PARTITION BY month) AS dw FROM held),
  ms AS (SELECT month, lead(month) OVER (ORDER BY month) AS nm, row_number() OVER (ORDER BY month) AS n FROM (SELECT DISTINCT month FROM held)),
  old AS (SELECT nm AS month, ticker, dw FROM dr JOIN ms USING (month) WHERE nm IS NOT NULL),
  tv AS (SELECT coalesce(h.month, o.month) AS month, 0.5 * sum(abs(coalesce(h.weight, 0) - coalesce(o.dw, 0))) AS t FROM held h FULL JOIN old o ON h.month = o.month AND h.ticker = o.ticker GROUP BY 1),
  tb AS (SELECT h.month, sum(g) AS multiple, max(bd) AS base_date, max(ed) AS end_date, CASE WHEN any_value(ms.n) = 1 THEN 1.0 ELSE any_value(tv.t) END AS turnover
         FROM held h JOIN tv USING (month) JOIN ms USING (month) GROUP BY h.month),
  tc AS (SELECT *, turnover * 0.001 AS cost, 100 * exp(sum(ln(multiple)) OVER (ORDER BY month)) AS gn,
         100 * exp(sum(ln(multiple) + ln(1 - turnover * 0.001)) OVER (ORDER BY month)) AS nn FROM tb)"""

WM = f"""{bars('instrument', 'day')}, {bars('type', 'day', 'tb')}, {market('bars')},
  b AS (SELECT min(date) AS lo, max(date) AS hi FROM bars),
  hm AS (SELECT CAST(unnest(generate_series(date_trunc('month', lo) + INTERVAL 1 MONTH, CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS h FROM b),
  rw AS (SELECT h, x.sector, x.ticker, x.date, x.close, m.close AS market, t.close AS second, x.volume FROM hm JOIN bars x ON x.date < h AND x.date >= CAST(h - INTERVAL 60 MONTH AS DATE)
         JOIN market m ON m.date = x.date JOIN tb t ON t.ticker = x.sector AND t.date = x.date),
  dw AS (SELECT *, close / max(close) OVER (PARTITION BY h, ticker ORDER BY date) - 1 AS d FROM rw),
  da AS (SELECT h, sector, ticker, CASE WHEN max(date) > min(date) THEN pow(arg_max(close, date) / arg_min(close, date), 1.0 / ((max(date) - min(date)) / 365.2425)) - 1 END AS cagr, min(d) AS mdd, count(*) AS n, max(date) AS lp FROM dw GROUP BY ALL),
  mo AS (SELECT h, sector, ticker, last_day(date) AS m, arg_max(close, date) AS c, arg_max(market, date) AS k, arg_max(second, date) AS s FROM rw GROUP BY ALL),
  mr2 AS (SELECT h, sector, ticker, c / lag(c) OVER w - 1 AS ret, k / lag(k) OVER w - 1 AS mret, s / lag(s) OVER w - 1 AS sret FROM mo WINDOW w AS (PARTITION BY h, ticker ORDER BY m)),
  st AS (SELECT h, sector, ticker, count(ret) AS nm, count(*) FILTER (mret < 0) AS fm, {corr('ret', 'mret')} AS cm, {corr('ret', 'sret')} AS cs,
     CASE WHEN var_samp(mret) FILTER (mret < 0) > 1e-8 THEN (covar_samp(ret, mret) FILTER (mret < 0)) / (var_samp(mret) FILTER (mret < 0)) END AS db, CASE WHEN avg(mret) FILTER (mret < 0) < -1e-8 THEN (avg(ret) FILTER (mret < 0)) / (avg(mret) FILTER (mret < 0)) END AS dc FROM mr2 GROUP BY ALL),
  lq AS (SELECT ticker, date, avg(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS dv FROM bars),
  fa AS (SELECT ticker, min(date) AS f FROM bars GROUP BY ticker),
  al AS (SELECT da.h, da.sector, da.ticker, cagr, mdd, n, lp, nm, fm, cm, cs, db, dc, lq.dv, (year(da.h) - year(f)) * 12 + month(da.h) - month(f) AS age
     FROM da JOIN st USING (h, sector, ticker) JOIN lq ON lq.ticker = da.ticker AND lq.date = da.lp JOIN fa ON fa.ticker = da.ticker),
  am AS (SELECT *, CASE WHEN age < 60 THEN 'History age ' || age || ' months; requires 60' WHEN n < 2 THEN 'fewer than two prices' WHEN nm < 2 THEN 'fewer than two monthly returns'
     WHEN fm < 2 OR db IS NULL THEN 'too few falling market months' WHEN cagr IS NULL OR mdd IS NULL OR cm IS NULL OR cs IS NULL OR dc IS NULL OR dv IS NULL THEN 'metric without a value' ELSE '' END AS why FROM al),
  wm AS MATERIALIZED (SELECT * FROM am WHERE why = '')"""
CRIT = [("cagr", 0.20, 1), ("cm", 0.15, -1), ("cs", 0.15, -1), ("db", 0.15, -1), ("mdd", 0.15, 1), ("dc", 0.15, -1), ("dv", 0.05, 1)]
SCORES = " UNION ALL ".join(
    f"SELECT h, sector, ticker, '{m}' AS k, {w} AS w, {m} AS v, {'max' if s > 0 else 'min'}({m}) OVER (PARTITION BY h, sector) AS best FROM wm" for m, w, s in CRIT
)

SQL = {
    "pf_returns": f"WITH {base()} SELECT portfolio, date, {r('ret')} AS ret FROM prets",
    "pf_equal_weight": f"WITH {instruments()} SELECT sector, 'equal' AS portfolio, ticker, {r('1.0 / count(*) OVER (PARTITION BY sector)')} AS weight FROM instruments",
    "pf_normalize": f"WITH {M} SELECT date, ticker, {r('volume / sum(volume) OVER (PARTITION BY date)')} AS weight FROM bars",
    "pf_inverse_vol": f"""WITH {bars('instrument', 'week')}, x AS (SELECT sector, ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars),
        s AS (SELECT sector, ticker, 1 / (stddev_samp(ret) * sqrt(52.0)) AS c FROM x GROUP BY ALL) SELECT sector, 'inverse_vol' AS portfolio, ticker, {r('c / sum(c) OVER (PARTITION BY sector)')} AS weight FROM s""",
    "pf_diversification_ratio": f"""WITH {base()}, s AS (SELECT ticker, stddev_samp(ret) * sqrt(12.0) AS s FROM rets GROUP BY ticker),
        c AS (SELECT a.ticker AS i, b.ticker AS j, covar_samp(a.ret, b.ret) * 12 AS cov FROM rets a JOIN rets b USING (date) GROUP BY ALL),
        v AS (SELECT w.portfolio, sum(w.weight * x.weight * cov) AS v FROM weights w JOIN weights x ON w.portfolio = x.portfolio JOIN c ON i = w.ticker AND j = x.ticker GROUP BY 1),
        m AS (SELECT portfolio, sum(weight * s) AS m FROM weights JOIN s USING (ticker) GROUP BY 1)
        SELECT portfolio, {r('m')} AS weighted_sigma, {r('v')} AS variance, {r('m / sqrt(v)')} AS diversification_ratio FROM m JOIN v USING (portfolio)""",
    "pf_constraints": f"""WITH {base()}, {grid()} SELECT candidate, count(*) AS assets, CAST(0 AS BIGINT) AS not_finite, abs(sum(weight) - 1) <= 1e-8 AS sums_to_one,
        count(*) FILTER (weight < 0.05 - 1e-8) AS below_lower, count(*) FILTER (weight > 0.25 + 1e-8) AS above_upper,
        abs(sum(weight) - 1) <= 1e-8 AND count(*) FILTER (weight < 0.05 - 1e-8 OR weight > 0.25 + 1e-8) = 0 AS satisfied FROM grid GROUP BY candidate""",
    "pf_mdp_analytic": f"""WITH {base('week')}, {COV}, x AS (SELECT grp, tk, s, list_reduce(list_prepend(list_transform(range(0, len(s)), lambda i: list_transform(range(0, len(s)), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE / len(s) ELSE 0.0::DOUBLE END)),
          list_transform(range(0, 16), lambda i: list_transform(s, lambda z: list_transform(s, lambda q: 0.0::DOUBLE)))), lambda x, z: list_transform(x, lambda a: list_transform(list_zip(a, x),
          lambda t: 2 * t[1] - list_dot_product(list_transform(c, lambda q: list_dot_product(q, a)), t[2])))) AS x FROM mm),
        y AS (SELECT grp, tk, list_sum(list_transform(x, lambda a: list_sum(a))) AS q, list_transform(list_zip(x, s), lambda t: list_sum(t[1]) / t[2]) AS raw FROM x)
        SELECT grp, unnest(tk) AS ticker, {r('unnest(list_transform(raw, lambda v: v / list_sum(raw)))', 5)} AS weight, {r('sqrt(q)', 5)} AS analytic_dr, 'solved' AS status FROM y""",
    "pf_mdp_long_only": f"""WITH {WINDOW_WEIGHTS} SELECT grp, ticker, {r('sigma', 5)} AS sigma, {r('weight', 4)} AS weight, {r('residual', 5)} AS kkt_residual, 'optimal' AS status FROM ww""",
    "pf_candidate_grid": f"WITH {base()}, {grid(cap=0.30)} SELECT candidate, ticker, {r('weight')} AS weight FROM grid",
    "pf_candidate_refined": f"""WITH {base()}, {grid(0.3, 0.25, 0.05)}, c AS (SELECT a.ticker AS i, b.ticker AS j, covar_samp(a.ret, b.ret) AS cov FROM rets a JOIN rets b USING (date) GROUP BY ALL),
        mc AS (SELECT ticker, covar_samp(x.ret, m.ret) AS mc, stddev_samp(m.ret) AS ms, stddev_samp(x.ret) AS s FROM rets x JOIN mrets m USING (date) GROUP BY ticker),
        g0a AS MATERIALIZED (SELECT objective, candidate, ticker, weight FROM grid, (VALUES ('max_diversification'), ('min_market_correlation')) o(objective)), {best_of('g0a', 'h0')},
        {moved('h0', 'g1', 1, STEPS[0])}, {best_of('g1', 'h1')}, {moved('h1', 'g2', 2, STEPS[1])}, {best_of('g2', 'h2')}
        SELECT objective, ticker, {r('h2.weight', 5)} AS weight, {r("CASE WHEN objective = 'max_diversification' THEN h2.value ELSE -h2.value END", 5)} AS value,
        {r("CASE WHEN objective = 'max_diversification' THEN z.value ELSE -z.value END", 5)} AS start_value FROM h2 JOIN (SELECT DISTINCT objective, value FROM h0) z USING (objective)""",
    "pf_candidate_scoring": f"""WITH {base()}, {grid(0.3, 0.25, 0.05)}, c AS (SELECT a.ticker AS i, b.ticker AS j, covar_samp(a.ret, b.ret) AS cov FROM rets a JOIN rets b USING (date) GROUP BY ALL),
        mc AS (SELECT ticker, covar_samp(x.ret, m.ret) AS mc, stddev_samp(m.ret) AS ms, stddev_samp(x.ret) AS s FROM rets x JOIN mrets m USING (date) GROUP BY ticker),
        v AS (SELECT w.candidate, sum(w.weight * x.weight * cov) AS v FROM grid w JOIN grid x ON w.candidate = x.candidate JOIN c ON i = w.ticker AND j = x.ticker GROUP BY 1),
        o AS (SELECT candidate, sum(weight * s) AS sw, sum(weight * mc) AS mw, any_value(ms) AS ms FROM grid JOIN mc USING (ticker) GROUP BY 1),
        k AS (SELECT candidate, sw / sqrt(v) AS dr, mw / (sqrt(v) * ms) AS rc FROM o JOIN v USING (candidate)),
        wk AS (WITH {base('week')}, {PATHS} SELECT x.*, spread FROM ({metrics('paths', 'candidate')}) x JOIN spread USING (candidate)),
        ut AS (SELECT candidate, {UTIL} AS u FROM wk, {PROFILES} WHERE profile = 'Balanced')
        SELECT 'max_diversification' AS objective, arg_max(candidate, row(dr, -candidate)) AS candidate, {r('max(dr)', 5)} AS value FROM k
        UNION ALL SELECT 'min_market_correlation', arg_min(candidate, row(rc, candidate)), {r('min(rc)', 5)} FROM k
        UNION ALL SELECT 'max_utility', arg_max(candidate, row(u, -candidate)), {r('max(u)', 5)} FROM ut""",
    "pf_utility": f"""WITH {base('week')}, {grid(0.3, 0.25, 0.05)}, {PATHS}, m AS ({metrics('paths', 'candidate')})
        SELECT candidate, profile, {r(UTIL, 5)} AS utility FROM m JOIN spread USING (candidate), {PROFILES}""",
    "pf_profile_select": f"""WITH mp AS MATERIALIZED (WITH {base()}, {grid(0.3, 0.25, 0.05)}, {PATHS} SELECT CAST(date_trunc('month', date) AS DATE) AS v, candidate, date, ret, mret, sret FROM paths),
        {base('week')}, {grid(0.3, 0.25, 0.05)}, {PATHS}, vm AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS v FROM paths),
        mem AS MATERIALIZED (SELECT paths.*, v FROM paths JOIN vm ON date < v AND date >= CAST(v - INTERVAL 36 MONTH AS DATE)),
        m AS ({metrics('mem', 'v, candidate')}),
        t AS (SELECT v, profile, candidate, {UTIL} AS u FROM m JOIN spread USING (candidate), {PROFILES} WHERE obs >= 140),
        p AS MATERIALIZED (SELECT v, profile, arg_max(candidate, row(u, -candidate)) AS candidate, max(u) AS tu FROM t GROUP BY ALL),
        vp AS (SELECT h.v AS h, p.profile, mp.date, ret, mret, sret FROM vm h JOIN p ON p.v < h.v AND p.v >= CAST(h.v - INTERVAL 24 MONTH AS DATE) JOIN mp ON mp.v = p.v AND mp.candidate = p.candidate),
        q AS ({metrics('vp', 'h, profile', 12.0)}),
        j AS (SELECT p.*, cagr - 0.25 * vol - 0.5 * abs(mdd) - 0.05 * greatest(cm, 0) - 0.05 * greatest(cs, 0) + 0.25 * de AS vu, mdd, vol FROM p JOIN q ON q.h = p.v AND q.profile = p.profile WHERE obs = 24)
        SELECT v AS holding_month, profile, candidate, {r('tu', 5)} AS training_utility, {r('vu', 5)} AS validation_utility, {r('mdd', 5)} AS max_drawdown, {r('vol', 5)} AS volatility,
          row_number() OVER (PARTITION BY v ORDER BY round(vu, 9) DESC, round(mdd, 9) DESC, round(vol, 9), profile) = 1 AS selected FROM j""",
    "pf_box_projection": f"""WITH {base()}, {grid()}, l AS (SELECT candidate, list(ticker ORDER BY ticker) AS tk, list(weight ORDER BY ticker) AS w FROM grid GROUP BY candidate),
        s AS (SELECT *, list_reduce(list_transform(range(0, 101), lambda i: [list_min(w) - 0.25, list_max(w) - 0.05]), lambda b, z:
          CASE WHEN list_sum(list_transform(w, lambda v: least(greatest(v - (b[1] + b[2]) / 2, 0.05), 0.25))) > 1 THEN [(b[1] + b[2]) / 2, b[2]] ELSE [b[1], (b[1] + b[2]) / 2] END) AS b FROM l)
        SELECT candidate, unnest(tk) AS ticker, {r('unnest(list_transform(w, lambda v: least(greatest(v - (b[1] + b[2]) / 2, 0.05), 0.25)))', 5)} AS weight FROM s""",
    "pf_round_units": f"""WITH {base()}, {grid()}, l AS (SELECT candidate, list(ticker ORDER BY ticker) AS tk, list(weight ORDER BY ticker) AS w FROM grid GROUP BY candidate),
        s AS (SELECT *, list_reduce(list_transform(range(0, 101), lambda i: [list_min(w) - 0.25, list_max(w) - 0.05]), lambda b, z:
          CASE WHEN list_sum(list_transform(w, lambda v: least(greatest(v - (b[1] + b[2]) / 2, 0.05), 0.25))) > 1 THEN [(b[1] + b[2]) / 2, b[2]] ELSE [b[1], (b[1] + b[2]) / 2] END) AS b FROM l),
        p AS (SELECT candidate, unnest(tk) AS ticker, round(unnest(list_transform(w, lambda v: least(greatest(v - (b[1] + b[2]) / 2, 0.05), 0.25))), 9) / 0.01 AS raw FROM s),
        u AS (SELECT *, least(greatest(floor(raw), 5), 25) AS un, 100 - sum(least(greatest(floor(raw), 5), 25)) OVER (PARTITION BY candidate) AS miss FROM p),
        st AS (SELECT *, unnest(range(1, CAST(CASE WHEN miss > 0 THEN 25 - un WHEN miss < 0 THEN un - 5 ELSE 0 END AS BIGINT) + 1)) AS k FROM u),
        mv AS (SELECT candidate, ticker, count(*) AS mvs FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY (raw - un) * sign(miss) - k + 1 DESC, ticker, k) <= abs(miss)) GROUP BY ALL)
        SELECT candidate, ticker, CAST(un + coalesce(mvs, 0) * sign(miss) AS BIGINT) AS units, {r('(un + coalesce(mvs, 0) * sign(miss)) * 0.01')} AS rounded_weight FROM u LEFT JOIN mv USING (candidate, ticker)""",
    "pf_nav_rebalanced": f"""WITH {base('week')}, {RESET}, mu AS (SELECT portfolio, x.date, f, sum(weight * x.close / y.close) AS m FROM aligned x JOIN cb USING (date)
          JOIN aligned y ON y.ticker = x.ticker AND y.date = cb.bd JOIN weights w ON w.ticker = x.ticker GROUP BY ALL)
        SELECT portfolio, date, f AS rebalance, {r('100 * m * exp(coalesce(sum(CASE WHEN f THEN ln(m) END) OVER (PARTITION BY portfolio ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))', 5)} AS nav FROM mu""",
    "pf_nav_monthly_costs": f"""WITH {base('day')}, {MONTHLY} SELECT 'momentum' AS portfolio, month, {r('multiple', 5)} AS multiple, base_date, end_date, {r('turnover', 5)} AS turnover, {r('cost', 5)} AS cost_rate,
        {r('ln(gn / 100)', 5)} AS log_gross_nav, {r('ln(nn / 100)', 5)} AS log_net_nav, {r('multiple - 1', 5)} AS gross_return, {r('(1 - cost) * multiple - 1', 5)} AS net_return FROM tc""",
    "pf_nav_daily_path": f"""WITH {base('day')}, {MONTHLY} SELECT 'momentum' AS portfolio, px.date, {r('ln(any_value(gn / multiple) * sum(weight * px.close / bc) / 100)', 5)} AS log_gross_nav,
        {r('ln(any_value(nn / multiple) * sum(weight * px.close / bc) / 100)', 5)} AS log_net_nav FROM held JOIN px USING (month, ticker) JOIN tc USING (month) GROUP BY px.date""",
    "pf_weights_long": f"""WITH {bars('type', 'month', 'mb')}, vol AS (SELECT ticker, CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS month, volume FROM mb),
        tp AS (SELECT month, ticker, volume / sum(volume) OVER (PARTITION BY month) AS weight FROM (SELECT * FROM vol QUALIFY row_number() OVER (PARTITION BY month ORDER BY volume DESC, ticker) <= 3))
        SELECT month, row_number() OVER (PARTITION BY month ORDER BY weight DESC, ticker) AS sleeve, ticker, {r('weight')} AS weight FROM tp""",
    "pf_stability_l1": f"SELECT *, true AS valid FROM ({L1})",
    "pf_window_robustness": f"""WITH {WINDOW_WEIGHTS}, s AS (SELECT grp, ticker, stddev_samp(ret) * sqrt(52.0) AS s FROM tails GROUP BY ALL),
        v AS (SELECT w.grp, sum(w.weight * x.weight * c.cov) AS v FROM ww w JOIN ww x ON w.grp = x.grp JOIN cov c ON c.grp = w.grp AND i = w.ticker AND j = x.ticker GROUP BY 1),
        m AS (SELECT grp, sum(weight * s) AS m FROM ww JOIN s USING (grp, ticker) GROUP BY 1),
        p AS (SELECT grp, date, sum(weight * ret) AS ret FROM rets JOIN ww USING (ticker) GROUP BY ALL),
        q AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY grp ORDER BY date)) AS v FROM p),
        d2 AS (SELECT q.*, v / max(v) OVER (PARTITION BY grp ORDER BY date) - 1 AS d, k.ret AS mret FROM q JOIN mrets k USING (date))
        SELECT grp, {r('exp(sum(ln(1 + ret))) - 1', 3)} AS cumulative_return, {r('pow(exp(sum(ln(1 + ret))), 52.0 / count(*)) - 1', 3)} AS annualized_return, {r('stddev_samp(ret) * sqrt(52.0)', 3)} AS annualized_volatility,
          {r(corr('ret', 'mret'), 3)} AS market_correlation, {r('min(d)', 3)} AS max_drawdown, count(*) AS observations,
          {r('(pow(exp(sum(ln(1 + ret))), 52.0 / count(*)) - 1) / (stddev_samp(ret) * sqrt(52.0))', 3)} AS sharpe_ratio, {r('any_value(m.m / sqrt(v.v))', 3)} AS diversification_ratio
        FROM d2 JOIN m USING (grp) JOIN v USING (grp) GROUP BY grp""",
    "pf_metrics_5y": f"""WITH {WM} SELECT ticker, h AS holding_month, sector, n AS price_rows, lp AS last_price_used, nm AS monthly_returns, fm AS falling_months, age AS history_age_months, why AS exclusion_reason,
        CASE WHEN age < 60 THEN 'NOT_RUN' WHEN why <> '' THEN 'FAILED' ELSE 'OK' END AS calculation_status, """ + ", ".join(
        r(f"CASE WHEN why = '' THEN {c} END", 4) + f" AS {name}" for c, name in (
            ("cagr", "cagr"), ("mdd", "maximum_drawdown"), ("cm", "correlation_market"), ("cs", "correlation_second"), ("db", "downside_beta"), ("dc", "downside_capture"), ("dv", "dollar_volume"))
    ) + " FROM am",
    "pf_scorecard": f"""WITH {WM}, sc AS ({SCORES}), pt AS (SELECT *, abs(v - best) <= 1e-12 + 1e-12 * abs(best) AS win FROM sc),
        pp AS (SELECT h, sector, ticker, CASE WHEN win THEN w / sum(CASE WHEN win THEN 1 ELSE 0 END) OVER (PARTITION BY h, sector, k) ELSE 0 END AS p FROM pt),
        tt AS (SELECT h, sector, ticker, round(sum(p), 12) AS total FROM pp GROUP BY ALL)
        SELECT h AS holding_month, sector, ticker, {r('total')} AS total_score, row_number() OVER (PARTITION BY h, sector ORDER BY total DESC, dc, db, cagr DESC, dv DESC, ticker) AS selection_rank,
          CAST(sum(CASE WHEN abs(total - mx) <= 1e-12 + 1e-12 * abs(mx) THEN 1 ELSE 0 END) OVER (PARTITION BY h, sector) AS BIGINT) AS tie_count
        FROM (SELECT *, max(total) OVER (PARTITION BY h, sector) AS mx FROM tt) JOIN wm USING (h, sector, ticker)""",
    "pf_tieout": f"WITH {base()} SELECT portfolio, count(*) AS rows, count(*) AS matching FROM prets GROUP BY portfolio",
}
