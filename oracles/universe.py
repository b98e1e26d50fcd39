"""SQL of the point-in-time universe queries."""

from oracles.base import bars, instruments, r
from oracles.cleaning import DAILY, RAW
from oracles.joins import D, MONTH_ENDS
from oracles.portfolios import SCORES, WM

N = "CAST(regexp_extract(ticker, '#(\\d+)', 1) AS INTEGER)"
CAND = f"""cand AS (SELECT ticker, sector AS typ, CASE sector WHEN 'SMALL' THEN 'Real Estate' WHEN 'MEDIUM' THEN 'Communication Services' WHEN 'LARGE' THEN 'Energy' WHEN 'ECONOMY' THEN 'Utilities'
    WHEN 'STANDARD' THEN 'Financials' ELSE 'Information Technology' END AS cs, listing_date AS ld, CASE WHEN {N} % 5 = 0 THEN CAST(last_date - INTERVAL 6 MONTH AS DATE) END AS dd,
    {N} % 11 = 0 AS lc, {N} = 13 AS lev, {N} = 17 AS inv, 'issuer ' || issuer AS source FROM instruments)"""


def trailing(n, source="bars"):
    w = f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""tr AS (SELECT ticker, date, count(*) OVER {w} AS wr, count(*) FILTER (close > 0 AND volume >= 0) OVER {w} AS vr, min(date) OVER {w} AS ws,
      avg(close * volume) OVER {w} AS md, avg(volume) OVER {w} AS msh FROM {source})"""


def adv(grid, source="bars"):
    return f"""{trailing(20, source)}, af AS (SELECT g.*, tr.date AS we, coalesce(wr, 0) AS wr, vr, ws, md FROM {grid} g ASOF LEFT JOIN tr ON tr.ticker = g.ticker AND g.selection_date >= tr.date),
      ar AS (SELECT *, CASE WHEN wr < 20 THEN 'fewer_than_20_observations' WHEN we <> selection_date THEN 'no_valid_price_on_selection_date' WHEN vr < 20 THEN 'invalid_close_or_volume_in_adv_window' ELSE '' END AS reason FROM af),
      adv AS (SELECT *, CASE WHEN reason = '' THEN md END AS adv20, CASE WHEN wr >= 20 THEN ws END AS aws, CASE WHEN wr >= 20 THEN we END AS awe,
        CASE WHEN reason = 'invalid_close_or_volume_in_adv_window' THEN vr ELSE wr END AS obs FROM ar)"""


ELIG = f"""{D}, {instruments()}, {CAND}, {MONTH_ENDS}, grid AS (SELECT * FROM cand CROSS JOIN months), {adv('grid')},
  el0 AS (SELECT *, selection_date >= ld AS listed, coalesce(selection_date >= dd, false) AS gone, CAST(ld + INTERVAL 60 MONTH AS DATE) <= selection_date AS hist,
    CASE WHEN selection_date >= ld AND cs = 'Communication Services' AND effective_trade_date < DATE '2001-03-01' THEN 'Telecommunication Services' ELSE cs END AS name,
    CASE WHEN selection_date < ld THEN false WHEN cs = 'Real Estate' THEN effective_trade_date >= DATE '2000-09-01'
      WHEN cs = 'Communication Services' THEN effective_trade_date >= DATE '2001-03-01' OR ticker IN ('Brand#1/MEDIUM', 'Brand#2/MEDIUM') ELSE true END AS cv FROM adv),
  el AS (SELECT *, listed AND NOT gone AND NOT lc AS lv, reason = '' AS pv, listed AND NOT gone AND NOT lc AND hist AND cv AND reason = '' AND NOT lev AND NOT inv AS eligible,
    concat_ws('|', CASE WHEN NOT listed THEN 'not_yet_listed' END, CASE WHEN listed AND gone THEN 'already_delisted' END, CASE WHEN NOT hist THEN 'less_than_60_months_valid_history' END,
      CASE WHEN NOT cv THEN 'classification_not_valid_at_effective_trade_date' END, CASE WHEN reason <> '' THEN reason END, CASE WHEN lc THEN 'unresolved_lifecycle_conflict' END,
      CASE WHEN lev OR inv THEN 'prohibited_product_flag' END) AS why,
    CASE WHEN ld <= selection_date THEN round((selection_date - ld) / 30.436875, 2) ELSE 0.0 END AS hm FROM el0)"""
REPS = f"""{ELIG}, e AS (SELECT * FROM el WHERE eligible),
  rk AS (SELECT *, row_number() OVER (PARTITION BY selection_date, name ORDER BY adv20 DESC, obs DESC, hm DESC, ticker) AS rk, count(*) OVER (PARTITION BY selection_date, name) AS cc,
    list_sort(list(ticker) OVER (PARTITION BY selection_date, name)) AS pool FROM e),
  tp AS (SELECT *, CASE WHEN name = 'Telecommunication Services' THEN 'Communication Services' ELSE name END AS cur FROM rk WHERE rk = 1),
  rp AS (SELECT *, lag(ticker) OVER (PARTITION BY cur ORDER BY selection_date) AS prev FROM tp),
  rep AS (SELECT *, coalesce(prev <> ticker, false) AS changed, CASE WHEN prev IS NULL THEN 'initial_selection' WHEN prev = ticker THEN 'unchanged_highest_ADV20'
    WHEN list_contains(pool, prev) THEN 'higher_ADV20_than_previous_representative' ELSE 'previous_representative_ineligible' END AS sw FROM rp)"""
SCREEN = f"""{D}, {instruments()}, {CAND}, {MONTH_ENDS}, g AS (SELECT cand.*, last_day(selection_date) AS cutoff FROM cand CROSS JOIN months), {trailing(63)},
  sc AS (SELECT g.*, tr.date AS mo, coalesce(wr, 0) AS wr, msh, md FROM g ASOF LEFT JOIN tr ON tr.ticker = g.ticker AND g.cutoff >= tr.date),
  s2 AS (SELECT *, coalesce(date_trunc('month', mo) = date_trunc('month', cutoff), false) AS cur, wr >= 40 AS en, coalesce(msh >= 20, false) AS lq FROM sc)"""
SHORT = f"""{SCREEN}, s3 AS (SELECT *, cur AND en AND lq AND ld <= cutoff AND (dd IS NULL OR dd > cutoff) AS ok FROM s2),
  s4 AS (SELECT *, row_number() OVER (PARTITION BY cutoff, cs ORDER BY ok DESC, round(msh, 9) DESC NULLS LAST, ticker) AS rk FROM s3),
  sh AS (SELECT CAST(cutoff + 1 AS DATE) AS holding_month, cutoff, cs AS sleeve, coalesce(string_agg(ticker, ', ' ORDER BY rk) FILTER (ok AND rk <= 3), '') AS selected_symbols,
    count(*) FILTER (ok AND rk <= 3) AS selected_count, count(*) FILTER (ok) AS eligible_count FROM s4 GROUP BY cutoff, cs),
  short AS (SELECT *, CASE WHEN selected_count >= 2 THEN 'READY' ELSE 'ERROR_NEEDS_2_OR_3_ETFS' END AS sleeve_status FROM sh)"""
NAMES = "(SELECT unnest(['Real Estate','Communication Services','Telecommunication Services','Energy','Utilities','Financials','Information Technology','Materials']) AS sector)"
TOTALS = f"""{WM}, sc AS ({SCORES}), pt AS (SELECT *, abs(v - best) <= 1e-12 + 1e-12 * abs(best) AS win FROM sc),
  pp AS (SELECT h, sector, ticker, CASE WHEN win THEN w / sum(CASE WHEN win THEN 1 ELSE 0 END) OVER (PARTITION BY h, sector, k) ELSE 0 END AS p FROM pt),
  tt AS (SELECT h, sector, ticker, round(sum(p), 12) AS total FROM pp GROUP BY ALL),
  wn AS (SELECT h, sector, ticker FROM tt JOIN wm USING (h, sector, ticker) QUALIFY row_number() OVER (PARTITION BY h, sector ORDER BY total DESC, dc, db, cagr DESC, dv DESC, ticker) = 1)"""

SQL = {
    "agg_adv_asof": f"""WITH {D}, {MONTH_ENDS}, p2 AS (SELECT ticker, date, CASE WHEN volume <> 13 THEN close END AS close, volume FROM bars WHERE volume <> 7 OR day(date) < 25),
        g AS (SELECT t.ticker, m.selection_date FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN months m), {adv('g', 'p2')}
        SELECT ticker, selection_date, {r('adv20', 4)} AS adv20, aws AS adv_window_start, awe AS adv_window_end, obs AS adv_valid_observations, reason = '' AS price_data_valid, reason AS adv_reason FROM adv""",
    "agg_liquidity_63": f"""WITH {SCREEN} SELECT ticker, cutoff, mo AS max_observation_used, wr AS trailing_rows, {r('msh', 4)} AS mean_shares, {r('md', 4)} AS mean_dollars, cur AND en AND lq AS passes,
        concat_ws(' | ', CASE WHEN NOT cur THEN 'NO_DATA_IN_FORMATION_MONTH' END, CASE WHEN NOT en THEN 'INSUFFICIENT_TRAILING_OBSERVATIONS' END, CASE WHEN NOT lq THEN 'LIQUIDITY_THRESHOLD_FAILED' END) AS failure_reason FROM s2""",
    "uni_monthly_shortlist": f"WITH {SHORT} SELECT * FROM short",
    "agg_readiness": f"""WITH {SHORT} SELECT holding_month, count(*) FILTER (sleeve_status = 'READY') AS ready_sleeves, count(DISTINCT sleeve) AS total_sleeves,
        count(*) FILTER (sleeve_status = 'READY') = (SELECT count(DISTINCT cs) FROM cand) AND count(DISTINCT sleeve) = (SELECT count(DISTINCT cs) FROM cand) AS all_ready FROM short GROUP BY holding_month""",
    "uni_candidate_5y": f"""WITH {SHORT}, x AS (SELECT holding_month, sleeve, string_split(selected_symbols, ', ') AS l FROM short WHERE selected_symbols <> ''),
        y AS (SELECT holding_month, sleeve, unnest(l) AS ticker, unnest(range(1, len(l) + 1)) AS liquidity_rank FROM x),
        z AS (SELECT y.*, (year(holding_month) - year(listing_date)) * 12 + month(holding_month) - month(listing_date) AS a FROM y JOIN instruments USING (ticker))
        SELECT holding_month, sleeve, liquidity_rank, ticker, a AS history_age_months, a >= 60 AS eligible_5y, CASE WHEN a >= 60 THEN '' ELSE 'History age ' || a || ' months; requires 60' END AS exclusion_reason FROM z""",
    "uni_monthly_eligible": f"""WITH {ELIG} SELECT selection_date, effective_trade_date, ticker, name AS historical_sector_name, {r('hm', 4)} AS available_history_months, hist AS history_valid, cv AS classification_valid,
        lv AS lifecycle_valid, pv AS price_data_valid, eligible, why AS ineligibility_reason, {r('adv20', 4)} AS adv20, aws AS adv_window_start, awe AS adv_window_end, obs AS adv_valid_observations FROM el""",
    "uni_representatives": f"""WITH {REPS} SELECT selection_date, effective_trade_date, name AS sector, ticker, {r('adv20', 4)} AS adv20, cc AS candidate_count, array_to_string(pool, '|') AS candidate_tickers,
        false AS tie_break_used, changed AS representative_changed, sw AS switch_reason FROM rep""",
    "win_switch_reason": f"WITH {REPS} SELECT name AS sector, sw AS switch_reason, count(*) AS months, count(*) FILTER (changed) AS changes FROM rep GROUP BY ALL",
    "agg_monthly_coverage": f"""WITH {ELIG}, c AS (SELECT selection_date, name AS sector, count(*) AS n, string_agg(ticker, '|' ORDER BY ticker) AS t FROM el WHERE eligible GROUP BY ALL),
        g AS (SELECT m.selection_date, s.sector, coalesce(n, 0) AS n, coalesce(t, '') AS t FROM months m CROSS JOIN {NAMES} s LEFT JOIN c ON c.selection_date = m.selection_date AND c.sector = s.sector)
        SELECT selection_date, sector, n AS eligible_count, t AS eligible_tickers, n > 0 AS coverage_available, CASE WHEN n > 0 THEN '' ELSE 'no ETF satisfied all point-in-time eligibility rules' END AS missing_reason,
          CAST(sum(n) OVER (PARTITION BY selection_date) AS BIGINT) AS eligible_total, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY selection_date) AS BIGINT) AS available_sectors FROM g""",
    "agg_sector_coverage": f"""WITH {instruments()}, {CAND}, f AS (SELECT cs, count(*) AS n, string_agg(ticker, '|' ORDER BY ticker) AS t, min(ld) AS e FROM cand WHERE NOT lc AND NOT lev AND NOT inv GROUP BY cs)
        SELECT sector, coalesce(n, 0) AS candidates, coalesce(t, '') AS tickers, coalesce(CAST(e AS VARCHAR), 'unknown') AS earliest_available_date, CASE WHEN n > 0 THEN 'covered' ELSE 'missing' END AS status
        FROM (SELECT unnest(['Energy','Materials','Industrials','Consumer Discretionary','Consumer Staples','Health Care','Financials','Information Technology','Communication Services','Utilities','Real Estate']) AS sector)
        LEFT JOIN f ON cs = sector""",
    "uni_update_metadata": f"""WITH {instruments()}, {CAND} SELECT ticker, ld AS listing_date, CASE WHEN k THEN cs ELSE 'unknown' END AS sector_or_industry, CASE WHEN k THEN 'sector' ELSE 'unknown' END AS classification_level,
        CASE WHEN k THEN 'clean_sector_candidate' ELSE 'needs_review' END AS review_status, CASE WHEN k THEN source ELSE 'unknown' END AS source, CASE WHEN k THEN 'high' ELSE 'low' END AS classification_confidence
        FROM (SELECT *, NOT lc AND NOT lev AND NOT inv AND dd IS NULL AS k FROM cand)""",
    "uni_priority_review": f"""WITH {D}, {instruments()}, {CAND}, {trailing(20)}, l AS (SELECT ticker, arg_max(CASE WHEN wr = 20 THEN md ELSE -1 END, date) AS a0 FROM tr GROUP BY ticker),
        x AS (SELECT cand.*, CASE WHEN a0 >= 0 THEN a0 END AS a FROM cand JOIN l USING (ticker) WHERE lc OR lev OR inv OR dd IS NOT NULL)
        SELECT cs AS target_sector, row_number() OVER (PARTITION BY cs ORDER BY ld, round(a, 6) DESC NULLS LAST, ticker) AS priority_rank, ticker, ld AS listing_date,
          last_day(CAST(ld + INTERVAL 60 MONTH AS DATE)) AS first_eligible_month_end, {r('a', 4)} AS latest_adv20 FROM x""",
    "uni_clean_detail": f"""WITH {D}, {instruments()}, {CAND}, {trailing(20)}, l AS (SELECT ticker, min(date) AS f, max(date) AS m, arg_max(CASE WHEN wr = 20 THEN md ELSE -1 END, date) AS a0 FROM tr GROUP BY ticker)
        SELECT ticker, cs AS likely_sector, f AS first_valid, m AS latest, {r('(m - f) / 30.436875', 4)} AS valid_history_months, {r('CASE WHEN a0 >= 0 THEN a0 END', 4)} AS latest_adv20, source
        FROM cand LEFT JOIN l USING (ticker) WHERE NOT lc AND NOT lev AND NOT inv""",
    "uni_clean_candidates": f"""WITH {RAW}, {DAILY}, {instruments()}, {CAND}, g AS (SELECT ticker, date, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS pd FROM daily),
        h AS (SELECT ticker, max(len(list_filter(range(1, CAST(date - pd AS BIGINT)), lambda k: isodow(CAST(pd + CAST(k AS INTEGER) AS DATE)) < 6))) AS gap FROM g WHERE pd IS NOT NULL GROUP BY ticker),
        t AS (SELECT ticker, concat_ws('|', CASE WHEN sum(missing) > 0 THEN 'missing_ohlcv' END, CASE WHEN sum(nonpos) > 0 THEN 'nonpositive_price' END, CASE WHEN sum(neg) > 0 THEN 'negative_volume' END,
          CASE WHEN sum(logic) > 0 THEN 'ohlc_logic_error' END, CASE WHEN max(n) > 1 THEN 'duplicate_date' END, CASE WHEN any_value(gap) > 5 THEN 'large_missing_gap' END) AS a FROM daily LEFT JOIN h USING (ticker) GROUP BY ticker)
        SELECT ticker, cs AS sector, ld AS listing_date, CASE cs WHEN 'Real Estate' THEN greatest(ld, DATE '2000-08-31') WHEN 'Communication Services' THEN greatest(ld, DATE '2001-02-26') ELSE ld END AS classification_start,
          CASE WHEN a = '' THEN 'none' ELSE a END AS anomaly_types, CASE WHEN lc THEN 'lifecycle_conflict' WHEN lev OR inv THEN 'prohibited_product' ELSE '' END AS problem
        FROM cand LEFT JOIN t USING (ticker) WHERE dd IS NULL""",
    "uni_winner_matrix": f"""WITH {TOTALS} SELECT hm.h AS holding_month, """ + ", ".join(
        f"max(CASE WHEN sector = '{s}' THEN ticker END) AS {s}" for s in ("SMALL", "MEDIUM", "LARGE", "ECONOMY", "STANDARD", "PROMO")
    ) + " FROM hm LEFT JOIN wn ON wn.h = hm.h GROUP BY hm.h",
    "agg_run_summary": f"""WITH {ELIG} SELECT CASE WHEN eligible THEN 'eligible' ELSE split_part(why, '|', 1) END AS status, count(*) AS rows, count(DISTINCT ticker) AS tickers,
        count(DISTINCT selection_date) AS months FROM el GROUP BY 1""",
}
