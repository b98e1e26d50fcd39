"""SQL of the cleaning queries."""

from oracles.aggregates import base
from oracles.base import bars, instruments, r, trades, weekdays_before
from oracles.windows import DATASET, TYPED, long_features

N = "CAST(regexp_extract(ticker, '#(\\d+)', 1) AS INTEGER)"
RAW = f"""{trades('instrument')}, raw AS (SELECT ticker, day AS date, unit_price AS open,
    CASE WHEN quantity = 47 THEN unit_price / 4 ELSE unit_price * 2 END AS high, unit_price / 2 AS low,
    CASE WHEN quantity = 48 THEN 0.0 ELSE unit_price END AS close,
    CASE WHEN quantity = 49 THEN -quantity WHEN quantity <> 50 THEN quantity END AS volume, quantity AS q FROM trades)"""
DAILY = """daily AS (SELECT ticker, date, count(*) AS n, count(*) FILTER (q BETWEEN 47 AND 50) AS f,
    count(*) FILTER (q = 50) AS missing, count(*) FILTER (q = 48) AS nonpos, count(*) FILTER (q = 49) AS neg,
    count(*) FILTER (q = 47 OR q = 48) AS logic FROM raw GROUP BY ALL)"""

SQL = {
    "clean_prices": f"""WITH {trades('instrument')}, v AS (SELECT upper(ticker) AS ticker, day AS date, CAST(cents AS DOUBLE) AS c, quantity,
          row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS s FROM trades WHERE l_linenumber NOT IN (6, 7) AND quantity NOT IN (1, 2))
        SELECT ticker, date, {r('arg_max(c, s)')} AS close, {r('arg_max(quantity, s)')} AS volume FROM v GROUP BY ticker, date""",
    "filter_valid_window": f"""WITH {bars('instrument', 'day')} SELECT ticker, date, {r('close')} AS close, {r('volume')} AS volume FROM bars
        WHERE date >= (SELECT CAST(max(date) - INTERVAL 12 MONTH AS DATE) FROM bars)""",
    "filter_valid_ohlcv": f"WITH {RAW} SELECT ticker, count(*) AS rows, count(*) FILTER (q < 47) AS valid_rows FROM raw GROUP BY ticker",
    "resolve_window": f"""WITH {bars()}, e AS (SELECT max(date) AS end_date FROM bars GROUP BY date_trunc('month', date))
        SELECT end_date, CAST(m AS BIGINT) AS months, CAST(end_date - m * INTERVAL 1 MONTH AS DATE) AS start_date FROM e, (SELECT unnest([1, 3, 12]) AS m)""",
    "filter_lifecycle_slice": f"""WITH {bars('instrument', 'day')}, {instruments()}, l AS (SELECT ticker, CAST(listing_date + INTERVAL 6 MONTH AS DATE) AS f,
          CASE WHEN {N} % 5 = 0 THEN CAST(last_date - INTERVAL 12 MONTH AS DATE) END AS u FROM instruments)
        SELECT ticker, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, {r('sum(volume)')} AS volume
        FROM bars JOIN l USING (ticker) WHERE date >= f AND (u IS NULL OR date <= u) GROUP BY ticker""",
    "filter_eligible_asof": f"""WITH {instruments()}, l AS (SELECT ticker, CASE WHEN {N} % 6 <> 0 THEN listing_date END AS listing_date,
          CASE WHEN {N} % 5 = 0 THEN CAST(last_date - INTERVAL 18 MONTH AS DATE) END AS delisting_date FROM instruments)
        SELECT l.*, as_of FROM l, (SELECT make_date(y, 1, 5) AS as_of FROM range(1995, 2003) t(y))
        WHERE listing_date <= as_of AND (delisting_date IS NULL OR delisting_date > as_of)""",
    "filter_available_asof": f"""WITH {DATASET} SELECT ticker, selection_date, count(*) AS rows, min(feature_date) AS first_feature,
          max(label_end_date) AS last_label_end, {r('avg(target)')} AS mean_target FROM avail GROUP BY ALL""",
    "validate_price_frame": f"""WITH {trades('instrument')}, x AS (SELECT ticker, CASE WHEN quantity <> 50 THEN day END AS date, l_orderkey * 10 + l_linenumber AS seq FROM trades),
        d AS (SELECT ticker, date, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM x GROUP BY ALL),
        e AS (SELECT *, date IS NOT NULL AND max(hi) OVER (PARTITION BY ticker ORDER BY date NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > lo AS late FROM d)
        SELECT ticker, CAST(coalesce(sum(n) FILTER (date IS NULL), 0) AS BIGINT) AS null_dates, CAST(coalesce(sum(n - 1) FILTER (date IS NOT NULL), 0) AS BIGINT) AS repeated_rows,
          count(*) FILTER (late) AS out_of_order_dates FROM e GROUP BY ticker""",
    "estimation_tail": f"""WITH {base()}, a AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM rets)
        SELECT grp, ticker, count(*) AS rows, min(date) AS start_date, max(date) AS end_date, {r('avg(ret)')} AS mean_ret
        FROM a JOIN (VALUES ('3 months', 3), ('6 months', 6), ('1 year', 12), ('2 years', 24), ('3 years', 36), ('full', 100000)) w(grp, size) ON age <= size GROUP BY ALL""",
    "select_features": f"""WITH {TYPED}, {long_features('bars')} SELECT ticker, feature, count(value) AS present, {r('min(value)')} AS low, {r('max(value)')} AS high
        FROM long GROUP BY ticker, feature""",
    "project_sector_sort": f"""WITH {bars('type', 'month')} SELECT CAST(list_position(['SMALL','MEDIUM','LARGE','ECONOMY','STANDARD','PROMO'], sector) AS BIGINT) AS sector_order,
        sector, {r('sum(volume)')} AS volume FROM bars GROUP BY sector""",
    "anomaly_flags": f"""WITH {RAW}, {DAILY}, g AS (SELECT ticker, date, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS pd FROM daily),
        h AS (SELECT *, greatest({weekdays_before('date')} - {weekdays_before('pd')} - 1, 0) AS m FROM g WHERE pd IS NOT NULL),
        gs AS (SELECT ticker, CAST(max(m) AS BIGINT) AS max_gap, string_agg('gap:' || pd || '..' || date, '|' ORDER BY date) FILTER (m > 5) AS gaps FROM h GROUP BY ticker),
        t AS (SELECT ticker, sum(n) AS total_rows, sum(CASE WHEN n > 1 THEN n ELSE f END) AS invalid_rows, sum(missing) AS missing, sum(nonpos) AS nonpos,
          sum(neg) AS neg, sum(logic) AS logic, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS dup,
          string_agg(CAST(date AS VARCHAR), '|' ORDER BY date) FILTER (n > 1 OR f > 0) AS days FROM daily GROUP BY ticker),
        u AS (SELECT t.*, coalesce(max_gap, 0) AS max_gap, gaps, concat_ws('|', CASE WHEN missing > 0 THEN 'missing_ohlcv' END, CASE WHEN nonpos > 0 THEN 'nonpositive_price' END,
          CASE WHEN neg > 0 THEN 'negative_volume' END, CASE WHEN logic > 0 THEN 'ohlc_logic_error' END, CASE WHEN dup > 0 THEN 'duplicate_date' END,
          CASE WHEN coalesce(max_gap, 0) > 5 THEN 'large_missing_gap' END) AS types FROM t LEFT JOIN gs USING (ticker))
        SELECT ticker, CASE WHEN types = '' THEN 'none' ELSE types END AS anomaly_types, concat_ws('|', days, gaps) AS anomaly_dates,
          CAST(total_rows AS BIGINT) AS total_rows, CAST(invalid_rows AS BIGINT) AS invalid_rows, max_gap FROM u""",
    "anomaly_quarantine": f"""WITH {RAW}, x AS (SELECT ticker, date, CASE WHEN q >= 47 OR count(*) OVER (PARTITION BY ticker, date) > 1 THEN 'quarantine' ELSE 'valid' END AS verdict FROM raw)
        SELECT ticker, verdict, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM x GROUP BY ALL""",
    "anomaly_second_source": f"""WITH {RAW}, {DAILY}, {bars('instrument', 'day')}, bad AS (SELECT ticker, date FROM daily WHERE n > 1 OR f > 0),
        s AS (SELECT * FROM bars WHERE day(date) <= 20)
        SELECT ticker, count(*) AS anomaly_dates, max(coalesce(sr, 0)) AS second_rows, count(s2.date) AS found, count(*) FILTER (s2.volume > 5) AS complete
        FROM bad LEFT JOIN s s2 USING (ticker, date) LEFT JOIN (SELECT ticker, count(*) AS sr FROM s GROUP BY ticker) z USING (ticker) GROUP BY ticker""",
}
