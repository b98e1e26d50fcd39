"""SQL of the source and sink queries."""

from oracles.base import bars, instruments, r

M = bars("type", "month")
N = "CAST(regexp_extract(issuer, '#(\\d+)', 1) AS INTEGER)"

SQL = {
    "scan_dim_csv": f"""WITH {instruments()} SELECT upper(ticker) AS ticker, issuer || ' ' || sector || ' Fund' AS etf_name, issuer,
        CASE WHEN issuer = 'Brand#13' THEN '' ELSE sector || ' Index' END AS underlying_index, sector AS gics_sector, 'issuer page' AS source,
        CASE WHEN issuer = 'Brand#13' THEN 'underlying_index' ELSE '' END AS blank_columns, false AS duplicate_key FROM instruments""",
    "scan_price_files": f"""WITH {M} SELECT 'title' AS layout, ticker, date, {r('cents / 100.0', 2)} AS price, {r('volume', 2)} AS volume FROM bars
        UNION ALL SELECT 'snake', ticker, date, {r('cents / 100.0', 2)}, CASE WHEN volume < 60 THEN NULL ELSE {r('volume', 2)} END FROM bars""",
    "scan_provider_json": f"""WITH {M}, q AS (SELECT ticker, date, {r('cents / 100.0', 2)} AS close, {r('volume', 2)} AS volume,
          date = max(date) OVER (PARTITION BY ticker, year(date)) AS is_last FROM bars)
        SELECT 'array' AS shape, ticker, date, close, volume, CAST(NULL AS VARCHAR) AS reject_reason FROM q
        UNION ALL SELECT 'map', ticker, date, close, volume, NULL FROM q WHERE year(date) <> 1997
        UNION ALL SELECT DISTINCT 'map', ticker, CAST(NULL AS DATE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'quota exceeded' FROM q WHERE year(date) = 1997
        UNION ALL SELECT 'parallel', ticker, date, close, CASE WHEN is_last THEN NULL ELSE volume END, NULL FROM q""",
    "parse_event_props": """WITH e AS (SELECT event_type, CAST(props ->> '$.k' AS BIGINT) AS k FROM events)
        SELECT event_type, count(*) AS events, count(k) AS parsed, min(k) AS min_k, max(k) AS max_k, CAST(sum(k) AS BIGINT) AS sum_k FROM e GROUP BY 1""",
    "scan_listing_snapshots": f"""WITH {instruments()}, b AS (SELECT upper(ticker) AS symbol, issuer || ' ' || sector || ' ETF' AS name,
          CASE WHEN {N} % 2 = 0 THEN 'NYSE Arca' ELSE 'NASDAQ' END AS exchange, listing_date AS ipo_date, last_date, {N} AS n FROM instruments WHERE {N} % 7 <> 0)
        SELECT symbol, name || ' Old' AS name, exchange, ipo_date, CAST(NULL AS DATE) AS delisting_date, 'Active' AS status, 'START_ACTIVE' AS snapshot
          FROM b WHERE ipo_date <= DATE '1995-01-15'
        UNION ALL SELECT symbol, name, exchange, ipo_date, NULL, 'Active', 'END_ACTIVE' FROM b WHERE n % 5 <> 0
        UNION ALL SELECT symbol, name, exchange, ipo_date, last_date, 'Delisted', 'END_DELISTED' FROM b WHERE n % 5 = 0""",
    "scan_pipe_directory": f"""WITH {instruments()} SELECT upper(ticker) AS ticker, issuer || ' ' || sector AS fund_name,
          CASE {N} % 6 WHEN 0 THEN 'NYSE American' WHEN 1 THEN 'NYSE' WHEN 2 THEN 'NYSE Arca' WHEN 3 THEN 'Cboe BZX' WHEN 4 THEN 'IEX' ELSE 'unknown' END AS exchange
        FROM instruments WHERE {N} % 4 <> 0 AND {N} % 9 <> 0""",
    "scan_source_manifest": f"""WITH {M}, f AS (SELECT ticker, 'date,cents,volume' || chr(10) ||
          string_agg(strftime(date, '%Y-%m-%d') || ',' || cents || ',' || CAST(volume AS BIGINT), chr(10) ORDER BY date) || chr(10) AS content,
          count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY ticker)
        SELECT ticker, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS bytes, rows, first_date, last_date, 'OK' AS status FROM f""",
    "merge_incremental": f"""WITH {bars('instrument', 'day')} SELECT ticker, count(*) AS rows, count(*) FILTER (date >= DATE '2000-01-01') AS fresh_rows,
          {r("sum(CASE WHEN date >= DATE '2000-01-01' THEN close + 1 ELSE close END)", 4)} AS close_sum, CAST(max(date) + 1 AS DATE) AS next_start FROM bars GROUP BY ticker""",
    "cache_coverage": f"""WITH {bars('instrument', 'day')}, e AS (SELECT max(date) AS we, CAST(max(date) - INTERVAL 24 MONTH AS DATE) AS ws FROM bars),
        ls AS (SELECT CAST(d AS DATE) AS d FROM e, generate_series(CAST(ws AS TIMESTAMP) + INTERVAL 1 DAY, CAST(ws AS TIMESTAMP) + INTERVAL 14 DAY, INTERVAL 1 DAY) g(d)
               WHERE isodow(d) < 6 ORDER BY d LIMIT 1 OFFSET 2),
        ee AS (SELECT CAST(d AS DATE) AS d FROM e, generate_series(CAST(we AS TIMESTAMP) - INTERVAL 14 DAY, CAST(we AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY) g(d)
               WHERE isodow(d) < 6 ORDER BY d DESC LIMIT 1)
        SELECT ticker, ws AS window_start, we AS window_end, count(*) AS valid_rows, min(date) AS first_date, max(date) AS last_date,
          (SELECT d FROM ls) AS latest_start, (SELECT d FROM ee) AS earliest_end,
          count(*) >= 40 AND min(date) <= (SELECT d FROM ls) AND max(date) >= (SELECT d FROM ee) AS covered
        FROM bars, e WHERE date >= ws GROUP BY ticker, ws, we""",
    "scan_wide_matrix": f"""WITH {M} SELECT d.date, t.ticker, {r('b.cents / 100.0', 2)} AS value, true AS unique_date
        FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT p_type AS ticker FROM part) t LEFT JOIN bars b ON b.date = d.date AND b.ticker = t.ticker""",
    "merge_reviewed": f"""WITH {instruments()} SELECT ticker,
          CASE WHEN {N} % 3 <> 0 THEN lower(sector) WHEN {N} % 2 = 0 THEN 'reviewed' ELSE 'unknown' END AS asset_class,
          CASE WHEN {N} % 4 <> 0 THEN 'US' WHEN {N} % 2 = 0 AND {N} % 8 <> 0 THEN 'Global' ELSE 'unknown' END AS scope FROM instruments""",
    "merge_missing_keys": f"""WITH {instruments()} SELECT ticker, 'reviewed' AS asset_class, CASE WHEN {N} % 8 = 0 THEN 'unknown' ELSE 'Global' END AS scope
        FROM instruments WHERE {N} % 2 = 0
        UNION ALL SELECT ticker, 'unknown', 'needs_review' FROM instruments WHERE {N} % 2 <> 0 AND last_date >= DATE '2001-01-01'""",
    "sink_csv_fixed": f"WITH {M} SELECT ticker, date, CAST(10 AS BIGINT) AS decimals, {r('close')} AS close FROM bars",
    "sink_parquet": f"WITH {bars('type', 'day')} SELECT ticker, count(*) AS rows, {r('sum(volume)')} AS volume, max(date) AS last_date FROM bars GROUP BY ticker",
    "sink_json": f"""WITH {M} SELECT ticker, count(*) AS rows, count(*) FILTER (volume > 100) AS present,
          {r('sum(volume) FILTER (volume > 100)')} AS volume FROM bars GROUP BY ticker""",
    "sink_guard": f"WITH {M} SELECT ticker, count(*) AS rows, 'written' AS first_write, 'refused' AS second_write FROM bars GROUP BY ticker",
}
