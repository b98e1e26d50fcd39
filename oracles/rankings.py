"""SQL of the ranking, sampling and set queries."""

from oracles.base import bars, instruments, r, trades
from oracles.aggregates import forecasts

D = bars("instrument", "day")
ADV = f"""{D}, e AS (SELECT max(date) AS e FROM bars), adv AS (SELECT ticker, sector, avg(close * volume) AS adv, count(*) AS days,
    min(date) || ' to ' || max(date) || ' (' || count(*) || ' trading days)' AS observation_period FROM bars, e
    WHERE date BETWEEN CAST(e - INTERVAL 24 MONTH AS DATE) AND e GROUP BY ticker, sector)"""
ERR = """e AS (SELECT ticker, "window", estimation_rows, sqrt(avg(pow(estimated - realized, 2))) AS rmse, avg(abs(estimated - realized)) AS mae FROM forecasts GROUP BY ALL)"""

SQL = {
    "agg_adv": f"WITH {ADV} SELECT ticker, sector, {r('adv', 4)} AS adv, days, observation_period, CASE WHEN days < 40 THEN 'too_few_days' ELSE 'ok' END AS status FROM adv",
    "win_rank_sector": f"""WITH {ADV} SELECT CAST(list_position(['SMALL','MEDIUM','LARGE','ECONOMY','STANDARD','PROMO'], sector) AS BIGINT) AS sector_order, sector,
        row_number() OVER (PARTITION BY sector ORDER BY adv DESC, ticker) AS rank, ticker, {r('adv', 4)} AS adv FROM adv""",
    "topk_sector_one": f"WITH {ADV} SELECT sector, ticker, {r('adv', 4)} AS adv, observation_period FROM adv QUALIFY row_number() OVER (PARTITION BY sector ORDER BY adv DESC, ticker) = 1",
    "topk_with_ties": f"""WITH {trades('instrument')}, m AS (SELECT last_day(day) AS date, sector, ticker, floor(sum(quantity) / 100) AS a, count(*) AS n FROM trades GROUP BY ALL),
        x AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY a DESC, n DESC, ticker) AS rk,
          sum(CASE WHEN a = mx THEN 1 ELSE 0 END) OVER (PARTITION BY date, sector) > 1 AS tied FROM (SELECT *, max(a) OVER (PARTITION BY date, sector) AS mx FROM m))
        SELECT date, sector, ticker, {r('a')} AS adv20, tied AS tie_break_used, CASE WHEN tied THEN
          'ADV20 tied exactly; selected by valid ADV observations, then longer listing history, then ticker alphabetical order' ELSE '' END AS tie_break_reason FROM x WHERE rk = 1""",
    "topk_three": f"""WITH {bars('instrument', 'month')}, t AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY volume DESC, ticker) AS rk FROM bars QUALIFY rk <= 3)
        SELECT date, sector, string_agg(ticker, ', ' ORDER BY rk) AS selected_symbols, count(*) AS selected_count,
          CASE WHEN count(*) >= 2 THEN 'READY' ELSE 'ERROR_NEEDS_2_OR_3_ETFS' END AS status FROM t GROUP BY date, sector""",
    "topk_min_tiebreak": f"""WITH {forecasts()}, {ERR} SELECT ticker, "window", {r('rmse', 5)} AS rmse, {r('mae', 5)} AS mae FROM e
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY rmse, mae, estimation_rows) = 1""",
    "sample_checks": f"""WITH {D}, s AS (SELECT ticker, date, close, lag(close, 21) OVER w AS b, lead(close, 21) OVER w AS a FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
        SELECT ticker, date, {r('close')} AS close_t, {r('close / b - 1')} AS return_21d, {r('a / close - 1')} AS target_21d, 'PASS' AS status FROM s WHERE b IS NOT NULL AND a IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY md5('42|' || ticker || '|' || date), date) <= 5""",
    "limit_head": f"WITH {instruments()} SELECT ticker, sector, listing_date FROM instruments ORDER BY ticker LIMIT 25",
    "set_union_frames": f"""WITH {bars('type', 'day', 'd')}, {bars('type', 'week', 'w')}, {bars('type', 'month', 'm')}
        SELECT 'day' AS freq, ticker, count(*) AS rows, CAST(0 AS BIGINT) AS with_volume, {r('avg(close)', 5)} AS mean_close FROM d GROUP BY ticker
        UNION ALL SELECT 'week', ticker, count(*), 0, {r('avg(close)', 5)} FROM w GROUP BY ticker
        UNION ALL SELECT 'month', ticker, count(*), count(volume), {r('avg(close)', 5)} FROM m GROUP BY ticker""",
    "set_except_keys": f"""WITH {bars('instrument', 'month')} SELECT t.ticker, c.date FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT DISTINCT date FROM bars) c
        WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = t.ticker AND b.date = c.date)""",
    "set_dedupe": f"""WITH {trades('instrument')} SELECT ticker, day, {r('arg_min(quantity, row(l_orderkey, l_linenumber, l_partkey, l_suppkey))')} AS first_quantity,
        {r('arg_max(quantity, row(l_orderkey, l_linenumber, l_partkey, l_suppkey))')} AS last_quantity, count(*) - 1 AS dropped FROM trades GROUP BY ticker, day HAVING count(*) > 1""",
    "set_signature_compare": f"""WITH {forecasts()}, p AS (SELECT "window", CAST(sum(CAST('0x' || substr(md5(ticker || '|' || date || '|' || testing_end_date), 1, 8) AS BIGINT)) AS BIGINT) AS signature,
        count(*) AS tests FROM forecasts GROUP BY ALL) SELECT "window", signature, tests, (SELECT count(DISTINCT signature) FROM p) AS distinct_signatures FROM p""",
}
