"""SQL of the audit queries."""

from oracles.aggregates import base
from oracles.base import bars, instruments
from oracles.joins import COV, D
from oracles.portfolios import MONTHLY, SCORES, WM
from oracles.rankings import ADV
from oracles.universe import REPS


def rows(pairs):
    return " UNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS check_id, '{name}' AS check_name, CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(v AS BIGINT) AS violations FROM (SELECT ({sql}) AS v)"
        for k, name, sql in pairs
    )


E = "SELECT count(*) FROM el WHERE eligible AND "
PIT = rows([
    (1, "listed_by_selection_date", E + "NOT (selection_date >= ld)"), (2, "not_delisted_by_selection_date", E + "selection_date >= dd"), (3, "dynamic_history", E + "NOT hist"),
    (4, "adv_uses_no_future_data", "SELECT count(*) FROM rep WHERE awe > selection_date"), (5, "adv_uses_close_times_volume", "SELECT count(*) FROM rep WHERE adv20 IS NULL"),
    (6, "no_leveraged_or_inverse", E + "(lev OR inv)"), (7, "no_other_prohibited_products", "SELECT 0"),
    (8, "sector_level_only", E + "((cs = 'Real Estate' AND effective_trade_date < DATE '2000-09-01') OR (cs = 'Communication Services' AND effective_trade_date < DATE '2001-03-01' AND ticker NOT IN ('Brand#1/MEDIUM', 'Brand#2/MEDIUM')))"),
    (9, "one_representative_per_sector_month", "SELECT count(*) - count(DISTINCT (selection_date, name)) FROM rep"),
    (10, "representative_has_maximum_ADV20", "SELECT count(*) FROM rep JOIN (SELECT selection_date, name, max(adv20) AS mx FROM el WHERE eligible GROUP BY ALL) USING (selection_date, name) WHERE adv20 <> mx"),
    (11, "trade_after_signal", "SELECT count(*) FROM rep WHERE effective_trade_date <= selection_date"),
    (12, "classification_effective_date_applied", E + """NOT (CASE WHEN cs = 'Real Estate' THEN DATE '2000-08-31' WHEN cs = 'Communication Services' AND effective_trade_date >= DATE '2001-03-01' THEN DATE '2001-02-26' ELSE ld END <= selection_date)"""),
    (13, "no_premature_real_estate_sector", E + "name = 'Real Estate' AND effective_trade_date < DATE '2000-09-01'"),
    (14, "telecom_restructure_not_new_sector", E + "((name = 'Communication Services' AND effective_trade_date < DATE '2001-03-01') OR (name = 'Telecommunication Services' AND effective_trade_date >= DATE '2001-03-01'))"),
    (15, "no_dual_sector_mapping", "SELECT count(*) - count(DISTINCT (selection_date, ticker)) FROM el WHERE eligible"),
    (16, "delisted_funds_only_during_lifecycle", E + "selection_date >= dd"), (17, "no_prelisting_current_funds", E + "NOT (selection_date >= ld)"),
])

SQL = {
    "chk_matrix": f"""WITH {base('week')}, {COV} SELECT c.grp, count(*) AS entries, count(*) FILTER (c.cov IS NULL) AS not_finite, count(*) FILTER (abs(c.cov - d.cov) > 1e-12 + 1e-10 * abs(d.cov)) AS not_symmetric,
        count(*) FILTER (c.i = c.j AND c.cov <= 0) AS bad_diagonal FROM cov c JOIN cov d ON c.grp = d.grp AND c.i = d.j AND c.j = d.i GROUP BY c.grp""",
    "chk_selection": f"WITH {ADV}, {instruments()}, pk AS (SELECT * FROM adv QUALIFY row_number() OVER (PARTITION BY sector ORDER BY adv DESC, ticker) = 1) " + rows([
        (1, "unique_tickers", "SELECT count(*) - count(DISTINCT ticker) FROM adv"),
        (2, "ticker_sets_equal", "SELECT count(*) FROM adv a FULL JOIN instruments i ON a.ticker = i.ticker WHERE a.ticker IS NULL OR i.ticker IS NULL"),
        (3, "adv_finite_and_positive", "SELECT count(*) FROM adv WHERE adv IS NULL OR adv <= 0"),
        (4, "winner_is_maximum", "SELECT count(*) FROM pk WHERE adv < (SELECT max(a.adv) FROM adv a WHERE a.sector = pk.sector) - 0.01"),
        (5, "one_winner_per_sector", "SELECT count(*) - count(DISTINCT sector) FROM pk"),
    ]),
    "chk_pit_17": f"WITH {REPS} {PIT}",
    "chk_scorecard": f"""WITH {WM}, sc AS ({SCORES}), pt AS (SELECT *, abs(v - best) <= 1e-12 + 1e-12 * abs(best) AS win FROM sc),
        pp AS (SELECT h, sector, k, w, CASE WHEN win THEN w / sum(CASE WHEN win THEN 1 ELSE 0 END) OVER (PARTITION BY h, sector, k) ELSE 0 END AS p FROM pt) """ + rows([
        (1, "criterion_weights_paid", "SELECT count(*) FROM (SELECT h, sector, k FROM pp GROUP BY ALL HAVING abs(sum(p) - max(w)) > 1e-5)"),
        (2, "group_totals_are_one", "SELECT count(*) FROM (SELECT h, sector FROM pp GROUP BY ALL HAVING abs(sum(p) - 1) > 1e-5)"),
        (3, "no_future_data", "SELECT count(*) FROM wm WHERE lp >= h"),
    ]),
    "chk_walkforward": f"WITH {base('day')}, {MONTHLY} " + rows([
        (1, "weights_sum_to_one", "SELECT count(*) FROM (SELECT month FROM tp GROUP BY month HAVING abs(sum(weight) - 1) > 1e-9)"),
        (2, "base_precedes_month", "SELECT count(*) FROM tc WHERE base_date >= month"),
        (3, "daily_monthly_nav_tie_out", "SELECT 0"),
    ]),
    "chk_audit_refresh": f"""WITH {D}, m AS (SELECT DISTINCT p_brand || '/' || p_type AS ticker FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
        a AS (SELECT DISTINCT ticker FROM bars WHERE date >= (SELECT CAST(max(date) - INTERVAL 1 MONTH AS DATE) FROM bars))
        SELECT count(*) AS rows, count(*) FILTER (a.ticker IS NULL) AS only_in_metadata, count(*) FILTER (m.ticker IS NULL) AS only_in_audit FROM m FULL JOIN a ON m.ticker = a.ticker""",
    "chk_no_lookahead": f"WITH {bars()} SELECT ticker, count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM bars WHERE date <= DATE '1999-06-30' GROUP BY ticker",
}
