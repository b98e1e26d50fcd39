"""SQL of the scalar, classification and metadata queries."""

from oracles.aggregates import base
from oracles.base import bars, instruments, r, weekdays_before
from oracles.cleaning import DAILY, RAW
from oracles.joins import D, MONTH_ENDS
from oracles.universe import CAND
from tidemark.functions import text

N = "CAST(regexp_extract(ticker, '#(\\d+)', 1) AS INTEGER)"
ENDINGS = ("['Gold Trust','US Equity ETF','Treasury Bond Fund','Global Index ETF','2X Daily Bull ETF','Bitcoin Strategy','Covered Call Income ETF',"
           "'S&P 500 ETF','Innovation Stock ETF','Short Daily ETF','Energy Fund','Utilities Shares','Insurance ETF']")
NAMED = f"""{instruments()}, named AS (SELECT *, {N} AS n, upper(sector[1]) || lower(sector[2:]) || ' ' || {N} || ' ' || ({ENDINGS})[{N} % 13 + 1] AS fund_name FROM instruments)"""


def norm(x):
    """Only for texts that are never null tokens."""
    words = f"string_split(trim(regexp_replace(upper({x}), '[^A-Z0-9]+', ' ', 'g')), ' ')"
    return f"array_to_string(list_filter({words}, lambda w: w NOT IN ('ETF','FUND','TRUST','SHARES','THE','')), ' ')"


LIFE = f"""{NAMED}, listing AS (SELECT ticker, fund_name, CAST(listing_date AS VARCHAR) AS ipo_date, 'unknown' AS delisting_date, CASE WHEN n % 9 = 0 THEN 'Active_Needs_Review' ELSE 'Active' END AS status FROM named
    UNION ALL SELECT ticker, 'Former ' || fund_name, CAST(CAST(listing_date - INTERVAL 120 MONTH AS DATE) AS VARCHAR), CAST(CAST(CASE WHEN n % 10 = 0 THEN listing_date + 30 ELSE listing_date - 30 END AS DATE) AS VARCHAR), 'Delisted' FROM named WHERE n % 5 = 0),
  life AS (SELECT *, upper(ticker) || '|' || {norm('fund_name')} || '|' || ipo_date || '|' || delisting_date AS entity_key FROM listing)"""
CUR = """cur AS (SELECT ticker, CASE WHEN n % 3 = 0 THEN 'Entirely Different ' || sector ELSE fund_name || ' Shares' END AS current_name, n FROM named WHERE n % 7 <> 0)"""


def sims(a, b, pairs):
    """(ticker, s): ratio of matching blocks. Each step takes the longest common block of a pair, the first in a and
    then in b, and leaves the pairs on both sides of it."""
    return f"""(WITH RECURSIVE p AS (SELECT ticker, {norm(a)} AS a, {norm(b)} AS b FROM {pairs}),
      blocks AS (SELECT ticker, a, b, CAST(0 AS BIGINT) AS k FROM p UNION ALL
        SELECT ticker, side.a, side.b, side.k FROM (SELECT ticker, unnest([
            {{'a': substr(a, 1, i - 1), 'b': substr(b, 1, strpos(b, block) - 1), 'k': length(block)}},
            {{'a': substr(a, i + length(block)), 'b': substr(b, strpos(b, block) + length(block)), 'k': CAST(0 AS BIGINT)}}]) AS side
          FROM (SELECT ticker, a, b, best.i AS i, substr(a, best.i, best.n) AS block FROM (SELECT ticker, a, b,
            list_filter(flatten(list_transform(range(length(a), 0, -1), lambda n: list_transform(range(1, length(a) - n + 2), lambda i: {{'n': n, 'i': i}}))),
              lambda c: contains(b, substr(a, c.i, c.n)))[1] AS best FROM blocks WHERE a <> '' AND b <> '') WHERE best IS NOT NULL)))
      SELECT ticker, CASE WHEN length(any_value(p.a)) + length(any_value(p.b)) = 0 THEN 1.0 ELSE 2.0 * sum(k) / (length(any_value(p.a)) + length(any_value(p.b))) END AS s
      FROM blocks JOIN p USING (ticker) GROUP BY ticker)"""


# every n % 9 = 0 row is neither active nor delisted, so it joins no active side
CONF = f"""{LIFE}, {CUR},
  sims AS {sims('fund_name', 'current_name', 'named JOIN cur USING (ticker)')},
  nm AS (SELECT n.ticker, n.n, n.fund_name, c.current_name, n.n % 9 <> 0 AS act, n.n % 5 = 0 AS old, s FROM named n JOIN cur c USING (ticker) JOIN sims USING (ticker)),
  c1 AS (SELECT ticker, current_name, array_to_string(list_sort(list_filter([CASE WHEN NOT act THEN 'nasdaq_not_in_alpha_active_etf' END, CASE WHEN act AND s < 0.72 THEN 'active_name_mismatch' END,
      CASE WHEN act AND n % 4 = 0 THEN 'price_predates_current_lifecycle' END, CASE WHEN old THEN 'current_ticker_has_distinct_delisted_entity' END, CASE WHEN old THEN 'alpha_lifecycle_name_conflict' END], lambda t: t IS NOT NULL)), '|') AS conflict_types,
      CASE WHEN act THEN fund_name ELSE '' END AS active_names, CASE WHEN old THEN 'Former ' || fund_name ELSE '' END AS delisted_names FROM nm),
  conf AS (SELECT ticker, conflict_types, current_name, active_names, delisted_names FROM c1 WHERE conflict_types <> ''
    UNION ALL SELECT ticker, 'alpha_active_not_in_nasdaq_snapshot', '', fund_name, '' FROM named WHERE n % 7 = 0 AND n % 9 <> 0
    UNION ALL SELECT ticker, 'alpha_non_etf_entity_same_ticker', current_name, CASE WHEN n % 12 = 0 THEN 'Company ' || ticker ELSE '' END, CASE WHEN n % 12 <> 0 THEN 'Company ' || ticker ELSE '' END FROM cur WHERE n % 6 = 0)"""


def lit(s):
    return "'" + s.replace("'", "''") + "'"


def plain(pattern):
    """RE2 has no look-around; an equivalent for the one rule that uses it."""
    return pattern.replace(r"(?<!\w)[+-]?[23]X(?!\w)", r"(?:^|\W)[23]X(?:\W|$)")


LABELS = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(upper(fund_name), {lit(plain(p))}, 'i') THEN '{k}' END" for k, p in text.EXCLUSION_RULES
) + "], lambda t: t IS NOT NULL)"
SLEEVE = "CASE " + " ".join(
    f"WHEN regexp_matches(fund_name, {lit(p)}, 'i')" + (f" AND NOT regexp_matches(fund_name, {lit(text.NON_EQUITY_ENERGY)}, 'i')" if k == "Energy" else "") + f" THEN {lit(k)}" for k, p in text.SLEEVE_RULES
) + " ELSE '' END"

ACTIVE = "lower(status) = 'active'"
GUESS = lambda label: f"CASE WHEN list_contains(l, '{label}') THEN true END"
VER = lambda truth, guess: f"CASE WHEN ver THEN {truth} ELSE {guess} END"
META = f"""{CONF}, m0 AS (SELECT 'lc_' || substr(sha256(entity_key), 1, 20) AS lifecycle_id, life.ticker, life.fund_name, life.status, life.ipo_date, n, listing_date, n % 2 = 1 AS ver FROM life JOIN named USING (ticker)),
  m1 AS (SELECT *, {LABELS} AS l FROM m0),
  dis AS (SELECT DISTINCT ticker FROM conf WHERE conflict_types <> 'active_name_mismatch'),
  m2 AS (SELECT m1.*, {VER("'ETF'", "CASE WHEN list_contains(l, 'etn') THEN 'ETN' ELSE 'ETF' END")} AS instrument_type,
    {VER("'equity'", f"CASE WHEN list_has_any(l, ['fixed_income', 'convertible_bond']) THEN 'fixed_income' WHEN list_contains(l, 'commodity') THEN 'commodity' WHEN list_contains(l, 'crypto') THEN 'crypto' WHEN list_contains(l, 'currency') THEN 'currency' WHEN list_contains(l, 'multi_asset') THEN 'multi_asset' WHEN list_contains(l, 'mlp') THEN 'mlp' WHEN regexp_matches(upper(fund_name), {lit(text.EQUITY_RULE)}) THEN 'equity_preliminary' ELSE 'unknown' END")} AS asset_class,
    {VER("'United States'", f"CASE WHEN list_contains(l, 'international_or_global') THEN 'non_us_or_global' WHEN regexp_matches(upper(fund_name), {lit(text.UNITED_STATES_RULE)}) THEN 'United States_preliminary' ELSE 'unknown' END")} AS geographic_scope,
    {VER("n = 13", GUESS('leveraged'))} AS leveraged_flag, {VER("n = 17", GUESS('inverse'))} AS inverse_flag,
    {VER("false", f"CASE WHEN regexp_matches(upper(fund_name), {lit(text.SINGLE_STOCK_RULE)}) THEN true END")} AS single_stock_flag, {VER("false", "list_contains(l, 'etn')")} AS etn_flag,
    {VER("CASE WHEN n = 19 THEN NULL ELSE false END", GUESS('option_or_defined_outcome'))} AS option_overlay_flag, {VER("false", f"regexp_matches(fund_name, {lit(text.THEMATIC_RULE)}, 'i')")} AS thematic_flag,
    n % 5 = 0 OR dis.ticker IS NOT NULL AS conflict, n % 4 <> 0 OR status = 'Delisted' AS identity, n % 8 <> 0 AS pc,
    {ACTIVE} AND n % 7 <> 0 AS act FROM m1 LEFT JOIN dis ON dis.ticker = m1.ticker),
  m3 AS (SELECT *, ver AND act AND n NOT IN (13, 17, 19) AND NOT conflict AND identity AND pc AS eligible, CASE WHEN ver THEN [] ELSE l END AS lab, conflict OR lower(status) = 'active_needs_review' AS unres FROM m2),
  m4 AS (SELECT *, NOT unres AND len(lab) = 0 AND NOT eligible AS pend FROM m3),
  meta AS (SELECT lifecycle_id, ticker, fund_name, status, instrument_type, asset_class, geographic_scope, leveraged_flag, inverse_flag, single_stock_flag, etn_flag, option_overlay_flag, thematic_flag,
    CASE WHEN unres THEN 'low' WHEN len(lab) > 0 THEN 'medium' WHEN eligible OR ver THEN 'high' ELSE 'low' END AS classification_confidence,
    CASE WHEN unres THEN 'needs_review' WHEN len(lab) > 0 THEN 'excluded' WHEN eligible THEN 'clean' ELSE 'needs_review' END AS review_status,
    array_to_string(list_sort(list_distinct(list_concat(lab, list_filter([CASE WHEN unres THEN 'unresolved_lifecycle_or_vendor_conflict' END, CASE WHEN pend AND coalesce(thematic_flag, false) THEN 'thematic_manual_review' END,
      CASE WHEN pend AND NOT ver THEN 'insufficient_structured_classification_evidence' END, CASE WHEN pend AND NOT pc THEN 'price_data_not_clean' END, CASE WHEN pend AND NOT identity THEN 'price_identity_not_confirmed' END], lambda t: t IS NOT NULL)))), '|') AS exclusion_reason,
    eligible, conflict AS lifecycle_conflict, identity AS price_identity_match FROM m4)"""
REJ = f"""{META}, r0 AS (SELECT meta.*, {N} AS n FROM meta WHERE review_status <> 'clean'),
  r1 AS (SELECT *, list_filter(list_concat([CASE WHEN n % 4 = 1 THEN 'broad_market_or_size_style' END, CASE WHEN n % 11 = 0 THEN 'industry_or_subindustry_not_sector' END, CASE WHEN leveraged_flag THEN 'leveraged' END,
    CASE WHEN inverse_flag THEN 'inverse' END, CASE WHEN single_stock_flag THEN 'single_stock' END, CASE WHEN etn_flag THEN 'etn' END, CASE WHEN option_overlay_flag THEN 'option_or_defined_outcome' END, CASE WHEN thematic_flag THEN 'thematic' END],
    string_split(exclusion_reason, '|')), lambda t: t IS NOT NULL AND t <> '') AS rs FROM r0),
  rej AS (SELECT *, CASE WHEN len(rs) = 0 THEN 'not_in_officially_verified_standard_sector_pool'
    ELSE array_to_string(list_transform(list_filter(list_zip(rs, range(1, len(rs) + 1)), lambda t: list_position(rs, t[1]) = t[2]), lambda t: t[1]), '|') END AS rejection_reason FROM r1)"""

SQL = {
    "meta_eligibility": f"WITH {META} SELECT * FROM meta",
    "meta_rejections": f"WITH {REJ} SELECT lifecycle_id, ticker, status, review_status, rejection_reason FROM rej",
    "meta_review_priority": f"""WITH {REJ} SELECT row_number() OVER (ORDER BY rejection_reason, ticker, lifecycle_id) AS manual_review_priority, lifecycle_id, ticker, fund_name,
        CASE WHEN lifecycle_conflict THEN 'historical OHLCV identity/cache; ticker lifecycle conflict' ELSE 'historical OHLCV identity/cache' END AS unresolved_fields
        FROM rej WHERE lower(status) = 'delisted' AND n % 10 = 5""",
    "chk_clean_universe": f"WITH {META}, c AS (SELECT * FROM meta WHERE review_status = 'clean') " + " UNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS check_id, '{name}' AS check_name, CASE WHEN count(*) FILTER ({bad}) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) FILTER ({bad}) AS violations FROM c"
        for k, name, bad in [
            *[(k, f"{f}_is_false", f"coalesce({f}, true)") for k, f in enumerate(("leveraged_flag", "inverse_flag", "single_stock_flag", "etn_flag", "option_overlay_flag", "thematic_flag", "lifecycle_conflict"), start=1)],
            (8, "instrument_type_is_etf", "instrument_type <> 'ETF'"), (9, "asset_class_is_equity", "asset_class <> 'equity'"), (10, "scope_is_united_states", "geographic_scope <> 'United States'"), (11, "eligible", "NOT eligible"),
        ]
    ),
    "fn_clean_text": """SELECT CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderpriority END AS priority,
        substr(CASE WHEN o_orderstatus = 'F' THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END, 1, 7) AS month, count(*) AS orders FROM orders GROUP BY ALL""",
    "fn_norm_name": "SELECT upper(p_name) || ' ' || upper(replace(p_brand, '#', ' ')) AS name, count(*) AS parts, CAST(max(p_size) AS BIGINT) AS max_size FROM part GROUP BY 1",
    "fn_lifecycle_id": f"WITH {LIFE} SELECT 'lc_' || substr(sha256(entity_key), 1, 20) AS lifecycle_id, ticker, entity_key, status FROM life",
    "fn_rule_labels": f"""WITH {NAMED}, x AS (SELECT ticker, fund_name, {LABELS} AS l FROM named)
        SELECT ticker, fund_name, array_to_string(l, '|') AS labels, CASE WHEN list_has_any(l, ['fixed_income', 'convertible_bond']) THEN 'fixed_income' WHEN list_contains(l, 'commodity') THEN 'commodity'
          WHEN list_contains(l, 'crypto') THEN 'crypto' WHEN list_contains(l, 'currency') THEN 'currency' WHEN list_contains(l, 'multi_asset') THEN 'multi_asset' WHEN list_contains(l, 'mlp') THEN 'mlp'
          WHEN regexp_matches(upper(fund_name), {lit(text.EQUITY_RULE)}) THEN 'equity_preliminary' ELSE 'unknown' END AS asset_class,
          CASE WHEN list_contains(l, 'international_or_global') THEN 'non_us_or_global' WHEN regexp_matches(upper(fund_name), {lit(text.UNITED_STATES_RULE)}) THEN 'United States_preliminary' ELSE 'unknown' END AS geographic_scope,
          regexp_matches(fund_name, {lit(text.THEMATIC_RULE)}, 'i') AS thematic FROM x""",
    "fn_sleeve_rule": f"""WITH {NAMED}, x AS (SELECT ticker, fund_name, {SLEEVE} AS sleeve, regexp_matches(fund_name, {lit(text.COMMON_EXCLUSION)}, 'i') AS common_exclusion,
          regexp_matches(fund_name, {lit(text.FOREIGN_EXCLUSION)}, 'i') AS foreign_exclusion, listing_date <= DATE '1995-02-01' AS in_window FROM named)
        SELECT *, sleeve <> '' AND NOT common_exclusion AND NOT foreign_exclusion AND in_window AS included FROM x""",
    "fn_tristate": """SELECT l_returnflag, l_linestatus, count(*) FILTER (l_linestatus = 'F') AS true_rows, count(*) FILTER (l_linestatus <> 'F' AND l_returnflag = 'A') AS false_rows,
        count(*) FILTER (l_linestatus <> 'F' AND l_returnflag <> 'A') AS unknown_rows, count(*) FILTER (l_linestatus = 'F' OR l_returnflag NOT IN ('A', 'R')) AS truthy_rows FROM lineitem GROUP BY ALL""",
    "fn_history_months": f"""WITH {instruments()} SELECT ticker, {r('(last_date - listing_date) / 30.436875', 4)} AS history_months, (year(last_date) - year(listing_date)) * 12 + month(last_date) - month(listing_date) AS month_distance,
        CAST(listing_date + INTERVAL 60 MONTH AS DATE) <= last_date AS has_60_months FROM instruments""",
    "fn_business_days": f"""WITH j AS (SELECT CAST(o_orderdate AS DATE) AS o, CAST(l_shipdate AS DATE) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE))
        SELECT last_day(o) AS month, count(*) AS lines, CAST(sum({weekdays_before('s')} - {weekdays_before('o')}) AS BIGINT) AS weekdays,
          max(CAST(o + CASE isodow(o) WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 3 ELSE 5 END AS DATE)) AS latest_third_weekday,
          min(CAST(o - CASE isodow(o) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS DATE)) AS earliest_previous_weekday FROM j GROUP BY 1""",
    "fn_month_end_dates": f"WITH {D} SELECT ticker, max(date) AS month_end FROM bars WHERE date < (SELECT date_trunc('month', max(date)) FROM bars) GROUP BY ticker, date_trunc('month', date)",
    "fn_resample": f"""WITH {D}, d AS (SELECT ticker, date, CASE WHEN volume > 3 THEN close END AS c FROM bars), b AS (
          SELECT 'W-FRI' AS rule, ticker, CAST(date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS DATE) AS bin, arg_max(c, CASE WHEN c IS NOT NULL THEN date END) AS c FROM d GROUP BY ALL
          UNION ALL SELECT 'ME', ticker, last_day(date), arg_max(c, CASE WHEN c IS NOT NULL THEN date END) FROM d GROUP BY ALL),
        sp AS (SELECT x.rule, x.bin, t.ticker FROM (SELECT DISTINCT rule, bin FROM b) x CROSS JOIN (SELECT DISTINCT ticker FROM b) t)
        SELECT sp.rule, sp.ticker, count(*) AS bins, count(c) AS filled, {r('avg(c)', 5)} AS mean_close FROM sp LEFT JOIN b ON b.rule = sp.rule AND b.bin = sp.bin AND b.ticker = sp.ticker GROUP BY ALL""",
    "fn_partition_key": f"WITH {D} SELECT regexp_replace(upper(ticker), '[^A-Z0-9._-]', '_', 'g') AS file_name, year(date) || 'Q' || quarter(date) AS quarter, count(*) AS days FROM bars GROUP BY ALL",
    "fn_math": f"""SELECT c_mktsegment, {r('sum(sign(c_acctbal))', 4)} AS signs, {r('avg(least(greatest(c_acctbal, 0), 5000))', 4)} AS clipped, {r('avg(sqrt(abs(c_acctbal)))', 4)} AS roots, {r('avg(ln(1 + abs(c_acctbal)))', 4)} AS logs,
        count(*) FILTER (abs(c_acctbal - round(c_acctbal)) <= 0.1) AS near_whole, count(*) AS finite_rows FROM customer GROUP BY 1""",
    "fn_positive_mask": f"""SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS positive_rows, count(*) FILTER (l_quantity >= 25) AS non_negative_rows,
        {r('avg(CASE WHEN l_tax > 0 THEN l_discount / l_tax END)', 5)} AS ratio, count(*) FILTER (l_tax > 0) AS ratios FROM lineitem GROUP BY 1""",
    "fn_reason_concat": """SELECT concat_ws('|', CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN l_discount = 0 THEN 'no_discount' END, CASE WHEN l_tax > 0.05 THEN 'taxed' END) AS reasons, count(*) AS lines FROM lineitem GROUP BY 1""",
    "fn_json_cols": f"""WITH {base()} SELECT portfolio, '{{' || string_agg('"' || ticker || '":"' || printf('%.4f', weight + 1e-9) || '"', ',' ORDER BY ticker) || '}}' AS weights FROM weights GROUP BY portfolio""",
    "fn_string_agg": f"WITH {instruments()} SELECT sector, string_agg(ticker, '|' ORDER BY ticker) AS tickers FROM instruments GROUP BY sector",
    "fn_name_similarity": f"""WITH {NAMED}, {CUR}, x AS {sims('fund_name', 'current_name', 'named JOIN cur USING (ticker)')} SELECT ticker, {r('s', 5)} AS similarity, s >= 0.72 AS same FROM x""",
    "fn_gics_pit": f"""WITH {D}, {instruments()}, {CAND}, {MONTH_ENDS}, g AS (SELECT *, ticker IN ('Brand#1/MEDIUM', 'Brand#2/MEDIUM') AS lg FROM cand CROSS JOIN months),
        c AS (SELECT *, CASE WHEN selection_date < ld THEN false WHEN cs = 'Real Estate' THEN effective_trade_date >= DATE '2000-09-01' WHEN cs = 'Communication Services' THEN effective_trade_date >= DATE '2001-03-01' OR lg ELSE true END AS v FROM g)
        SELECT ticker, selection_date, CASE WHEN selection_date >= ld AND cs = 'Communication Services' AND effective_trade_date < DATE '2001-03-01' THEN 'Telecommunication Services' ELSE cs END AS historical_sector_name,
          v AS classification_valid, CASE WHEN selection_date >= ld AND cs = 'Real Estate' AND effective_trade_date < DATE '2000-09-01' THEN 'industry_group'
            WHEN selection_date >= ld AND cs = 'Communication Services' AND effective_trade_date < DATE '2001-03-01' AND NOT lg THEN 'unclassified' ELSE 'sector' END AS classification_level_at_date,
          CASE WHEN v THEN CASE WHEN cs = 'Real Estate' THEN DATE '2000-08-31' WHEN cs = 'Communication Services' AND effective_trade_date >= DATE '2001-03-01' THEN DATE '2001-02-26' ELSE ld END END AS classification_effective_date FROM c""",
    "agg_ticker_reuse": f"""WITH {NAMED} SELECT ticker, CAST(2 AS BIGINT) AS lifecycle_rows, CAST(2 AS BIGINT) AS distinct_names, 'Former ' || fund_name || '|' || fund_name AS fund_names,
        CAST(CAST(listing_date - INTERVAL 120 MONTH AS DATE) AS VARCHAR) || '|' || listing_date AS ipo_dates, CAST(CASE WHEN n % 10 = 0 THEN listing_date + 30 ELSE listing_date - 30 END AS DATE) || '|unknown' AS delisting_dates
        FROM named WHERE n % 5 = 0""",
    "agg_lifecycle": f"""WITH {instruments()}, b AS (SELECT upper(ticker) AS symbol, issuer || ' ' || sector || ' ETF' AS name, listing_date, last_date, {N} AS n FROM instruments WHERE {N} % 7 <> 0)
        SELECT symbol, CASE WHEN listing_date <= DATE '1995-01-15' THEN name || ' Old' ELSE name END AS name, listing_date AS ipo_date, CASE WHEN n % 5 = 0 THEN last_date END AS delisting_date,
          listing_date <= DATE '1995-01-15' AS seen_start, n % 5 <> 0 AS seen_active, n % 5 = 0 AS seen_delisted, CAST(CASE WHEN listing_date <= DATE '1995-01-15' THEN 2 ELSE 1 END AS BIGINT) AS records FROM b""",
    "vendor_conflicts": f"WITH {CONF} SELECT *, 'needs_review' AS resolution_status FROM conf",
    "vendor_resolution": f"""WITH {CONF}, j AS (SELECT c.*, n.n, n.listing_date FROM conf c JOIN named n USING (ticker)),
        k AS (SELECT *, conflict_types = 'active_name_mismatch' AND n % 2 = 1 AS benign, contains(conflict_types, 'alpha_non_etf_entity_same_ticker') AS twin, contains(conflict_types, 'current_ticker_has_distinct_delisted_entity') AS old,
          contains(conflict_types, 'price_predates_current_lifecycle') OR contains(conflict_types, 'nasdaq_not_in_alpha_active_etf') AS severe FROM j),
        m AS (SELECT *, CASE WHEN benign THEN 'benign_name_difference' WHEN twin AND n % 12 = 0 THEN 'entity_type_conflict' WHEN twin THEN 'ticker_reuse_non_overlapping'
            WHEN old AND NOT severe AND n % 9 <> 0 THEN CASE WHEN n % 10 = 0 THEN 'ticker_reuse_overlapping' ELSE 'ticker_reuse_non_overlapping' END ELSE 'unresolved_lifecycle_conflict' END AS cat FROM k)
        SELECT ticker, conflict_types, {norm('current_name')} AS normalized_name, cat AS resolution_category,
          CASE WHEN benign THEN 'same_active_product' WHEN twin AND n % 12 = 0 THEN 'active_non_etf_entity_present' WHEN cat = 'ticker_reuse_non_overlapping' THEN 'non_overlapping'
            WHEN cat = 'ticker_reuse_overlapping' THEN 'overlapping' ELSE 'unknown' END AS lifecycle_overlap_status, benign OR cat = 'ticker_reuse_non_overlapping' AS resolved,
          CAST(listing_date AS VARCHAR) AS usable_price_start_date FROM m""",
    "agg_price_audit": f"""WITH {RAW}, {DAILY}, g AS (SELECT ticker, date, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS pd, missing, n, f, row_number() OVER (PARTITION BY ticker ORDER BY date) AS p FROM daily),
        h AS (SELECT ticker, CAST(coalesce(max(greatest({weekdays_before('date')} - {weekdays_before('pd')} - 1, 0)), 0) AS BIGINT) AS max_gap FROM g GROUP BY ticker),
        rr AS (SELECT ticker, count(*) AS n FROM (SELECT ticker, p - row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM g WHERE missing > 0) GROUP BY ticker, k),
        ru AS (SELECT ticker, max(n) AS m FROM rr GROUP BY ticker),
        s AS (SELECT ticker, min(date) AS fd, max(date) AS ld, CAST(sum(missing) AS BIGINT) AS mi, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS du, CAST(sum(nonpos) AS BIGINT) AS np, CAST(sum(logic) AS BIGINT) AS lo, CAST(sum(neg) AS BIGINT) AS ne,
          CAST(sum(n) AS BIGINT) AS tot, sum(CASE WHEN n > 1 THEN n ELSE f END) AS inv FROM daily GROUP BY ticker)
        SELECT ticker, fd AS first_price_date, ld AS last_price_date, mi AS missing_rows, du AS duplicate_rows, np AS nonpositive_rows, lo AS logic_error_rows, ne AS negative_volume_rows,
          CAST(fd + INTERVAL 60 MONTH AS DATE) <= ld AS sufficient_history, max_gap, tot AS total_rows, coalesce(m, 0) AS max_missing_run, max_gap > 5 OR coalesce(m, 0) > 5 AS large_missing_gap,
          inv = 0 AND NOT (max_gap > 5 OR coalesce(m, 0) > 5) AS clean FROM s JOIN h USING (ticker) LEFT JOIN ru USING (ticker)""",
}
