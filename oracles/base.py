"""Shared SQL text for the DuckDB side. Independent of the Spark code."""

LEVEL = {"type": "p_type", "instrument": "p_brand || '/' || p_type"}
FREQ = {
    "day": "CAST(l_shipdate AS DATE)",
    "week": "CAST(CAST(l_shipdate AS DATE) + CAST((5 - isodow(CAST(l_shipdate AS DATE)) + 7) % 7 AS INTEGER) AS DATE)",
    "month": "last_day(CAST(l_shipdate AS DATE))",
}


def r(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + 1e-{digits + 4}, {digits}) + 0.0)"


def trades(level: str = "type", name: str = "trades") -> str:
    return f"""{name} AS (
      SELECT {LEVEL[level]} AS ticker, p_type AS sector, CAST(l_shipdate AS DATE) AS day,
             l_quantity AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
             l_extendedprice / l_quantity AS unit_price,
             l_orderkey, l_linenumber, l_partkey, l_suppkey
      FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def bars(level: str = "type", freq: str = "day", name: str = "bars") -> str:
    return f"""{name} AS (
      SELECT {LEVEL[level]} AS ticker, p_type AS sector, {FREQ[freq]} AS date,
             arg_min(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS open,
             max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / sum(l_quantity) AS close,
             sum(l_quantity) AS volume,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def market(source: str = "bars", name: str = "market") -> str:
    return f"""{name} AS (
      SELECT 'MARKET' AS ticker, 'MARKET' AS sector, date,
             CAST(sum(cents) AS DOUBLE) / 100.0 / sum(volume) AS close, sum(volume) AS volume,
             CAST(sum(cents) AS BIGINT) AS cents
      FROM {source} GROUP BY date)"""


def instruments(name: str = "instruments") -> str:
    return f"""{name} AS (
      SELECT p_brand || '/' || p_type AS ticker, p_type AS sector, p_brand AS issuer,
             min(CAST(l_shipdate AS DATE)) AS listing_date, max(CAST(l_shipdate AS DATE)) AS last_date,
             count(*) AS trade_rows
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def weekdays_before(day: str) -> str:
    x = f"({day} - DATE '1970-01-05')"
    return f"(5 * CAST(floor({x} / 7.0) AS BIGINT) + least((({x} % 7) + 7) % 7, 5))"
