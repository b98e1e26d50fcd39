"""Column helpers shared by all operators. Everything here stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONDAY_EPOCH = "1970-01-05"


def rnd(column, digits: int = 6) -> Column:
    """Round for output.

    A nudge far below the last digit moves exact halves, which a ratio of cents and
    pieces often hits, off the boundary; adding zero turns a negative zero into zero.
    """
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + F.lit(10.0 ** -(digits + 4)), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **overrides: int) -> DataFrame:
    """Round every double column of an output table."""
    picked = []
    for field in df.schema.fields:
        if field.dataType.simpleString() == "double":
            picked.append(rnd(F.col(field.name), overrides.get(field.name, digits)).alias(field.name))
        elif field.dataType.simpleString() == "int":
            picked.append(F.col(field.name).cast("bigint").alias(field.name))
        else:
            picked.append(F.col(field.name))
    return df.select(*picked)


def finite(column: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(column) | (F.abs(column) == F.lit(float("inf"))), None).otherwise(column)


def positive(column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column > 0, column)


def non_negative(column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column >= 0, column)


def is_close(left: Column, right: Column, rtol: float, atol: float) -> Column:
    return F.abs(left - right) <= F.lit(atol) + F.lit(rtol) * F.abs(right)


def corr_of(x: Column, y: Column) -> Column:
    """Sample correlation that yields NULL, never an error, on a constant series."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))


def beta_of(y: Column, x: Column) -> Column:
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(py, px), F.var_samp(px))


def corr_over(x: Column, y: Column, window, expected: Column | None = None) -> Column:
    """Windowed version of :func:`corr_of`, optionally only for full windows."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    value = F.try_divide(
        F.covar_samp(px, py).over(window),
        F.stddev_samp(px).over(window) * F.stddev_samp(py).over(window),
    )
    if expected is None:
        return value
    return F.when(F.count(px).over(window) == expected, value)


def by_date(*keys: str, order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, *keys: str, order: str = "date"):
    return by_date(*keys, order=order).rowsBetween(-(n - 1), 0)


def full_window(value: Column, source: Column, window, n: int) -> Column:
    """``value`` only where all ``n`` rows of the frame carry ``source``."""
    return F.when(F.count(source).over(window) == n, value)


def weekday_index(day: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.pmod(F.datediff(day, F.lit(MONDAY_EPOCH).cast("date")), F.lit(7))


def weekdays_before(day: Column) -> Column:
    days = F.datediff(day, F.lit(MONDAY_EPOCH).cast("date"))
    return F.lit(5) * F.floor(days / 7).cast("bigint") + F.least(F.pmod(days, F.lit(7)), F.lit(5)).cast("bigint")


def weekdays_between(start: Column, end: Column) -> Column:
    """Weekdays in [start, end)."""
    return weekdays_before(end) - weekdays_before(start)


def add_weekdays(day: Column, n: int) -> Column:
    """Shift by ``n`` weekdays; a weekend start first rolls to the adjoining weekday."""
    dow = weekday_index(day).cast("int")
    if n >= 0:
        base = F.date_sub(day, F.greatest(dow - 4, F.lit(0)))
        inner = F.least(dow, F.lit(4))
        return F.date_add(base, (F.lit(n) + F.lit(2) * F.floor((inner + n) / 5)).cast("int"))
    steps = -n
    base = F.when(dow > 4, F.date_add(day, 7 - dow)).otherwise(day)
    inner = F.when(dow > 4, F.lit(0)).otherwise(dow)
    return F.date_sub(base, (F.lit(steps) + F.lit(2) * F.floor((F.lit(steps + 4) - inner) / 5)).cast("int"))


def week_ending_friday(day: Column) -> Column:
    return F.next_day(F.date_sub(day, 1), "FRI")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month").cast("date")


def reasons_text(*pairs) -> Column:
    """Ordered reason list joined by a pipe; ``pairs`` are (condition, text)."""
    return F.concat_ws("|", *[F.when(condition, text) for condition, text in pairs])


def hex_uniform(text: Column) -> Column:
    """Uniform in (0, 1) from a digest, so a draw depends on its key and seed alone."""
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(2 ** 52))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows by key over the cores at hand.

    Panels are few bytes but much work per row, so sizes alone would merge them into
    one task; a window over the same keys then needs no further exchange.
    """
    session = df.sparkSession
    cores = session.sparkContext.defaultParallelism
    return df.repartition(min(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * cores), *keys)
