"""Writers. Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fixed_csv(df: DataFrame, path: str, digits: int, mode: str = "errorifexists") -> None:
    """CSV with every double printed to a fixed number of decimals."""
    kind = f"decimal(38,{digits})"
    out = df.select(
        *[
            F.col(f.name).cast(kind).cast("string").alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    out.write.mode(mode).option("header", True).csv(path)


def write_wide_csv(long: DataFrame, path: str, tickers: Sequence[str], value: str, digits: int) -> None:
    """Date x ticker matrix; the tickers are named by the caller, so no extra pass finds them."""
    wide = long.groupBy("date").pivot("ticker", list(tickers)).agg(F.first(value))
    write_fixed_csv(wide, path, digits)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("ticker",), mode: str = "errorifexists") -> None:
    """Parquet folders by key; rows are spread by key first, so a key makes few files."""
    df.repartition(*[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def guarded(write, *args, **kwargs) -> str:
    """Report whether a write that must not overwrite went through."""
    from pyspark.errors import AnalysisException

    try:
        write(*args, **kwargs)
        return "written"
    except AnalysisException as error:
        if "PATH_ALREADY_EXISTS" in str(error):
            return "refused"
        raise
