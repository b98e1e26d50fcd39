"""Net asset value of drifting weights: segments between resets, chained by logarithms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.episodes import rebalance_flags


def nav_rebalanced(prices: DataFrame, weights: DataFrame, frequency: str, start: float = 100.0) -> DataFrame:
    """Weights return to target at the close of the first row of each new period.

    A row belongs to the segment opened by the latest earlier reset; its value is the
    segment multiple of that reset's prices, and closed segments multiply up. A day on
    which any holding of a portfolio lacks a price is no day of that portfolio.
    """
    priced = prices.select("ticker", "date", "close").where(F.col("close").isNotNull()).join(weights.select("portfolio", "ticker", "weight"), "ticker")
    size = weights.groupBy("portfolio").agg(F.count(F.lit(1)).alias("_size"))
    days = priced.groupBy("portfolio", "date").agg(F.count(F.lit(1)).alias("_n")).join(size, "portfolio").where("_n = _size").select("portfolio", "date")
    calendar = rebalance_flags(days, frequency, ["portfolio"])
    before = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("date").over(Window.partitionBy("portfolio"))
    calendar = calendar.withColumn(
        "base_date", F.coalesce(F.max(F.when(F.col("rebalance"), F.col("date"))).over(before), first)
    )
    base = prices.select("ticker", F.col("date").alias("base_date"), F.col("close").alias("base_close"))
    moved = priced.join(calendar, ["portfolio", "date"]).join(base, ["ticker", "base_date"])
    multiple = moved.groupBy("portfolio", "date", "rebalance").agg(
        F.sum(F.col("weight") * F.col("close") / F.col("base_close")).alias("multiple")
    )
    path = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.sum(F.when(F.col("rebalance"), F.log("multiple"))).over(path), F.lit(0.0))
    return multiple.withColumn("nav", F.lit(start) * F.exp(closed) * F.col("multiple")).select("portfolio", "date", "rebalance", "nav")


def nav_monthly_costs(prices: DataFrame, weights: DataFrame, bps: float, start: float = 100.0) -> dict[str, DataFrame]:
    """Monthly holdings with turnover and costs: tables ``monthly``, ``daily`` and ``incomplete``.

    ``weights``: portfolio, month (first day), ticker, weight. The base price is the
    last one before the month; turnover is half the L1 distance to the drifted weights
    of the month before, and everything is bought in the first month. A month in which
    a holding lacks a base or an end price has no row; ``incomplete`` names the holding.
    A day on which any holding lacks a price is left out of the path.
    """
    prices = prices.where(F.col("close").isNotNull())
    by_month = prices.select("ticker", "date", "close", F.trunc("date", "month").cast("date").alias("month"))
    ends = by_month.groupBy("month", "ticker").agg(F.max_by("close", "date").alias("end_close"), F.max("date").alias("end_date"))
    order = Window.partitionBy("ticker").orderBy("month")
    ends = ends.withColumns({"base_close": F.lag("end_close").over(order), "base_date": F.lag("end_date").over(order)})
    part = Window.partitionBy("portfolio", "month")
    wanted = weights.withColumn("_size", F.count(F.lit(1)).over(part)).join(ends, ["month", "ticker"], "left")
    missing = F.when(F.col("end_close").isNull(), "no_price_in_month").when(F.col("base_close").isNull(), "no_base_price")
    incomplete = wanted.withColumn("reason", missing).where(F.col("reason").isNotNull()).select("portfolio", "month", "ticker", "reason")
    held = wanted.withColumn("_found", F.count("base_close").over(part)).where("_found = _size")
    held = held.withColumn("grown", F.col("weight") * F.col("end_close") / F.col("base_close"))
    held = held.withColumn("drifted", F.col("grown") / F.sum("grown").over(part))
    months = held.select("portfolio", "month").distinct()
    chain = Window.partitionBy("portfolio").orderBy("month")
    months = months.withColumns({"next_month": F.lead("month").over(chain), "_n": F.row_number().over(chain)})
    old = held.join(months, ["portfolio", "month"]).where(F.col("next_month").isNotNull()).select(
        "portfolio", F.col("next_month").alias("month"), "ticker", F.col("drifted").alias("old_weight")
    )
    new = held.select("portfolio", "month", "ticker", F.col("weight").alias("new_weight"))
    distance = new.join(old, ["portfolio", "month", "ticker"], "full_outer").groupBy("portfolio", "month").agg(
        (F.sum(F.abs(F.coalesce("new_weight", F.lit(0.0)) - F.coalesce("old_weight", F.lit(0.0)))) * 0.5).alias("turnover")
    )
    table = held.groupBy("portfolio", "month").agg(
        F.sum("grown").alias("multiple"), F.max("base_date").alias("base_date"), F.max("end_date").alias("end_date")
    ).join(distance, ["portfolio", "month"]).join(months.select("portfolio", "month", "_n"), ["portfolio", "month"])
    table = table.withColumn("turnover", F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.col("turnover")))
    table = table.withColumn("cost_rate", F.col("turnover") * F.lit(bps / 10000.0))
    upto = chain.rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumns(
        {
            "gross_nav": F.lit(start) * F.exp(F.sum(F.log("multiple")).over(upto)),
            "net_nav": F.lit(start) * F.exp(F.sum(F.log("multiple") + F.log1p(-F.col("cost_rate"))).over(upto)),
        }
    ).drop("_n")
    monthly = table.withColumns(
        {"gross_return": F.col("multiple") - 1, "net_return": (1 - F.col("cost_rate")) * F.col("multiple") - 1}
    )
    starts = table.select(
        "portfolio", "month", (F.col("gross_nav") / F.col("multiple")).alias("gross_start"), (F.col("net_nav") / F.col("multiple")).alias("net_start")
    )
    day = (
        held.select("portfolio", "month", "ticker", "weight", "base_close", "_size").join(by_month, ["month", "ticker"])
        .groupBy("portfolio", "month", "date").agg(
            F.sum(F.col("weight") * F.col("close") / F.col("base_close")).alias("path"), F.count(F.lit(1)).alias("_n"), F.max("_size").alias("_size")
        ).where("_n = _size")
        .join(starts, ["portfolio", "month"])
    )
    daily = day.select(
        "portfolio", "date", (F.col("gross_start") * F.col("path")).alias("gross_nav"), (F.col("net_start") * F.col("path")).alias("net_nav")
    )
    return {"monthly": monthly, "daily": daily, "incomplete": incomplete}
