"""Audits as tables of (check, passed, details)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import universe


def check_row(rows: DataFrame, number: int, name: str, violations: Column) -> DataFrame:
    """One aggregate row per check: it passes when nothing violates it."""
    return rows.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(number).cast("bigint").alias("check_id"), F.lit(name).alias("check_name"),
        F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"), "violations",
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def checks_in_one_pass(rows: DataFrame, checks: list[tuple[int, str, Column]]) -> DataFrame:
    """Several checks over the same rows as one aggregate, turned to rows afterwards."""
    counted = rows.agg(*[F.coalesce(column, F.lit(0)).cast("bigint").alias(f"c{number}") for number, _, column in checks])
    cells = F.array(
        *[F.struct(F.lit(number).cast("bigint").alias("check_id"), F.lit(name).alias("check_name"), F.col(f"c{number}").alias("violations")) for number, name, _ in checks]
    )
    return counted.select(F.inline(cells)).select(
        "check_id", "check_name", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"), "violations"
    )


def point_in_time_checks(monthly: DataFrame, reps: DataFrame, coverage: DataFrame, real_estate: str, communication: str) -> DataFrame:
    """Seventeen assertions on the eligible table, the representatives and the coverage grid."""
    day = lambda text: F.lit(text).cast("date")
    e = F.col("eligible")
    bad = lambda condition: F.count_if(e & ~F.coalesce(condition, F.lit(False)))
    banned = F.col("etn") | F.col("single_stock") | F.col("thematic")
    alive = F.col("delisting_date").isNull() | (F.col("selection_date") < F.col("delisting_date"))
    listed = F.col("selection_date") >= F.col("listing_date")
    eligible = checks_in_one_pass(
        monthly,
        [
            (1, "listed_by_selection_date", bad(listed)), (2, "not_delisted_by_selection_date", bad(alive)), (3, "dynamic_history", bad(F.col("history_valid"))),
            (6, "no_leveraged_or_inverse", F.count_if(e & (F.col("leveraged") | F.col("inverse")))), (7, "no_other_prohibited_products", F.count_if(e & banned)),
            (8, "sector_level_only", bad(F.col("classification_level_at_date") == "sector")), (12, "classification_effective_date_applied", bad(F.col("classification_effective_date") <= F.col("selection_date"))),
            (13, "no_premature_real_estate_sector", F.count_if(e & (F.col("historical_sector_name") == universe.REAL_ESTATE["name"]) & (F.col("effective_trade_date") < day(real_estate)))),
            (16, "delisted_funds_only_during_lifecycle", bad(alive)), (17, "no_prelisting_current_funds", bad(listed)),
        ],
    )
    best = monthly.where("eligible").groupBy("selection_date", "historical_sector_name").agg(F.max("adv20").alias("max_adv20"))
    joined = reps.join(best, ["selection_date", "historical_sector_name"], "left")
    selected = checks_in_one_pass(
        joined,
        [
            (4, "adv_uses_no_future_data", F.count_if(F.col("adv_window_end") > F.col("selection_date"))), (5, "adv_uses_close_times_volume", F.count_if(F.col("adv20").isNull())),
            (10, "representative_has_maximum_ADV20", F.count_if(F.coalesce(F.col("adv20") != F.col("max_adv20"), F.lit(True)))),
            (11, "trade_after_signal", F.count_if(F.col("effective_trade_date") <= F.col("selection_date"))),
        ],
    )
    once = reps.groupBy("selection_date", "historical_sector_name").agg((F.count(F.lit(1)) - 1).alias("extra"))
    dual = monthly.where("eligible").groupBy("selection_date", "ticker").agg((F.count(F.lit(1)) - 1).alias("extra"))
    older, newer, early = universe.COMMUNICATION["older"], universe.COMMUNICATION["name"], F.col("effective_trade_date") < day(communication)
    shown = F.col("eligible_count") > 0
    telecom = F.count_if(shown & early & (F.col("sector") == newer)) + F.count_if(shown & ~early & (F.col("sector") == older))
    return union([
        eligible, selected, check_row(once, 9, "one_representative_per_sector_month", F.sum("extra")), check_row(coverage, 14, "telecom_restructure_not_new_sector", telecom),
        check_row(dual, 15, "no_dual_sector_mapping", F.sum("extra")),
    ])
