"""Instrument metadata: lifecycles, reuse of tickers, vendor conflicts, eligibility, rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text

# Fixed value: the published threshold of the ratio of matching blocks.
SIMILARITY_THRESHOLD = 0.72
OPEN_CONFLICT = "needs_review"


def _known_date(column: str) -> Column:
    return F.expr(f"try_to_date({column})")


def lifecycles(rows: DataFrame) -> DataFrame:
    """Entity key and stable id per listing row; identical entities fold to the first source."""
    key = text.entity_key(F.col("ticker"), F.col("fund_name"), F.col("ipo_date"), F.col("delisting_date"))
    keyed = rows.withColumn("entity_key", key).withColumn("lifecycle_id", text.lifecycle_id(F.col("entity_key")))
    columns = [c for c in keyed.columns if c != "lifecycle_id"]
    first = F.min_by(F.struct(*columns), F.struct("source", "fund_name"))
    return keyed.groupBy("lifecycle_id").agg(first.alias("r")).select("lifecycle_id", "r.*")


def ticker_reuse(lifecycle: DataFrame) -> DataFrame:
    """Tickers with several lifecycle rows and several distinct normalised names."""
    entry = F.struct("ipo_date", "delisting_date", "fund_name", "lifecycle_id")
    grouped = lifecycle.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("lifecycle_rows"), F.count_distinct(text.normalized_name(F.col("fund_name"))).alias("distinct_names"),
        F.array_sort(F.collect_list(entry)).alias("e"),
    ).where((F.col("lifecycle_rows") > 1) & (F.col("distinct_names") > 1))
    joined = lambda field: F.array_join(F.transform("e", lambda x: x[field]), "|")
    return grouped.select(
        "ticker", "lifecycle_rows", "distinct_names", joined("fund_name").alias("fund_names"), joined("ipo_date").alias("ipo_dates"),
        joined("delisting_date").alias("delisting_dates"),
    )


def vendor_conflicts(lifecycle: DataFrame, current: DataFrame, audit: DataFrame, non_funds: DataFrame) -> DataFrame:
    """One row per ticker and set of conflicts between two listings, price history and other entities."""
    status = F.lower("status")
    active, delisted = lifecycle.where(status == "active"), lifecycle.where(status == "delisted")
    names = lambda frame, label: frame.groupBy("ticker").agg(
        F.array_join(F.array_sort(F.collect_list("fund_name")), "|").alias(label)
    )
    similar = current.join(active.select("ticker", F.col("fund_name").alias("active_name")), "ticker").groupBy("ticker").agg(
        F.max(text.name_similarity(F.col("fund_name"), F.col("active_name"))).alias("similarity")
    )
    ipo = active.groupBy("ticker").agg(F.max(_known_date("ipo_date")).alias("latest_ipo"))
    other = current.join(delisted.select("ticker", F.col("fund_name").alias("old_name")), "ticker").groupBy("ticker").agg(
        F.bool_or(text.normalized_name(F.col("fund_name")) != text.normalized_name(F.col("old_name"))).alias("distinct_old")
    )
    reuse = ticker_reuse(lifecycle).select("ticker", F.lit(True).alias("reused"))
    first = audit.groupBy("ticker").agg(F.min(_known_date("first_price_date")).alias("first_price"))
    wide = current.select("ticker", F.col("fund_name").alias("current_name"))
    for side in (similar, ipo, other, reuse, first, names(active, "active_names"), names(delisted, "delisted_names")):
        wide = wide.join(side, "ticker", "left")
    listed = F.col("active_names").isNotNull()
    types = F.array(
        F.when(~listed, "nasdaq_not_in_alpha_active_etf"),
        F.when(listed & (F.col("similarity") < SIMILARITY_THRESHOLD), "active_name_mismatch"),
        F.when(listed & (F.col("first_price") < F.date_sub("latest_ipo", 31)), "price_predates_current_lifecycle"),
        F.when(F.col("distinct_old"), "current_ticker_has_distinct_delisted_entity"),
        F.when(F.col("reused"), "alpha_lifecycle_name_conflict"),
    )
    found = F.array_sort(F.filter(types, lambda t: t.isNotNull()))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    mine = wide.withColumn("conflict_types", F.array_join(found, "|")).where("conflict_types != ''").select(
        "ticker", "conflict_types", "current_name", blank("active_names").alias("active_names"), blank("delisted_names").alias("delisted_names")
    )
    absent = names(active, "active_names").join(current.select("ticker"), "ticker", "left_anti").select(
        "ticker", F.lit("alpha_active_not_in_nasdaq_snapshot").alias("conflict_types"), F.lit("").alias("current_name"), "active_names",
        F.lit("").alias("delisted_names"),
    )
    twins = non_funds.join(current.select("ticker", F.col("fund_name").alias("current_name")), "ticker")
    by_state = lambda state: F.array_join(F.array_sort(F.collect_list(F.when(F.col("snapshot") == state, F.col("name")))), "|")
    twin = twins.groupBy("ticker", "current_name").agg(by_state("active").alias("active_names"), by_state("delisted").alias("delisted_names")).select(
        "ticker", F.lit("alpha_non_etf_entity_same_ticker").alias("conflict_types"), "current_name", "active_names", "delisted_names"
    )
    return mine.unionByName(absent).unionByName(twin).withColumn("resolution_status", F.lit(OPEN_CONFLICT))


def vendor_resolution(conflicts: DataFrame, lifecycle: DataFrame, non_funds: DataFrame, official: DataFrame) -> DataFrame:
    """Category, overlap and usable price start of each conflict, from lifecycle intervals."""
    status = F.lower("status")
    listing = lifecycle.where(status.isin("active", "active_needs_review")).groupBy("ticker").agg(F.max(_known_date("ipo_date")).alias("listing"))
    entities = non_funds.groupBy("ticker").agg(
        F.bool_or(F.lower("status") == "active").alias("entity_active"), F.count(F.lit(1)).alias("entities"),
        F.count(_known_date("delisting_date")).alias("entities_dated"), F.max(_known_date("delisting_date")).alias("entity_end"),
    )
    spans = lifecycle.groupBy("ticker").agg(
        F.count_if(status == "active").alias("actives"), F.count(F.when(status == "active", _known_date("ipo_date"))).alias("actives_dated"),
        F.min(F.when(status == "active", _known_date("ipo_date"))).alias("first_active"),
        F.count_if(status == "delisted").alias("olds"), F.count(F.when(status == "delisted", _known_date("delisting_date"))).alias("olds_dated"),
        F.max(F.when(status == "delisted", _known_date("delisting_date"))).alias("last_old"),
    )
    wide = conflicts.join(listing, "ticker", "left").join(entities, "ticker", "left").join(spans, "ticker", "left").join(
        official.select("ticker", F.lit(True).alias("verified")).distinct(), "ticker", "left"
    )
    kinds = F.split("conflict_types", r"\|")
    has = lambda kind: F.array_contains(kinds, kind)
    severe = has("price_predates_current_lifecycle") | has("nasdaq_not_in_alpha_active_etf")
    benign = (F.col("conflict_types") == "active_name_mismatch") & F.coalesce("verified", F.lit(False))
    twin, old = has("alpha_non_etf_entity_same_ticker"), has("current_ticker_has_distinct_delisted_entity")
    dated_twin = F.col("listing").isNotNull() & (F.col("entities") > 0) & (F.col("entities") == F.col("entities_dated"))
    dated_old = (
        ~severe & (F.col("actives") > 0) & (F.col("olds") > 0) & (F.col("actives") == F.col("actives_dated")) & (F.col("olds") == F.col("olds_dated"))
    )
    active_twin = F.coalesce("entity_active", F.lit(False))
    twin_apart, old_apart = F.col("entity_end") < F.col("listing"), F.col("last_old") < F.col("first_active")
    category = (
        F.when(benign, "benign_name_difference").when(twin & active_twin, "entity_type_conflict")
        .when(twin & dated_twin & twin_apart, "ticker_reuse_non_overlapping").when(twin & dated_twin, "ticker_reuse_overlapping")
        .when(twin, "unresolved_lifecycle_conflict")
        .when(old & dated_old & old_apart, "ticker_reuse_non_overlapping").when(old & dated_old, "ticker_reuse_overlapping")
        .otherwise("unresolved_lifecycle_conflict")
    )
    overlap = (
        F.when(benign, "same_active_product").when(twin & active_twin, "active_non_etf_entity_present")
        .when(twin & dated_twin & twin_apart, "non_overlapping").when(twin & dated_twin, "overlapping").when(twin, "dates_incomplete")
        .when(old & dated_old & old_apart, "non_overlapping").when(old & dated_old, "overlapping").otherwise("unknown")
    )
    start = F.when(~benign & ~twin & old & dated_old & old_apart, F.col("first_active")).otherwise(F.col("listing"))
    return wide.select(
        "ticker", "conflict_types", text.normalized_name(F.col("current_name"), aliases=True).alias("normalized_name"), category.alias("resolution_category"),
        overlap.alias("lifecycle_overlap_status"), (benign | category.isin("ticker_reuse_non_overlapping")).alias("resolved"),
        F.coalesce(start.cast("string"), F.lit("unknown")).alias("usable_price_start_date"),
    )


FLAGS = ("leveraged_flag", "inverse_flag", "single_stock_flag", "etn_flag", "option_overlay_flag", "thematic_flag")


def eligibility(lifecycle: DataFrame, current: DataFrame, official: DataFrame, audit: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Conservative classification of every lifecycle: clean, excluded or needs review, with reasons.

    Flags are TRUE, FALSE or NULL for unknown; evidence of the issuer replaces name rules.
    """
    name = F.col("fund_name")
    base = lifecycle.withColumn("labels", text.exclusion_labels(name))
    has = lambda label: F.array_contains("labels", label)
    hint = lambda condition: F.when(condition, True)
    guess = {
        "leveraged_flag": hint(has("leveraged")), "inverse_flag": hint(has("inverse")), "single_stock_flag": text.is_single_stock(name),
        "etn_flag": has("etn"), "option_overlay_flag": hint(has("option_or_defined_outcome")), "thematic_flag": text.is_thematic(name),
        "instrument_type": F.when(has("etn"), "ETN").otherwise("ETF"), "asset_class": text.asset_class(F.col("labels"), name),
        "geographic_scope": text.geography(F.col("labels"), name),
    }
    evidence = official.groupBy("ticker").agg(
        *[F.first(c).alias(f"v_{c}") for c in ("instrument_type", "asset_class", "geographic_scope", *FLAGS)]
    ).withColumn("verified", F.lit(True))
    listed = current.groupBy("ticker").agg(F.min("fund_name").alias("current_name"))
    prices = audit.groupBy("ticker").agg(
        F.min(_known_date("first_price_date")).alias("first_price"), F.bool_and("price_clean").alias("price_clean")
    )
    disputed = conflicts.where(F.col("resolution_status") == OPEN_CONFLICT).select("ticker").distinct().withColumn("disputed", F.lit(True))
    wide = base
    for side in (evidence, listed, prices, disputed, ticker_reuse(lifecycle).select("ticker", F.lit(True).alias("reused"))):
        wide = wide.join(side, "ticker", "left")
    verified = F.coalesce("verified", F.lit(False))
    known = {
        key: F.when(verified, text.tristate(F.col(f"v_{key}")) if key in FLAGS else F.col(f"v_{key}")).otherwise(value) for key, value in guess.items()
    }
    wide = wide.withColumns({f"x_{key}": value for key, value in known.items()})
    active = F.lower("status") == "active"
    similar = text.name_similarity(name, F.col("current_name")) >= SIMILARITY_THRESHOLD
    matched = active & F.col("current_name").isNotNull() & (verified | similar)
    conflict = F.coalesce("reused", F.lit(False)) | F.coalesce("disputed", F.lit(False))
    ipo = _known_date("ipo_date")
    identity = F.col("first_price") >= F.date_sub(ipo, 31)
    clean_price = F.coalesce("price_clean", F.lit(False))
    no_flag = F.lit(True)
    for key in FLAGS:
        no_flag = no_flag & (F.coalesce(F.col(f"x_{key}"), F.lit(True)) == F.lit(False))
    eligible = (
        verified & active & ipo.isNotNull() & (F.col("x_instrument_type") == "ETF") & (F.col("x_asset_class") == "equity")
        & (F.col("x_geographic_scope") == "United States") & no_flag & F.coalesce(matched, F.lit(False)) & ~conflict
        & F.coalesce(identity, F.lit(False)) & clean_price
    )
    labels = F.when(verified, F.array().cast("array<string>")).otherwise(F.col("labels"))
    unresolved = conflict | (F.lower("status") == "active_needs_review")
    status = F.when(unresolved, "needs_review").when(F.size(labels) > 0, "excluded").when(eligible, "clean").otherwise("needs_review")
    confidence = F.when(unresolved, "low").when(F.size(labels) > 0, "medium").when(eligible | verified, "high").otherwise("low")
    pending = ~unresolved & (F.size(labels) == 0) & ~eligible
    extra = F.array(
        F.when(unresolved, "unresolved_lifecycle_or_vendor_conflict"), F.when(pending & F.coalesce(F.col("x_thematic_flag"), F.lit(False)), "thematic_manual_review"),
        F.when(pending & ~verified, "insufficient_structured_classification_evidence"), F.when(pending & ~clean_price, "price_data_not_clean"),
        F.when(pending & ~F.coalesce(identity, F.lit(False)), "price_identity_not_confirmed"),
    )
    reasons = F.array_sort(F.array_distinct(F.concat(labels, F.filter(extra, lambda r: r.isNotNull()))))
    return wide.select(
        "lifecycle_id", "ticker", "fund_name", "status", *[F.col(f"x_{key}").alias(key) for key in ("instrument_type", "asset_class", "geographic_scope", *FLAGS)],
        confidence.alias("classification_confidence"), status.alias("review_status"), F.array_join(reasons, "|").alias("exclusion_reason"),
        eligible.alias("eligible"), conflict.alias("lifecycle_conflict"), identity.alias("price_identity_match"),
    )


def rejections(metadata: DataFrame, accepted: DataFrame, broad: DataFrame, industry: DataFrame) -> DataFrame:
    """Rows outside the accepted set with ordered, distinct reasons."""
    rows = metadata.join(accepted.select("lifecycle_id"), "lifecycle_id", "left_anti")
    rows = rows.join(broad.select("ticker", F.lit(True).alias("_broad")).distinct(), "ticker", "left")
    rows = rows.join(industry.select("ticker", F.lit(True).alias("_industry")).distinct(), "ticker", "left")
    flagged = (
        ("leveraged_flag", "leveraged"), ("inverse_flag", "inverse"), ("single_stock_flag", "single_stock"), ("etn_flag", "etn"),
        ("option_overlay_flag", "option_or_defined_outcome"), ("thematic_flag", "thematic"),
    )
    first = F.array(
        F.when(F.col("_broad"), "broad_market_or_size_style"), F.when(F.col("_industry"), "industry_or_subindustry_not_sector"),
        *[F.when(F.col(flag), label) for flag, label in flagged],
    )
    told = F.filter(F.split("exclusion_reason", r"\|"), lambda r: (r != "") & (F.lower(r) != "unknown"))
    reasons = F.array_distinct(F.concat(F.filter(first, lambda r: r.isNotNull()), told))
    text_reason = F.when(F.size(reasons) > 0, F.array_join(reasons, "|")).otherwise("not_in_officially_verified_standard_sector_pool")
    return rows.withColumn("rejection_reason", text_reason).drop("_broad", "_industry")


def numbered(rows: DataFrame, order: Sequence[str], lead: Column, name: str) -> DataFrame:
    """Number rows from 1 by `order` without bringing them together.

    `lead` is a short text that does not fall along the order after order[0]: rows are numbered within
    (order[0], lead), and one window over the catalogue of these groups adds what comes before each.
    """
    keyed = rows.withColumns({"_head": F.col(order[0]), "_lead": lead})
    groups = keyed.groupBy("_head", "_lead").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_head", "_lead").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = F.row_number().over(Window.partitionBy("_head", "_lead").orderBy(*order))
    return keyed.withColumn("_inside", inside).join(offsets, ["_head", "_lead"]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("int")).drop("_head", "_lead", "_inside", "_before")


def priority(rejected: DataFrame, pool: DataFrame) -> DataFrame:
    """Delisted rows of a named suite, numbered for review."""
    queue = rejected.where(F.lower("status") == "delisted").join(pool.select("ticker").distinct(), "ticker", "left_semi")
    fields = F.when(F.col("lifecycle_conflict"), "historical OHLCV identity/cache; ticker lifecycle conflict").otherwise("historical OHLCV identity/cache")
    ranked = numbered(queue, ("rejection_reason", "ticker", "lifecycle_id"), F.substring("ticker", 1, 3), "manual_review_priority")
    return ranked.select("manual_review_priority", "lifecycle_id", "ticker", "fund_name", fields.alias("unresolved_fields"))
