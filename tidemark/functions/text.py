"""Text, flag and rule functions for instrument metadata."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

UNKNOWN = "unknown"
# Tokens that stand for a missing value.
NULL_TOKENS = ("", "none", "nan", "nat", "null", "unknown")
# Words dropped from a fund name, and issuer spellings that mean one issuer.
GENERIC_WORDS = ("ETF", "FUND", "TRUST", "SHARES", "THE")
ISSUER_ALIASES = (
    ("STATE STREET", "SSGA"), ("STATE STREET R", "SSGA"), ("SPDR R", "SPDR"), ("VANGUARD INDEX FUND", "VANGUARD"),
)
# Exclusion labels and the patterns that raise them, on upper-case names.
EXCLUSION_RULES = (
    ("etn", r"\bETN(?:S)?\b|EXCHANGE[- ]TRADED NOTE|NOTES DUE"),
    ("fixed_income", r"\bBOND\b|TREASURY|MUNICIPAL|T[- ]?BILL|FIXED INCOME|CLO\b|MORTGAGE|\bMBS\b|CORPORATE DEBT|HIGH YIELD|SENIOR LOAN|FLOATING RATE|AGGREGATE BOND"),
    ("commodity", r"\bGOLD\b|\bSILVER\b|COMMODIT|CRUDE OIL|NATURAL GAS|\bCOPPER\b|URANIUM|PLATINUM|PALLADIUM|AGRICULTUR"),
    ("crypto", r"BITCOIN|ETHEREUM|CRYPTO|BLOCKCHAIN.*INCOME|DIGITAL ASSET"),
    ("currency", r"CURRENCY|DOLLAR INDEX|EURO|YEN|SWISS FRANC|FOREX"),
    ("international_or_global", r"EMERGING MARKET|INTERNATIONAL|GLOBAL|EUROPE|CHINA|JAPAN|INDIA|BRAZIL|KOREA|TAIWAN|MEXICO|CANADA|AUSTRALIA|GERMANY|FRANCE|UNITED KINGDOM|LATIN AMERICA|\bEAFE\b|EX[- ]US|WORLD|ASIA"),
    ("leveraged", r"(?<!\w)[+-]?[23]X(?!\w)|LEVERAGED|ULTRAPRO|ULTRASHORT|DAILY BULL"),
    ("inverse", r"INVERSE|DAILY BEAR|\bSHORT\b.*(?:DAILY|ETF|ETN)|-[123]X"),
    ("preferred_stock", r"PREFERRED (?:STOCK|SECURIT|ETF|INCOME)"),
    ("convertible_bond", r"CONVERTIBLE (?:BOND|SECURIT)"),
    ("mlp", r"\bMLP\b|MASTER LIMITED PARTNERSHIP"),
    ("multi_asset", r"MULTI[- ]ASSET|ASSET ALLOCATION|RISK PARITY|BALANCED ETF"),
    ("volatility", r"\bVIX\b|VOLATILITY (?:FUTURES|INDEX|ETF|ETN)"),
    ("option_or_defined_outcome", r"COVERED CALL|OPTION INCOME|PREMIUM INCOME|BUYWRITE|BUY[- ]WRITE|BUFFER|DEFINED OUTCOME|AUTOCALLABLE|COLLAR|YIELDBOOST|MAX INCOME"),
)
# Patterns of thematic, equity, United States and single-stock names.
THEMATIC_RULE = r"ARTIFICIAL INTELLIGENCE|\bAI\b|ROBOT|CYBER|CLEAN ENERGY|GENOMIC|SPACE|METAVERSE|CANNABIS|ESPORTS|FINTECH|NEXT GEN|INNOVATION|QUANTUM|HYDROGEN|CLOUD COMPUTING|DIGITAL ECONOMY"
EQUITY_RULE = r"\bEQUITY\b|\bSTOCK\b|S&P|RUSSELL|NASDAQ"
UNITED_STATES_RULE = r"\bU\.?S\.?\b|UNITED STATES|S&P 500|RUSSELL"
SINGLE_STOCK_RULE = r"SINGLE[- ]STOCK|DAILY (?:BULL|BEAR)|[23]X (?:LONG|SHORT)"
# Sleeve rules in order, and the exclusions applied next to them.
SLEEVE_RULES = (
    ("Pharmaceuticals", r"\b(pharmaceuticals?|pharma|generic drugs?)\b"),
    ("Consumer Staples", r"consumer staples|food\s*&\s*beverage"),
    ("Capital Markets & Exchanges", r"broker[- ]?dealers?|capital markets|securities exchanges?"),
    ("Aerospace & Defense", r"aerospace|defen[cs]e"),
    ("Insurance", r"insurance|property\s*(?:&|and)?\s*casualty"),
    ("Utilities", r"\butilities?\b"),
    ("Energy", r"\benergy\b|oil\s*&\s*gas|oil services|natural gas"),
)
COMMON_EXCLUSION = r"\b(?:2x|3x|ultra|ultrashort|ultrashrt|inverse|short|bear|bull|leveraged|etn|income)\b|high yield bond|resources trust$|fund inc$|development company$|total return fund$"
FOREIGN_EXCLUSION = r"\b(?:global|international|world|china|canadian|asia|europe|korea|ex[- ]?u\.?s\.?|emerging markets?)\b"
NON_EQUITY_ENERGY = r"crude oil|brent|gasoline|heating oil|commodity|futures?|natural gas fund|mlp|midstream|infrastructure|clean.*energy|green.*energy|renewable|solar|wind|low carbon|energy transition|energy storage|progressive energy|smart energy|sustainable energy|ex[- ]?energy|db energy fund"


def clean_text(value: Column, default: str = UNKNOWN) -> Column:
    """Trimmed text; a null or a null token becomes the default."""
    trimmed = F.trim(value)
    return F.when(trimmed.isNull() | F.lower(trimmed).isin(*NULL_TOKENS), F.lit(default)).otherwise(trimmed)


def clean_date(value: Column) -> Column:
    """ISO date text, or unknown."""
    parsed = F.to_date(F.try_to_timestamp(F.nullif(clean_text(value), F.lit(UNKNOWN))))
    return F.coalesce(parsed.cast("string"), F.lit(UNKNOWN))


def normalized_name(value: Column, aliases: bool = False) -> Column:
    """Upper case, letters and digits only, generic words dropped; with aliases issuers are
    spelled one way and a missing name stays empty."""
    source = F.coalesce(value, F.lit("")) if aliases else clean_text(value)
    text = F.trim(F.regexp_replace(F.upper(source), "[^A-Z0-9]+", " "))
    if aliases:
        for old, new in ISSUER_ALIASES:
            text = F.replace(text, F.lit(old), F.lit(new))
    words = F.filter(F.split(text, " +"), lambda word: (word != "") & ~word.isin(*GENERIC_WORDS))
    return F.array_join(words, " ")


def entity_key(ticker: Column, name: Column, listing: Column, delisting: Column) -> Column:
    return F.concat_ws("|", F.upper(clean_text(ticker)), normalized_name(name), clean_text(listing), clean_text(delisting))


def lifecycle_id(key: Column) -> Column:
    return F.concat(F.lit("lc_"), F.substring(F.sha2(key, 256), 1, 20))


def tristate(value: Column) -> Column:
    """TRUE, FALSE or NULL for anything else."""
    text = F.lower(F.trim(value))
    return F.when(text == "true", True).when(text == "false", False)


def truth(value: Column, default: bool = False) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False).otherwise(F.lit(default))


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def exclusion_labels(name: Column) -> Column:
    """Every label whose pattern the name matches, in rule order."""
    upper = F.upper(name)
    hits = F.array(*[F.when(_matches(upper, pattern), F.lit(label)) for label, pattern in EXCLUSION_RULES])
    return F.filter(hits, lambda label: label.isNotNull())


def asset_class(labels: Column, name: Column) -> Column:
    has = lambda label: F.array_contains(labels, label)
    out = F.when(has("fixed_income") | has("convertible_bond"), "fixed_income")
    for label in ("commodity", "crypto", "currency", "multi_asset", "mlp"):
        out = out.when(has(label), label)
    return out.when(F.upper(name).rlike(EQUITY_RULE), "equity_preliminary").otherwise(UNKNOWN)


def geography(labels: Column, name: Column) -> Column:
    return (
        F.when(F.array_contains(labels, "international_or_global"), "non_us_or_global")
        .when(F.upper(name).rlike(UNITED_STATES_RULE), "United States_preliminary")
        .otherwise(UNKNOWN)
    )


def is_thematic(name: Column) -> Column:
    return _matches(name, THEMATIC_RULE)


def is_single_stock(name: Column) -> Column:
    return F.when(F.upper(name).rlike(SINGLE_STOCK_RULE), True)


def sleeve(name: Column) -> Column:
    """First matching sleeve; an energy name outside core equity has none."""
    out = None
    for label, pattern in SLEEVE_RULES:
        hit = _matches(name, pattern)
        if label == "Energy":
            hit = hit & ~_matches(name, NON_EQUITY_ENERGY)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("")


def name_similarity(left: Column, right: Column) -> Column:
    """Ratio of matching blocks of normalised names: twice the characters of the blocks over all characters.

    The longest common block comes first, then those to its left and right. Depends on which name is left. 1 for
    two empty names, null where either is null.
    """
    return _block_ratio(normalized_name(left), normalized_name(right))


@F.pandas_udf(DoubleType())
def _block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    ratio = lambda a, b: None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
    return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def weights_json(entries: Column) -> Column:
    """Sorted JSON object of (key, value) structs."""
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def safe_file_name(ticker: Column) -> Column:
    return F.regexp_replace(F.upper(ticker), "[^A-Z0-9._-]", "_")
