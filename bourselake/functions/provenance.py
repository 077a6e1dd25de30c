"""Where a value came from, how far it is trusted, and what it may overwrite."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Approved sources and their trust tier (1 is the most trusted).
SOURCE_TIERS = {
    "DSE_OFFICIAL_ARCHIVE": 1,
    "DSE_OFFICIAL_BENCHMARK": 1,
    "DSE_OFFICIAL_GRAPH": 1,
    "DSE_SCRAPE": 1,
    "DSE_OFFICIAL": 1,
    "DSE_LIVE_CLOSING": 1,
    "DSE_LIVE_TICKER": 1,
    "LANKABD": 2,
    "STAGING_DB": 1,
}

# Sources a promotion run owns, per table.
PROMOTION_SOURCE = "STAGING_DB"

# Trading codes that are written differently by different sources.
SYMBOL_ALIASES = {
    "AMCLPRAN": "AMCL(PRAN)",
    "AMCL": "AMCL(PRAN)",
    "KAYQUE": "KAY&QUE",
    "KAY": "KAY&QUE",
    "NPOLYMAR": "NPOLYMER",
}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])


def tier_of(source: Column) -> Column:
    """Trust tier, or null for a source that is not approved."""
    return F.try_element_at(_map(SOURCE_TIERS), source)


def is_approved(source: Column) -> Column:
    return tier_of(source).isNotNull()


def tier_allows_overwrite(existing: Column, incoming: Column) -> Column:
    """An equal or better tier may overwrite; an unknown tier on either side never blocks."""
    return F.coalesce(tier_of(incoming) <= tier_of(existing), F.lit(True))


def tier_display_name(source: Column) -> Column:
    tier = tier_of(source)
    return F.when(tier == 1, "Tier 1").when(tier == 2, "Tier Two")


def clean_symbol(text: Column) -> Column:
    return F.upper(F.trim(text))


def resolve_alias(symbol: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(SYMBOL_ALIASES), symbol), symbol)
