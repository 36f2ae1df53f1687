"""Realm groups, and the one-character tokens reports use to name them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The realms counted by their own subscription id, and those by the global one.
DISCOVERY_REALMS = (
    "go", "dplay", "dplusapac", "eurosport", "motortrend", "streaming_apac", "streaming_india",
)
MAX_REALMS = ("bolt", "streaming")


def realm_filter(realm: Column, token: str) -> Column:
    """`%` is every realm, `$` the Discovery ones, `^` the MAX/streaming ones, else one realm."""
    if token == "%":
        return F.lit(True)
    if token == "$":
        return realm.isin(*DISCOVERY_REALMS)
    if token == "^":
        return realm.isin(*MAX_REALMS)
    return realm == token


def wildcard(value: Column, token: str) -> Column:
    """`%` is everything, anything else one value."""
    return F.lit(True) if token == "%" else value == token


def subscriber_id(realm: Column, subscription_id: Column, global_id: Column) -> Column:
    """The id that tells subscribers of a realm apart; NULL for a realm of neither group."""
    return F.when(realm.isin(*DISCOVERY_REALMS), subscription_id.cast("string")).when(
        realm.isin(*MAX_REALMS), global_id.cast("string")
    )
