"""Record identifiers ``at://authority/collection/key`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(uri: Column | str, k: int) -> Column:
    bare = F.regexp_replace(F.col(uri) if isinstance(uri, str) else uri, r"^at://", "")
    return F.coalesce(F.get(F.split(bare, "/"), F.lit(k)), F.lit(""))


def authority_of(uri: Column | str) -> Column:
    return _part(uri, 0)


def nsid_of(uri: Column | str) -> Column:
    return _part(uri, 1)


def rkey_of(uri: Column | str) -> Column:
    return _part(uri, 2)


def short_uri(uri: Column | str) -> Column:
    """The last two path segments."""
    parts = F.split(F.col(uri) if isinstance(uri, str) else uri, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def truncate(text: Column | str, width: int) -> Column:
    """At most ``width`` characters, the last one an ellipsis if any were cut."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def card_uri(uri: Column | str, nsid: str = "index.card", authority: str = "did:local:index") -> Column:
    """The index entry of a dataset: keyed by the first 24 hex digits of the uri's SHA-256."""
    uri = F.col(uri) if isinstance(uri, str) else uri
    return F.concat(F.lit(f"at://{authority}/{nsid}/"), F.substring(F.sha2(uri, 256), 1, 24))
