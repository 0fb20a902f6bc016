"""Fetched documents as tables. Fetching itself is not the engine's: what a connector returned is a row, with how it ended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that mark a cached absence.
ABSENT = ("_404", "_missing", "_error")
#: Parts of error texts that a later try may not meet.
RETRYABLE = (
    "expected flush", "rpc failed", "early eof", "connection reset", "connection timed out", "could not read from remote", "unexpected disconnect",
    "the remote end hung up", "gnutls", "ssl_read", "http/2", "502", "503", "504",
)


def lookup_state(document: Column) -> Column:
    """resolved, absent (a completed lookup without result) or failed (no or an unreadable document): failed is not absent."""
    doc = F.try_parse_json(document)
    marked = F.lit(False)
    for m in ABSENT:
        marked = marked | F.get_json_object(document, f"$.{m}").isNotNull()
    return F.when(doc.isNull(), "failed").when(marked | (F.trim(document) == "{}"), "absent").otherwise("resolved")


def keyed_table(document: Column, value_type: str) -> Column:
    """The rows of a {key: row} document as a map."""
    return F.from_json(document, f"map<string,{value_type}>")


def is_retryable(error: Column, markers: Sequence[str] = RETRYABLE) -> Column:
    low = F.lower(error)
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    return F.coalesce(out, F.lit(False))


def preferred(primary: DataFrame, fallback: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, value, origin): the primary source's answer where it was asked, even if that is nothing; else the fallback's.

    A row with a null value is a known absence; a missing row was never fetched.
    """
    a = primary.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_asked"))
    b = fallback.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_known"))
    return a.join(b, list(key), "full_outer").select(
        *key, F.when(F.col("_asked"), F.col("_a")).otherwise(F.col("_b")).alias(value), F.when(F.col("_asked"), "primary").otherwise("fallback").alias("origin")
    )


def is_empty(c: Column, kind: str = "string") -> Column:
    """null, '' or a collection without entries."""
    return c.isNull() | ((F.size(c) == 0) if kind != "string" else (c == ""))
