"""Identifiers: stable hashes, spellings, URI-safe names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str | Column, *parts: Column) -> Column:
    """prefix//first 12 hex digits of the SHA-256 of the parts joined by '|'; a null part counts as empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("//"), F.substring(F.sha2(joined, 256), 1, 12))


def store_key(text: Column) -> Column:
    """The first 32 hex digits of a text's SHA-256, laid out 8-4-4-4-12."""
    h = F.sha2(text, 256)
    return F.concat_ws("-", *(F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def method_id(value: Column) -> Column:
    """One spelling for method ids: method://x for method//x as well."""
    return F.regexp_replace(F.trim(value), r"^method//", "method://")


def method_id_variants(value: Column) -> Column:
    """Both spellings of a method id, its own first; any other id alone."""
    v = F.trim(value)
    other = F.when(v.startswith("method://"), F.regexp_replace(v, "^method://", "method//")).when(v.startswith("method//"), F.regexp_replace(v, "^method//", "method://"))
    return F.array_compact(F.array(v, other))


def with_scheme(value: Column, scheme: str) -> Column:
    """value with scheme:// before it unless it is there."""
    return F.when(value.startswith(f"{scheme}://"), value).otherwise(F.concat(F.lit(f"{scheme}://"), value))


def uri_local(value: Column) -> Column:
    """A name for the local part of a URI: anything but letters, digits, '_', '.' and '-' becomes '_'; a null is empty."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9_.\-]", "_")


def relation_label(value: Column) -> Column:
    """A relation's name as an upper-case label."""
    return F.upper(F.regexp_replace(value, r"[^A-Za-z0-9_]", "_"))
