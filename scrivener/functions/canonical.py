"""Canonical JSON: one text for all spellings of an object, and the hashes and keys that rest on it.

Spark's VARIANT keeps an object's fields in the order of their names at every depth, so parsing a text and writing it again
sorts the keys, drops blanks and writes equal decimals alike (1 and 1.0 are 1; with an exponent a number is a double, and
1e2 is 100.0). Text that isn't JSON, and objects that have a key twice, have none: null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """The canonical spelling of a JSON text."""
    return F.to_json(F.try_parse_json(text))


def canonical(value: Column) -> Column:
    """The canonical JSON of a struct, map or array; fields that are null are there, as null."""
    return canonical_json(F.to_json(value, {"ignoreNullFields": "false"}))


def canonical_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def cache_key(namespace: str, payload: Column) -> Column:
    """namespace:hash of a JSON payload; null if the payload isn't JSON."""
    return F.concat(F.lit(f"{namespace}:"), canonical_hash(payload))


def content_versions(documents: DataFrame, chunks: DataFrame, key: str, fields: Sequence[str], text: str | None, order: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """key and version: a hash of a document's fields, of its text, and of its chunks (`parts`) in the order of `order`.

    Long texts are hashed before they are put together, so a document's chunks meet as a list of hashes of fixed length. A
    null field is an empty text; a document without chunks has an empty list.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    hashed = chunks.select(key, *order, F.sha2(canonical(F.struct(*(plain(c) for c in parts))), 256).alias("__h"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, "__h"))), lambda s: s["__h"])
    per = hashed.groupBy(key).agg(listed.alias("chunks"))
    whole = [F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("document_text")] if text else []
    payload = F.struct(*(plain(c) for c in fields), *whole, F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"))
    return documents.join(per, key, "left").select(key, F.sha2(canonical(payload), 256).alias("version"))
