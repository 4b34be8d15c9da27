"""Identifiers, names and paths."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_URL = str(uuid.NAMESPACE_URL)


def sha256(c: Column, digits: int = 64) -> Column:
    return F.substring(F.sha2(F.encode(c, "utf-8"), 256), 1, digits)


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    """``document_index_hash``: the index with four digits at least, eight of the text's hash; null if any of them is."""
    return F.when(document.isNotNull() & index.isNotNull() & text.isNotNull(), F.format_string("%s_%04d_%s", document, index, sha256(text, 8)))


def record_id(path: Column, index: Column, text: Column) -> Column:
    return sha256(F.concat_ws("|", path, index.cast("string"), sha256(text, 8)), 16)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab"), (nibble % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def store_name(collection: Column) -> Column:
    """The collection's name if a store takes it, else ``coll_`` and the digits of its UUID."""
    ok = collection.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9._-]{1,510}[a-zA-Z0-9]$")
    return F.when(ok, collection).otherwise(F.concat(F.lit("coll_"), F.replace(uuid5(NAMESPACE_URL, collection), F.lit("-"), F.lit(""))))


def safe_filename(name: Column, most: int = 200) -> Column:
    """Last part of a path with separators replaced; blank and dots become ``upload.bin``."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"[/\\]", "_")
    return F.when(F.trim(base).isin("", ".", "..") | base.isNull(), F.lit("upload.bin")).otherwise(F.substring(base, 1, most))


def canonical_path(folder: str, collection: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit(folder), F.coalesce(F.nullif(collection, F.lit("")), F.lit("default")), safe_filename(name))


def batches(n: Column, size: int) -> Column:
    """Half-open ranges of at most ``size`` that cover 0..n."""
    if size < 1:
        raise ValueError("size must be at least 1")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")))


def wire_time(epoch: Column) -> Column:
    """UTC time of epoch seconds with (truncated) milliseconds and ``Z``."""
    whole = F.floor(epoch * 1000).cast("long")
    return F.concat(F.date_format(F.timestamp_millis(whole), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def event_id(provider: Column, request: Column) -> Column:
    """``provider:request``, or a random UUID where there is no request id."""
    return F.coalesce(F.concat(provider, F.lit(":"), F.nullif(request, F.lit(""))), F.uuid())
