"""Hashes as text, shards and groups of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_of(text: Column) -> Column:
    """The bytes of 64 hex digits in either case, null for any other text."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def shard_of(key: Column, shards: int) -> Column:
    """A shard by the first 32 bits of the key's SHA-256."""
    return (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long") % shards).cast("long")


def extent_key(index: Column) -> Column:
    """A key of 16 hex digits that sorts as the number does."""
    return F.lpad(F.lower(F.hex(index)), 16, "0")


def extent_index(key: Column) -> Column:
    return F.conv(key, 16, 10).cast("long")


def extent_group(index: Column, size: int = 64) -> Column:
    return F.floor(index / size).cast("long")
