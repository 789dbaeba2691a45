"""Capacities as text, and clocks that are off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clock skews in milliseconds from which a node is warned of, critical and quarantined.
WARNING_MS, CRITICAL_MS, QUARANTINE_MS = 200, 500, 1_000


def text_bytes(text: Column) -> Column:
    """1.5G as bytes: suffixes K, M, G, T are binary, a plain number is bytes; null for what is neither."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([KMGT]?)B?\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([KMGT]?)B?\s*$", 2)
    power = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1)
    return F.when(number != "", F.floor(number.try_cast("double") * power).cast("long"))


def skew_ms(sent: Column, received: Column, remote: Column) -> Column:
    """How far a node's clock is off: against the middle of question and answer."""
    return F.abs(remote - (sent + F.floor((received - sent) / 2)))


def skew_class(skew: Column) -> Column:
    return F.when(skew >= QUARANTINE_MS, "quarantine").when(skew >= CRITICAL_MS, "critical").when(skew >= WARNING_MS, "warning").otherwise("ok")
