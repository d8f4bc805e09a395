"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped_empty(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+", "") == ""


def trimmed_empty(s: Column) -> Column:
    return F.trim(s) == ""


def all_upper(s: Column) -> Column:
    return s == F.upper(s)


def all_lower(s: Column) -> Column:
    return s == F.lower(s)


def numeric(s: Column) -> Column:
    """Only digits, minus, point and e."""
    return s.rlike("^[0-9.e-]*$")


def log_n(base: float, x: Column) -> Column:
    return F.log(base, x)


def rescale(x: Column, low: Column, high: Column, to_low: float = 0.001, to_high: float = 0.999) -> Column:
    """Linear from a domain to a range; a domain without width divides by its maximum instead."""
    width = F.when(high != low, high - low).otherwise(high)
    return F.lit(to_low) + (x - low) * (to_high - to_low) / F.nullif(width, F.lit(0.0))


def seeded(key: Column, seed: int = 0) -> Column:
    """A value from 0 to 1 that depends on the key and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
