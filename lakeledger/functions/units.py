"""Weights, roundings, dates and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import DEFAULT_TARE


def net_to_gross(net: Column, tare: Column, decimals: int = 1) -> Column:
    return F.round(net + F.coalesce(tare, F.lit(DEFAULT_TARE)), decimals)


def gross_to_net(gross: Column, tare: Column, decimals: int = 1) -> Column:
    """Never below zero; usage events are in the gross weight already."""
    return F.round(F.greatest(gross - F.coalesce(tare, F.lit(DEFAULT_TARE)), F.lit(0.0)), decimals)


def tare_assumed(tare: Column) -> Column:
    return tare.isNull()


def weight_changed(then: Column, now: Column, threshold: float) -> Column:
    return F.coalesce(F.abs(then - now) >= threshold, F.lit(False))


def clamp(c: Column) -> Column:
    return F.round(F.greatest(c, F.lit(0.0)), 2)


def as_temperature(c: Column) -> Column:
    return F.bround(c.try_cast("double"), 0).cast("int")


def as_amount(c: Column) -> Column:
    return F.round(c.try_cast("double"), 2)


def as_text(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def instant(c: Column) -> Column:
    """ISO text as a UTC instant (the session's zone is UTC); null if it is not one."""
    return F.try_to_timestamp(c)


def day(c: Column) -> Column:
    """The date that the text itself names in its own zone, else its first ten characters; null if it is shorter."""
    return F.when(F.char_length(c) >= 10, F.substr(c, F.lit(1), F.lit(10)))


def provenance(registered: Column, first_used: Column) -> tuple[Column, Column]:
    """When an item was bought and when it was opened."""
    return day(registered).alias("purchased"), day(first_used).alias("opened")


def after(ts: Column, anchor: Column) -> Column:
    """``ts`` if it is after the anchor, or if there is none."""
    return F.when(anchor.isNull() | (ts > anchor), ts)


def version(c: Column) -> Column:
    """Comparable array of three numbers; 0.0.0 for what is not a version."""
    parts = F.regexp_extract(F.coalesce(c, F.lit("")), r"^v?(\d+(?:\.\d+){0,2})", 1)
    numbers = F.transform(F.split(parts, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), 3)), 1, 3)


def is_newer(a: Column, b: Column) -> Column:
    """Whether version a is above b; false where either cannot be read."""
    ok = lambda c: F.coalesce(c, F.lit("")).rlike(r"^v?\d+(\.\d+)*")
    return ok(a) & ok(b) & (version(a) > version(b))


def at_least(a: Column, least: Column) -> Column:
    """Whether version a is enough; an unknown one never blocks."""
    return (version(a) == F.array(F.lit(0), F.lit(0), F.lit(0))) | (version(a) >= version(least))
