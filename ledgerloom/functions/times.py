"""Times and leases. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lease_micros(nanos: Column) -> Column:
    """A lease in whole microseconds, 1 at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(nanos / 1000).cast("bigint"))


def after_micros(now: Column, micros: Column) -> Column:
    return now + F.make_dt_interval(secs=(micros / 1000000).cast("decimal(18,6)"))


def after_minutes(now: Column, minutes: int) -> Column:
    return now + F.make_dt_interval(mins=F.lit(minutes))


def is_fresh(loaded_at: Column, ttl_seconds: int, now: Column) -> Column:
    """Whether what was loaded then still holds."""
    return F.coalesce(loaded_at + F.make_dt_interval(secs=F.lit(ttl_seconds).cast("decimal(18,6)")) > now, F.lit(False))
