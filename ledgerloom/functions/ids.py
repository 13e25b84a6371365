"""Deterministic identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"


def sha_id(*parts: Column, prefix: str = "") -> Column:
    """SHA-256 of the parts joined by the unit separator, in hexadecimal."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws(UNIT, *parts), 256))


def opaque_id(prefix: str, *parts: Column) -> Column:
    """The prefix and 24 hexadecimal digits of the SHA-256 of the parts joined by line ends."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 24))


def name_uuid(name: Column) -> Column:
    """A version 3 UUID of the name's bytes alone, without a name space."""
    h = F.md5(name)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3).cast("long")) + F.lit(8).cast("long")))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def random_id() -> Column:
    """A version 4 UUID, another one each time that it is computed."""
    return F.uuid()
