"""Ids in the spelling that other stores want."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_uuid(hex_id: Column) -> Column:
    """A 24-digit hexadecimal id as a UUID: zeros fill it to 32 digits, hyphens part it; null if it isn't one."""
    h = F.rpad(F.lower(hex_id), 32, "0")
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.lower(hex_id).rlike("^[0-9a-f]{24}$"), F.concat_ws("-", *parts))


def from_uuid(uuid: Column) -> Column:
    """The 24 digits that ``to_uuid`` started from."""
    return F.substring(F.replace(uuid, F.lit("-"), F.lit("")), 1, 24)
