"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
# Formats tried in order.
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyy/MM/dd"]


def whole_days(start: Column, end: Column) -> Column:
    """Days from start to end, rounded down, also where end is earlier."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(DAY)).cast("int")


def parse_mixed(text: Column, formats: list[str] = FORMATS) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def without_zone(text: Column) -> Column:
    """Text without a zone abbreviation, offset and comment at its end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s*\([A-Za-z]+\)$", ""), r"\s+(?:[A-Z]{3,4}|[+-]\d{4})$", ""))


def local_mail_time(text: Column) -> Column:
    """Wall-clock time of an RFC 2822 date; the zone is dropped, not applied."""
    bare = F.regexp_replace(without_zone(text), r"^[A-Za-z]{3},\s*", "")
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss"))


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def id_time(message_id: Column) -> Column:
    """Time in a message id that begins with seconds since 1970."""
    seconds = F.regexp_extract(F.coalesce(message_id, F.lit("")), r"^<?(\d{9,10})\.", 1)
    return F.when(seconds != "", F.timestamp_seconds(seconds.cast("bigint")))
