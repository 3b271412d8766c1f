"""Scalar Column helpers (F1-F11, P8). All JVM-side built-ins; no Python UDF."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# fixed values: significance classes of an event
SIG_LOW_BELOW = 100
SIG_MODERATE_BELOW = 500
SIG_LOW, SIG_MODERATE, SIG_HIGH = "Low", "Moderate", "High"

DEFAULT_LOGICAL_DATE = "2014-01-01"
MS_PER_DAY = 86_400_000


def sig_class(sig: Column | str) -> Column:
    """``sig < 100`` Low, ``< 500`` Moderate, otherwise High. A NULL ``sig`` fails
    both tests and lands in High, as in the source system."""
    s = F.col(sig) if isinstance(sig, str) else sig
    return (F.when(s < SIG_LOW_BELOW, F.lit(SIG_LOW))
             .when(s < SIG_MODERATE_BELOW, F.lit(SIG_MODERATE))
             .otherwise(F.lit(SIG_HIGH)))


def parse_json_strict(text: Column | str, schema: DataType | str) -> Column:
    """decode with a declared schema; unknown fields are ignored, malformed JSON
    raises (the permissive default would silently give NULL rows)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.from_json(c, schema, {"mode": "FAILFAST"})


def item(arr: Column | str, i: int) -> Column:
    """list item by index, NULL when out of bounds (``arr[i]`` raises under ANSI)."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.get(c, F.lit(i))


def epoch_ms_to_timestamp(ms: Column | str) -> Column:
    """epoch milliseconds to an instant (TIMESTAMP, rendered in the session zone)."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return F.timestamp_millis(c)


def epoch_ms_to_date_string(ms: Column | str) -> Column:
    """F5 for epoch input: the UTC calendar day as ``yyyy-MM-dd``, independent of the
    session time zone."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return F.date_format(F.date_from_unix_date(F.floor(c / MS_PER_DAY).cast("int")), "yyyy-MM-dd")


def ntz_epoch_ms(ts: Column | str) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ read as UTC wall time (zone independent)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), c)


def day_window(logical_date: str | None) -> tuple[Column, Column]:
    """Bounds (dates) of the half-open day; a blank date falls back to the first day of the feed.
    Both fold to literals, so filters on them reach the scan."""
    first = F.to_date(F.lit(logical_date or DEFAULT_LOGICAL_DATE), "yyyy-MM-dd")
    return first, F.date_add(first, 1)


def in_window(ts: Column | str, start: Column | str, end: Column | str) -> Column:
    """Half-open filter on a timestamp column against two day bounds; both bounds are
    literals after constant folding, so the filter reaches the Parquet scan."""
    c = F.col(ts) if isinstance(ts, str) else ts
    lo, hi = (F.to_date(F.lit(x) if isinstance(x, str) else x).cast("timestamp_ntz") for x in (start, end))
    return (c >= lo) & (c < hi)


def day_string(ts: Column | str) -> Column:
    """timestamp to ``yyyy-MM-dd``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "yyyy-MM-dd")


def utc_now_iso() -> Column:
    """current UTC time as an ISO string (audit column; never compared)."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
