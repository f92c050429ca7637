"""Time helpers: epoch-aligned buckets, ISO rendering, second bounds."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog import schema as S


def bucket_start(ts: Column | str, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of ``seconds`` holding ``ts``.

    Integer arithmetic on epoch microseconds, so it floors correctly before
    1970 and does not depend on the session time zone.
    """
    col = F.col(ts) if isinstance(ts, str) else ts
    width = F.lit(int(seconds) * 1_000_000)
    micros = F.unix_micros(col)
    return F.timestamp_micros(micros - F.pmod(micros, width))


def iso_ms(ts: Column | str) -> Column:
    """ISO-8601 text at millisecond precision with a ``Z`` suffix (UTC session)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(col, S.ISO_MS_FORMAT)


def floor_second(t: datetime) -> datetime:
    return t.replace(microsecond=0)


def ceil_second(t: datetime) -> datetime:
    """True ceiling: an aligned value stays where it is."""
    base = t.replace(microsecond=0)
    return base if base == t else base + timedelta(seconds=1)
