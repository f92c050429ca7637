"""Typed query arguments with the argument checks of the log contract.

A filter is a plain dataclass; ``operators.predicates`` turns it into one
Spark ``Column``. Checks raise ``ValueError`` with the contract's texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from emberlog import schema as S

class _AllTenants:
    """Scope sentinel: no tenant scoping at all (access control off)."""

    _inst = None

    def __new__(cls):
        if cls._inst is None:
            cls._inst = super().__new__(cls)
        return cls._inst

    def __repr__(self) -> str:
        return "ALL_TENANTS"


# Tenant scope: ALL_TENANTS = every row; None = rows without tenant; str = one tenant.
ALL_TENANTS = _AllTenants()


# Date and time of a bound: seconds and their fraction, and the zone, may be missing.
_BOUND = re.compile(r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(?:([Zz])|([+-])(\d{2}):?(\d{2}))?", re.ASCII)


def parse_bound(text: str) -> datetime | None:
    """A bound's text by its own grammar, at millisecond precision; None when it is not of that shape.

    As a JavaScript Date reads it: 24:00:00 is the next midnight, days up to 31 run over into the next month, digits
    after the third of a fraction are cut off, and a time without a zone is UTC.
    """
    m = _BOUND.fullmatch(text)
    if not m:
        return None
    year, month, day, hour, minute = (int(x) for x in m.groups()[:5])
    second, milli = int(m[6] or 0), int(((m[7] or "") + "000")[:3])
    off_hour, off_minute = int(m[10] or 0), int(m[11] or 0)
    if not (1 <= month <= 12 and 1 <= day <= 31 and hour <= 24 and minute <= 59 and second <= 59 and off_hour <= 23 and off_minute <= 59):
        return None
    if hour == 24 and (minute or second or int(m[7] or 0)):
        return None
    offset = timedelta(hours=off_hour, minutes=off_minute) * (-1 if m[9] == "-" else 1)
    try:
        start = datetime(year, month, 1, tzinfo=timezone.utc)
        return start + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second, milliseconds=milli) - offset
    except (ValueError, OverflowError):  # year 0, or past the last year
        return None


def to_utc(value: datetime | str) -> datetime:
    """Query bound → aware UTC datetime: text by ``parse_bound``; a naive datetime is taken as UTC."""
    parsed = parse_bound(value) if isinstance(value, str) else value
    if not isinstance(parsed, datetime):
        raise ValueError(f"invalid timestamp: '{value}'")
    if parsed.tzinfo is None:
        return parsed.replace(tzinfo=timezone.utc)
    return parsed.astimezone(timezone.utc)


@dataclass(frozen=True)
class Bookmark:
    """Keyset position: the (ts, id) of the last row of a page."""

    ts: datetime
    id: int

    def __post_init__(self):
        if isinstance(self.ts, datetime) and self.ts.tzinfo is None:
            raise ValueError("a bookmark's time needs a zone: a collected datetime is local to its process")
        object.__setattr__(self, "ts", to_utc(self.ts))
        object.__setattr__(self, "id", int(self.id))


@dataclass(frozen=True)
class LogFilter:
    """Conjunction of the list/aggregate filters (all optional)."""

    service: str | None = None
    level: str | None = None
    since: datetime | str | None = None
    until: datetime | str | None = None
    attrs: tuple[tuple[str, str], ...] = field(default_factory=tuple)  # or a dict
    q: str | None = None

    def __post_init__(self):
        if self.service is not None and len(self.service) == 0:
            raise ValueError("service must be a non-empty string")
        if self.level is not None and self.level not in S.LEVELS:
            raise ValueError(f"unsupported level: '{self.level}'")
        if self.since is not None:
            object.__setattr__(self, "since", to_utc(self.since))
        if self.until is not None:
            object.__setattr__(self, "until", to_utc(self.until))
        raw = self.attrs.items() if isinstance(self.attrs, dict) else (self.attrs or ())
        pairs = tuple((str(k), str(v)) for k, v in raw)
        for k, _ in pairs:
            if len(k) == 0:
                raise ValueError("invalid attribute key")
        object.__setattr__(self, "attrs", pairs)
        if self.q is not None and len(self.q) == 0:
            object.__setattr__(self, "q", None)
        if self.since is not None and self.until is not None and self.until < self.since:
            raise ValueError("until must not be earlier than since")

    @property
    def needs_scan(self) -> bool:
        """Attribute and text filters cannot be answered from the rollup."""
        return bool(self.attrs) or self.q is not None


@dataclass(frozen=True)
class ListSpec:
    filter: LogFilter = field(default_factory=LogFilter)
    limit: int = S.LIST_LIMIT_DEFAULT
    bookmark: Bookmark | None = None

    def __post_init__(self):
        if isinstance(self.limit, bool) or not isinstance(self.limit, int):
            raise ValueError("limit must be a non-negative integer")
        if self.limit < S.LIST_LIMIT_MIN or self.limit > S.LIST_LIMIT_MAX:
            raise ValueError("limit must be between 1 and 1000")


@dataclass(frozen=True)
class AggregateSpec:
    since: datetime | str
    until: datetime | str
    bucket: str
    group_by: str | None = None
    filter: LogFilter = field(default_factory=LogFilter)

    def __post_init__(self):
        if self.since is None:
            raise ValueError("since is required")
        if self.until is None:
            raise ValueError("until is required")
        if self.bucket is None:
            raise ValueError("bucket is required")
        object.__setattr__(self, "since", to_utc(self.since))
        object.__setattr__(self, "until", to_utc(self.until))
        if self.until < self.since:
            raise ValueError("until must not be earlier than since")
        if self.bucket not in S.BUCKET_SECONDS:
            raise ValueError(f"unsupported bucket: '{self.bucket}' (expected 1m, 5m, 1h or 1d)")
        if self.group_by is not None and self.group_by not in S.GROUP_COLUMNS:
            raise ValueError("group_by must be 'service' or 'level'")

    @property
    def width_seconds(self) -> int:
        return S.BUCKET_SECONDS[self.bucket]

    def window_filter(self) -> LogFilter:
        """The list filter with the aggregate window as its time bounds."""
        f = self.filter
        return LogFilter(f.service, f.level, self.since, self.until, f.attrs, f.q)
