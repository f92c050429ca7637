"""DuckDB-dialect SQL text for the oracle checks of the query catalog.

Each statement reads the driver's tables through the same ``logs`` view the
Spark side uses (``sources.events.LOGS_VIEW_SQL``).
"""

from __future__ import annotations

from datetime import datetime

from emberlog.sources.events import LOGS_VIEW_SQL

ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"


def iso(expr: str) -> str:
    return f"strftime({expr}, {ISO})"


def ts_lit(t: datetime) -> str:
    return "TIMESTAMP '" + t.strftime("%Y-%m-%d %H:%M:%S.%f") + "'"


def with_logs(body: str, extra_ctes: str = "") -> str:
    ctes = f"logs AS ({LOGS_VIEW_SQL})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


def str_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def attr_probe(key: str, value: str, num: float | None) -> str:
    path = str_lit("$." + key)
    t = f"json_type(attributes, {path})"
    probes = [f"({t} = 'VARCHAR' AND json_extract_string(attributes, {path}) = {str_lit(value)})"]
    if num is not None:
        probes.append(
            f"({t} IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND "
            f"CAST(json_extract(attributes, {path}) AS DOUBLE) = CAST({num!r} AS DOUBLE))"
        )
    if value in ("true", "false"):
        probes.append(f"({t} = 'BOOLEAN' AND CAST(json_extract(attributes, {path}) AS BOOLEAN) = {value})")
    return "COALESCE(" + " OR ".join(probes) + ", FALSE)"


def where_sql(flt, tenant, bookmark=None, with_time=True) -> str:
    from emberlog.functions.attrs import js_number
    from emberlog.spec import ALL_TENANTS

    c = []
    if with_time and flt.since is not None:
        c.append(f"ts >= {ts_lit(flt.since)}")
    if with_time and flt.until is not None:
        c.append(f"ts < {ts_lit(flt.until)}")
    if flt.service is not None:
        c.append(f"service = {str_lit(flt.service)}")
    if flt.level is not None:
        c.append(f"level = {str_lit(flt.level)}")
    for k, v in flt.attrs:
        c.append(attr_probe(k, v, js_number(v) if v != "" else None))
    if flt.q is not None:
        c.append(f"contains(lower(message), lower({str_lit(flt.q)}))")
    if tenant is None:
        c.append("tenant_id IS NULL")
    elif tenant is not ALL_TENANTS:
        c.append(f"tenant_id = {str_lit(tenant)}")
    if bookmark is not None:
        b = ts_lit(bookmark.ts)
        c.append(f"(ts < {b} OR (ts = {b} AND id < {bookmark.id}))")
    return ("WHERE " + " AND ".join(c)) if c else ""


def bucket_sql(expr: str, seconds: int) -> str:
    return f"time_bucket(INTERVAL '{seconds} seconds', {expr}, TIMESTAMP '1970-01-01')"
