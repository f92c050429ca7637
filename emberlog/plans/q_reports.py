"""Catalog entries for measurement reports (M1, M2 is in q_ingest) and the bench set (M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators.report import percentiles
from emberlog.plans import oracle as O
from emberlog.plans.catalog import register
from emberlog.session import configure
from emberlog.sources.events import read_table

PCTS = (50, 95, 99)


def _pct_sql() -> str:
    cols = ",\n  ".join(
        f"max(CASE WHEN rk = least(n - 1, CAST(floor({p}.0 / 100.0 * n) AS BIGINT)) THEN value END) AS p{p}"
        for p in PCTS
    )
    return (
        "SELECT event_type, max(n) AS n,\n  " + cols + "\nFROM (\n"
        "  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rk,\n"
        "         count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) t\n"
        "GROUP BY event_type"
    )


@register("latency_percentiles", _pct_sql())
def q_latency_percentiles(spark, sf_dir):
    """Nearest-rank p50/p95/p99 of ``value`` per ``event_type`` (exact)."""
    configure(spark)
    ev = read_table(spark, sf_dir, "events")
    return percentiles(ev, "value", ["event_type"], PCTS).select("event_type", "n", *[f"p{p}" for p in PCTS])


@register(
    "latency_percentiles_by_service",
    O.with_logs(
        _pct_sql()
        .replace("event_type", "service")
        .replace("FROM events", "FROM (SELECT service, CAST(id AS DOUBLE) AS value FROM logs) l")
    ),
)
def q_latency_percentiles_by_service(spark, sf_dir):
    from emberlog.plans.catalog import logs_of

    logs = logs_of(spark, sf_dir).select("service", F.col("id").cast("double").alias("value"))
    return percentiles(logs, "value", ["service"], PCTS).select("service", "n", *[f"p{p}" for p in PCTS])


# ---------------------------------------------------------------------------
# Bench query set (M4): the six query kinds of the load generator, one week wide.
# ---------------------------------------------------------------------------
def _bench():
    from emberlog.plans.catalog import _register_agg, _register_list
    from emberlog.spec import AggregateSpec, ListSpec, LogFilter

    day = ("2024-01-10T00:00:00Z", "2024-01-17T00:00:00Z")  # one week
    _register_list("bench_list", ListSpec(LogFilter(service="svc-3", level="info", since=day[0], until=day[1])))
    _register_list("bench_list_attr", ListSpec(LogFilter(service="svc-1", since=day[0], until=day[1],
                                                         attrs=(("k", "3"),))))
    _register_list("bench_list_q", ListSpec(LogFilter(since=day[0], until=day[1], q="purchase")))
    _register_agg("bench_agg", AggregateSpec(*day, "5m", "service", LogFilter(service="svc-2")), rollup=True)
    _register_agg("bench_agg_attr", AggregateSpec(*day, "5m", "level", LogFilter(attrs=(("k", "3"),))))
    _register_agg("bench_agg_q", AggregateSpec(*day, "1m", None, LogFilter(q="click")))


_bench()
