"""emberlog: a Spark-native structured-log store.

Batches or streams of JSON log entries become a validated, partitioned log
table (rejected entries are kept with their reason); the table answers
filtered newest-first listings with keyset pages and per-bucket counts, the
latter from an additive one-second rollup that is exact for any window.
Everything is expressed with the DataFrame API on built-in functions.
"""

from emberlog.spec import (  # noqa: F401
    ALL_TENANTS,
    AggregateSpec,
    Bookmark,
    ListSpec,
    LogFilter,
)

__all__ = ["ALL_TENANTS", "AggregateSpec", "Bookmark", "ListSpec", "LogFilter"]
