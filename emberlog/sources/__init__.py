"""Sources and sinks: the driver tables as a log view, JSON batch documents,
and the partitioned Parquet log store."""
