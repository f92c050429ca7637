"""The driver's ``events`` table seen as a ``logs`` table.

The same mapping is written once as Spark columns and once as SQL text, so
DuckDB oracles run over exactly the rows the Spark queries see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# SQL text of the view (runs unchanged in DuckDB and Spark SQL).
LOGS_VIEW_SQL = """
SELECT event_id AS id, ts,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
                       WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
       concat('svc-', CAST(user_id % 8 AS VARCHAR(20))) AS service,
       concat(event_type, ' by user ', CAST(user_id AS VARCHAR(20))) AS message,
       props AS attributes,
       CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a' ELSE 'b' END AS tenant_id
FROM events
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` → (id, ts, level, service, message, attributes, tenant_id)."""
    ev = read_table(spark, sf_dir, "events")
    et, uid = F.col("event_type"), F.col("user_id")
    tenant_slot = uid % 3
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(et == "error", "error")
        .when(et == "purchase", "warn")
        .when(et == "view", "debug")
        .otherwise("info")
        .alias("level"),
        F.concat(F.lit("svc-"), (uid % 8).cast("string")).alias("service"),
        F.concat(et, F.lit(" by user "), uid.cast("string")).alias("message"),
        F.col("props").alias("attributes"),
        F.when(tenant_slot == 0, F.lit(None).cast("string"))
        .when(tenant_slot == 1, F.lit("a"))
        .otherwise(F.lit("b"))
        .alias("tenant_id"),
    )
