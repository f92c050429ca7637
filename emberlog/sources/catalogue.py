"""The store's tables in Spark's catalogue.

The partitions of a batch are added once its commit marker is there, so what the catalogue shows is what is
committed: reads need no join with the markers, list no folder of a day that the filter prunes, and start no job before
the action. ``analyze`` gives the planner sizes and row counts. The markers stay the record that ``sync`` starts from, in a
new session or after a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.sources.store import LogStore

# Partition columns of each table; ``commits`` comes last and tells which batches are in.
PARTITIONS = {
    "logs": ("dt", "batch_id"), "log_counts": ("dt", "batch_id"), "rejected": ("batch_id",), "receipts": ("batch_id",), "commits": ("batch_id",),
}
# Partitions named in one statement.
CHUNK = 500


class Catalogue:
    """The tables of ``store`` in ``database``. One object at a time adds and drops partitions."""

    def __init__(self, spark: SparkSession, store: LogStore, database: str):
        self.spark, self.store, self.database = spark, store, database

    def name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def open(self) -> Catalogue:
        """Create what is missing: database, tables, columns of keys promoted since, partitions of committed batches."""
        root = self.store.root.rstrip("/").replace("'", "\\'")
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}` LOCATION '{root}/_database'")
        for table, parts in PARTITIONS.items():
            ddl = self.store.ddl(table)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({ddl}) USING parquet PARTITIONED BY ({', '.join(parts)}) LOCATION '{root}/{table}'")
        have = set(self.spark.table(self.name("logs")).columns)
        new = [f"{f.name} {f.dataType.simpleString()}" for f in self.store.promoted_schema() if f.name not in have]
        if new:
            self.spark.sql(f"ALTER TABLE {self.name('logs')} ADD COLUMNS ({', '.join(new)})")
        self.sync()
        return self

    def partitions(self, table: str) -> list[dict[str, str]]:
        rows = self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect()
        return [dict(p.split("=", 1) for p in r["partition"].split("/")) for r in rows]

    def sync(self) -> list[int]:
        """Add the committed batches that are not in yet; returns their numbers."""
        known = {p["batch_id"] for p in self.partitions("commits")}
        new = [b for b in self.store.values(self.spark, self.store.path("commits"), "batch_id") if b not in known]
        self._add(new)
        return sorted(int(b) for b in new)

    def add_batch(self, batch_id: int) -> None:
        """Show a batch. An uncommitted one stays unseen, one that is in already stays as it is."""
        if self.store.is_committed(self.spark, batch_id):
            self._add([str(batch_id)])

    def _add(self, batches: list[str]) -> None:
        for table, parts in PARTITIONS.items():
            found = [p for b in batches for p in self.store.batch_partitions(self.spark, table, b)] if batches else []
            self._alter(table, "ADD IF NOT EXISTS", found)

    def drop_until(self, day: str) -> None:
        """Forget the partitions whose folders a sweep up to ``day`` has removed; look at the others of that day anew."""
        for table in ("logs", "log_counts"):
            held = set(self.store.values(self.spark, f"{self.store.path(table)}/dt={day}", "batch_id"))
            gone = [p for p in self.partitions(table) if p["dt"] < day or (p["dt"] == day and p["batch_id"] not in held)]
            self._alter(table, "DROP IF EXISTS", gone)
            self.spark.catalog.refreshTable(self.name(table))

    def _alter(self, table: str, what: str, parts: list[dict[str, str]]) -> None:
        specs = ["PARTITION (" + ", ".join(f"{c}='{v}'" for c, v in p.items()) + ")" for p in parts]
        between = ", " if what.startswith("DROP") else " "
        for lo in range(0, len(specs), CHUNK):
            self.spark.sql(f"ALTER TABLE {self.name(table)} {what} {between.join(specs[lo:lo + CHUNK])}")

    def analyze(self, rows: bool = False) -> None:
        """Sizes of all tables for the planner; with ``rows`` also row counts (reads the footers of every file)."""
        for table in PARTITIONS:
            self.spark.sql(f"ANALYZE TABLE {self.name(table)} COMPUTE STATISTICS{'' if rows else ' NOSCAN'}")

    # -- readers ----------------------------------------------------------
    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def logs(self) -> DataFrame:
        return self.table("logs")

    def counts(self) -> DataFrame:
        return self.table("log_counts")

    def rejected(self) -> DataFrame:
        return self.table("rejected")

    def receipts(self) -> DataFrame:
        return self.table("receipts")

    def days(self) -> list[str]:
        """Day partitions of the log table, newest first."""
        return sorted({p["dt"] for p in self.partitions("logs")}, reverse=True)
