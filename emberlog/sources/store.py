"""Partitioned Parquet log store.

Layout under one root (a shared, cluster-visible folder)::

    logs/dt=YYYY-MM-DD/batch_id=N/      id ts level service message attributes(variant) tenant_id
                                        + typed columns of the promoted attribute keys
    log_counts/dt=.../batch_id=N/       bucket_ts service level tenant_id n   (additive partials)
    rejected/batch_id=N/                doc_id entry_index reason raw
    receipts/batch_id=N/                doc_id accepted rejected status error rejections(index, reason)
    keys/seed=N/                        key_hash name scopes tenant_id created_at position   (insert-only)
    commits/batch_id=N/                 committed   (written last)

A batch becomes visible only once its commit marker exists; an attempt that
ended before it is removed when the batch is sent again. Retention drops whole
day folders and rewrites the day that holds the cutoff, batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberlog.functions.attrs import promoted_columns, promoted_values
from emberlog.operators.access import KEY_COLUMNS, first_seeds, seed_rows

# Stored log rows: attributes as VARIANT (typed values, direct path lookups).
STORED_LOGS_DDL = (
    "id bigint, ts timestamp, level string, service string, message string, attributes variant, "
    "tenant_id string, dt date, batch_id bigint"
)
REJECTED_DDL = "doc_id string,entry_index int,reason string,raw string,batch_id bigint"
RECEIPTS_DDL = ("doc_id string,accepted bigint,rejected bigint,status string,error string,"
                "rejections array<struct<index:int,reason:string>>,batch_id bigint")
COMMITS_DDL = "committed boolean, batch_id bigint"
STORED_COUNTS_DDL = "bucket_ts timestamp, service string, level string, tenant_id string, n bigint, dt date, batch_id bigint"


@dataclass(frozen=True)
class LogStore:
    """``promoted`` declares the hot attribute keys: what is written from then on also holds their values as typed columns,
    with Bloom filters, and probes of these keys are pushed into the scan. Files written before, or by a
    writer that did not declare a key, are answered from the VARIANT, so the list may change at any time."""

    root: str
    promoted: tuple[str, ...] = ()

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    # -- writers ----------------------------------------------------------
    def write_partitions(self, df: DataFrame, table: str, partition_cols: list[str],
                         sort_col: str | None = None, cluster: bool = False) -> None:
        """Dynamic partition overwrite of the partitions present in ``df``.

        Rows are sorted inside each task by partition then ``sort_col``, so
        Parquet row groups carry tight min/max ranges on it. ``cluster`` first
        range-partitions on (day, ``sort_col``) so each task writes one time
        slice (one or two day directories; a hot day is split over many
        tasks). Ingest leaves it off: it rebalances its rows by day itself.
        """
        if sort_col:
            if cluster:
                keys = [c for c in partition_cols if c != "batch_id"] + [sort_col]
                df = df.repartitionByRange(*keys)
            df = df.sortWithinPartitions(*partition_cols, sort_col)
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        for key in self.promoted if table == "logs" else ():
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
            for kind in ("text", "number"):
                writer = writer.option(f"parquet.bloom.filter.enabled#{promoted_columns(key)[kind]}", "true")
        writer.partitionBy(*partition_cols).parquet(self.path(table))

    def promoted_schema(self) -> StructType:
        """The typed columns of the promoted keys."""
        types = {"text": "string", "number": "double", "bool": "boolean", "kept": "boolean"}
        out = StructType()
        for key in self.promoted:
            for kind, name in promoted_columns(key).items():
                out = out.add(name, types[kind])
        return out

    def ddl(self, table: str) -> str:
        """Columns of a table, partition columns included."""
        plain = {"logs": STORED_LOGS_DDL, "log_counts": STORED_COUNTS_DDL, "rejected": REJECTED_DDL, "receipts": RECEIPTS_DDL,
                 "commits": COMMITS_DDL}[table]
        typed = [f"{f.name} {f.dataType.simpleString()}" for f in self.promoted_schema()] if table == "logs" else []
        return ", ".join([plain, *typed])

    def with_promoted(self, logs: DataFrame) -> DataFrame:
        """Log rows (attributes as VARIANT) with the typed columns of the promoted keys."""
        return logs.select("*", *[c for key in self.promoted for c in promoted_values("attributes", key)])

    def is_committed(self, spark: SparkSession, batch_id: int) -> bool:
        """Whether the batch has its marker (one look at a path)."""
        fs, marker = self._folder(spark, f"{self.path('commits')}/batch_id={batch_id}")
        return fs.exists(marker)

    def clear_uncommitted(self, spark: SparkSession, batch_id: int) -> None:
        """Delete what an earlier, uncommitted attempt of this batch left: dynamic overwrite
        replaces only partitions the new attempt writes, the others would become visible with
        its marker. A committed batch is left alone."""
        if self.is_committed(spark, batch_id):
            return
        for table in ("logs", "log_counts", "rejected", "receipts"):
            for folder in self._batch_folders(spark, table, batch_id):
                self.drop(spark, folder)

    # -- readers ----------------------------------------------------------
    def _read(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        """The table by its known schema: no file is opened to plan a query."""
        try:
            return spark.read.schema(schema).parquet(self.path(table))
        except Exception as exc:  # empty store: no files yet
            if "PATH_NOT_FOUND" in str(exc):
                return spark.createDataFrame([], schema)
            raise

    def commits(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "commits", COMMITS_DDL).select("batch_id").distinct()

    def commit(self, spark: SparkSession, batch_id: int) -> None:
        """Write the commit marker of ``batch_id`` (the last write of a batch)."""
        df = spark.range(1).select(F.lit(True).alias("committed"), F.lit(int(batch_id)).cast("bigint").alias("batch_id"))
        self.write_partitions(df.coalesce(1), "commits", ["batch_id"])

    # -- folders ----------------------------------------------------------
    def _folder(self, spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

    def values(self, spark: SparkSession, path: str, column: str) -> list[str]:
        """Values of a partition column below ``path`` (a directory listing)."""
        fs, p = self._folder(spark, path)
        names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()] if fs.exists(p) else []
        return sorted(n[len(column) + 1:] for n in names if n.startswith(f"{column}="))

    def drop(self, spark: SparkSession, path: str) -> None:
        fs, p = self._folder(spark, path)
        fs.delete(p, True)

    def _batch_folders(self, spark: SparkSession, table: str, batch_id: int | str) -> list[str]:
        days = "dt=*/" if table in ("logs", "log_counts") else ""
        fs, pattern = self._folder(spark, f"{self.path(table)}/{days}batch_id={batch_id}")
        return [st.getPath().toString() for st in fs.globStatus(pattern) or []]

    def batch_partitions(self, spark: SparkSession, table: str, batch_id: int | str) -> list[dict[str, str]]:
        """Partition values of a batch's folders (one listing)."""
        found = [folder.rsplit("/", 2)[1:] for folder in self._batch_folders(spark, table, batch_id)]
        return [dict(p.split("=", 1) for p in parts if p.startswith(("dt=", "batch_id="))) for parts in found]

    def days(self, spark: SparkSession) -> list[str]:
        """Day partitions of the log table, newest first."""
        return self.values(spark, self.path("logs"), "dt")[::-1]

    def _visible(self, spark: SparkSession, raw: DataFrame) -> DataFrame:
        """Semi join on committed batches. The planner knows the size of the markers from their files: it broadcasts
        them while that is small, and no job is needed to find out."""
        return raw.join(self.commits(spark), "batch_id", "left_semi")

    def raw_logs(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "logs", self.ddl("logs"))

    def raw_counts(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "log_counts", STORED_COUNTS_DDL)

    def logs(self, spark: SparkSession) -> DataFrame:
        """Logs of committed batches (J4). ``batch_id`` and ``dt`` are
        partition columns, so the join also prunes partitions at run time."""
        return self._visible(spark, self.raw_logs(spark))

    def counts(self, spark: SparkSession) -> DataFrame:
        return self._visible(spark, self.raw_counts(spark))

    def raw_rejected(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "rejected", REJECTED_DDL)

    def raw_receipts(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "receipts", RECEIPTS_DDL)

    def rejected(self, spark: SparkSession) -> DataFrame:
        """Rejections of committed batches."""
        return self._visible(spark, self.raw_rejected(spark))

    def receipts(self, spark: SparkSession) -> DataFrame:
        """Receipts of committed batches: a batch is acknowledged once stored."""
        return self._visible(spark, self.raw_receipts(spark))

    # -- keys -------------------------------------------------------------
    KEYS_DDL = ("key_hash string, name string, scopes array<string>, tenant_id string, created_at timestamp, "
                "position bigint, seed bigint")

    def raw_keys(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "keys", self.KEYS_DDL)

    def keys(self, spark: SparkSession) -> DataFrame:
        """The key table: one row for each key, the one that was seeded first."""
        return first_seeds(self.raw_keys(spark)).select(*KEY_COLUMNS)

    def seed_keys(self, spark: SparkSession, new_keys: DataFrame, seed: int | None = None) -> int:
        """Insert the keys (key, name, scopes, tenant_id[, created_at, position]) that are not stored yet; returns the seed's number.

        Rows are only ever added, so a repeated or retried seed changes nothing, and of two seeds at the same time the
        one of the lower number counts in every read.
        """
        if seed is None:
            last = self.raw_keys(spark).agg(F.max("seed")).first()[0]
            seed = 0 if last is None else int(last) + 1
        stored = self.raw_keys(spark).select("key_hash")
        fresh = seed_rows(new_keys, seed).join(stored, "key_hash", "left_anti")
        fresh.write.mode("append").partitionBy("seed").parquet(self.path("keys"))
        return seed
