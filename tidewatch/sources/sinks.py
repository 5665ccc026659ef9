"""Writers: append without repeats, upsert of column subsets, partitioned facts, audit, ledger, documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from tidewatch.sources.scratch import shuffled


def append_new_events(events: DataFrame, path: str, history: DataFrame | None, keys=("global_event_id", "event_date")) -> int:
    """Append rows whose keys are new; returns how many. The count is observed during the write."""
    fresh = events.dropDuplicates(list(keys))
    if history is not None:
        fresh = fresh.join(shuffled(history.select(*keys)), list(keys), "left_anti")
    seen = Observation(f"append_{uuid.uuid4().hex}")
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return int(seen.get["n"])


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], update_cols: list[str]) -> DataFrame:
    """Rows of ``target`` with ``update_cols`` taken from ``updates`` where a key matches, and new rows; other columns stay.

    A full outer join on the keys. Several updates of one key must be resolved before.
    """
    new = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"__t_{c}") for c in new], F.lit(True).alias("__old"))
    u = updates.select(*keys, *[F.col(c).alias(f"__u_{c}") for c in new if c in updates.columns], F.lit(True).alias("__new"))
    j = t.join(u, keys, "full")
    out = []
    for c in new:
        old, fresh = F.col(f"__t_{c}"), F.col(f"__u_{c}") if c in updates.columns else F.lit(None)
        out.append(F.when(F.col("__old").isNull(), fresh).when(F.col("__new").isNotNull() & F.lit(c in update_cols and c in updates.columns), fresh).otherwise(old).alias(c))
    return j.select(*keys, *out)


def write_upsert(target_path: str, updates: DataFrame, keys: list[str], update_cols: list[str], partition_by: list[str]) -> None:
    """Upsert into a partitioned Parquet table: only partitions that have updates are read, staged and overwritten."""
    spark = updates.sparkSession
    target = spark.read.parquet(target_path)
    touched = target.join(updates.select(*partition_by).distinct(), partition_by, "left_semi") if partition_by else target
    staged = f"{target_path.rstrip('/')}__stage_{uuid.uuid4().hex}"
    upsert(touched, updates, keys, update_cols).write.parquet(staged)
    writer = spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target_path)


def write_monthly(events: DataFrame, path: str) -> None:
    """Facts partitioned by month; months in ``events`` are replaced, others stay."""
    e = events.withColumn("event_month", F.date_format("event_date", "yyyy-MM"))
    e.repartition("event_month", F.pmod(F.xxhash64("global_event_id"), F.lit(16))).sortWithinPartitions("action_geo_country").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_month").parquet(path)


def audit_row(spark, run_id: str, date: str, parsed: int, inserted: int, skipped: int, seconds: float, status: str, error: str | None = None) -> DataFrame:
    return spark.createDataFrame([(run_id, date, parsed, inserted, skipped, float(seconds), status, (error or "")[:500] or None)], "run_id string, run_date string, parsed long, inserted long, skipped long, seconds double, status string, error string")


def register_files(ledger: DataFrame, manifest: DataFrame) -> DataFrame:
    """The ledger with unknown files of the manifest as pending."""
    fresh = manifest.join(ledger.select("file_url"), "file_url", "left_anti").dropDuplicates(["file_url"])
    return ledger.unionByName(fresh.select("file_url", "file_ts", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("events"), F.lit(None).cast("string").alias("error")))


def next_files(ledger: DataFrame, n: int) -> DataFrame:
    """The ``n`` oldest pending files."""
    return ledger.filter("status = 'pending'").orderBy("file_ts", "file_url").limit(n)


def mark_files(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """Status, events and error (cut to 500 characters) of ``results`` put into the ledger."""
    return upsert(ledger, results.withColumn("error", F.substring("error", 1, 500)), ["file_url"], ["status", "events", "error"])


def ledger_status(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("files"), F.sum("events").alias("events"), F.max("file_ts").alias("latest"))


def run_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count_distinct(F.when(F.col("status") == "success", F.col("run_date"))).alias("dates_ok"), F.coalesce(F.sum("inserted"), F.lit(0)).alias("events_inserted"))


def missing_dates(wanted: DataFrame, events: DataFrame, date: str = "event_date") -> DataFrame:
    return wanted.join(events.select(date).distinct(), date, "left_anti")


def count_per_date(events: DataFrame, date: str = "event_date") -> DataFrame:
    return events.groupBy(date).agg(F.count("*").alias("n"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str, rows: int = 250_000) -> None:
    """Text files, gzipped, of at most ``rows`` lines, as a compressed file is read by one task."""
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", rows).text(path)


def land_lines(lines: DataFrame, path: str) -> None:
    """Gzipped text added to a stream's folder, one file by partition, as a batch is so many files; a task reads a file whole."""
    lines.write.mode("append").option("compression", "gzip").text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
