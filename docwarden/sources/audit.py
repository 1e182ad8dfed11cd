"""The audit table: appended to by day, pruned by day."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ..rules import AuditOptions


#: Rows of a day beyond which its part in one task goes on in another file.
ROWS_PER_FILE = 1_000_000


def _by_day(audit: DataFrame) -> DataFrame:
    """Rows in order of day, in even parts for all cores: many short days cost their files, not their bytes, and a long day is several parts.

    Spark looks at a sample before it cuts the parts, so ``audit`` is computed twice unless it is kept.
    """
    spark = audit.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.xxhash64(*(F.col(f"`{f.name}`") for f in audit.schema if isinstance(f.dataType, AtomicType)))
    return audit.repartitionByRange(parts, "audit_date", spread)


def write_audit(audit: DataFrame, path: str) -> None:
    """Append records to parquet, one directory per ``audit_date``. Rows are gathered by day, and Spark
    splits big days and merges small ones, so files come out in even size whatever the days hold."""
    balanced = audit.hint("rebalance", "audit_date")
    balanced.write.mode("append").partitionBy("audit_date").parquet(path)


def stream_audit(audit: DataFrame, path: str, checkpoint: str):
    """Streaming writer for the same layout; the caller starts it."""
    return (
        audit.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("audit_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def audit_sink(audit: DataFrame, path: str, checkpoint: str):
    """Streaming writer of which a batch that is run again after a failure replaces what its first run wrote; the caller starts it.

    Every batch has a folder of its own in each day (``audit_date``, ``batch_id``). ``read_audit`` reads the table. A batch that was
    begun before (a mark in ``_begun``) replaces its folders one by one; any other is appended at once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        writer = _by_day(batch.withColumn("batch_id", F.lit(batch_id))).write.option("maxRecordsPerFile", ROWS_PER_FILE)
        if _begins(batch.sparkSession, path, batch_id):
            writer = writer.mode("append")
        else:
            writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("audit_date", "batch_id").parquet(path)
        batch.unpersist()

    return audit.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def _begins(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Marks a batch as begun; whether it surely was not before. A table without marks may hold parts of any."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marked = files.exists(place(f"{path}/_begun")) or not files.exists(place(path))
    return files.createNewFile(place(f"{path}/_begun/{batch_id}")) and marked


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The records of an audit table, however it was written."""
    return spark.read.parquet(path).drop("batch_id")


def summarize_stream(audit: DataFrame, delay: str = "1 day") -> DataFrame:
    """``audit_summary`` of a stream: a day (UTC) comes out once, when the watermark on ``ts`` has passed its end.

    State is one row for each open day, action and level. Records that come more than ``delay`` late are dropped and counted by Spark.
    """
    timed = audit.withWatermark("ts", delay)
    days = timed.groupBy(F.window("ts", "1 day").alias("day"), "action", "level").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("warnings_count").alias("warnings"),
        F.sum("errors_count").alias("errors"),
        F.max("risk_score").alias("max_risk"),
    )
    return days.select(F.to_date("day.start").alias("audit_date"), "action", "level", "requests", "warnings", "errors", "max_risk")


def drop_expired_days(spark: SparkSession, path: str, today: datetime.date, days: int = AuditOptions().retention_days) -> list[datetime.date]:
    """Delete the folders of days that ``audit_retention`` would not keep; no record is read. The days dropped, in order."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = []
    for status in files.listStatus(place):
        found = re.fullmatch(r"audit_date=(\d{4}-\d\d-\d\d)", status.getPath().getName())
        if found and status.isDirectory():
            day = datetime.date.fromisoformat(found[1])
            if day < today - datetime.timedelta(days):
                files.delete(status.getPath(), True)
                dropped.append(day)
    return sorted(dropped)


def audit_retention(
    audit: DataFrame, today: Column, days: int = AuditOptions().retention_days
) -> DataFrame:
    """Records still to be kept: a filter on the partition column, so older days are not read."""
    return audit.where(F.col("audit_date") >= F.date_sub(today, days))
