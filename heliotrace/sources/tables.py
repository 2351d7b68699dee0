"""The stored tables: Parquet by day, sorted for pruning, with Bloom filters where equality is asked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotrace.functions import semantics as S
from heliotrace.schema import LOGS, METRICS, SPANS

BATCH, STREAMS = "ingest_batch", ".streams"
DAY = 86_400 * 10**9
LAYOUT = {  # signal -> time column, sort order inside files, columns with Bloom filters, schema
    "logs": ("timestamp_nanos", ("app", "timestamp_nanos", "seq"), ("trace_id",), LOGS),
    "spans": ("start_nanos", ("app", "start_nanos", "seq"), ("trace_id",), SPANS),
    "metrics": ("timestamp_nanos", ("name", "timestamp_nanos", "seq"), ("name",), METRICS),
}


def hoisted(df: DataFrame, signal: str) -> DataFrame:
    """Labels that prune files, as plain columns: statistics know columns, not map entries."""
    labels = "labels" if signal == "metrics" else "stream"
    time = LAYOUT[signal][0]
    out = df.withColumn("app", F.coalesce(F.element_at(labels, F.lit("app")), F.lit("unknown")))
    if signal == "metrics":
        out = out.withColumn("name", F.coalesce(F.element_at(labels, F.lit("__name__")), F.lit("")))
    return out.withColumn("signal_day", F.expr(f"date_add(date'1970-01-01', cast({time} div {DAY} as int))"))


def append(df: DataFrame, path: str, signal: str, *, compression: str = "zstd", batch: str | None = None) -> None:
    """One commit of records and of their label sets; rows of a day are range-sorted inside each file. A batch written again replaces itself."""
    _, order, bloom, _ = LAYOUT[signal]
    rows = hoisted(df, signal).withColumn(BATCH, F.lit(batch or uuid.uuid4().hex))
    writer = rows.repartition("signal_day", "app").sortWithinPartitions("signal_day", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression)
    for column in bloom:
        if column in df.columns or column == "name":
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.partitionBy("signal_day", BATCH).parquet(path)
    labels, time = "labels" if signal == "metrics" else "stream", LAYOUT[signal][0]
    by_stream = rows.groupBy("signal_day", BATCH, S.label_key(F.col(labels)).alias("stream_key")).agg(F.first(labels).alias(labels), F.min(time).alias("first_nanos"), F.max(time).alias("last_nanos"), F.count("*").alias("records"))
    by_stream.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("signal_day", BATCH).parquet(f"{path}{STREAMS}")


def streams(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """Label sets of each day and batch with their first and last time and number of records: what label discovery reads instead of the records."""
    labels = "labels" if signal == "metrics" else "stream"
    return spark.read.schema(f"stream_key string, {labels} map<string,string>, first_nanos bigint, last_nanos bigint, records bigint, signal_day date, {BATCH} string").parquet(f"{path}{STREAMS}").drop(BATCH)


def _stored(spark: SparkSession, path: str, signal: str) -> DataFrame:
    return spark.read.schema(f"{LAYOUT[signal][3]}, app string, signal_day date, {BATCH} string").parquet(path)


def with_live(spark: SparkSession, path: str, signal: str, live: DataFrame) -> DataFrame:
    """Stored records and those of batches still on their way, each once.

    ``live`` has the table's columns and the batch's name in ``ingest_batch``; batches that the table
    holds by now are taken from the table alone. Their names come from the table's partitions.
    """
    stored = _stored(spark, path, signal)
    known = stored.select(BATCH).distinct()
    fresh = live.join(F.broadcast(known), BATCH, "left_anti")  # names only, a few bytes for each batch
    own = hoisted(fresh, signal).select(*[c for c in stored.columns if c in {*fresh.columns, "app", "name", "signal_day"}])
    return stored.unionByName(own, allowMissingColumns=True).drop(BATCH)


def read(spark: SparkSession, path: str, signal: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Records of a time range: whole days are pruned by partition, the rest by file statistics."""
    df = _stored(spark, path, signal).drop(BATCH)
    time = LAYOUT[signal][0]
    for bound, inside in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound is not None:
            day = F.expr(f"date_add(date'1970-01-01', {bound // DAY})")
            df = df.where(inside(F.col("signal_day"), day) & inside(F.col(time), F.lit(bound)))
    return df


def files(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """(signal, id, newest_nanos, bytes) of the stored files, for the retention plan."""
    time = LAYOUT[signal][0]
    df = spark.read.parquet(path)
    return df.groupBy(F.col("_metadata.file_path").alias("id")).agg(F.max(time).alias("newest_nanos"), F.max("_metadata.file_size").alias("bytes")).select(F.lit(signal).alias("signal"), "id", "newest_nanos", "bytes")
