"""Continuous ingest, live tail, relay and streaming admission with Structured Streaming.

The checkpoint is the write-ahead log: a batch is replayed whole after a crash. A batch is written to
partitions of its own, named by the query's checkpoint and the batch's number, and a replay overwrites
them, so a table holds each batch once. Nothing is dropped as late: there is no watermark on stored
records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heliotrace.functions import semantics as S
from heliotrace.operators.admission import GLOBAL, PER_APP
from heliotrace.operators.logs import run_pipeline
from heliotrace.plans import logql
from heliotrace.sources import otlp, tables, wire

DECODERS = {"logs": otlp.decode_logs, "spans": otlp.decode_traces, "metrics": otlp.decode_metrics}


def landing(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Requests that arrive as text files, one JSON request on each line; back-pressure is the number of files for each trigger."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select(F.col("value").alias("body"), (F.unix_micros("_metadata.file_modification_time") * 1000).alias("received_nanos"))  # a replay gives the same times


def landing_bodies(spark: SparkSession, path: str, *, files_per_trigger: int = 100, most: int = wire.MAX_BODY) -> DataFrame:
    """Requests that arrive as one file each, compressed as the file's name says (.gz, .deflate, .zst, else not)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return wire.bodies(files.select("content", wire.encoding_of(F.col("path")).alias("encoding"), (F.unix_micros("modificationTime") * 1000).alias("received_nanos")), most)


def ingest(requests: DataFrame, signal: str, table: str, rejects: str, checkpoint: str, limits: otlp.Limits = otlp.Limits(), *, app: str | None = None):
    """Decodes each batch, appends accepted records to the table and counts of refusals beside it."""

    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def batch(df: DataFrame, batch_id: int) -> None:
        name = f"{run}-{batch_id}"
        decoded = DECODERS[signal](df, limits).persist()
        good = otlp.accepted(decoded)
        if app is not None:
            good = otlp.stamp(good, app, "labels" if signal == "metrics" else "stream")
        tables.append(good, table, signal, batch=name)
        counts = otlp.rejected(decoded).select(F.lit(name).alias(tables.BATCH), F.lit(batch_id).alias("batch"), "reason", "records")
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tables.BATCH).parquet(rejects)
        decoded.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(records: DataFrame, text: str) -> DataFrame:
    """The records of a stream that a log query lets pass: stream and body, without metadata."""
    return run_pipeline(records, logql.parse(text)).select("timestamp_nanos", "stream", "body")


RELAY_PAGE = 50_000


def ship(records: DataFrame, encode: Callable[..., DataFrame], post: Callable[[str], int], *, time: str = "timestamp_nanos", page: int = RELAY_PAGE, per_line: int = 2_000) -> int:
    """Posts all records in order of time, a page of them at a time, and gives their number.

    A cursor of (time, position) walks the pages, so records of equal time are neither lost nor
    repeated between pages. Only a request answered 413 is sent again, in halves of its records;
    any other answer than 2xx is an error, and so is 413 for a single record.
    """
    own = records.withColumn("seq", F.monotonically_increasing_id()).persist()
    place = F.struct(F.col(time), F.col("seq"))
    at = lambda cursor: F.struct(F.lit(cursor[0]).cast("long").alias(time), F.lit(cursor[1]).cast("long").alias("seq"))

    def send(part: DataFrame, lines: int) -> tuple[int, tuple[int, int] | None]:
        sent, last = 0, None
        for row in encode(part, limit=page, per_line=lines).orderBy("batch").toLocalIterator():
            status, end = post(row.body), (row.last_nanos, row.last_seq)
            if status == 413 and row.records > 1:
                cut = part.where(place <= at(end)) if last is None else part.where((place > at(last)) & (place <= at(end)))
                send(cut, -(-row.records // 2))
            elif not 200 <= status < 300:
                raise RuntimeError(f"the receiver answered {status}")
            sent, last = sent + row.records, end
        return sent, last

    total, cursor = 0, None
    try:
        while True:
            rest = own if cursor is None else own.where(place > at(cursor))
            sent, last = send(rest.orderBy(time, "seq").limit(page), per_line)
            total += sent
            if sent < page:
                return total
            cursor = last
    finally:
        own.unpersist()


def relay(records: DataFrame, encode: Callable[..., DataFrame], post: Callable[[str], int], checkpoint: str, *, time: str = "timestamp_nanos", page: int = RELAY_PAGE):
    """Ships each batch whole; the checkpoint moves only after every request was taken (at least once)."""

    def batch(df: DataFrame, _: int) -> None:
        ship(df, encode, post, time=time, page=page)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admit_stream(arrivals: DataFrame, *, max_series: int = 100_000, max_series_per_app: int = 20_000) -> DataFrame:
    """(app, series_key, reason) of new series in order of arrival; one global state, since the caps are global.

    The state holds at most ``max_series`` keys. Put distinct series of a batch in, not records.
    """

    def update(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = set(state.get[0]) if state.exists else set()
        by_app: dict[str, int] = {}
        for entry in known:
            app = entry.split("\x00", 1)[0]
            by_app[app] = by_app.get(app, 0) + 1
        frame = pd.concat(list(batches)).sort_values("seq")
        out, refused = [], set()
        for app, key in zip(frame["app"], frame["series_key"], strict=True):
            entry = f"{app}\x00{key}"
            if entry in known or entry in refused:
                continue
            reason = GLOBAL if max_series and len(known) >= max_series else PER_APP if max_series_per_app and by_app.get(app, 0) >= max_series_per_app else None
            if reason is None:
                known.add(entry)
                by_app[app] = by_app.get(app, 0) + 1
            else:
                refused.add(entry)
            out.append((app, key, reason))
        state.update((sorted(known),))
        yield pd.DataFrame(out, columns=["app", "series_key", "reason"])

    own = arrivals.select(F.lit(0).alias("all"), "app", "series_key", "seq")
    return own.groupBy("all").applyInPandasWithState(update, "app string, series_key string, reason string", "known array<string>", "append", GroupStateTimeout.NoTimeout)


def rollup(samples: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, sum, least and greatest value of each series in tumbling windows, for samples that come within ``late``."""
    ts = F.timestamp_micros(F.expr("timestamp_nanos div 1000"))
    keyed = samples.select(ts.alias("ts"), S.label_key(F.col("labels")).alias("series"), "value").withWatermark("ts", late)
    return keyed.groupBy(F.window("ts", window).alias("w"), "series").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest")).select(F.col("w.start").alias("start"), "series", "n", "total", "least", "greatest")
