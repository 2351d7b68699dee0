"""Imports: cursors that walk a foreign source window by window, and always move.

What a foreign source answers is decoded here into rows; fetching is a function of the caller's, so any
transport serves. Functions given to the cluster (``post``, ``get``) must be picklable.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotrace.functions import semantics as S
from heliotrace.sources import otlp, remote_write


def walk_back(fetch: Callable[[int, int], list[tuple[int, str]]], start: int, end: int, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Pages of (time, record), newest first, until ``start``.

    A full page may have cut records of its oldest time, so the next window ends there and what
    was already seen is skipped; if a whole page has one time only, the cursor steps past it.
    """
    seen: set[tuple[int, str]] = set()
    while end >= start:
        page = fetch(start, end)
        fresh = [r for r in page if r not in seen]
        if fresh:
            yield fresh
        if len(page) < limit:
            return
        oldest = min(t for t, _ in page)
        seen = {r for r in page if r[0] == oldest}
        end = oldest if oldest < end else oldest - 1
        if not fresh:
            end = min(end, oldest - 1)


def import_requests(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """Decoded records of exported files: one request on each line, compressed or not by the file's name."""
    body = spark.read.text(path).withColumnRenamed("value", "body")
    return {"logs": otlp.decode_logs, "spans": otlp.decode_traces, "metrics": otlp.decode_metrics}[signal](body)


def import_spans_once(spans: DataFrame, known: DataFrame) -> DataFrame:
    """Spans of traces not yet known: a trace is imported whole or not at all."""
    return spans.join(known.select("trace_id").distinct(), "trace_id", "left_anti")


def read_windows(start_millis: int, end_millis: int, window_millis: int) -> list[tuple[int, int]]:
    """Both ends of each window are inside; together they cover the range once."""
    return [(at, min(end_millis, at + window_millis - 1)) for at in range(start_millis, end_millis + 1, window_millis)]


def pull_metrics(spark: SparkSession, post: Callable[[bytes], bytes], start_millis: int, end_millis: int, matchers: list[tuple[str, str, str]], window_millis: int = 3_600_000) -> DataFrame:
    """Samples of a remote-read server; each window is a task of its own, fetched where it is used."""
    schema = pa.schema([("timestamp_nanos", pa.int64()), ("labels", pa.map_(pa.string(), pa.string())), ("value", pa.float64()), ("kind", pa.string()), ("reject_reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = remote_write.read_response(post(remote_write.read_request(start, end, matchers)))
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=schema)

    windows = read_windows(start_millis, end_millis, window_millis)
    ends = spark.createDataFrame(windows, "start_millis bigint, end_millis bigint").repartition(max(1, len(windows)))
    return ends.mapInArrow(run, remote_write.SCHEMA)


_VALUES = "array<array<string>>"


def decode_stream_pages(pages: DataFrame) -> DataFrame:
    """(timestamp_nanos, seq, stream, body, attributes) of range-query answers, a JSON text ``body`` each.

    A value is [time, line] or [time, line, metadata]; metadata is a map, or a map under
    ``structuredMetadata``. Values without a whole time are left out.
    """
    parsed = F.from_json("body", f"data struct<result:array<struct<stream:map<string,string>,values:{_VALUES}>>>")
    rows = pages.select(F.explode(F.array(parsed)).alias("p")).select(F.explode("p.data.result").alias("r"))
    rows = rows.select(F.col("r.stream").alias("stream"), F.explode("r.values").alias("v"))
    more = F.get("v", F.lit(2))
    metadata = F.coalesce(F.from_json(F.get_json_object(more, "$.structuredMetadata"), "map<string,string>"), F.from_json(more, "map<string,string>"), S.empty_map())
    rows = rows.select(F.get("v", F.lit(0)).try_cast("bigint").alias("timestamp_nanos"), F.monotonically_increasing_id().alias("seq"), F.coalesce("stream", S.empty_map()).alias("stream"), F.coalesce(F.get("v", F.lit(1)), F.lit("")).alias("body"), metadata.alias("attributes"))
    return rows.where("timestamp_nanos is not null")


def page_records(page: str) -> list[tuple[int, str]]:
    """(time, the record as a page of its own) of one range-query answer, for ``walk_back``."""
    out = []
    for result in (json.loads(page).get("data") or {}).get("result") or []:
        for value in result.get("values") or []:
            out.append((int(value[0]), json.dumps({"data": {"result": [{"stream": result.get("stream") or {}, "values": [value]}]}}, sort_keys=True)))
    return out


def import_streams(spark: SparkSession, fetch: Callable[[int, int], str], start: int, end: int, limit: int) -> DataFrame:
    """All records of a log source between two times (nanoseconds), page by page, newest first."""
    pages = [record for page in walk_back(lambda a, b: page_records(fetch(a, b)), start, end, limit) for _, record in page]
    return decode_stream_pages(spark.createDataFrame([(p,) for p in pages], "body string"))


def trace_ids(search: Callable[[int, int], str], start_seconds: int, end_seconds: int) -> Iterator[str]:
    """Ids of all traces that searches (start, end in seconds, both inside) list, each once, newest window first.

    Searches know whole seconds only, so the oldest second stays in the next window and known ids are
    skipped; a window without a new id ends the walk.
    """
    seen: set[str] = set()
    while True:
        traces = json.loads(search(start_seconds, end_seconds)).get("traces") or []
        starts = [int(t["startTimeUnixNano"]) // 10**9 for t in traces if str(t.get("startTimeUnixNano", "")).isdigit()]
        fresh = [t["traceID"] for t in traces if isinstance(t.get("traceID"), str) and t["traceID"] not in seen]
        yield from dict.fromkeys(fresh)
        seen.update(fresh)
        if not fresh or not starts or min(starts) <= start_seconds:
            return
        end_seconds = min(starts)


def import_traces(spark: SparkSession, search: Callable[[int, int], str], get: Callable[[str], str], start_seconds: int, end_seconds: int) -> DataFrame:
    """Decoded spans of all listed traces: the driver lists ids, tasks fetch the traces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trace in batch.column(0).to_pylist():
                found = json.loads(get(trace)).get("batches")
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps({"resourceSpans": found})] if found is not None else [], pa.string())], names=["body"])

    ids = spark.createDataFrame([(i,) for i in trace_ids(search, start_seconds, end_seconds)], "trace string")
    return otlp.decode_traces(ids.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "body string"))
