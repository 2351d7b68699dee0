"""One object over the three tables, with the query surface of the three protocols."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotrace.errors import BadRequest, QueryError
from heliotrace.functions.semantics import format_number
from heliotrace.operators import discovery, logs, metrics, traces
from heliotrace.plans import logql, promql
from heliotrace.plans.lexer import duration_nanos
from heliotrace.sources import otlp_encode

HOUR = 3_600 * 10**9


def log_time(text: str) -> int:
    """Nanoseconds of whole seconds, ms, us or ns by size, float seconds, or RFC 3339 (whose zone is not applied)."""
    text = text.strip()
    if re.fullmatch(r"[0-9]+", text):
        value = int(text)
        for unit, scale in ((10**11, 10**9), (10**14, 10**6), (10**17, 10**3)):
            if value < unit:
                return value * scale
        return value
    if re.fullmatch(r"[0-9]+\.[0-9]+", text):
        whole, part = text.split(".")
        return int(whole) * 10**9 + int(part[:9].ljust(9, "0"))
    m = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d+))?(?:Z|[+-]\d\d:\d\d)?", text)
    if not m:
        raise BadRequest(f"not a time: {text}")
    seconds = int((datetime.fromisoformat(m[1]) - datetime(1970, 1, 1)).total_seconds())
    return seconds * 10**9 + int((m[2] or "0")[:9].ljust(9, "0"))


def seconds_time(text: str) -> int:
    """Metric times are always seconds, or RFC 3339."""
    try:
        whole, _, part = text.strip().partition(".")
        return int(whole) * 10**9 + int((part or "0")[:9].ljust(9, "0"))
    except ValueError:
        return log_time(text)


def step_of(text: str) -> int:
    own = text.strip()
    if re.fullmatch(r"[0-9]+(\.[0-9]+)?", own):
        return round(float(own) * 1e9)
    if not re.fullmatch(r"(?:[0-9]+(?:\.[0-9]+)?(?:ns|us|ms|s|m|h|d|w|y))+", own):
        raise BadRequest(f"not a duration: {text}")
    return duration_nanos(own)


def trace_duration(text: str) -> int:
    """A bare number is milliseconds."""
    return round(float(text) * 1e6) if re.fullmatch(r"[0-9]+(\.[0-9]+)?", text.strip()) else step_of(text)


def _now() -> int:
    return time.time_ns()


@dataclass
class Engine:
    """Tables are DataFrames in the shapes of :mod:`heliotrace.schema`. Results are DataFrames; ``*_json`` are bounded responses."""

    spark: SparkSession
    logs: DataFrame | None = None
    spans: DataFrame | None = None
    metrics: DataFrame | None = None
    log_streams: DataFrame | None = None  # of tables.streams: label discovery reads these instead of the records
    metric_streams: DataFrame | None = None

    def _discovered(self, kind: str, start: int | None, end: int | None, *args) -> tuple:
        """What a discovery function takes: the streams of a range, or the records and the range."""
        streams, records = (self.log_streams, self.logs) if kind == "log" else (self.metric_streams, self.metrics)
        return (records, *args, start, end) if streams is None else (discovery.active(streams, start, end), *args)

    # logs
    def query_logs(self, text: str, start: int | None = None, end: int | None = None, *, limit: int | None = None, direction: str = "backward") -> DataFrame:
        if direction not in ("backward", "forward"):
            raise BadRequest("direction is backward or forward")
        end = _now() if end is None else end
        return logs.query_range(self.logs, text, end - 6 * HOUR if start is None else start, end, limit=limit, forward=direction == "forward")

    def query_logs_json(self, text: str, start: int | None = None, end: int | None = None, *, limit: int | None = None, direction: str = "backward") -> dict:
        """The response of a range query: streams with [nanoseconds as text, line, metadata]."""
        rows = logs.group_streams(self.query_logs(text, start, end, limit=limit, direction=direction), forward=direction == "forward").collect()  # at most MAX_LIMIT records
        values = lambda r: [[str(v.timestamp_nanos), v.body, {"structuredMetadata": dict(map(tuple, v.attributes))}] if v.attributes else [str(v.timestamp_nanos), v.body] for v in r["values"]]
        return {"status": "success", "data": {"resultType": "streams", "result": [{"stream": r.stream, "values": values(r)} for r in rows]}}

    def tail(self, records: DataFrame, text: str) -> DataFrame:
        return logs.run_pipeline(records, logql.parse(text)).select("timestamp_nanos", "stream", "body")

    def log_labels(self, start: int | None = None, end: int | None = None) -> DataFrame:
        return discovery.label_names(*self._discovered("log", start, end))

    def log_label_values(self, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
        return discovery.label_values(*self._discovered("log", start, end, name))

    def log_series(self, selectors: list[str] = (), start: int | None = None, end: int | None = None) -> DataFrame:
        return discovery.series(*self._discovered("log", start, end, selectors))

    # metrics
    def query_metrics(self, text: str, at: int | None = None) -> DataFrame:
        return metrics.instant(self.metrics, text, _now() if at is None else at)

    def query_metrics_range(self, text: str, start: int, end: int, step: int) -> DataFrame:
        return metrics.query_range(self.metrics, text, start, end, step)

    def query_metrics_json(self, text: str, at: int | None = None) -> dict:
        at = _now() if at is None else at
        rows = [{"metric": r.labels, "value": [at / 1e9, format_number(r.value)]} for r in self.query_metrics(text, at).collect()]
        return {"status": "success", "data": {"resultType": "vector", "result": rows}}

    def query_metrics_range_json(self, text: str, start: int, end: int, step: int) -> dict:
        """A matrix: one entry for each label set, points in order of time."""
        df = self.query_metrics_range(text, start, end, step)
        grouped = df.groupBy("labels_key").agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("timestamp_nanos", "value"))).alias("points"))
        rows = [{"metric": r.labels, "values": [[p.timestamp_nanos / 1e9, format_number(p.value)] for p in r.points]} for r in grouped.collect()]
        return {"status": "success", "data": {"resultType": "matrix", "result": rows}}

    def metric_labels(self, start: int | None = None, end: int | None = None) -> DataFrame:
        return discovery.label_names(*self._discovered("metric", start, end), column="labels")

    def metric_label_values(self, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
        return discovery.label_values(*self._discovered("metric", start, end, name), column="labels")

    def metric_series(self, selectors: list[str] = (), start: int | None = None, end: int | None = None) -> DataFrame:
        """Selectors may begin with a metric's name."""
        own = []
        for text in selectors:
            node = promql.parse(text)
            if not isinstance(node, promql.Selector):
                raise BadRequest("match[] takes selectors")
            own.append("{" + ",".join(f'{m.name}{m.op}"{m.value.replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}"' for m in node.matchers) + "}")
        return discovery.series(*self._discovered("metric", start, end, own), column="labels")

    # traces
    def search_traces(self, text: str = "", start: int | None = None, end: int | None = None, *, limit: int | None = None, min_duration: str | None = None, max_duration: str | None = None) -> DataFrame:
        end = _now() if end is None else end
        bounds = {k: trace_duration(v) for k, v in (("min_duration", min_duration), ("max_duration", max_duration)) if v is not None}
        return traces.search(self.spans, text, end - HOUR if start is None else start, end, limit=limit, **bounds)

    def trace(self, trace_id: str) -> DataFrame:
        return traces.require(traces.by_id(self.spans, trace_id))

    def trace_tags(self, start: int | None = None, end: int | None = None) -> DataFrame:
        return traces.tags(self.spans, start, end)

    def trace_tag_values(self, tag: str, start: int | None = None, end: int | None = None) -> DataFrame:
        return traces.tag_values(self.spans, tag, start, end)

    # administration
    def export(self, signal: str = "logs", **options) -> DataFrame:
        table, make = {"logs": (self.logs, otlp_encode.export_logs), "spans": (self.spans, otlp_encode.export_spans), "metrics": (self.metrics, otlp_encode.export_metrics)}[signal]
        return make(table, **options)

    def export_all(self, signal: str = "logs") -> DataFrame:
        """All records of a signal as requests, without the bound of one export."""
        return otlp_encode.encode_all({"logs": self.logs, "spans": self.spans, "metrics": self.metrics}[signal], signal)

    @staticmethod
    def respond(call, *args, **kwargs) -> dict:
        """A call's response, or the body of its error."""
        try:
            return call(*args, **kwargs)
        except QueryError as e:
            return e.body()
