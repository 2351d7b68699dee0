"""Rows back to OTLP JSON: one request for each batch of records, grouped by stream; and batched export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotrace.errors import LimitExceeded
from heliotrace.functions import semantics as S

DOTTED = {  # fixed values: label -> attribute of the wire format
    "service_name": "service.name", "service_namespace": "service.namespace", "service_version": "service.version",
    "deployment_environment": "deployment.environment", "deployment_environment_name": "deployment.environment.name",
}
SEVERITY_NUMBER = {"trace": 1, "debug": 5, "info": 9, "warn": 13, "error": 17, "fatal": 21}
DEFAULT_EXPORT, MAX_EXPORT, RECORDS_PER_LINE = 50_000, 200_000, 2_000


def _key_values(labels: Column, rename: bool = False, drop: tuple[str, ...] = ()) -> Column:
    names = F.create_map(*[F.lit(x) for pair in DOTTED.items() for x in pair])
    entries = F.array_sort(F.map_entries(F.coalesce(labels, S.empty_map())))
    entries = F.filter(entries, lambda e: ~e["key"].isin(list(drop))) if drop else entries
    name = lambda k: F.coalesce(F.element_at(names, k), k) if rename else k
    return F.transform(entries, lambda e: F.struct(name(e["key"]).alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))


def _numbered(df: DataFrame, order: list[str], per_line: int) -> DataFrame:
    """Batches of records in order of time; an export is bounded by MAX_EXPORT, so one task can number it."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / per_line))


def _dealt(df: DataFrame, per_line: int) -> DataFrame:
    """Batches of records that stand behind each other in a task, without a shuffle and without a bound."""
    return df.withColumn("batch", F.floor(F.monotonically_increasing_id() / per_line))


def _oldest(df: DataFrame, time: str, after_nanos: int | None, limit: int, per_line: int) -> DataFrame:
    if not 0 < limit <= MAX_EXPORT:
        raise LimitExceeded(f"an export has 1 to {MAX_EXPORT} records")
    df = df if after_nanos is None else df.where(F.col(time) > after_nanos)
    return _numbered(df.orderBy(time, "seq").limit(limit), [time, "seq"], per_line)


def export_logs(logs: DataFrame, *, after_nanos: int | None = None, limit: int = DEFAULT_EXPORT, per_line: int = RECORDS_PER_LINE) -> DataFrame:
    """(batch, records, last_nanos, last_seq, body): the oldest ``limit`` records behind the cursor, as one request for each line."""
    return _log_requests(_oldest(logs, "timestamp_nanos", after_nanos, limit, per_line))


def export_spans(spans: DataFrame, *, after_nanos: int | None = None, limit: int = DEFAULT_EXPORT, per_line: int = RECORDS_PER_LINE) -> DataFrame:
    return _span_requests(_oldest(spans, "start_nanos", after_nanos, limit, per_line))


def export_metrics(samples: DataFrame, *, after_nanos: int | None = None, limit: int = DEFAULT_EXPORT, per_line: int = RECORDS_PER_LINE) -> DataFrame:
    """Samples as gauges and monotonic sums; labels other than the name are attributes of the point."""
    return _sample_requests(_oldest(samples, "timestamp_nanos", after_nanos, limit, per_line))


def encode_all(df: DataFrame, signal: str, *, per_line: int = RECORDS_PER_LINE) -> DataFrame:
    """All records of a signal (logs, spans or metrics) as requests; records of a request stood behind each other in the table."""
    return {"logs": _log_requests, "spans": _span_requests, "metrics": _sample_requests}[signal](_dealt(df, per_line))


def _log_requests(df: DataFrame) -> DataFrame:
    level = F.element_at("stream", F.lit("level"))
    numbers = F.create_map(*[F.lit(x) for pair in SEVERITY_NUMBER.items() for x in pair])
    record = F.struct(
        F.col("timestamp_nanos").cast("string").alias("timeUnixNano"), F.coalesce(F.element_at(numbers, level), F.lit(0)).alias("severityNumber"), level.alias("severityText"),
        F.struct(F.col("body").alias("stringValue")).alias("body"), _key_values(F.col("attributes")).alias("attributes"),
        *[F.col(c).alias(w) if c in df.columns else F.lit(None).cast("string").alias(w) for c, w in (("trace_id", "traceId"), ("span_id", "spanId"))],
    )
    return _requests(df.withColumn("__t", F.col("timestamp_nanos")), record, "resourceLogs", "scopeLogs", "logRecords", ("level", "scope_name"))


def _span_requests(df: DataFrame) -> DataFrame:
    code = F.when(F.col("status") == "error", 2).when(F.col("status") == "ok", 1).otherwise(0)
    kinds = F.create_map(*[F.lit(x) for pair in (("internal", 1), ("server", 2), ("client", 3), ("producer", 4), ("consumer", 5)) for x in pair])
    record = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", F.coalesce(F.element_at(kinds, F.col("kind")), F.lit(0)).alias("kind"),
        F.col("start_nanos").cast("string").alias("startTimeUnixNano"), F.col("end_nanos").cast("string").alias("endTimeUnixNano"), _key_values(F.col("attributes")).alias("attributes"), F.struct(code.alias("code")).alias("status"),
    )
    return _requests(df.withColumn("__t", F.col("start_nanos")), record, "resourceSpans", "scopeSpans", "spans", ("scope_name",))


def _sample_requests(df: DataFrame) -> DataFrame:
    point = F.struct(_key_values(F.col("labels"), drop=("__name__",)).alias("attributes"), F.col("timestamp_nanos").cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"))
    counter = F.col("kind") == "counter" if "kind" in df.columns else F.lit(False)
    record = F.struct(
        F.element_at("labels", F.lit("__name__")).alias("name"), F.when(~counter, F.struct(F.array(point).alias("dataPoints"))).alias("gauge"),
        F.when(counter, F.struct(F.array(point).alias("dataPoints"), F.lit(True).alias("isMonotonic"))).alias("sum"),
    )
    df = df.withColumn("__t", F.col("timestamp_nanos")).withColumn("stream", S.keep_labels(F.col("labels"), ["app"]))
    return _requests(df, record, "resourceMetrics", "scopeMetrics", "metrics", ())


def _requests(df: DataFrame, record: Column, top: str, middle: str, leaf: str, drop: tuple[str, ...]) -> DataFrame:
    grouped = df.groupBy("batch", S.label_key(F.col("stream")).alias("key")).agg(F.first("stream").alias("stream"), F.array_sort(F.collect_list(F.struct("__t", "seq", F.to_json(record).alias("r")))).alias("rows"), F.count("*").alias("n"), F.max(F.struct("__t", "seq")).alias("last"))
    # records are rendered one by one, since structs with maps have no order to sort by
    resource = F.to_json(F.struct(F.struct(_key_values(F.col("stream"), rename=True, drop=drop).alias("attributes")).alias("resource")))
    records = F.array_join(F.transform("rows", lambda x: x["r"]), ",")
    part = F.concat(F.expr("substring(__resource, 1, length(__resource) - 1)"), F.lit(f',"{middle}":[{{"{leaf}":['), records, F.lit("]}]}"))
    parts = grouped.withColumn("__resource", resource).select("batch", "key", "n", "last", part.alias("part"))
    lines = parts.groupBy("batch").agg(F.sum("n").alias("records"), F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("key", "part"))).alias("parts"))
    return lines.select("batch", "records", F.col("last.__t").alias("last_nanos"), F.col("last.seq").alias("last_seq"), F.concat(F.lit(f'{{"{top}":['), F.array_join(F.transform("parts", lambda x: x["part"]), ","), F.lit("]}")).alias("body"))
