"""OTLP JSON requests as rows of logs, spans and samples, with a reason on each refused record.

A source is any DataFrame with a column ``body`` (one request as JSON text each); the decoders are
plain projections, so the same code serves batch and streaming reads. Records that cannot be kept
come back with ``reject_reason`` set: split them off with :func:`accepted` and :func:`rejected`.
A request that is not JSON of the expected shape is refused as a whole (``invalid_request``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotrace.functions import semantics as S
from heliotrace.schema import STREAM_LABELS
from heliotrace.sources import anyvalue as A

SEVERITIES = ("trace", "debug", "info", "warn", "error", "fatal")
SEVERITY_WORDS = {  # fixed values: text -> severity
    "trace": "trace", "trc": "trace", "verbose": "trace", "debug": "debug", "dbg": "debug", "info": "info", "information": "info", "inf": "info", "notice": "info", "warn": "warn", "warning": "warn", "wrn": "warn",
    "error": "error", "err": "error", "severe": "error", "fatal": "fatal", "critical": "fatal", "crit": "fatal", "alert": "fatal", "emergency": "fatal", "panic": "fatal",
}
SPAN_KINDS = {f"SPAN_KIND_{k}": i for i, k in enumerate(("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"))}
STATUS_CODES = {"STATUS_CODE_UNSET": 0, "STATUS_CODE_OK": 1, "STATUS_CODE_ERROR": 2}
TRUNCATED = "…[truncated]"


@dataclass(frozen=True)
class Limits:
    labels: int = 60
    label_name: int = 128
    label_value: int = 2_048
    attributes: int = 128
    line_bytes: int = 256 << 10
    truncate: bool = True
    stream_labels: tuple[str, ...] = STREAM_LABELS


_LOG = f"array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:string,severityText:string,body:{A.ANY},attributes:{A.ATTRIBUTES},traceId:string,spanId:string>>"
LOGS = f"resourceLogs array<struct<resource:{A.RESOURCE},scopeLogs:array<struct<scope:{A.SCOPE},logRecords:{_LOG}>>>>"
_EVENT = f"array<struct<timeUnixNano:string,name:string,attributes:{A.ATTRIBUTES}>>"
_SPAN = f"array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{A.ATTRIBUTES},events:{_EVENT},status:struct<code:string,message:string>>>"
TRACES = f"resourceSpans array<struct<resource:{A.RESOURCE},scopeSpans:array<struct<scope:{A.SCOPE},spans:{_SPAN}>>>>"
_POINT = f"struct<attributes:{A.ATTRIBUTES},timeUnixNano:string,startTimeUnixNano:string,asDouble:string,asInt:string>"
_HISTOGRAM = f"struct<attributes:{A.ATTRIBUTES},timeUnixNano:string,count:string,sum:string,bucketCounts:array<string>,explicitBounds:array<double>>"
_METRIC = f"array<struct<name:string,gauge:struct<dataPoints:array<{_POINT}>>,sum:struct<dataPoints:array<{_POINT}>,isMonotonic:boolean>,histogram:struct<dataPoints:array<{_HISTOGRAM}>>,summary:struct<dataPoints:array<struct<timeUnixNano:string>>>,exponentialHistogram:struct<dataPoints:array<struct<timeUnixNano:string>>>>>"
METRICS = f"resourceMetrics array<struct<resource:{A.RESOURCE},scopeMetrics:array<struct<scope:{A.SCOPE},metrics:{_METRIC}>>>>"


def _leaves(df: DataFrame, schema: str, top: str, middle: str, leaf: str, name: str, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(received_nanos, bad, what ``prepare`` makes of resource and scope, leaf): the records of all requests, and one row for a request that is not of the shape.

    Each request is parsed once: nothing is asked of the parsed column but its arrays. Labels of
    resource and scope are made once for all records of a scope, before these are dealt out.
    """
    received = F.col("received_nanos") if "received_nanos" in df.columns else F.unix_micros(F.current_timestamp()) * 1000
    parsed = F.from_json("body", schema + ", `__corrupt` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    rows = df.select(received.alias("received_nanos"), F.explode(F.array(parsed)).alias("r"))
    bad = F.col("r").isNull() | F.col("r.__corrupt").isNotNull()
    rows = rows.select("received_nanos", bad.alias("bad"), F.explode_outer(F.when(~bad, F.col(f"r.{top}"))).alias("res"))
    rows = rows.select("received_nanos", "bad", "res.resource", F.explode_outer(f"res.{middle}").alias("sc"))
    rows = prepare(rows.select("received_nanos", "bad", "resource", "sc.scope", F.col(f"sc.{leaf}").alias("__leaves")))
    rows = rows.select(*[c for c in rows.columns if c != "__leaves"], F.explode_outer("__leaves").alias(name))
    return rows.where(F.col("bad") | F.col(name).isNotNull())


def _refused(rows: DataFrame) -> DataFrame:
    """Rows of bad requests keep nothing but their reason, which comes before all others."""
    return rows.select(*[F.when(F.col("bad"), "invalid_request").otherwise(F.col(c)).alias(c) if c == "reject_reason" else F.when(~F.col("bad"), F.col(c)).alias(c) for c in rows.columns if c != "bad"])


def _found_labels(rows: DataFrame, scope_name: bool) -> DataFrame:
    """Adds ``found``, the labels of resource and scope (scope wins), and ``app``, which is never missing.

    Each step is a projection of its own: joining maps names each of them twice, so one nested
    expression would grow with every step.
    """
    rows = rows.withColumn("of_resource", A.attributes(F.col("resource.attributes"), sanitised=True)).withColumn("of_scope", A.attributes(F.col("scope.attributes"), sanitised=True))
    rows = rows.withColumn("found", S.merge(F.col("of_resource"), F.col("of_scope")))
    if scope_name:
        own = F.when(F.length(F.coalesce("scope.name", F.lit(""))) > 0, F.create_map(F.lit("scope_name"), F.col("scope.name"))).otherwise(S.empty_map())
        rows = rows.withColumn("of_scope", own).withColumn("found", S.merge(F.col("found"), F.col("of_scope")))
    return rows.withColumn("app", F.coalesce(F.element_at("found", F.lit("app")), F.element_at("found", F.lit("service_name")), F.lit("unknown"))).drop("of_resource", "of_scope", "resource", "scope")


def _with_stream(rows: DataFrame, limits: Limits, level: bool) -> DataFrame:
    """Adds ``stream``: the promoted labels and the app; where records bring a ``level``, no other label has that name."""
    rows = _found_labels(rows, True)
    kept = [n for n in (*limits.stream_labels, "scope_name") if n != "app" and not (level and n == "level")]
    return rows.withColumn("stream", F.map_concat(S.keep_labels(F.col("found"), kept), F.create_map(F.lit("app"), F.col("app")))).drop("found", "app")


def _label_fault(limits: Limits, labels: Column, *, lengths: bool = True) -> Column:
    fault = F.when(F.size(labels) > limits.labels, "too_many_labels")
    if lengths:
        fault = fault.when(F.exists(F.map_keys(labels), lambda k: F.octet_length(k) > limits.label_name), "label_name_too_long")
        fault = fault.when(F.exists(F.map_values(labels), lambda v: F.octet_length(v) > limits.label_value), "label_value_too_long")
    return fault


def severity(number: Column, text: Column) -> Column:
    """Four numbers to each severity, else the text's word, else unknown."""
    by_number = F.when((number >= 1) & (number <= 24), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.least(F.floor((number - 1) / 4) + 1, F.lit(6)).cast("int")))
    words = F.create_map(*[F.lit(x) for pair in SEVERITY_WORDS.items() for x in pair])
    return F.coalesce(by_number, F.element_at(words, F.lower(F.trim(text))), F.lit("unknown"))


def cap_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes."""
    head = F.substring(text.cast("binary"), 1, most)
    # a cut character leaves up to three bytes that do not decode: drop them
    tries = [F.substring(head, 1, most - n) for n in range(4)]
    return F.coalesce(*[F.when(F.is_valid_utf8(t.cast("string")), t.cast("string")) for t in tries])


def decode_logs(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(timestamp_nanos, seq, stream, severity, severity_text, body, attributes, trace_id, span_id, rescaled, reject_reason)."""
    rows = _leaves(requests, LOGS, "resourceLogs", "scopeLogs", "logRecords", "rec", lambda df: _with_stream(df, limits, True))
    rows = rows.withColumn("list_body", F.struct("rec.body.arrayValue", "rec.body.kvlistValue"))
    rows = rows.withColumn("level", severity(A.enum(F.col("rec.severityNumber"), {}), F.col("rec.severityText")))
    rows = rows.withColumn("stream", F.map_concat("stream", F.create_map(F.lit("level"), F.col("level"))))
    time, observed = A.unsigned(F.col("rec.timeUnixNano")), A.unsigned(F.col("rec.observedTimeUnixNano"))
    body = F.coalesce(A.composites(F.col("list_body.arrayValue"), F.col("list_body.kvlistValue")), A.scalar_text(F.col("rec.body")), F.lit(""))
    rows = rows.select(
        F.coalesce(A.rescale(time), A.rescale(observed), F.col("received_nanos")).alias("timestamp_nanos"), F.monotonically_increasing_id().alias("seq"),
        "stream", F.col("level").alias("severity"), F.col("rec.severityText").alias("severity_text"), body.alias("body"),
        A.attributes(F.col("rec.attributes")).alias("attributes"), A.normalise_id(F.col("rec.traceId")).alias("trace_id"), A.normalise_id(F.col("rec.spanId")).alias("span_id"),
        F.coalesce(A.rescale(time) != time, F.lit(False)).alias("rescaled"), "bad",
    )
    long_line = F.octet_length("body") > limits.line_bytes
    reason = F.coalesce(F.when(long_line & F.lit(not limits.truncate), "line_too_long"), F.when(F.size("attributes") > limits.attributes, "too_many_attributes"), _label_fault(limits, F.col("stream")))
    rows = rows.withColumn("reject_reason", reason)
    if limits.truncate:
        rows = rows.withColumn("body", F.when(long_line, F.concat(cap_bytes(F.col("body"), limits.line_bytes), F.lit(TRUNCATED))).otherwise(F.col("body")))
    return _refused(rows)


def decode_traces(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    rows = _leaves(requests, TRACES, "resourceSpans", "scopeSpans", "spans", "s", lambda df: _with_stream(df, limits, False))
    start = F.coalesce(A.rescale(A.unsigned(F.col("s.startTimeUnixNano"))), F.col("received_nanos"))
    kind = F.get(F.array(*map(F.lit, ("unspecified", "internal", "server", "client", "producer", "consumer"))), F.coalesce(A.enum(F.col("s.kind"), SPAN_KINDS), F.lit(0)))
    status = F.get(F.array(*map(F.lit, ("unset", "ok", "error"))), F.coalesce(A.enum(F.col("s.status.code"), STATUS_CODES), F.lit(0)))
    events = F.transform(F.coalesce("s.events", F.array().cast(_EVENT)), lambda e: F.struct(A.unsigned(e["timeUnixNano"]).alias("time_nanos"), e["name"].alias("name"), A.attributes(e["attributes"]).alias("attributes")))
    rows = rows.select(
        A.normalise_id(F.col("s.traceId")).alias("trace_id"), A.normalise_id(F.col("s.spanId")).alias("span_id"), A.normalise_id(F.col("s.parentSpanId")).alias("parent_span_id"),
        F.coalesce("s.name", F.lit("")).alias("name"), F.coalesce(kind, F.lit("unspecified")).alias("kind"), start.alias("start_nanos"),
        F.coalesce(A.rescale(A.unsigned(F.col("s.endTimeUnixNano"))), start).alias("end_nanos"), F.coalesce(status, F.lit("unset")).alias("status"), F.col("s.status.message").alias("status_message"),
        F.monotonically_increasing_id().alias("seq"), "stream", A.attributes(F.col("s.attributes")).alias("attributes"), events.alias("events"), "bad",
    )
    reason = F.coalesce(F.when(F.col("trace_id").isNull(), "invalid_trace_id"), F.when(F.col("span_id").isNull(), "invalid_span_id"), F.when(F.size("attributes") > limits.attributes, "too_many_attributes"), _label_fault(limits, F.col("stream"), lengths=False))
    return _refused(rows.withColumn("reject_reason", reason))


def metric_name(name: Column) -> Column:
    """Characters outside the metric alphabet become ``_``; colons stay."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_:]", "_"), "^[0-9]", "_")


def bound_text(bound: Column) -> Column:
    """An upper bound as a label: +Inf, or the number without a trailing ``.0``."""
    return F.when(bound.isNull() | (bound == float("inf")), "+Inf").otherwise(F.regexp_replace(bound.cast("decimal(38,12)").cast("string"), r"\.?0+\z", ""))


def expand_histogram(counts: Column, bounds: Column) -> Column:
    """Cumulative (le, value) of per-bucket counts; the bucket without a bound is +Inf."""
    running = lambda i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0.0), lambda a, c: a + c)
    return F.transform(counts, lambda _, i: F.struct(bound_text(F.get(bounds, i)).alias("le"), running(i).alias("value")))


def decode_metrics(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(timestamp_nanos, seq, labels, value, kind, reject_reason): gauges, sums and histograms (as buckets, sum and count)."""
    base = F.map_concat(S.drop_labels(F.col("found"), ["app"]), F.create_map(F.lit("app"), F.col("app")))
    rows = _leaves(requests, METRICS, "resourceMetrics", "scopeMetrics", "metrics", "m", lambda df: _found_labels(df, False).withColumn("base", base).drop("found", "app"))
    rows = rows.select("received_nanos", "bad", "base", metric_name(F.col("m.name")).alias("name"), "m")
    value = lambda p: F.coalesce(p["asDouble"].try_cast("double"), A.signed(p["asInt"]).cast("double"), F.lit(0.0))
    point = "struct<t:string,a:" + A.ATTRIBUTES + ",suffix:string,le:string,value:double,kind:string>"
    empty = F.array().cast(f"array<{point}>")
    one = lambda p, suffix, le, v, kind: F.struct(p["timeUnixNano"].alias("t"), p["attributes"].alias("a"), F.lit(suffix).alias("suffix"), (le if le is not None else F.lit(None).cast("string")).alias("le"), v.alias("value"), kind.alias("kind"))
    plain = lambda points, kind: F.transform(F.coalesce(points, F.array().cast(f"array<{_POINT}>")), lambda p: one(p, "", None, value(p), kind))
    counts = lambda p: F.transform(p["bucketCounts"], lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0)))
    buckets = lambda p: F.coalesce(F.transform(expand_histogram(counts(p), p["explicitBounds"]), lambda b: one(p, "_bucket", b["le"], b["value"], F.lit("histogram"))), empty)
    ends = lambda p: F.array(one(p, "_sum", None, F.coalesce(p["sum"].try_cast("double"), F.lit(0.0)), F.lit("histogram")), one(p, "_count", None, F.coalesce(p["count"].try_cast("double"), F.lit(0.0)), F.lit("histogram")))
    histogram = F.flatten(F.transform(F.coalesce("m.histogram.dataPoints", F.array().cast(f"array<{_HISTOGRAM}>")), lambda p: F.concat(buckets(p), ends(p))))
    kind = F.when(F.coalesce("m.sum.isMonotonic", F.lit(False)), "counter").otherwise("gauge")
    points = F.concat(plain(F.col("m.gauge.dataPoints"), F.lit("gauge")), plain(F.col("m.sum.dataPoints"), kind), histogram)
    other = F.col("m.summary").isNotNull() | F.col("m.exponentialHistogram").isNotNull()
    rows = rows.withColumn("points", points).select("received_nanos", "bad", "base", "name", other.alias("other"), F.explode_outer("points").alias("p")).where("p is not null or other or bad")
    extra = F.when(F.col("p.le").isNotNull(), F.create_map(F.lit("le"), F.col("p.le"))).otherwise(S.empty_map())
    named = F.create_map(F.lit("__name__"), F.concat("name", F.coalesce("p.suffix", F.lit(""))))
    rows = rows.withColumn("own", A.attributes(F.col("p.a"), sanitised=True)).withColumn("own", S.merge(F.col("base"), F.col("own")))
    rows = rows.withColumn("fixed", F.map_concat(extra, named))
    rows = rows.select(
        F.coalesce(A.rescale(A.unsigned(F.col("p.t"))), F.col("received_nanos")).alias("timestamp_nanos"), F.monotonically_increasing_id().alias("seq"),
        S.merge(F.col("own"), F.col("fixed")).alias("labels"), F.col("p.value").alias("value"), F.coalesce("p.kind", F.lit("unknown")).alias("kind"), "other", "name", "bad",
    )
    reason = F.coalesce(F.when(F.col("other"), "unsupported_metric_type"), F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, "missing_metric_name"), _label_fault(limits, F.col("labels")))
    return _refused(rows.withColumn("reject_reason", reason).drop("other", "name"))


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where("reject_reason is null").drop("reject_reason")


def rejected(decoded: DataFrame) -> DataFrame:
    """(reason, records): why records were refused."""
    return decoded.where("reject_reason is not null").groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("records"))


def stamp(rows: DataFrame, app: str, column: str = "stream") -> DataFrame:
    """The sender's identity over whatever ``app`` its records claim."""
    return rows.withColumn(column, S.merge(F.col(column), F.create_map(F.lit("app"), F.lit(app))))
