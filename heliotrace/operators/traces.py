"""Trace search and assembly as DataFrame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotrace.errors import NotFound
from heliotrace.functions import semantics as S
from heliotrace.operators.logs import in_range
from heliotrace.plans import traceql

DEFAULT_LIMIT, MAX_LIMIT = 20, 1_000
EPSILON = 2.220446049250313e-16


def duration() -> Column:
    return F.greatest(F.col("end_nanos") - F.col("start_nanos"), F.lit(0).cast("long"))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def _text(value: Column, op: str, wanted) -> Column:
    """Text against text, number or nil; an absent value fits ``!=`` alone."""
    if wanted is None:
        return value.isNull() if op == "=" else value.isNotNull() if op == "!=" else F.lit(False)
    if op == "=~":
        return F.coalesce(S.search(value, wanted), F.lit(False))
    number = S.parse_number(value)
    if op in ("=", "!="):
        if isinstance(wanted, str):
            same = value == wanted
        else:
            same = (number == float(wanted)) | (F.abs(number - float(wanted)) < EPSILON)
        same = F.coalesce(same & value.isNotNull(), F.lit(False))
        return same if op == "=" else ~same
    other = F.lit(float(wanted)) if not isinstance(wanted, str) else S.parse_number(F.lit(wanted))
    return F.coalesce(_compare(number, op, other) & ~F.isnan(number) & ~F.isnan(other), F.lit(False))


def field(scope: str, name: str) -> Column:
    stream, attributes = F.col("stream"), F.col("attributes")
    if scope == "resource":
        return F.element_at(stream, F.lit(S.sanitize_name(name)))
    if scope == "span":
        return S.relaxed(attributes, name)
    return F.coalesce(S.relaxed(attributes, name), S.relaxed(stream, name))


def condition(c: traceql.Condition) -> Column:
    if c.scope != "intrinsic":
        return _text(field(c.scope, c.field), c.op, c.value)
    if c.field == "name":
        return _text(F.col("name"), c.op, c.value)
    if c.field == "duration":
        wanted = c.value if not isinstance(c.value, str) else None
        if wanted is None or c.op == "=~":
            return F.lit(False)
        return _compare(duration(), c.op, F.lit(wanted if isinstance(wanted, int) else float(wanted)))
    if c.op not in ("=", "!=") or not isinstance(c.value, str):
        return F.lit(False)
    return _compare(F.lower(c.field), c.op, F.lit(c.value.lower()))


def matching_spans(spans: DataFrame, text: str, start: int | None = None, end: int | None = None, *, min_duration: int | None = None, max_duration: int | None = None) -> DataFrame:
    """Spans that start in the range and fit all conditions; the bounds of duration are inside."""
    df = in_range(spans, start, end, "start_nanos")
    conditions = traceql.parse(text)
    if conditions:
        df = df.where(reduce(Column.__and__, map(condition, conditions)))
    if min_duration is not None:
        df = df.where(duration() >= min_duration)
    return df.where(duration() <= max_duration) if max_duration is not None else df


def search(spans: DataFrame, text: str, start: int | None = None, end: int | None = None, *, limit: int | None = None, min_duration: int | None = None, max_duration: int | None = None) -> DataFrame:
    """Traces with matching spans, latest first: times, root's service and name, the matched spans."""
    df = matching_spans(spans, text, start, end, min_duration=min_duration, max_duration=max_duration)
    service = F.coalesce(F.element_at("stream", F.lit("service_name")), F.element_at("stream", F.lit("app")), F.lit("unknown"))
    first = F.struct(F.col("parent_span_id").isNotNull().alias("child"), "start_nanos", "seq")
    span = F.struct("start_nanos", "seq", "span_id", "name", duration().alias("duration_nanos"))
    traces = df.groupBy("trace_id").agg(
        F.min("start_nanos").alias("start_nanos"), F.max("end_nanos").alias("end_nanos"), F.count("*").alias("matched"),
        F.min_by(F.struct(service.alias("service"), F.col("name").alias("name")), first).alias("root"), F.array_sort(F.collect_list(span)).alias("spans"),
    )
    traces = traces.select("trace_id", "start_nanos", "end_nanos", F.expr("greatest(end_nanos - start_nanos, 0L) div 1000000").alias("duration_ms"), F.col("root.service").alias("root_service"), F.col("root.name").alias("root_name"), "matched", "spans")
    return traces.orderBy(F.desc("start_nanos"), "trace_id").limit(min(DEFAULT_LIMIT if limit is None else limit, MAX_LIMIT))


def by_id(spans: DataFrame, trace_id: str) -> DataFrame:
    """All spans of a trace by resource, each resource's spans by start. An unknown id gives no rows."""
    own = spans.where(F.col("trace_id") == trace_id.strip().lower())
    span = F.struct("start_nanos", "seq", "span_id", "parent_span_id", "name", "kind", "end_nanos", "status")
    return own.groupBy(S.label_key(F.col("stream")).alias("resource")).agg(F.first("stream").alias("stream"), F.array_sort(F.collect_list(span)).alias("spans"))


def require(trace: DataFrame) -> DataFrame:
    if trace.isEmpty():
        raise NotFound("no such trace")
    return trace


def tags(spans: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Names that can be searched: stream labels, attributes and the intrinsics."""
    df = in_range(spans, start, end, "start_nanos")
    names = df.select(F.explode(F.array_union(F.map_keys("stream"), F.map_keys("attributes"))).alias("tag"))
    fixed = spans.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, traceql.INTRINSICS))).alias("tag"))
    return names.unionByName(fixed).distinct()


def tag_values(spans: DataFrame, tag: str, start: int | None = None, end: int | None = None) -> DataFrame:
    df = in_range(spans, start, end, "start_nanos")
    if tag in ("name", "status", "kind"):
        value = F.col(tag)
    else:
        for prefix in ("resource.", "span.", "."):
            if tag.startswith(prefix):
                tag = tag[len(prefix) :]
                break
        value = F.coalesce(S.relaxed(F.col("attributes"), tag), S.relaxed(F.col("stream"), tag))
    return df.select(value.alias("value")).where("value is not null").distinct()
