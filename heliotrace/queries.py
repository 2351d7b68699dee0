"""The catalogue: every operator as a query over the test tables, with independent SQL for comparison.

The SQL is written from the operators' definitions: where the plans deal samples to grid points by
arithmetic, the SQL joins samples and points by time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotrace import views as V
from heliotrace.functions import semantics as S
from heliotrace.operators import admission, discovery, logs, metrics, traces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
T0, DAY, HOUR, MINUTE = V.T0, V.DAY, V.HOUR, 60 * 10**9
LOG_COLUMNS = "timestamp_nanos, seq, app, level, body"


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _log_rows(df: DataFrame) -> DataFrame:
    return df.select("timestamp_nanos", "seq", F.element_at("stream", F.lit("app")).alias("app"), F.element_at("stream", F.lit("level")).alias("level"), "body")


def _logs(name: str, text: str, where: str, *, logfmt: bool = False) -> None:
    """All records of a log query."""
    from heliotrace.plans.logql import parse

    _add(name, lambda spark, d: _log_rows(logs.run_pipeline(V.logs(spark, d, logfmt=logfmt), parse(text))), f"SELECT {LOG_COLUMNS} FROM (SELECT *, {V.SQL_LOGFMT_BODY if logfmt else V.SQL_JSON_BODY} AS body FROM ({V.SQL_LOGS})) WHERE {where}")


def _text(name: str, text: str, where: str) -> None:
    from heliotrace.plans.logql import parse

    _add(name, lambda spark, d: _log_rows(logs.run_pipeline(V.textlogs(spark, d), parse(text))).select("seq", "app", "level"), f"SELECT doc_id AS seq, source AS app, lang AS level FROM documents WHERE {where}")


_logs("log_eq", '{app="app-1"}', "app = 'app-1'")
_logs("log_neq_absent", '{app="app-2", missing!="x", level!="info"}', "app = 'app-2' AND level <> 'info'")
_logs("log_regex_anchored", '{app=~"app-[12]", service_name=~"pur.*|err", level!~"err"}', "app IN ('app-1', 'app-2') AND regexp_full_match(service_name, 'pur.*|err') AND NOT regexp_full_match(level, 'err')")
_logs("log_contains", '{app=~".+"} |= "\\"k\\": 7" != "click"', "contains(body, '\"k\": 7') AND NOT contains(body, 'click')")
_logs("log_json_field", '{app=~"app-.*"} | json | event="purchase"', "service_name = 'purchase'")
_logs("log_json_number", '{app=~"app-.*"} |= "user" | json | k=~"1.", user!="3"', "regexp_full_match(k, '1.') AND \"user\" <> '3'")
_logs("log_logfmt_field", '{app="app-3"} | logfmt | event=~"view|click" and user!~"1.*"', "app = 'app-3' AND service_name IN ('view', 'click') AND NOT regexp_full_match(\"user\", '1.*')", logfmt=True)
_logs("log_and_or", '{app=~".+"} | level="error" and k="5" or service_name="view" and k="6"', "(level = 'error' AND k = '5') OR (service_name = 'view' AND k = '6')")
_logs("log_attr_relaxed", '{app=~".+"} | user_id="17"', "\"user\" = '17'")
_text("log_not_contains", '{app=~"src.*"} != "the" |= "de"', "NOT contains(text, 'the') AND contains(text, 'de')")
_text("log_line_regex", '{app=~"src1.*", level="en"} |~ "\\\\b[Oo]nan\\\\w+" !~ "(?i)apache"', r"starts_with(source, 'src1') AND lang = 'en' AND regexp_matches(text, '(^|[^\pL\pN_])[Oo]nan[\pL\pN_]+') AND NOT regexp_matches(text, '(?i)apache')")

for _name, _forward in (("log_topk_backward", False), ("log_topk_forward", True)):
    _add(
        _name,
        lambda spark, d, f=_forward: _log_rows(logs.query_range(V.logs(spark, d), '{app="app-1"} |= "purchase"', limit=100, forward=f)),
        f"SELECT {LOG_COLUMNS} FROM (SELECT *, {V.SQL_JSON_BODY} AS body FROM ({V.SQL_LOGS})) WHERE app = 'app-1' AND contains(body, 'purchase') ORDER BY timestamp_nanos {'' if _forward else 'DESC'}, seq {'' if _forward else 'DESC'} LIMIT 100",
    )
_add(
    "log_time_inclusive",
    lambda spark, d: _log_rows(logs.in_range(V.textlogs(spark, d), T0 + 10 * 10**9, T0 + 20 * 10**9)).select("timestamp_nanos", "seq", "app"),
    f"SELECT {T0} + doc_id * 1000000000 AS timestamp_nanos, doc_id AS seq, source AS app FROM documents WHERE doc_id BETWEEN 10 AND 20",
)
_add(
    "log_stream_groups",
    lambda spark, d: logs.group_streams(logs.query_range(V.logs(spark, d), '{level="error"}', limit=500)).select(F.element_at("stream", F.lit("app")).alias("app"), F.size("values").cast("long").alias("n"), F.element_at("values", 1)["seq"].alias("newest")),
    f"SELECT app, count(*) AS n, arg_max(seq, timestamp_nanos) AS newest FROM (SELECT * FROM ({V.SQL_LOGS}) WHERE level = 'error' ORDER BY timestamp_nanos DESC, seq DESC LIMIT 500) GROUP BY app",
)
_add("log_label_names", lambda spark, d: discovery.label_names(V.logs(spark, d)), "SELECT * FROM (VALUES ('app'), ('level'), ('service_name')) t(name)")
_add("log_label_values", lambda spark, d: discovery.label_values(V.logs(spark, d), "app", T0 + 5 * DAY, T0 + 6 * DAY), f"SELECT DISTINCT app AS value FROM ({V.SQL_LOGS}) WHERE timestamp_nanos BETWEEN {T0 + 5 * DAY} AND {T0 + 6 * DAY}")
_add(
    "log_series",
    lambda spark, d: discovery.series(V.logs(spark, d), ['{app="app-1"}', '{level="warn"}']).select(*[F.element_at("stream", F.lit(n)).alias(n) for n in ("app", "level", "service_name")]),
    f"SELECT DISTINCT app, level, service_name FROM ({V.SQL_LOGS}) WHERE app = 'app-1' OR level = 'warn'",
)
_add("streams_table", lambda spark, d: discovery.streams(V.logs(spark, d)).select(F.element_at("stream", F.lit("app")).alias("app"), F.element_at("stream", F.lit("service_name")).alias("service_name"), "first_nanos", "last_nanos", "records"), f"SELECT app, service_name, min(timestamp_nanos) AS first_nanos, max(timestamp_nanos) AS last_nanos, count(*) AS records FROM ({V.SQL_LOGS}) GROUP BY 1, 2")
_add(
    "usage_by_app",
    lambda spark, d: discovery.usage(V.logs(spark, d), 1_000_000),
    f"SELECT app, count(*) AS records, count(DISTINCT (level, service_name)) AS series, CAST(floor(1000000 * count(*) / sum(count(*)) OVER ()) AS BIGINT) AS bytes FROM ({V.SQL_LOGS}) GROUP BY app",
)

# metrics ---------------------------------------------------------------------------------------

START, END = T0, T0 + 30 * DAY + 17 * MINUTE  # the end is off the grid
GAUGE, COUNTER, HISTOGRAM = (V.gauge, V.SQL_GAUGE, "event_type"), (V.counter, V.SQL_COUNTER, "event_type"), (V.histogram, V.SQL_HISTOGRAM, "le")


def _grid(step: int, start: int = START, end: int = END) -> str:
    return f"(SELECT unnest(range({start}, {end} + 1, {step})) AS t UNION SELECT {end})"


def _at(source, grid: str, *, window: int = 300 * 10**9, offset: int = 0, where: str = "true") -> str:
    """Newest sample of each series at each point."""
    return f"(SELECT t, app, {source[2]} AS other, arg_max(value, (timestamp_nanos, seq)) AS value FROM {grid} g JOIN ({source[1]}) s ON timestamp_nanos > t - {offset} - {window} AND timestamp_nanos <= t - {offset} WHERE {where} GROUP BY ALL)"


def _rates(source, grid: str, window: int, *, where: str = "true", offset: int = 0) -> str:
    rows = f"SELECT t, app, {source[2]} AS other, value, timestamp_nanos, lag(value) OVER (PARTITION BY t, app, {source[2]} ORDER BY timestamp_nanos, seq) AS before FROM {grid} g JOIN ({source[1]}) s ON timestamp_nanos > t - {offset} - {window} AND timestamp_nanos <= t - {offset} WHERE {where}"
    return f"(SELECT t, app, other, sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) / ((max(timestamp_nanos) - min(timestamp_nanos)) / 1e9) AS value FROM ({rows}) GROUP BY t, app, other HAVING count(*) >= 2 AND max(timestamp_nanos) > min(timestamp_nanos))"


def _range(name: str, source, text: str, step: int, sql: str, labels: tuple[str, ...] = ("app", "event_type")) -> None:
    """A range query; ``sql`` gives t, the labels and value."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = metrics.query_range(source[0](spark, d), text, START, END, step)
        return df.select("timestamp_nanos", *[S.label(F.col("labels"), n).alias(n) for n in labels], F.round("value", 6).alias("value"))

    names = ", ".join((["app"] if "app" in labels else []) + [f"other AS {n}" for n in labels if n != "app"])
    _add(name, run, f"SELECT CAST(t AS BIGINT) AS timestamp_nanos{', ' + names if names else ''}, round(CAST(value AS DOUBLE), 6) AS value FROM {sql}")


def _instant(name: str, source, text: str, at: int, sql: str, labels: tuple[str, ...] = ("app", "event_type")) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = metrics.instant(source[0](spark, d), text, at)
        return df.select(*[S.label(F.col("labels"), n).alias(n) for n in labels], F.round("value", 6).alias("value"))

    names = "".join(f"{'app' if n == 'app' else f'other AS {n}'}, " for n in labels)
    _add(name, run, f"SELECT {names}round(CAST(value AS DOUBLE), 6) AS value FROM {sql}")


_H = _grid(HOUR)
_D6 = _grid(6 * HOUR)
_NOW = T0 + 10 * DAY
_ONE = f"(SELECT {_NOW} AS t)"
_instant("prom_instant", GAUGE, 'event_value{app=~"app-.*"}', _NOW, _at(GAUGE, _ONE))
_range("prom_stale_lookback", GAUGE, "event_value", HOUR, _at(GAUGE, _H))
_range("prom_offset", GAUGE, 'event_value{app!="app-0"} offset 3h', HOUR, _at(GAUGE, _H, offset=3 * HOUR, where="app <> 'app-0'"))
_instant("prom_rate", COUNTER, "rate(events_total[2d])", _NOW, _rates(COUNTER, _ONE, 2 * DAY))
_instant("prom_increase", COUNTER, "increase(events_total[36h])", _NOW, f"(SELECT t, app, other, value * {36 * 3600} AS value FROM {_rates(COUNTER, _ONE, 36 * HOUR)})")
_range("prom_rate_range_grid", COUNTER, "rate(events_total[12h])", 6 * HOUR, _rates(COUNTER, _D6, 12 * HOUR))
_range("prom_rate_offset", COUNTER, 'rate(events_total{event_type="click"}[1d] offset 1d)', 6 * HOUR, _rates(COUNTER, _D6, DAY, offset=DAY, where="event_type = 'click'"))
_range("prom_sum_by", COUNTER, "sum by (app) (rate(events_total[1d]))", 6 * HOUR, f"(SELECT t, app, sum(value) AS value FROM {_rates(COUNTER, _D6, DAY)} GROUP BY t, app)", ("app",))
_range("prom_sum_without", COUNTER, "sum(increase(events_total[1d])) without (app)", 6 * HOUR, f"(SELECT t, other, sum(value) * 86400 AS value FROM {_rates(COUNTER, _D6, DAY)} GROUP BY t, other)", ("event_type",))
for _op in ("avg", "min", "max", "count"):
    _range(f"prom_{_op}", GAUGE, f"{_op}(event_value)", HOUR, f"(SELECT t, {_op}(value) AS value FROM {_at(GAUGE, _H)} GROUP BY t)", ())
_range("prom_scalar_arith", GAUGE, "(event_value * 2 + 1) / 4 - 2 ^ 3 % 5", HOUR, f"(SELECT t, app, other, (value * 2 + 1) / 4 - 8 % 5 AS value FROM {_at(GAUGE, _H)})")
_range("prom_divide_zero", GAUGE, "0 * event_value / 0", 6 * HOUR, f"(SELECT t, app, other, 'nan'::DOUBLE AS value FROM {_at(GAUGE, _D6)})")
_range("prom_vector_arith", COUNTER, "rate(events_total[1d]) / rate(events_total[2d])", 6 * HOUR, f"(SELECT a.t, a.app, a.other, CASE WHEN b.value = 0 THEN CASE WHEN a.value = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE a.value / b.value END AS value FROM {_rates(COUNTER, _D6, DAY)} a JOIN {_rates(COUNTER, _D6, 2 * DAY)} b ON a.t = b.t AND a.app = b.app AND a.other = b.other)")
_range("prom_or", GAUGE, 'event_value{event_type="click"} or event_value offset 1h', HOUR, f"(WITH a AS {_at(GAUGE, _H, where=chr(34) + 'event_type' + chr(34) + ' = ' + chr(39) + 'click' + chr(39))}, b AS {_at(GAUGE, _H, offset=HOUR)} SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.t = b.t AND a.app = b.app AND a.other = b.other))")
_range("prom_counter_increase_form", COUNTER, "clamp_min(events_total - (events_total offset 5m or events_total * 0), 0)", HOUR, f"(SELECT a.t, a.app, a.other, greatest(a.value - coalesce(b.value, 0), 0) AS value FROM {_at(COUNTER, _H)} a LEFT JOIN {_at(COUNTER, _H, offset=300 * 10**9)} b ON a.t = b.t AND a.app = b.app AND a.other = b.other)")
_range("prom_clamp", GAUGE, "clamp_max(clamp_min(event_value, 20), 60)", HOUR, f"(SELECT t, app, other, least(greatest(value, 20), 60) AS value FROM {_at(GAUGE, _H)})")
_range("prom_abs_neg", GAUGE, "abs(-event_value) - -1", HOUR, f"(SELECT t, app, other, abs(-value) + 1 AS value FROM {_at(GAUGE, _H)})")
_range(
    "prom_hist_quantile", HISTOGRAM, "histogram_quantile(0.9, event_value_bucket)", 6 * HOUR,
    f"""(WITH v AS (SELECT t, app, CASE other WHEN '+Inf' THEN 'inf' ELSE other END::DOUBLE AS bound, value FROM {_at(HISTOGRAM, _D6)}),
w AS (SELECT *, lag(bound, 1, 0.0) OVER p AS low, lag(value, 1, 0.0) OVER p AS low_count, max(value) OVER (PARTITION BY t, app) * 0.9::DOUBLE AS wanted, lag(value) OVER p AS before FROM v WINDOW p AS (PARTITION BY t, app ORDER BY bound)),
h AS (SELECT *, row_number() OVER (PARTITION BY t, app ORDER BY bound) AS i FROM w WHERE value >= wanted AND wanted > 0)
SELECT t, app, CASE WHEN bound = 'inf'::DOUBLE THEN low WHEN value - low_count <= 0 THEN bound ELSE low + (bound - low) * (wanted - low_count) / (value - low_count) END AS value FROM h WHERE i = 1)""", ("app",),
)
_add("prom_number", lambda spark, d: metrics.instant(V.gauge(spark, d), "1 + 2 * 3", _NOW).select("value"), "SELECT 7.0::DOUBLE AS value")
_add("prom_series", lambda spark, d: discovery.series(V.gauge(spark, d), ['{__name__="event_value", app="app-1"}'], column="labels").select(*[F.element_at("labels", F.lit(n)).alias(n) for n in ("app", "event_type")]), f"SELECT DISTINCT app, event_type FROM ({V.SQL_GAUGE}) WHERE app = 'app-1'")

# traces ----------------------------------------------------------------------------------------


def _spans(name: str, text: str, where: str, **bounds: int) -> None:
    _add(name, lambda spark, d: traces.matching_spans(V.spans(spark, d), text, **bounds).select("trace_id", "span_id", "name", "status"), f"SELECT trace_id, span_id, name, status FROM ({V.SQL_SPANS}) WHERE {where}")


_spans("trace_status", '{ status = ERROR && name = "user" }', "status = 'error' AND name = 'user'")
_spans("trace_duration_filter", "{ duration > 300ms && duration <= 1s }", "size > 300 AND size <= 1000")
_spans("trace_min_max_duration", "{}", "size BETWEEN 100 AND 400", min_duration=100 * 10**6, max_duration=400 * 10**6)
_spans("trace_attr_numeric", "{ span.text_length >= 250 && .turn = 1 }", "size >= 250 AND turn = 1")
_spans("trace_nil", '{ resource.app = "svc-1" && .missing = nil && .turn != nil && .other != "x" }', "app = 'svc-1'")
_spans("trace_regex", '{ name =~ "ass.s" && resource.app != "svc-0" }', "regexp_matches(name, 'ass.s') AND app <> 'svc-0'")
_add(
    "trace_search",
    lambda spark, d: traces.search(V.spans(spark, d), '{ name = "assistant" }', limit=50).select("trace_id", "start_nanos", "end_nanos", "duration_ms", "root_service", "root_name", "matched", F.size("spans").cast("long").alias("n_spans")),
    f"SELECT trace_id, min(start_nanos) AS start_nanos, max(end_nanos) AS end_nanos, (max(end_nanos) - min(start_nanos)) // 1000000 AS duration_ms, arg_min(app, (parent_span_id IS NOT NULL, start_nanos, seq)) AS root_service, arg_min(name, (parent_span_id IS NOT NULL, start_nanos, seq)) AS root_name, count(*) AS matched, count(*) AS n_spans FROM ({V.SQL_SPANS}) WHERE name = 'assistant' GROUP BY trace_id ORDER BY start_nanos DESC, trace_id LIMIT 50",
)
_TRACE = "0000000000000000000000000000000B"
_add(
    "trace_by_id",
    lambda spark, d: traces.by_id(V.spans(spark, d), f" {_TRACE} ").select(F.element_at("stream", F.lit("app")).alias("app"), F.explode("spans").alias("s")).select("app", "s.span_id", "s.start_nanos", "s.status"),
    f"SELECT app, span_id, start_nanos, status FROM ({V.SQL_SPANS}) WHERE trace_id = lower('{_TRACE}')",
)
_add("trace_tags", lambda spark, d: traces.tags(V.spans(spark, d)), "SELECT * FROM (VALUES ('app'), ('text.length'), ('turn'), ('name'), ('status'), ('duration'), ('kind')) t(tag)")
_add("trace_tag_values", lambda spark, d: traces.tag_values(V.spans(spark, d), "span.turn"), f"SELECT DISTINCT CAST(turn AS VARCHAR) AS value FROM ({V.SQL_SPANS})")

# operations ------------------------------------------------------------------------------------


def _admission(spark: SparkSession, d: str) -> DataFrame:
    rows = V.logs(spark, d).select(F.element_at("stream", F.lit("app")).alias("app"), F.concat_ws("/", F.element_at("stream", F.lit("service_name")), F.element_at("attributes", F.lit("user.id"))).alias("series_key"), "seq")
    return admission.admit(rows, max_series=200, max_series_per_app=60)


_add(
    "admission_caps",
    _admission,
    f"""WITH s AS (SELECT app, service_name || '/' || "user" AS series_key, min(seq) AS first_seq FROM ({V.SQL_LOGS}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY first_seq) AS n FROM s),
a AS (SELECT *, count(*) FILTER (n <= 60) OVER (ORDER BY first_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM r)
SELECT app, series_key, first_seq, CASE WHEN used >= 200 THEN 'limits.max_series' WHEN n > 60 THEN 'limits.max_series_per_app' END AS reason FROM a""",
)


def _files(spark: SparkSession, d: str) -> DataFrame:
    day = F.expr(f"timestamp_nanos div {DAY}")
    return V.logs(spark, d).groupBy(day.alias("day")).agg(F.max("timestamp_nanos").alias("newest_nanos"), (F.count("*") * 100).alias("bytes")).select(F.lit("logs").alias("signal"), F.concat(F.lit("f"), F.col("day").cast("string")).alias("id"), "newest_nanos", "bytes")


_add(
    "retention_plan",
    lambda spark, d: admission.retention_plan(_files(spark, d), T0 + 30 * DAY, {"logs": 25 * DAY}, 200_000),
    f"""WITH f AS (SELECT 'f' || (timestamp_nanos // {DAY}) AS id, max(timestamp_nanos) AS newest, count(*) * 100 AS bytes FROM ({V.SQL_LOGS}) GROUP BY 1),
k AS (SELECT *, newest < {T0 + 5 * DAY} AS old FROM f),
b AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY newest, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(bytes) OVER () AS total FROM k WHERE NOT old)
SELECT 'logs' AS signal, id, 'age' AS reason FROM k WHERE old UNION ALL SELECT 'logs', id, 'budget' FROM b WHERE before < total - 200000""",
)


# sources and sinks -----------------------------------------------------------------------------


def _otlp_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from heliotrace.sources import otlp, otlp_encode

    requests = otlp_encode.encode_all(V.logs(spark, d), "logs")
    rows = otlp.accepted(otlp.decode_logs(requests.select("body")))
    return rows.select("timestamp_nanos", F.element_at("stream", F.lit("app")).alias("app"), "severity", F.element_at("stream", F.lit("service_name")).alias("service_name"), "body", F.element_at("attributes", F.lit("user.id")).alias("user_id"))


_add("otlp_roundtrip", _otlp_roundtrip, f"SELECT timestamp_nanos, app, level AS severity, service_name, {V.SQL_JSON_BODY} AS body, \"user\" AS user_id FROM ({V.SQL_LOGS})")


def _spans_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from heliotrace.sources import otlp, otlp_encode

    requests = otlp_encode.encode_all(V.spans(spark, d), "spans")
    return otlp.accepted(otlp.decode_traces(requests.select("body"))).select("trace_id", "span_id", "parent_span_id", "name", "kind", "start_nanos", "end_nanos", "status", F.element_at("stream", F.lit("app")).alias("app"))


_add("spans_roundtrip", _spans_roundtrip, f"SELECT trace_id, span_id, parent_span_id, name, 'internal' AS kind, start_nanos, end_nanos, status, app FROM ({V.SQL_SPANS})")


def _metrics_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from heliotrace.sources import otlp, otlp_encode

    requests = otlp_encode.encode_all(V.counter(spark, d).withColumn("kind", F.lit("counter")), "metrics")
    return otlp.accepted(otlp.decode_metrics(requests.select("body"))).select("timestamp_nanos", *[F.element_at("labels", F.lit(n)).alias(n) for n in ("app", "event_type")], "value", "kind")


_add("metrics_roundtrip", _metrics_roundtrip, f"SELECT timestamp_nanos, app, event_type, value, 'counter' AS kind FROM ({V.SQL_COUNTER})")


def _remote_write(spark: SparkSession, d: str) -> DataFrame:
    from heliotrace.sources import otlp, remote_write

    rows = otlp.accepted(remote_write.decode(remote_write.encode(V.gauge(spark, d))))
    return rows.select("timestamp_nanos", *[F.element_at("labels", F.lit(n)).alias(n) for n in ("app", "event_type")], "value", "kind")


_add("remote_write_roundtrip", _remote_write, f"SELECT timestamp_nanos // 1000000 * 1000000 AS timestamp_nanos, app, event_type, value, 'gauge' AS kind FROM ({V.SQL_GAUGE})")


def _export(spark: SparkSession, d: str) -> DataFrame:
    from heliotrace.sources import otlp_encode

    return otlp_encode.export_logs(V.logs(spark, d)).select("batch", "records", "last_nanos")


_add("export_batches", _export, f"SELECT (n - 1) // 2000 AS batch, count(*) AS records, max(timestamp_nanos) AS last_nanos FROM (SELECT timestamp_nanos, row_number() OVER (ORDER BY timestamp_nanos, seq) AS n FROM ({V.SQL_LOGS})) WHERE n <= 50000 GROUP BY 1")


def _rejects(spark: SparkSession, d: str) -> DataFrame:
    """Spans of events, some without usable ids, as requests of one span each; and what is not JSON."""
    from heliotrace.sources import otlp

    e = V._events(spark, d)
    trace = F.when(F.col("user_id") % 7 == 0, F.lit("00000000")).otherwise(F.hex(F.col("seq") + 1))
    span = F.when(F.col("user_id") % 5 == 0, F.lit("not hex")).otherwise(F.hex(F.col("seq") + 1))
    body = F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":[]},"scopeSpans":[{"scope":{},"spans":[{"name":"n","traceId":"'), trace, F.lit('","spanId":"'), span, F.lit('","startTimeUnixNano":"'), F.col("timestamp_nanos").cast("string"), F.lit('"}]}]}]}'))
    body = F.when(F.col("user_id") % 11 == 0, F.lit("{broken")).otherwise(body)
    return otlp.rejected(otlp.decode_traces(e.select(body.alias("body"))))


_add(
    "rejects_by_reason", _rejects,
    "SELECT reason, count(*) AS records FROM (SELECT CASE WHEN user_id % 11 = 0 THEN 'invalid_request' WHEN user_id % 7 = 0 THEN 'invalid_trace_id' WHEN user_id % 5 = 0 THEN 'invalid_span_id' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY 1",
)


def _otlp_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of values by app as one request each, expanded to buckets, sum and count."""
    from heliotrace.sources import otlp

    e = V._events(spark, d)
    cut = lambda low, high: F.sum(F.when((F.col("value") > low) & (F.col("value") <= high), 1).otherwise(0)).cast("string")
    h = e.groupBy("app").agg(cut(float("-inf"), 10.0).alias("b0"), cut(10.0, 50.5).alias("b1"), cut(50.5, float("inf")).alias("b2"), F.count("*").cast("string").alias("n"))
    body = F.concat(F.lit('{"resourceMetrics":[{"resource":{"attributes":[{"key":"app","value":{"stringValue":"'), "app", F.lit(f'"}}}}]}},"scopeMetrics":[{{"scope":{{}},"metrics":[{{"name":"event.value","histogram":{{"dataPoints":[{{"timeUnixNano":"{T0}","count":"'), "n", F.lit('","sum":12.5,"bucketCounts":["'), "b0", F.lit('","'), "b1", F.lit('","'), "b2", F.lit('"],"explicitBounds":[10,50.5]}]}}]}]}]}'))
    rows = otlp.accepted(otlp.decode_metrics(h.select(body.alias("body"))))
    return rows.select(*[S.label(F.col("labels"), n).alias(n) for n in ("app", "le")], F.element_at("labels", F.lit("__name__")).alias("name"), "value", "kind")


_add(
    "otlp_histogram", _otlp_histogram,
    f"""WITH h AS (SELECT app, count(*) FILTER (value <= 10) AS b0, count(*) FILTER (value <= 50.5) AS b1, count(*) AS n FROM ({V.SQL_LOGS}) GROUP BY app)
SELECT app, le, 'event_value' || suffix AS name, v::DOUBLE AS value, 'histogram' AS kind FROM (
  SELECT app, '10' AS le, '_bucket' AS suffix, b0 AS v FROM h UNION ALL SELECT app, '50.5', '_bucket', b1 FROM h UNION ALL SELECT app, '+Inf', '_bucket', n FROM h
  UNION ALL SELECT app, '', '_sum', 12.5 FROM h UNION ALL SELECT app, '', '_count', n FROM h)""",
)


# what decoders make of odd input ---------------------------------------------------------------


def _log_requests(e: DataFrame, record: str, resource: str = "[]", scope: str = "{}") -> DataFrame:
    """One request with one record for each row; ``record``, ``resource`` and ``scope`` are SQL texts of JSON."""
    return e.select(F.expr(f"""concat('{{"resourceLogs":[{{"resource":{{"attributes":', {resource}, '}},"scopeLogs":[{{"scope":', {scope}, ',"logRecords":[', {record}, ']}}]}}]}}')""").alias("body"), F.lit(T0).alias("received_nanos"))


def _decoded(requests: DataFrame, **limits) -> DataFrame:
    from heliotrace.sources import otlp

    return otlp.decode_logs(requests, otlp.Limits(**limits))


_WORDS = ("TRC", " Verbose", "dbg", "inf", "notice", "wrn", "Severe", "crit", "panic", "informational", "emerg", "")
_add(
    "otlp_severity",
    lambda spark, d: _decoded(_log_requests(V._events(spark, d), f"""concat('{{"severityNumber":', CASE WHEN user_id % 3 = 0 THEN user_id % 30 ELSE 0 END, ',"severityText":"', element_at(array({', '.join(f"'{w}'" for w in _WORDS)}), CAST(user_id % {len(_WORDS)} AS INT) + 1), '"}}')""", "'[]'", "'{}'")).groupBy("severity", F.element_at("stream", F.lit("level")).alias("level")).agg(F.count("*").alias("n")),
    f"""WITH w AS (SELECT CASE WHEN user_id % 3 = 0 THEN user_id % 30 ELSE 0 END AS number, user_id % {len(_WORDS)} AS word FROM events),
s AS (SELECT CASE WHEN number BETWEEN 1 AND 24 THEN ['trace', 'debug', 'info', 'warn', 'error', 'fatal'][(number - 1) // 4 + 1] ELSE ['trace', 'trace', 'debug', 'info', 'info', 'warn', 'error', 'fatal', 'fatal', 'unknown', 'unknown', 'unknown'][word + 1] END AS severity FROM w)
SELECT severity, severity AS level, count(*) AS n FROM s GROUP BY severity""",
)
_BODY = """CASE user_id % 6 WHEN 0 THEN '{"stringValue":"s"}' WHEN 1 THEN '{"boolValue":true}' WHEN 2 THEN concat('{"intValue":"', user_id, '"}') WHEN 3 THEN concat('{"doubleValue":', user_id, '.0}') WHEN 4 THEN concat('{"arrayValue":{"values":[{"intValue":"', user_id, '"},{"stringValue":"x"}]}}') ELSE concat('{"kvlistValue":{"values":[{"key":"k","value":{"intValue":', user_id, '}}]}}') END"""
_add(
    "otlp_any_values",
    lambda spark, d: _decoded(_log_requests(V._events(spark, d), f"""concat('{{"body":', {_BODY}, ',"attributes":[{{"key":"a.b","value":{{"stringValue":"first"}}}},{{"key":"a.b","value":', {_BODY}, '}},{{"key":"none","value":{{}}}}]}}')""", "'[]'", "'{}'")).select("body", F.size("attributes").alias("attributes")).groupBy("body", "attributes").agg(F.count("*").alias("n")),
    """SELECT body, CAST(1 AS INTEGER) AS attributes, count(*) AS n FROM (SELECT CASE user_id % 6 WHEN 0 THEN 's' WHEN 1 THEN 'true' WHEN 2 THEN user_id::VARCHAR WHEN 3 THEN user_id::VARCHAR WHEN 4 THEN '[' || user_id || ',"x"]' ELSE '{"k":' || user_id || '}' END AS body FROM events) GROUP BY body""",
)
_UNIT = "element_at(array(1000000000, 1000000, 1000, 1, 0), CAST(user_id % 5 AS INT) + 1)"
_add(
    "otlp_times",
    lambda spark, d: _decoded(_log_requests(V._events(spark, d), f"""concat('{{"timeUnixNano":"', CASE WHEN user_id % 5 = 4 THEN user_id ELSE timestamp_nanos div 1000000000 * (1000000000 div {_UNIT}) END, '","observedTimeUnixNano":', CASE WHEN user_id % 2 = 0 THEN '"0"' ELSE '"{T0 + 5 * 10**9}"' END, '}}')""".replace("div element_at", "div greatest(1, element_at").replace("+ 1))", "+ 1)))"), "'[]'", "'{}'")).select("timestamp_nanos", "rescaled").groupBy("timestamp_nanos", "rescaled").agg(F.count("*").alias("n")),
    f"SELECT timestamp_nanos, rescaled, count(*) AS n FROM (SELECT CASE WHEN user_id % 5 < 4 THEN epoch_us(ts) // 1000000 * 1000000000 WHEN user_id % 2 = 1 THEN {T0 + 5 * 10**9} ELSE {T0} END AS timestamp_nanos, user_id % 5 < 3 AS rescaled FROM events) GROUP BY 1, 2",
)
_add(
    "otlp_limits",
    lambda spark, d: _decoded(
        _log_requests(V._events(spark, d), """concat('{"body":{"stringValue":"', repeat('é', CAST(user_id % 9 AS INT)), '"},"attributes":[', CASE WHEN user_id % 7 = 0 THEN '{"key":"a","value":{"intValue":1}},{"key":"b","value":{"intValue":1}},{"key":"c","value":{"intValue":1}}' ELSE '' END, ']}')""", """concat('[{"key":"service.name","value":{"stringValue":"', repeat('v', CAST(user_id % 13 AS INT)), '"}}]')""", "'{}'"),
        line_bytes=9, attributes=2, label_value=10,
    ).groupBy("reject_reason", F.when(F.col("reject_reason").isNull(), F.col("body")).alias("body")).agg(F.count("*").alias("n")),
    """SELECT reject_reason, CASE WHEN reject_reason IS NULL THEN body END AS body, count(*) AS n FROM (
  SELECT CASE WHEN user_id % 7 = 0 THEN 'too_many_attributes' WHEN user_id % 13 > 10 THEN 'label_value_too_long' END AS reject_reason, CASE WHEN user_id % 9 > 4 THEN 'éééé…[truncated]' ELSE repeat('é', user_id % 9) END AS body FROM events) GROUP BY 1, 2""",
)
_add(
    "otlp_labels",
    lambda spark, d: _decoded(_log_requests(V._events(spark, d), "'{}'", """concat('[{"key":"service.name","value":{"stringValue":"', event_type, '"}},{"key":"service-version","value":{"intValue":"', user_id % 3, '"}},{"key":"host.name","value":{"stringValue":"h"}}]')""", """CASE WHEN user_id % 2 = 0 THEN '{"name":"sc","attributes":[{"key":"app","value":{"stringValue":"from-scope"}}]}' ELSE '{}' END""")).groupBy(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("stream")))).alias("stream")).agg(F.count("*").alias("n")),
    """SELECT '{"app":"' || CASE WHEN user_id % 2 = 0 THEN 'from-scope' ELSE event_type END || '","level":"unknown"' || CASE WHEN user_id % 2 = 0 THEN ',"scope_name":"sc"' ELSE '' END || ',"service_name":"' || event_type || '","service_version":"' || user_id % 3 || '"}' AS stream, count(*) AS n FROM events GROUP BY 1""",
)


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    from heliotrace.sources import otlp

    return otlp.stamp(V.logs(spark, d), "sender").groupBy(F.element_at("stream", F.lit("app")).alias("app"), F.element_at("stream", F.lit("level")).alias("level")).agg(F.count("*").alias("n"))


_add("identity_stamp", _stamped, f"SELECT 'sender' AS app, level, count(*) AS n FROM ({V.SQL_LOGS}) GROUP BY level")


def _compressed(spark: SparkSession, d: str) -> DataFrame:
    """Requests as gzip, deflate, zstd and plain bodies, and one that is none of what it claims."""
    from heliotrace.sources import otlp, otlp_encode, wire

    def pack(batches):
        import gzip
        import zlib

        import pyarrow as pa
        import zstandard

        forms = {"gzip": gzip.compress, "deflate": zlib.compress, "zstd": zstandard.compress, "identity": bytes}
        for batch in batches:
            for k, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = list(forms)[k % 4]
                yield pa.RecordBatch.from_arrays([pa.array([forms[name](body.encode()), b"nope"], pa.binary()), pa.array([name, "gzip"]), pa.array([T0, T0], pa.int64())], names=["content", "encoding", "received_nanos"])

    requests = otlp_encode.encode_all(V.logs(spark, d), "logs", per_line=500).select("batch", "body").mapInArrow(pack, "content binary, encoding string, received_nanos bigint")
    rows = otlp.decode_logs(wire.bodies(requests)).where("reject_reason is null")
    return rows.groupBy(F.element_at("stream", F.lit("app")).alias("app")).agg(F.count("*").alias("n"), F.max("timestamp_nanos").alias("newest"))


_add("compressed_bodies", _compressed, f"SELECT app, count(*) AS n, max(timestamp_nanos) AS newest FROM ({V.SQL_LOGS}) GROUP BY app")


def _stream_pages(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a log source, one for each app and level, as records again."""
    from heliotrace.sources import transfer

    value = F.to_json(F.array(F.col("timestamp_nanos").cast("string"), "body"))
    pages = V.logs(spark, d).groupBy(F.to_json("stream").alias("stream")).agg(F.array_join(F.collect_list(value), ",").alias("values"))
    pages = pages.select(F.concat(F.lit('{"data":{"result":[{"stream":'), "stream", F.lit(',"values":['), "values", F.lit("]}]}}")).alias("body"))
    return transfer.decode_stream_pages(pages).select("timestamp_nanos", F.element_at("stream", F.lit("app")).alias("app"), "body")


_add("import_stream_pages", _stream_pages, f"SELECT timestamp_nanos, app, {V.SQL_JSON_BODY} AS body FROM ({V.SQL_LOGS})")


def _remote_read(spark: SparkSession, d: str) -> DataFrame:
    """A day of a remote series with a sample each minute, read by the hour."""
    from heliotrace.sources import remote_write, transfer, wire

    def post(body: bytes) -> bytes:
        (query,) = [{n: v for n, _, v in wire.fields(q)} for _, _, q in wire.fields(wire.snappy_decode(body))]
        return remote_write.encode_read_response([({"__name__": "up", "job": "j"}, [(t, t / 1000) for t in range(-(-query[1] // 60_000) * 60_000, query[2] + 1, 60_000)])])

    first = T0 // 10**6
    rows = transfer.pull_metrics(spark, post, first + 30_000, first + 86_400_000, [("__name__", "=", "up")])
    return rows.select("timestamp_nanos", "value", F.element_at("labels", F.lit("app")).alias("app"))


_add("remote_read_windows", _remote_read, f"SELECT t * 1000000000 AS timestamp_nanos, t::DOUBLE AS value, 'j' AS app FROM range({T0 // 10**9 + 60}, {T0 // 10**9 + 86_400 + 1}, 60) r(t)")


def _figures_of(spark: SparkSession, d: str) -> DataFrame:
    from heliotrace.operators import selfmetrics

    rows = selfmetrics.figures({"logs": V.logs(spark, d), "metrics": V.gauge(spark, d)}, max_series=10)
    return rows.select("name", S.label(F.col("labels"), "signal").alias("signal"), S.label(F.col("labels"), "app").alias("app"), "value")


_add(
    "self_figures", _figures_of,
    f"""WITH s AS (SELECT 'logs' AS signal, app, app || '/' || level || '/' || service_name AS series FROM ({V.SQL_LOGS}) UNION ALL SELECT 'metrics', app, app || '/' || event_type FROM ({V.SQL_GAUGE}))
SELECT 'heliotrace_records_appended_total' AS name, signal, '' AS app, count(*)::DOUBLE AS value FROM s GROUP BY signal UNION ALL SELECT 'heliotrace_series_active', signal, '', count(DISTINCT series)::DOUBLE FROM s GROUP BY signal
UNION ALL SELECT 'heliotrace_app_rows', signal, app, count(*)::DOUBLE FROM s GROUP BY signal, app UNION ALL SELECT 'heliotrace_app_series', signal, app, count(DISTINCT series)::DOUBLE FROM s GROUP BY signal, app UNION ALL SELECT 'heliotrace_series_limit', '', '', 10.0::DOUBLE""",
)


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    from heliotrace.streaming import ingest

    rows = ingest.rollup(V.gauge(spark, d), "6 hours").withColumn("series", F.regexp_extract("series", r'"app","value":"([^"]*)"', 1))
    return rows.groupBy(F.unix_micros("start").alias("start_micros"), F.col("series").alias("app")).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


_add("metric_rollup", _rollup, f"SELECT timestamp_nanos // {6 * HOUR} * {6 * HOUR // 1000} AS start_micros, app, count(*) AS n, min(value) AS least, max(value) AS greatest FROM ({V.SQL_GAUGE}) GROUP BY 1, 2")


# two metrics with the same labels: the first by name is what a right side matches with
def _two(spark: SparkSession, d: str) -> DataFrame:
    own = V.gauge(spark, d)
    return own.unionByName(own.withColumn("labels", S.merge(F.col("labels"), F.create_map(F.lit("__name__"), F.lit("a_value")))).withColumn("value", F.col("value") * 10))


_TWO = (_two, V.SQL_GAUGE, "event_type")
_range("prom_duplicate_labels", _TWO, '{event_type="click"} - {event_type="click"}', 6 * HOUR, f"(SELECT t, app, other, unnest([value * 10, value]) - value * 10 AS value FROM {_at(GAUGE, _D6, where=chr(34) + 'event_type' + chr(34) + ' = ' + chr(39) + 'click' + chr(39))})")
_range("prom_or_duplicates", _TWO, 'event_value{event_type="click"} or {event_type=~"click|view"}', 6 * HOUR, f"(SELECT t, app, other, CASE other WHEN 'click' THEN value ELSE value * 10 END AS value FROM {_at(GAUGE, _D6)} WHERE other IN ('click', 'view'))")
