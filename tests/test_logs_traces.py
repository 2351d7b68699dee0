"""Log pipelines, traces, discovery and administration on small tables."""

import pytest

from heliotrace.engine import Engine, log_time, step_of, trace_duration
from heliotrace.errors import BadRequest, NotFound
from heliotrace.functions.logfields import json_fields, logfmt_fields
from heliotrace.operators import admission, discovery, logs, traces
from heliotrace.plans import logql

LOG = "timestamp_nanos bigint, seq bigint, stream map<string,string>, body string, attributes map<string,string>"


@pytest.fixture
def table(spark):
    rows = [
        (1, 0, {"app": "a", "level": "info"}, '{"status": 200, "user": {"id": "u1", "tags": [1, 2]}, "gone": null}', {"http.method": "GET"}),
        (2, 1, {"app": "a", "level": "error"}, "not json at all", {}),
        (3, 2, {"app": "b", "level": "info"}, 'msg="say \\"hi\\"" code=7 flag', {"level": "attr"}),
        (3, 3, {"app": "b", "level": "info"}, "line\r\nend$", None),
    ]
    return spark.createDataFrame(rows, LOG)


@pytest.mark.parametrize(
    ("text", "seqs"),
    [
        ('{app="a"}', [0, 1]), ('{app=~"a|b", level!="error"}', [0, 2, 3]), ('{app=~"."} |= "not"', [1]), ('{app=~"."} != "json"', [0, 2, 3]), ('{app=~"."} |~ "^line.$"', []), ('{app=~"."} |~ "end\\\\$$"', [3]),
        ('{app="a"} | json | status="200"', [0]), ('{app="a"} | json | user_id="u1"', [0]), ('{app="a"} | json | user_tags="[1,2]"', [0]), ('{app="a"} | json | gone=""', [0, 1]), ('{app="a"} | json | status!="200"', [1]),
        ('{app="b"} | logfmt | code="7" and msg=~"say.*"', [2]), ('{app="b"} | logfmt | flag=""', [2, 3]), ('{app="a"} | http_method="GET"', [0]), ('{app="b"} | level="attr"', [2]), ('{app="a"} | status="200" | json', []),
        ('{app="a"} | json | status="200" or level="error"', [0, 1]), ('{nope="", app="a"}', [0, 1]),
    ],
)
def test_pipelines(table, text, seqs):
    assert sorted(r.seq for r in logs.run_pipeline(table, logql.parse(text)).collect()) == seqs


def test_order_and_limit(table):
    ask = lambda **k: [r.seq for r in logs.query_range(table, '{app=~"."}', **k).collect()]
    assert ask() == [3, 2, 1, 0] and ask(forward=True) == [0, 1, 2, 3] and ask(limit=2) == [3, 2]
    assert ask(start=2, end=2) == [1]
    with pytest.raises(BadRequest):
        ask(limit=0)
    assert logs.limit_of(10**9) == 5_000 and logs.limit_of(None) == 100
    plan = logs.query_range(table, '{app=~"."}')._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_fields():
    assert json_fields('{"a": {"b c": 1.5}, "x": true, "x2": "", "a_b_c": 2}') == {"a_b_c": "2", "x": "true", "x2": ""}
    assert json_fields("[1]") == json_fields("nope") == json_fields(None) == json_fields("[" * 5000) == {}
    assert logfmt_fields('a=1 b="two words" c d= e="open') == {"a": "1", "b": "two words", "c": "", "d": "", "e": "open"}


def test_engine_responses(spark, table):
    e = Engine(spark, logs=table)
    out = e.query_logs_json('{app="a"}', 0, 10)
    streams = {s["stream"]["level"]: s["values"] for s in out["data"]["result"]}
    assert streams["error"] == [["2", "not json at all"]]
    assert e.respond(e.query_logs_json, "rate(x[5m])")["error"]["code"] == "unsupported"
    assert sorted(r[0] for r in e.log_labels().collect()) == ["app", "level"]
    assert sorted(r[0] for r in e.log_label_values("app").collect()) == ["a", "b"]
    assert e.log_series(['{app="a"}']).count() == 2


SPAN = "trace_id string, span_id string, parent_span_id string, name string, kind string, start_nanos bigint, end_nanos bigint, status string, seq bigint, stream map<string,string>, attributes map<string,string>"


@pytest.fixture
def spans(spark):
    ms = 10**6
    rows = [
        ("aa", "1", None, "POST /checkout", "server", 100 * ms, 250 * ms, "error", 0, {"service_name": "shop", "app": "shop"}, {"http.status_code": "500"}),
        ("aa", "2", "1", "SELECT", "client", 110 * ms, 120 * ms, "unset", 1, {"app": "db"}, {"db.system": "mysql"}),
        ("bb", "3", "9", "GET /", "server", 300 * ms, 290 * ms, "ok", 2, {"app": "shop"}, {"http.status_code": "200"}),
    ]
    return spark.createDataFrame(rows, SPAN)


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("{}", "123"), ("{ status = error }", "1"), ("{ status != ERROR }", "23"), ("{ duration > 100ms }", "1"), ("{ duration < 1 }", "3"), ("{ span.http.status_code >= 500 }", "1"), ("{ .http_status_code = 200 }", "3"),
        ('{ resource.service.name = "shop" }', "1"), ('{ .app = "shop" && kind = server }', "13"), ("{ .db.system != nil }", "2"), ("{ .db.system = nil }", "13"), ('{ name =~ "checkout" }', "1"), ('{ .db.system != "x" }', "123"), ("{ status > ok }", ""),
    ],
)
def test_span_conditions(spans, text, ids):
    assert "".join(sorted(r.span_id for r in traces.matching_spans(spans, text).collect())) == ids


def test_trace_search_and_id(spark, spans):
    rows = traces.search(spans, "").collect()
    assert [(r.trace_id, r.root_service, r.root_name, r.matched, r.duration_ms) for r in rows] == [("bb", "shop", "GET /", 1, 0), ("aa", "shop", "POST /checkout", 2, 150)]
    assert traces.search(spans, "", limit=1).count() == 1
    e = Engine(spark, spans=spans)
    assert e.trace(" AA ").count() == 2
    with pytest.raises(NotFound):
        e.trace("cc")
    assert {r.tag for r in e.trace_tags().collect()} >= {"app", "db.system", "duration"}
    assert sorted(r.value for r in e.trace_tag_values(".http.status_code").collect()) == ["200", "500"]
    assert traces.matching_spans(spans, "{}", min_duration=trace_duration("10"), max_duration=trace_duration("1s")).count() == 2


def test_times():
    assert log_time("1750000000") == log_time("1750000000000") == log_time("1750000000000000") == log_time("1750000000000000000") == 1_750_000_000 * 10**9
    assert log_time("2025-06-15T15:06:40Z") == log_time("2025-06-15T15:06:40+05:00") == 1_750_000_000 * 10**9  # the zone is not applied
    assert log_time("1750000000.5") % 10**9 == 500_000_000 and step_of("15") == 15 * 10**9 and step_of("1m30s") == 90 * 10**9
    with pytest.raises(BadRequest):
        step_of("x")


def _greedy(arrivals, known, top, each):
    held, out = set(known), {}
    for app, key, _ in sorted(arrivals, key=lambda r: r[2]):
        if (app, key) in held or (app, key) in out:
            continue
        full = top and len(held) >= top
        reason = admission.GLOBAL if full else admission.PER_APP if each and sum(a == app for a, _ in held) >= each else None
        out[app, key] = reason
        if reason is None:
            held.add((app, key))
    return out


@pytest.mark.parametrize(("top", "each"), [(5, 2), (0, 2), (5, 0), (0, 0), (3, 3), (1, 1)])
def test_admission_equals_greedy(spark, top, each):
    import random

    random.seed(top * 10 + each)
    arrivals = [(random.choice("abc"), random.choice("uvwxyz"), i) for i in range(40)]
    known = [("a", "u"), ("b", "q")]
    got = admission.admit(spark.createDataFrame(arrivals, "app string, series_key string, seq bigint"), spark.createDataFrame(known, "app string, series_key string"), max_series=top, max_series_per_app=each)
    assert {(r.app, r.series_key): r.reason for r in got.collect()} == _greedy(arrivals, known, top, each)


def test_retention(spark):
    rows = [("logs", "a", 10, 100, True), ("logs", "b", 50, 100, False), ("metrics", "c", 40, 100, True), ("logs", "d", 90, 100, True)]
    files = spark.createDataFrame(rows, "signal string, id string, newest_nanos bigint, bytes bigint, delivered boolean")
    plan = lambda *a, **k: {(r.id, r.reason) for r in admission.retention_plan(files, 100, {"logs": 80}, *a, **k).collect()}
    assert plan() == {("a", "age")}
    assert plan(300) == {("a", "age")}
    assert plan(250) == {("a", "age"), ("c", "budget")}
    assert plan(50) == {("a", "age"), ("c", "budget"), ("d", "budget"), ("b", "budget")}
    assert plan(0, keep_undelivered=True) == {("a", "age"), ("c", "budget"), ("d", "budget")}


def test_usage(table):
    rows = {r.app: (r.records, r.series, r.bytes) for r in discovery.usage(table, 1_001).collect()}
    assert rows == {"a": (2, 2, 500), "b": (2, 1, 500)}
