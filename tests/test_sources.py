"""Decoders, wire formats, stored tables and streams."""

import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliotrace.errors import BadRequest, LimitExceeded, QueryError, Unsupported
from heliotrace.operators import logs
from heliotrace.sources import otlp, otlp_encode, remote_write, tables, transfer, wire
from heliotrace.streaming import ingest

T = 1_750_000_000


def log_request(*records, resource=(), scope=None):
    kv = lambda pairs: [{"key": k, "value": {"stringValue": v}} for k, v in pairs]
    return json.dumps({"resourceLogs": [{"resource": {"attributes": kv(resource)}, "scopeLogs": [{"scope": scope or {}, "logRecords": list(records)}]}]})


def decode(spark, *bodies, limits=otlp.Limits(), how=otlp.decode_logs):
    df = spark.createDataFrame([(b,) for b in bodies], "body string").withColumn("received_nanos", F.lit(7))
    return how(df, limits).collect()


def test_log_records(spark):
    any_body = {"arrayValue": {"values": [{"stringValue": "a"}, {"intValue": "2"}]}}
    rows = decode(
        spark,
        log_request(
            {"timeUnixNano": str(T * 10**9), "severityNumber": 17, "body": {"stringValue": "x"}, "attributes": [{"key": "n", "value": {"doubleValue": 60.0}}, {"key": "b", "value": {"boolValue": True}}], "traceId": "ABCD", "spanId": "0000"},
            {"timeUnixNano": T, "severityText": "Warning", "body": any_body},
            {"timeUnixNano": "-5", "observedTimeUnixNano": str(T * 1000), "severityNumber": "SEVERITY?", "body": {"kvlistValue": {"values": [{"key": "k", "value": {"boolValue": False}}]}}},
            {"body": {}},
            resource=[("service.name", "shop"), ("host", "h")], scope={"name": "lib"},
        ),
        "{broken",
    )
    good = [r for r in rows if r.reject_reason is None]
    assert [r.timestamp_nanos for r in good] == [T * 10**9, T * 10**9, T * 10**9, 7]
    assert [r.severity for r in good] == ["error", "warn", "unknown", "unknown"]
    assert [r.body for r in good] == ["x", '["a",2]', '{"k":false}', ""]
    assert good[0].stream == {"service_name": "shop", "app": "shop", "level": "error", "scope_name": "lib"}
    assert good[0].attributes == {"n": "60", "b": "true"} and good[0].trace_id == "abcd" and good[0].span_id is None
    assert [r.rescaled for r in good][:2] == [False, True]
    assert [r.reject_reason for r in rows if r.reject_reason] == ["invalid_request"]


def test_log_limits(spark):
    record = {"timeUnixNano": str(T * 10**9), "body": {"stringValue": "é" * 10}}
    (cut,) = decode(spark, log_request(record), limits=otlp.Limits(line_bytes=5))
    assert cut.body == "éé" + otlp.TRUNCATED and cut.reject_reason is None
    reason = lambda limits, **k: decode(spark, log_request({**record, **k.pop("extra", {})}, **k), limits=limits)[0].reject_reason
    assert reason(otlp.Limits(line_bytes=5, truncate=False)) == "line_too_long"
    assert reason(otlp.Limits(attributes=0), extra={"attributes": [{"key": "a", "value": {"stringValue": "b"}}]}) == "too_many_attributes"
    assert reason(otlp.Limits(labels=1)) == "too_many_labels"
    assert reason(otlp.Limits(label_value=3), resource=[("service.name", "long")]) == "label_value_too_long"


def test_metrics_and_histograms(spark):
    attributes = [{"key": "a.b", "value": {"stringValue": "c"}}]
    body = json.dumps({"resourceMetrics": [{"resource": {}, "scopeMetrics": [{"scope": {}, "metrics": [
        {"name": "http.requests", "sum": {"isMonotonic": True, "dataPoints": [{"timeUnixNano": str(T * 10**9), "asInt": "-5", "attributes": attributes}]}},
        {"name": "http.duration", "histogram": {"dataPoints": [{"timeUnixNano": str(T * 10**9), "bucketCounts": ["50", "40", "10"], "explicitBounds": [0.1, 0.5], "sum": 12.5, "count": "100"}]}},
        {"name": "s", "summary": {"dataPoints": [{"timeUnixNano": "1"}]}},
    ]}]}]})
    rows = decode(spark, body, how=otlp.decode_metrics)
    got = {(r.labels["__name__"], r.labels.get("le")): r.value for r in rows if r.reject_reason is None}
    assert got == {("http_requests", None): -5, ("http_duration_bucket", "0.1"): 50, ("http_duration_bucket", "0.5"): 90, ("http_duration_bucket", "+Inf"): 100, ("http_duration_sum", None): 12.5, ("http_duration_count", None): 100}
    assert [r.labels["a_b"] for r in rows if r.kind == "counter"] == ["c"]
    assert [r.reject_reason for r in rows if r.reject_reason] == ["unsupported_metric_type"]


def test_remote_write(spark):
    body = remote_write.write_request([({"__name__": "requests", "job": "j"}, [(T * 1000, 100.0), (5, 1.0)]), ({"__name__": "bad-name"}, [(T * 1000, 1.0)]), ({"x": "y"}, [(T * 1000, 1.0)])])
    rows = remote_write.decode(spark.createDataFrame([(body,), (b"\xff",)], "body binary")).collect()
    assert sorted(str(r.reject_reason) for r in rows) == ["None", "invalid_metric_name", "invalid_request", "missing_metric_name", "timestamp_out_of_range"]
    (ok,) = [r for r in rows if r.reject_reason is None]
    assert (ok.timestamp_nanos, ok.labels["app"], ok.value) == (T * 10**9, "j", 100.0)


def test_remote_read():
    request = wire.snappy_decode(remote_write.read_request(1, 2, [("__name__", "=~", "x.*")]))
    (query,) = [v for n, _, v in wire.fields(request)]
    assert [n for n, _, _ in wire.fields(query)] == [1, 2, 3]
    rows = remote_write.read_response(remote_write.encode_read_response([({"__name__": "x"}, [(T * 1000, 2.5)])]))
    assert [(r["timestamp_nanos"], r["value"]) for r in rows] == [(T * 10**9, 2.5)]


def test_compression():
    import gzip
    import zlib

    import zstandard

    text = b"abc" * 1000
    raw = zlib.compressobj(wbits=-15)
    forms = {"gzip": gzip.compress(text), "x-gzip": gzip.compress(text), "deflate": zlib.compress(text), "DEFLATE": raw.compress(text) + raw.flush(), "zstd": zstandard.compress(text), "identity": text, None: text}
    for name, body in forms.items():
        assert wire.decompress(body, name) == text
        with pytest.raises(LimitExceeded):
            wire.decompress(body, name, 100)
    with pytest.raises(Unsupported):
        wire.decompress(text, "br")
    with pytest.raises(BadRequest):
        wire.decompress(b"nope", "gzip")


def test_snappy_copies_and_lies():
    assert wire.snappy_decode(bytes([6, 4, *b"ab", 0b00000001, 2])) == b"ababab"
    with pytest.raises(LimitExceeded):
        wire.snappy_decode(wire.write_varint(1 << 40))
    for body in (bytes([5, 0, 97]), bytes([2, 1, 9]), b"", bytes([3, 60 << 2])):
        with pytest.raises(QueryError):
            wire.snappy_decode(body)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_snappy_round_trip_and_noise(data):
    assert wire.snappy_decode(wire.snappy_encode(data)) == data
    try:
        list(wire.fields(wire.snappy_decode(data)))
    except (QueryError, IndexError, struct.error) as e:
        assert isinstance(e, QueryError)


def _log_table(spark, n):
    return spark.range(n).select((F.lit(T * 10**9) + F.col("id") * 3_600 * 10**9).alias("timestamp_nanos"), F.col("id").alias("seq"), F.create_map(F.lit("app"), F.concat(F.lit("a"), (F.col("id") % 2).cast("string")), F.lit("level"), F.lit("info")).alias("stream"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("body"), F.create_map(F.lit("k.v"), F.lit("x")).alias("attributes"))


def test_export_import_round_trip(spark, tmp_path):
    df = _log_table(spark, 50)
    lines = otlp_encode.export_logs(df, per_line=20)
    assert [(r.batch, r.records) for r in lines.orderBy("batch").collect()] == [(0, 20), (1, 20), (2, 10)]
    lines.select("body").write.text(str(tmp_path / "out"), compression="gzip")
    back = otlp.accepted(transfer.import_requests(spark, str(tmp_path / "out"), "logs"))
    key = lambda d: sorted((r.timestamp_nanos, r.body, tuple(sorted(r.stream.items())), tuple(r.attributes.items())) for r in d.collect())
    assert key(back) == key(df)
    with pytest.raises(LimitExceeded):
        otlp_encode.export_logs(df, limit=10**9)


def test_tables_prune_and_newest_first(spark, tmp_path):
    path = str(tmp_path / "logs")
    tables.append(_log_table(spark, 100), path, "logs")
    one_day = tables.read(spark, path, "logs", T * 10**9 + 30 * 3_600 * 10**9, T * 10**9 + 40 * 3_600 * 10**9)
    assert one_day.count() == 11 and len(one_day.inputFiles()) > 0
    scan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(signal_day" in scan and "GreaterThanOrEqual(timestamp_nanos" in scan
    days = sorted(str(r[0]) for r in tables.read(spark, path, "logs").select("signal_day").distinct().collect())
    read = []
    day = lambda d: read.append(d) or tables.read(spark, path, "logs").where(F.col("signal_day") == d)
    assert [r.seq for r in logs.newest_by_day(day, days, '{app=~"a."}', limit=5).collect()] == [99, 98, 97, 96, 95]
    assert len(read) == 1
    assert tables.files(spark, path, "logs").count() >= len(days)


def test_walk_back_always_moves():
    data = [(t, f"r{t}-{i}") for t in (5, 5, 5, 7, 9) for i in range(1)] + [(5, "x"), (5, "y")]
    fetch = lambda start, end: sorted({r for r in data if start <= r[0] <= end}, reverse=True)[:3]
    got = [r for page in transfer.walk_back(fetch, 0, 10, 3) for r in page]
    assert len(got) == len(set(got)) and {t for t, _ in got} == {5, 7, 9}


def test_streaming_ingest_tail_and_relay(spark, tmp_path):
    landing, table, rejects = (str(tmp_path / n) for n in ("in", "table", "rejects"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(log_request({"timeUnixNano": str(T * 10**9), "body": {"stringValue": "hello"}}, resource=[("service.name", "s")]) + "\n{bad\n")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.landing(spark, landing), "logs", table, rejects, str(tmp_path / "c"), app="me").awaitTermination()
    rows = tables.read(spark, table, "logs").collect()
    assert [(r.body, r.stream["app"]) for r in rows] == [("hello", "me")]
    assert [(r.reason, r.records) for r in spark.read.parquet(rejects).collect()] == [("invalid_request", 1)]
    stream = spark.readStream.schema(tables.read(spark, table, "logs").schema).parquet(table)
    query = ingest.tail(stream, '{app="me"} |= "hel"').writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.body for r in spark.table("tailed").collect()] == ["hello"]
    sent = []
    own = stream.drop("signal_day")
    ingest.relay(own, otlp_encode.export_logs, lambda body: sent.append(body) or 200, str(tmp_path / "r")).awaitTermination()
    assert len(sent) == 1 and "hello" in sent[0]


def test_streaming_admission(spark, tmp_path):
    source = tmp_path / "s"
    spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3), ("a", "w", 4), ("a", "x", 5)], "app string, series_key string, seq bigint").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("app string, series_key string, seq bigint").parquet(str(source))
    query = ingest.admit_stream(stream, max_series=3, max_series_per_app=2).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.series_key, r.reason) for r in spark.table("admitted").collect()} == {("x", None), ("y", None), ("z", None), ("w", "limits.max_series")}


def test_relay_ships_everything_once(spark):
    """50,001 records, more than a page, with one time for all of the last 1,000; a request that is too large is halved alone."""
    df = spark.range(50_001).select((F.lit(T * 10**9) + F.least(F.col("id"), F.lit(49_000))).alias("timestamp_nanos"), F.col("id").alias("seq"), F.create_map(F.lit("app"), F.lit("a")).alias("stream"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("body"), F.create_map().cast("map<string,string>").alias("attributes"))
    sent, refused = [], []

    def post(body):
        lines = [r["body"]["stringValue"] for res in json.loads(body)["resourceLogs"] for sc in res["scopeLogs"] for r in sc["logRecords"]]
        if len(lines) > 1_500 and "line 7" in lines:
            refused.append(len(lines))
            return 413
        sent.extend(lines)
        return 200

    assert ingest.ship(df, otlp_encode.export_logs, post, page=20_000) == 50_001
    assert len(refused) == 1 and len(sent) == 50_001 and len(set(sent)) == 50_001
    with pytest.raises(RuntimeError):
        ingest.ship(df.limit(1), otlp_encode.export_logs, lambda body: 413)
    with pytest.raises(RuntimeError):
        ingest.ship(df.limit(1), otlp_encode.export_logs, lambda body: 500)
    assert ingest.ship(df.limit(0), otlp_encode.export_logs, post) == 0


def test_a_batch_that_runs_twice_is_stored_once(spark, tmp_path):
    import shutil

    landing, table, rejects, checkpoint = (str(tmp_path / n) for n in ("in", "table", "rejects", "c"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(log_request({"body": {"stringValue": "without a time"}}, {"timeUnixNano": str(T * 10**9), "body": {"stringValue": "hello"}}) + "\n{bad\n")
    run = lambda: ingest.ingest(ingest.landing(spark, landing), "logs", table, rejects, checkpoint).awaitTermination()
    run()
    first = sorted((r.body, r.timestamp_nanos) for r in tables.read(spark, table, "logs").collect())
    shutil.rmtree(tmp_path / "c" / "commits")  # as after a crash between the writing and the commit
    run()
    assert sorted((r.body, r.timestamp_nanos) for r in tables.read(spark, table, "logs").collect()) == first and len(first) == 2
    assert [(r.reason, r.records) for r in spark.read.parquet(rejects).collect()] == [("invalid_request", 1)]
    names = [r[0] for r in spark.read.parquet(table).select(tables.BATCH).distinct().collect()]
    live = tables._stored(spark, table, "logs").where("body = 'hello'").drop("app", "signal_day")
    late = live.withColumn(tables.BATCH, F.lit("next")).withColumn("body", F.lit("late"))
    assert len(names) == 1 and sorted(r.body for r in tables.with_live(spark, table, "logs", live.unionByName(late)).collect()) == ["hello", "late", "without a time"]


def test_compressed_landing(spark, tmp_path):
    import gzip

    import zstandard

    (tmp_path / "in").mkdir()
    request = log_request({"timeUnixNano": str(T * 10**9), "body": {"stringValue": "x"}}).encode()
    for name, body in {"a.json.gz": gzip.compress(request), "b.zst": zstandard.compress(request), "c.json": request, "d.gz": b"nope"}.items():
        (tmp_path / "in" / name).write_bytes(body)
    table, rejects = str(tmp_path / "table"), str(tmp_path / "rejects")
    ingest.ingest(ingest.landing_bodies(spark, str(tmp_path / "in")), "logs", table, rejects, str(tmp_path / "c")).awaitTermination()
    assert [r.body for r in tables.read(spark, table, "logs").collect()] == ["x"] * 3
    assert [(r.reason, r.records) for r in spark.read.parquet(rejects).collect()] == [("invalid_request", 1)]


def test_imports_of_foreign_answers(spark):
    page = json.dumps({"data": {"result": [{"stream": {"app": "a"}, "values": [[str(T * 10**9), "one"], [str(T * 10**9 + 1), "two", {"structuredMetadata": {"k": "v"}}], ["x", "bad"], [str(T * 10**9 + 2), "three", {"m": "n"}]]}]}})
    rows = sorted(transfer.decode_stream_pages(spark.createDataFrame([(page,), ("{bad",), ('{"data":{}}',)], "body string")).collect())
    assert [(r.timestamp_nanos - T * 10**9, r.body, r.attributes, r.stream) for r in rows] == [(0, "one", {}, {"app": "a"}), (1, "two", {"k": "v"}, {"app": "a"}), (2, "three", {"m": "n"}, {"app": "a"})]
    values = [[str(t), f"l{t}"] for t in (1, 2, 2, 3, 4, 5)]
    fetch = lambda a, b: json.dumps({"data": {"result": [{"stream": {}, "values": [v for v in reversed(values) if a <= int(v[0]) <= b][:3]}]}})
    assert sorted(r.body for r in transfer.import_streams(spark, fetch, 0, 10, 3).collect()) == ["l1", "l2", "l2", "l3", "l4", "l5"]

    traces = {f"{i:032x}": 100 + i // 3 for i in range(1, 20)}
    search = lambda a, b: json.dumps({"traces": [{"traceID": t, "startTimeUnixNano": str(s * 10**9)} for t, s in sorted(traces.items(), key=lambda x: (-x[1], x[0])) if a <= s <= b][:5]})
    get = lambda t: json.dumps({"batches": [{"scopeSpans": [{"spans": [{"traceId": t, "spanId": "0a", "startTimeUnixNano": str(T * 10**9)}]}]}]})
    assert sorted(r.trace_id for r in transfer.import_traces(spark, search, get, 0, 1_000).collect()) == sorted(traces)


def test_remote_read_in_windows(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from heliotrace.sources.remote_read import RemoteRead

    def answer(body):
        (query,) = [dict((n, v) for n, _, v in wire.fields(q)) for _, _, q in wire.fields(wire.snappy_decode(body))]
        return remote_write.encode_read_response([({"__name__": "up", "app": "a"}, [(t, float(t)) for t in range(T * 1000, T * 1000 + 100, 10) if query[1] <= t <= query[2]])])

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            out = answer(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *args):
            pass

    pulled = transfer.pull_metrics(spark, answer, T * 1000, T * 1000 + 99, [("__name__", "=", "up")], 25)
    assert pulled.rdd.getNumPartitions() == 4 and sorted(r.value for r in pulled.collect()) == [float(T * 1000 + 10 * i) for i in range(10)]
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(RemoteRead)
    read = spark.read.format("remote_read").options(url=f"http://127.0.0.1:{server.server_port}/", start=T * 1000, end=T * 1000 + 99, window=40, matchers='[["__name__", "=", "up"]]').load()
    assert read.rdd.getNumPartitions() == 3 and sorted(r.value for r in read.collect()) == [float(T * 1000 + 10 * i) for i in range(10)]
    server.shutdown()


def test_own_figures_and_command_line(spark, tmp_path, capsys):
    from heliotrace import __main__ as shell
    from heliotrace.operators import selfmetrics

    path = str(tmp_path / "logs")
    tables.append(_log_table(spark, 20), path, "logs")
    df, files = tables.read(spark, path, "logs"), tables.files(spark, path, "logs")
    rejects = spark.createDataFrame([("logs", 'bad "x"', 2), ("logs", 'bad "x"', 1)], "signal string, reason string, records bigint")
    text = selfmetrics.exposition(spark, selfmetrics.figures({"logs": df}, files=files, rejects=rejects, budget_bytes=1, max_series=7))
    for line in ('heliotrace_records_appended_total{signal="logs"} 20', 'heliotrace_app_rows{app="a0",signal="logs"} 10', 'heliotrace_series_active{signal="logs"} 2', 'heliotrace_ingest_rejected_total{reason="bad \\"x\\"",signal="logs"} 3', "heliotrace_storage_over_budget 1", "heliotrace_series_limit 7"):
        assert line in text.split("\n"), line
    assert text.count("# TYPE") == len(selfmetrics.FIGURES)
    assert shell.main(["--data", str(tmp_path), "logs", '{app="a1"} |= "line 3"', "--start", str(T), "--end", str(T + 10**6)]) == 0
    assert json.loads(capsys.readouterr().out)["body"] == "line 3"
    assert shell.main(["--data", str(tmp_path), "export", "logs", str(tmp_path / "out")]) == 0
    assert shell.main(["--data", str(tmp_path / "new"), "import", "logs", str(tmp_path / "out")]) == 0
    assert tables.read(spark, str(tmp_path / "new" / "logs"), "logs").count() == 20
    assert shell.main(["--data", str(tmp_path), "logs", "{app="]) == 1
    assert shell.main(["--data", str(tmp_path), "figures"]) == 0 and "heliotrace_segments" in capsys.readouterr().out


def test_label_discovery_reads_streams_only(spark, tmp_path):
    from heliotrace.engine import Engine

    path = str(tmp_path / "logs")
    tables.append(_log_table(spark, 100), path, "logs")
    own, streams = Engine(spark, tables.read(spark, path, "logs")), tables.streams(spark, path, "logs")
    small = Engine(spark, own.logs, log_streams=streams)
    names = lambda df: sorted(r[0] for r in df.collect())
    day = T * 10**9 + 30 * 3_600 * 10**9
    for args in ((), (day, day + 10**9)):
        assert names(small.log_labels(*args)) == names(own.log_labels(*args)) == ["app", "level"]
        assert set(names(small.log_label_values("app", *args))) >= set(names(own.log_label_values("app", *args)))
    assert names(small.log_label_values("app")) == ["a0", "a1"] and small.log_series(['{app="a1"}']).count() == 1
    assert all(".streams" in f for f in small.log_labels().inputFiles())
    assert streams.agg(F.sum("records")).first()[0] == 100
