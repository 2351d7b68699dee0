"""The metrics protocol: write requests as rows, and the client side of remote read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotrace.errors import QueryError
from heliotrace.sources import wire
from heliotrace.sources.anyvalue import EARLIEST, LATEST
from heliotrace.sources.otlp import Limits, _label_fault

SCHEMA = "timestamp_nanos bigint, labels map<string,string>, value double, kind string, reject_reason string"
_METRIC, _LABEL = re.compile(r"[A-Za-z_:][A-Za-z0-9_:]*\Z"), re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_MATCH = {"=": 0, "!=": 1, "=~": 2, "!~": 3}


def series_rows(labels: dict[str, str], samples: list[tuple[int, float]]) -> Iterator[dict]:
    """Rows of one series; invalid names are refused, not rewritten."""
    labels = {k: v for k, v in labels.items() if v != ""}
    name = labels.get("__name__", "")
    reason = None
    if not name:
        reason = "missing_metric_name"
    elif not _METRIC.match(name):
        reason = "invalid_metric_name"
    elif not all(_LABEL.match(k) for k in labels):
        reason = "invalid_label_name"
    app = next((labels[k] for k in ("app", "service_name", "job") if labels.get(k)), "unknown")
    labels["app"] = app
    kind = "counter" if name.endswith(("_total", "_count", "_sum", "_bucket")) else "gauge"
    for millis, value in samples:
        bad = None if EARLIEST * 1000 <= millis < LATEST * 1000 else "timestamp_out_of_range"
        yield {"timestamp_nanos": millis * 1_000_000 if not bad else None, "labels": list(labels.items()), "value": value, "kind": kind, "reject_reason": reason or bad}


def decode(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Samples of write requests (a binary column ``body``, snappy over protobuf), refused ones with a reason."""
    kind = pa.schema([("timestamp_nanos", pa.int64()), ("labels", pa.map_(pa.string(), pa.string())), ("value", pa.float64()), ("kind", pa.string()), ("reject_reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                try:
                    rows = [r for number, k, v in wire.fields(wire.snappy_decode(body or b"")) if number == 1 and k == 2 for r in series_rows(*wire.time_series(v))]
                except QueryError:
                    rows = [{"timestamp_nanos": None, "labels": None, "value": None, "kind": None, "reject_reason": "invalid_request"}]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=kind)

    rows = requests.select("body").mapInArrow(run, SCHEMA).withColumn("seq", F.monotonically_increasing_id())
    fault = F.when(F.col("labels").isNotNull(), _label_fault(limits, F.col("labels")))
    return rows.withColumn("reject_reason", F.coalesce("reject_reason", fault))


def write_request(series: list[tuple[dict[str, str], list[tuple[int, float]]]]) -> bytes:
    return wire.snappy_encode(wire.message(*[(1, wire.encode_series(labels, samples)) for labels, samples in series]))


def encode(samples: DataFrame, per_request: int = 500) -> DataFrame:
    """(body): write requests of samples, a few hundred series each, made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_series: dict[tuple, list[tuple[int, float]]] = {}
            for labels, t, x in zip(*(batch.column(c).to_pylist() for c in ("labels", "timestamp_nanos", "value")), strict=True):
                by_series.setdefault(tuple(sorted(labels)), []).append((t // 1_000_000, x))
            own = [(dict(k), sorted(v)) for k, v in by_series.items()]
            for at in range(0, len(own), per_request):
                yield pa.RecordBatch.from_arrays([pa.array([write_request(own[at : at + per_request])], pa.binary())], names=["body"])

    return samples.select("labels", "timestamp_nanos", "value").mapInArrow(run, "body binary")


def read_request(start_millis: int, end_millis: int, matchers: list[tuple[str, str, str]]) -> bytes:
    """A remote-read query of (name, op, value) matchers."""
    query = wire.message((1, start_millis), (2, end_millis), *[(3, wire.message((1, _MATCH[op]), (2, name), (3, value))) for name, op, value in matchers])
    return wire.snappy_encode(wire.message((1, query)))


def read_response(body: bytes) -> list[dict]:
    """Rows of a remote-read response."""
    return [
        row
        for n, k, result in wire.fields(wire.snappy_decode(body))
        if n == 1 and k == 2
        for m, j, series in wire.fields(result)
        if m == 1 and j == 2
        for row in series_rows(*wire.time_series(series))
    ]


def encode_read_response(series: list[tuple[dict[str, str], list[tuple[int, float]]]]) -> bytes:
    return wire.snappy_encode(wire.message((1, wire.message(*[(1, wire.encode_series(labels, samples)) for labels, samples in series]))))
