"""``python -m heliotrace``: queries and transfers over stored tables from a shell."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from heliotrace.engine import Engine, seconds_time, log_time, step_of
from heliotrace.errors import QueryError
from heliotrace.operators import selfmetrics
from heliotrace.sources import tables, transfer


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="heliotrace", description=__doc__)
    out.add_argument("--data", required=True, help="folder with the tables logs, spans and metrics")
    commands = out.add_subparsers(dest="command", required=True)
    for name, help_ in (("logs", "a log query"), ("metrics", "a metric query"), ("traces", "a trace search")):
        c = commands.add_parser(name, help=help_)
        c.add_argument("query")
        c.add_argument("--start")
        c.add_argument("--end")
        if name == "metrics":
            c.add_argument("--step")
        else:
            c.add_argument("--limit", type=int)
    commands.add_parser("trace", help="one trace").add_argument("id")
    for name in ("labels", "usage", "figures"):
        commands.add_parser(name)
    for name in ("export", "import"):
        c = commands.add_parser(name, help=f"{name} requests, one on each line")
        c.add_argument("signal", choices=["logs", "spans", "metrics"])
        c.add_argument("path")
    return out


def run(args: argparse.Namespace, spark: SparkSession) -> list:
    """The answer as rows that JSON can say."""
    path = lambda signal: f"{args.data}/{signal}"

    def table(signal: str):
        try:
            return tables.read(spark, path(signal), signal)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    engine = Engine(spark, *(table(s) for s in ("logs", "spans", "metrics")))
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if args.command == "logs":
        return rows(engine.query_logs(args.query, *(log_time(t) if t else None for t in (args.start, args.end)), limit=args.limit).select("timestamp_nanos", "stream", "body"))
    if args.command == "metrics":
        if args.step:
            return rows(engine.query_metrics_range(args.query, seconds_time(args.start), seconds_time(args.end), step_of(args.step)).drop("labels_key"))
        return rows(engine.query_metrics(args.query, seconds_time(args.end) if args.end else None).drop("labels_key"))
    if args.command == "traces":
        return rows(engine.search_traces(args.query, *(log_time(t) if t else None for t in (args.start, args.end)), limit=args.limit))
    if args.command == "trace":
        return rows(engine.trace(args.id))
    if args.command == "labels":
        return rows(engine.log_labels())
    held = {s: table(s) for s in ("logs", "spans", "metrics") if table(s) is not None}
    if args.command in ("usage", "figures"):
        files = None
        for signal in held:
            own = tables.files(spark, path(signal), signal)
            files = own if files is None else files.unionByName(own)
        samples = selfmetrics.figures(held, files=files)
        return selfmetrics.exposition(spark, samples).splitlines() if args.command == "figures" else rows(samples.where("name like '%_app_%'"))
    if args.command == "export":
        engine.export_all(args.signal).select("body").write.text(args.path)
        return []
    decoded = transfer.import_requests(spark, args.path, args.signal)
    tables.append(decoded.where("reject_reason is null").drop("reject_reason", "rescaled"), path(args.signal), args.signal)
    return []


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        for row in run(args, SparkSession.builder.appName("heliotrace").getOrCreate()):
            print(row if isinstance(row, str) else json.dumps(row, ensure_ascii=False, default=str))
    except QueryError as e:
        print(json.dumps(e.body()), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
