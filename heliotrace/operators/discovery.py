"""Label names, label values and series.

Over records they are exact for each record in the range. Over the small table of streams, which
stored tables keep beside their files (:func:`active` of ``tables.streams``), no record is read, and a
label set counts in a range that its first and last time of a day and batch overlap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotrace.functions import semantics as S
from heliotrace.operators.logs import in_range, matches
from heliotrace.plans.lexer import Cursor
from heliotrace.plans.logql import selector


def streams(df: DataFrame, column: str = "stream", time: str = "timestamp_nanos") -> DataFrame:
    """A row for each label set: its key, first and last time, records and bytes of its key."""
    return df.groupBy(S.label_key(F.col(column)).alias("stream_key")).agg(F.first(column).alias(column), F.min(time).alias("first_nanos"), F.max(time).alias("last_nanos"), F.count("*").alias("records"))


def active(streams_: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """The streams with records around a time range; label discovery over these needs no times."""
    df = streams_ if start is None else streams_.where(F.col("last_nanos") >= start)
    return df if end is None else df.where(F.col("first_nanos") <= end)


def label_names(df: DataFrame, start: int | None = None, end: int | None = None, *, column: str = "stream", time: str = "timestamp_nanos") -> DataFrame:
    return in_range(df, start, end, time).select(F.explode(F.map_keys(column)).alias("name")).distinct()


def label_values(df: DataFrame, name: str, start: int | None = None, end: int | None = None, *, column: str = "stream", time: str = "timestamp_nanos") -> DataFrame:
    return in_range(df, start, end, time).select(F.element_at(column, F.lit(name)).alias("value")).where("value is not null").distinct()


def series(df: DataFrame, selectors: list[str] = (), start: int | None = None, end: int | None = None, *, column: str = "stream", time: str = "timestamp_nanos") -> DataFrame:
    """Distinct label sets that fit any of the selectors, or all."""
    df = in_range(df, start, end, time)
    tests = []
    for text in selectors:
        c = Cursor(text)
        own = selector(c)
        c.finish()
        tests.append(reduce(Column.__and__, (matches(S.label(F.col(column), m.name), m.op, m.value) for m in own), F.lit(True)))
    if tests:
        df = df.where(reduce(Column.__or__, tests))
    return df.groupBy(S.label_key(F.col(column)).alias("stream_key")).agg(F.first(column).alias(column))


def usage(df: DataFrame, total_bytes: int, *, column: str = "stream") -> DataFrame:
    """Rows and series by app, and each app's share of the bytes by its rows, largest first."""
    app = F.coalesce(F.element_at(column, F.lit("app")), F.element_at(column, F.lit("service_name")), F.lit("unknown"))
    by_stream = df.groupBy(app.alias("app"), S.label_key(F.col(column)).alias("stream_key")).agg(F.count("*").alias("records"))
    by_app = by_stream.groupBy("app").agg(F.sum("records").alias("records"), F.count("*").alias("series"))
    rows = by_app.agg(F.sum("records").alias("all_records"))
    share = (F.lit(total_bytes).cast("decimal(38,0)") * F.col("records") / F.greatest(F.col("all_records"), F.lit(1)))
    return by_app.join(F.broadcast(rows)).select("app", "records", "series", F.floor(share).cast("long").alias("bytes")).orderBy(F.desc("bytes"), "app")
