"""The three signals as views of general event, conversation and document tables; each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliotrace.functions import partitions
from heliotrace.functions.semantics import empty_map

T0 = 1_704_067_200_000_000_000
DAY, HOUR = 86_400 * 10**9, 3_600 * 10**9
BOUNDS = ("1", "5", "10", "50", "100", "+Inf")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nanos(ts: str) -> Column:
    """Nanoseconds of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))") * 1000


def _map(**fields: Column) -> Column:
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warn").otherwise("info")
    return e.select(_nanos("ts").alias("timestamp_nanos"), F.col("event_id").alias("seq"), F.concat(F.lit("app-"), (F.col("user_id") % 5).cast("string")).alias("app"), level.alias("level"), "event_type", "user_id", "value", F.regexp_extract("props", "([0-9]+)", 1).alias("k"))


def logs(spark: SparkSession, sf_dir: str, *, logfmt: bool = False) -> DataFrame:
    e = _events(spark, sf_dir)
    user = F.col("user_id").cast("string")
    body = F.concat(F.lit("event="), "event_type", F.lit(" k="), "k", F.lit(' user="'), user, F.lit('"')) if logfmt else F.concat(F.lit('{"event": "'), "event_type", F.lit('", "k": '), "k", F.lit(', "user": '), user, F.lit("}"))
    return e.select("timestamp_nanos", "seq", _map(app=F.col("app"), level=F.col("level"), service_name=F.col("event_type")).alias("stream"), body.alias("body"), F.create_map(F.lit("user.id"), user, F.lit("k"), F.col("k")).alias("attributes"))


def textlogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select((F.lit(T0) + F.col("doc_id") * 10**9).alias("timestamp_nanos"), F.col("doc_id").alias("seq"), _map(app=F.col("source"), level=F.col("lang")).alias("stream"), F.col("text").alias("body"), empty_map().alias("attributes"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    size = F.length("text")
    span_id = lambda turn: F.lower(F.lpad(F.hex(F.col("conv_id") * 1000 + turn + 1), 16, "0"))
    start = F.lit(T0) + F.col("conv_id") * (60 * 10**9) + F.col("turn") * 10**9
    status = F.when(size % 7 == 0, "error").when(size % 7 == 1, "unset").otherwise("ok")
    return c.select(
        F.lower(F.lpad(F.hex(F.col("conv_id") + 1), 32, "0")).alias("trace_id"), span_id(F.col("turn")).alias("span_id"), F.when(F.col("turn") > 0, span_id(F.lit(0))).alias("parent_span_id"),
        F.col("role").alias("name"), F.lit("internal").alias("kind"), start.alias("start_nanos"), (start + size * 10**6).alias("end_nanos"), status.alias("status"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        _map(app=F.concat(F.lit("svc-"), (F.col("conv_id") % 3).cast("string"))).alias("stream"), F.create_map(F.lit("text.length"), size.cast("string"), F.lit("turn"), F.col("turn").cast("string")).alias("attributes"),
    )


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("timestamp_nanos", "seq", _map(__name__=F.lit("event_value"), app=F.col("app"), event_type=F.col("event_type")).alias("labels"), "value")


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running count of each app and event type that starts anew every 200 events.

    Events are numbered within hours, after a row that has the number of events in the hours before: no task
    gets a whole series. Such rows are as many as hours with events.
    """
    e = _events(spark, sf_dir).withColumn("hour", F.col("timestamp_nanos") - F.pmod(F.col("timestamp_nanos"), F.lit(HOUR)))
    e = e.select("app", "event_type", "hour", "timestamp_nanos", "seq")
    earlier = F.sum("n").over(Window.partitionBy("app", "event_type").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    heads = e.groupBy("app", "event_type", "hour").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(earlier, F.lit(0)))
    rows = e.withColumn("earlier", F.lit(None).cast("long")).withColumn("head", F.lit(False))
    rows = rows.unionByName(heads.drop("n").withColumn("head", F.lit(True)), allowMissingColumns=True)
    rows = partitions.spread(rows, partitions.source_bytes(e), "app", "event_type", "hour")
    w = Window.partitionBy("hour", "app", "event_type").orderBy(F.desc("head"), "timestamp_nanos", "seq")
    n = F.first("earlier").over(w) + F.row_number().over(w) - 1
    rows = rows.withColumn("n", n).where(~F.col("head"))
    return rows.select("timestamp_nanos", "seq", _map(__name__=F.lit("events_total"), app=F.col("app"), event_type=F.col("event_type")).alias("labels"), ((F.col("n") - 1) % 200 + 1).cast("double").alias("value"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly cumulative counts of values by upper bound."""
    e = _events(spark, sf_dir).withColumn("hour", F.col("timestamp_nanos") - F.pmod(F.col("timestamp_nanos"), F.lit(HOUR)))
    counts = e.groupBy("app", "hour").agg(*[F.sum(F.when(F.col("value") <= (float("inf") if b == "+Inf" else float(b)), 1.0).otherwise(0.0)).alias(f"b{i}") for i, b in enumerate(BOUNDS)])
    rows = counts.select("app", "hour", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("value")) for i, b in enumerate(BOUNDS)])).alias("x"))
    return rows.select(F.col("hour").alias("timestamp_nanos"), F.lit(0).cast("long").alias("seq"), _map(__name__=F.lit("event_value_bucket"), app=F.col("app"), le=F.col("x.le")).alias("labels"), F.col("x.value").alias("value"))


SQL_LOGS = """SELECT epoch_us(ts) * 1000 AS timestamp_nanos, event_id AS seq, 'app-' || (user_id % 5) AS app,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' ELSE 'info' END AS level, event_type AS service_name, event_type, value,
  CAST(user_id AS VARCHAR) AS "user", regexp_extract(props, '([0-9]+)', 1) AS k FROM events"""
SQL_JSON_BODY = """'{"event": "' || service_name || '", "k": ' || k || ', "user": ' || "user" || '}'"""
SQL_LOGFMT_BODY = """'event=' || service_name || ' k=' || k || ' user="' || "user" || '"'"""
SQL_SPANS = f"""SELECT lower(lpad(to_hex(conv_id + 1), 32, '0')) AS trace_id, lower(lpad(to_hex(conv_id * 1000 + turn + 1), 16, '0')) AS span_id,
  CASE WHEN turn > 0 THEN lower(lpad(to_hex(conv_id * 1000 + 1), 16, '0')) END AS parent_span_id, role AS name, {T0} + conv_id * 60000000000 + turn * 1000000000 AS start_nanos,
  {T0} + conv_id * 60000000000 + turn * 1000000000 + length(text) * 1000000 AS end_nanos, CASE length(text) % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'unset' ELSE 'ok' END AS status,
  conv_id * 1000 + turn AS seq, 'svc-' || (conv_id % 3) AS app, length(text) AS size, turn FROM conversations"""
SQL_GAUGE = f"SELECT timestamp_nanos, seq, app, event_type, value FROM ({SQL_LOGS})"
SQL_COUNTER = f"SELECT timestamp_nanos, seq, app, event_type, CAST((row_number() OVER (PARTITION BY app, event_type ORDER BY timestamp_nanos, seq) - 1) % 200 + 1 AS DOUBLE) AS value FROM ({SQL_LOGS})"
SQL_HISTOGRAM = f"""SELECT timestamp_nanos, CAST(0 AS BIGINT) AS seq, app, le, bound, value FROM (
  SELECT timestamp_nanos - timestamp_nanos % {HOUR} AS timestamp_nanos, app, b.le, b.bound, sum(CASE WHEN value <= b.bound THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS value
  FROM ({SQL_LOGS}) CROSS JOIN (VALUES {', '.join(f"('{b}', {chr(39)}{'inf' if b == '+Inf' else b}{chr(39)}::DOUBLE)" for b in BOUNDS)}) b(le, bound) GROUP BY 1, 2, 3, 4)"""
