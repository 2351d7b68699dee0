"""Cardinality admission and retention planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_MAX_SERIES, DEFAULT_PER_APP = 100_000, 20_000
GLOBAL, PER_APP = "limits.max_series", "limits.max_series_per_app"


SALTS = 64


def _app_full(new: DataFrame, cap: int) -> DataFrame:
    """Adds ``app_full``: whether an app's cap was spent before a series came.

    An app's first series up to the cap are found in two steps, over parts of the app and then over
    what is left of these, at most ``SALTS`` times the cap, so no task ranks all series of an app.
    """
    order = ["first_seq", "series_key"]
    salted = Window.partitionBy("app", F.pmod(F.xxhash64("series_key"), F.lit(SALTS))).orderBy(*order)
    first = new.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= cap)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("app").orderBy(*order))).where(F.col("held") + F.col("rank") <= cap)
    inside = first.groupBy("app").agg(F.max(F.struct(*order)).alias("last_in"), F.count("*").alias("n_in"))
    new = new.join(inside, "app", "left")
    spent = F.col("held") + F.coalesce("n_in", F.lit(0)) >= cap
    return new.withColumn("app_full", spent & (F.col("last_in").isNull() | (F.struct(*order) > F.col("last_in"))))


def admit(arrivals: DataFrame, known: DataFrame | None = None, *, max_series: int = DEFAULT_MAX_SERIES, max_series_per_app: int = DEFAULT_PER_APP) -> DataFrame:
    """(app, series_key, first_seq, reason) of each new series; reason is null for admitted ones.

    ``arrivals`` has app, series_key and seq, in order of arrival; ``known`` the series already
    admitted. Greedy admission in arrival order parts into two ranks: a series refused by its
    app's cap uses no global budget, and what comes after the global budget is spent is refused
    for that, whatever its app. A cap of 0 is none. Only rows within the global cap's reach meet in
    one task: survivors are cut to the cap before they are ranked together.
    """
    new = arrivals.groupBy("app", "series_key").agg(F.min("seq").alias("first_seq"))
    known_total = 0
    if known is not None:
        known = known.select("app", "series_key").distinct()
        new = new.join(known, ["app", "series_key"], "left_anti")
        known_total = known.count()
        per_app = known.groupBy("app").agg(F.count("*").alias("held"))
        new = new.join(per_app, "app", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    else:
        new = new.withColumn("held", F.lit(0))
    new = new.withColumn("app_full", F.lit(False)) if not max_series_per_app else _app_full(new, max_series_per_app)
    if not max_series:
        return new.select("app", "series_key", "first_seq", F.when(F.col("app_full"), PER_APP).alias("reason"))
    room = max(0, max_series - known_total)
    # The arrival that spends the budget: everything seen after it is refused globally.
    spent = new.where(~F.col("app_full")).select("first_seq").orderBy("first_seq").limit(room).agg(F.max("first_seq").alias("last"), F.count("*").alias("n")).first()
    if spent.n < room:
        over = F.lit(False)
    else:
        over = F.col("first_seq") > (spent.last if spent.last is not None else -(1 << 62))
    reason = F.when(over, GLOBAL).when(F.col("app_full"), PER_APP)
    return new.select("app", "series_key", "first_seq", reason.alias("reason"))


def retention_plan(files: DataFrame, now_nanos: int, max_age_nanos: dict[str, int], budget_bytes: int | None = None, *, keep_undelivered: bool = False) -> DataFrame:
    """(signal, id, reason) of the files to drop.

    ``files`` has signal, id, newest_nanos, bytes and optionally delivered. First go files whose
    newest record is older than their signal's age; then, oldest first over all signals (ties by
    id, delivered files before others), as many as the byte budget asks for. With
    ``keep_undelivered`` no undelivered file goes for the budget.
    """
    if "delivered" not in files.columns:
        files = files.withColumn("delivered", F.lit(True))
    age = F.lit(None).cast("long")
    for signal, span in max_age_nanos.items():
        age = F.when(F.col("signal") == signal, F.lit(span)).otherwise(age)
    marked = files.withColumn("old", F.coalesce(F.col("newest_nanos") < F.lit(now_nanos) - age, F.lit(False)))
    out = marked.where("old").select("signal", "id", F.lit("age").alias("reason"))
    if budget_bytes is None:
        return out
    rest = marked.where("not old")
    total = rest.agg(F.sum("bytes").alias("b")).first().b or 0
    excess = total - budget_bytes
    if excess <= 0:
        return out
    allowed = rest.where("delivered") if keep_undelivered else rest
    w = Window.orderBy(F.col("delivered").desc(), "newest_nanos", "id").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file, not for each record
    before = F.coalesce(F.sum("bytes").over(w), F.lit(0))
    return out.unionByName(allowed.withColumn("before", before).where(F.col("before") < excess).select("signal", "id", F.lit("budget").alias("reason")))
