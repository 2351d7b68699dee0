"""Metric expressions evaluated on a grid of times, without a range join.

Point k of a grid is ``start + k * step``, and a last point lies at ``end`` even off the grid. A
sample at ts with window w and offset o counts at the points of [ts + o, ts + o + w): two integer
divisions give the first and last k, and one explode deals the sample to them. Everything after
that is aggregation on (series, k); the samples are read once for all points. Rates are summed up
before the explode, over samples that the same points see.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotrace.errors import BadRequest, LimitExceeded
from heliotrace.functions import partitions
from heliotrace.functions import semantics as S
from heliotrace.operators.logs import in_range, matches
from heliotrace.plans import promql

MAX_STEPS = 11_000
SLOTS = 32
COLUMNS = ("k", "labels", "labels_key", "value", "name")


@dataclass(frozen=True)
class Grid:
    """Evaluation times: start, start + step, ..., and end."""

    start: int
    end: int
    step: int

    def __post_init__(self):
        if self.step <= 0:
            raise BadRequest("step must be positive")
        if self.end < self.start:
            raise BadRequest("end is before start")
        if (self.end - self.start) // self.step + 1 > MAX_STEPS:
            raise LimitExceeded(f"more than {MAX_STEPS} steps", hint="raise the step")

    @property
    def regular(self) -> int:
        return (self.end - self.start) // self.step + 1

    @property
    def extra(self) -> bool:
        return (self.end - self.start) % self.step != 0

    def time(self, k: Column) -> Column:
        return F.when(k >= self.regular, F.lit(self.end)).otherwise(F.lit(self.start) + k * F.lit(self.step))

    def points(self, spark) -> DataFrame:
        return spark.range(self.regular + self.extra).select(F.col("id").alias("k"))

    def bounds(self, ts: Column, window: int) -> tuple[Column, Column, Column]:
        """First and last regular point at which a sample whose time (offset included) is ts counts, and whether an end off the grid counts it; none of them falls as ts grows."""
        step, start = F.lit(self.step), F.lit(self.start)
        ahead = ts - start
        first = F.greatest(F.lit(0).cast("long"), F.when(ahead > 0, _div(ahead + step - 1, step)).otherwise(F.lit(0).cast("long")))
        room = ts + F.lit(window - 1) - start
        last = F.least(F.lit(self.regular - 1).cast("long"), F.when(room >= 0, _div(room, step)).otherwise(F.lit(-1).cast("long")))
        return first, last, (ts <= self.end) & (ts > self.end - window) if self.extra else F.lit(False)

    def between(self, first: Column, last: Column, at_end: Column) -> Column:
        """The points of such bounds."""
        none = F.array().cast("array<bigint>")
        own = F.when(first <= last, F.sequence(first, last)).otherwise(none)
        return F.concat(own, F.when(at_end, F.array(F.lit(self.regular).cast("long"))).otherwise(none)) if self.extra else own

    def visible(self, ts: Column, window: int) -> Column:
        """The points at which a sample whose time (offset included) is ts counts."""
        return self.between(*self.bounds(ts, window))


def _div(a: Column, b: Column) -> Column:
    """Integer division of longs that are not negative, exact beyond 2^53."""
    whole = a - F.pmod(a, b)
    return (whole.cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long")


def _rise(before: Column, value: Column) -> Column:
    """What a counter has risen by since the sample before; a fall is a start from 0."""
    return F.when(before.isNull(), F.lit(0.0)).when((value < before) & ~F.isnan(before), value).otherwise(value - before)


def select_samples(df: DataFrame, matchers) -> DataFrame:
    return df.where(reduce(Column.__and__, (matches(S.label(F.col("labels"), m.name), m.op, m.value) for m in matchers))) if matchers else df


class Evaluator:
    """Turns an expression into a DataFrame of (k, labels, labels_key, value, name), or a plain number.

    ``name`` is the metric's name that the labels have lost: samples of several metrics may have equal
    labels at one point, and then the first by name is the one that a right side matches with.
    """

    def __init__(self, samples: DataFrame, grid: Grid):
        self.samples, self.grid, self.spark = samples, grid, samples.sparkSession

    def eval(self, node) -> DataFrame | float:
        return getattr(self, "_" + type(node).__name__.lower())(node)

    @cached_property
    def _bytes(self) -> int | None:
        return partitions.source_bytes(self.samples)

    def _seen(self, s: promql.Selector, window: int) -> DataFrame:
        """(series, labels, seq, value, ts): the samples that points may see; the range is cut here."""
        g = self.grid
        df = in_range(select_samples(self.samples, s.matchers), g.start - s.offset - window + 1, g.end - s.offset)
        return df.select(S.label_key(F.col("labels")).alias("series"), "labels", "seq", "value", (F.col("timestamp_nanos") + F.lit(s.offset)).alias("ts"))

    def _dealt(self, s: promql.Selector, window: int) -> DataFrame:
        """(series, k, ts, seq, value): each sample at each point that sees it."""
        return self._seen(s, window).withColumn("k", F.explode(self.grid.visible(F.col("ts"), window)))

    def _finish(self, df: DataFrame, value: Column) -> DataFrame:
        labels = S.drop_labels(F.col("labels"), [promql.NAME])
        return df.select("k", labels.alias("labels"), S.label_key(labels).alias("labels_key"), value.alias("value"), S.label(F.col("labels"), promql.NAME).alias("name"))

    def _selector(self, s: promql.Selector) -> DataFrame:
        newest = self._dealt(s, promql.LOOKBACK).groupBy("series", "k").agg(F.max_by("value", F.struct("ts", "seq")).alias("v"), F.first("labels").alias("labels"))
        return self._finish(newest, F.col("v"))

    def _panes(self, s: promql.Selector) -> DataFrame:
        """One row for the samples of a series that the same points see, in slots of a 32nd of the range: their bounds, times, first and last value and the rises between them."""
        first, last, at_end = self.grid.bounds(F.col("ts"), s.range)
        df = self._seen(s, s.range).withColumns({"first": first, "last": last, "at_end": at_end, "slot": F.col("ts") - F.pmod(F.col("ts"), F.lit(max(1, s.range // SLOTS)))})
        df = partitions.spread(df.where((F.col("first") <= F.col("last")) | F.col("at_end")), self._bytes, "series", "slot")
        pane = ("slot", "first", "last", "at_end", "series")
        w = Window.partitionBy(*pane).orderBy("ts", "seq")
        rows = df.withColumns({"before": F.lag("value").over(w), "i": F.row_number().over(w), "after": F.lead("ts").over(w)})
        v = F.col("value")
        return rows.groupBy(*pane).agg(
            F.sum(_rise(F.col("before"), v)).alias("rise"), F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"),
            F.max(F.when(F.col("i") == 1, v)).alias("head"), F.max(F.when(F.col("after").isNull(), v)).alias("tail"), F.first("labels").alias("labels"),
        )

    def _rate(self, r: promql.Rate) -> DataFrame:
        g, window = self.grid, r.selector.range
        seen = min(g.regular + g.extra, -(-window // g.step), 8)  # panes of a point: few, or as many as samples
        dealt = self._panes(r.selector).withColumn("k", F.explode(g.between(F.col("first"), F.col("last"), F.col("at_end"))))
        dealt = partitions.spread(dealt, self._bytes and self._bytes * seen, "series", "k")
        jump = _rise(F.lag("tail").over(Window.partitionBy("k", "series").orderBy("low")), F.col("head"))
        sums = dealt.withColumn("jump", jump).groupBy("k", "series").agg((F.sum("rise") + F.sum("jump")).alias("rise"), F.sum("n").alias("n"), (F.max("high") - F.min("low")).alias("span"), F.first("labels").alias("labels"))
        rate = F.col("rise") / (F.col("span") / F.lit(1e9))
        return self._finish(sums.where("n >= 2 and span > 0"), rate * F.lit(window / 1e9) if r.increase else rate)

    def _number(self, node: promql.Number) -> float:
        return node.value

    def _vector(self, value: DataFrame | float) -> DataFrame:
        """A plain number as one sample without labels at each point."""
        if isinstance(value, DataFrame):
            return value
        return self.grid.points(self.spark).select("k", S.empty_map().alias("labels"), F.lit("[]").alias("labels_key"), F.lit(float(value)).alias("value"), F.lit("").alias("name"))

    def _map(self, value, column, plain):
        return plain(value) if not isinstance(value, DataFrame) else value.withColumn("value", column(F.col("value")))

    def _negate(self, node):
        return self._map(self.eval(node.inner), lambda v: -v, lambda v: -v)

    def _absolute(self, node):
        return self._map(self._vector(self.eval(node.inner)), F.abs, abs)

    def _clamp(self, node):
        bound = self.eval(node.bound)
        if isinstance(bound, DataFrame):
            raise BadRequest("the bound of clamp_min and clamp_max is a number")
        clamp = S.clamp_max if node.upper else S.clamp_min
        return self._map(self._vector(self.eval(node.inner)), lambda v: clamp(v, bound), float)

    def _aggregate(self, node: promql.Aggregate) -> DataFrame:
        inner = self._vector(self.eval(node.inner))
        labels = F.col("labels")
        group = S.keep_labels(labels, list(node.by)) if node.by is not None else S.drop_labels(labels, list(node.without)) if node.without is not None else S.empty_map()
        v = F.col("value")
        value = {"sum": F.sum(v), "avg": F.sum(v) / F.count("*"), "min": S.nan_min(v), "max": S.nan_max(v), "count": F.count("*").cast("double")}[node.op]
        keyed = inner.select("k", group.alias("labels"), S.label_key(group).alias("labels_key"), "value")
        return keyed.groupBy("k", "labels_key").agg(F.first("labels").alias("labels"), value.alias("value"), F.lit("").alias("name")).select(*COLUMNS)

    def _binary(self, node: promql.Binary):
        left, right = self.eval(node.left), self.eval(node.right)
        if node.op == "or":
            left, right = self._vector(left), self._vector(right)
            first = right.groupBy("k", "labels_key").agg(F.first("labels").alias("labels"), F.min_by("value", "name").alias("value"), F.min("name").alias("name")).select(*COLUMNS)
            return left.unionByName(first.join(left.select("k", "labels_key").distinct(), ["k", "labels_key"], "left_anti"))
        frames = isinstance(left, DataFrame), isinstance(right, DataFrame)
        if frames == (False, False):
            return S.scalar(node.op, left, right)
        if frames == (True, False):
            return left.withColumn("value", S.arithmetic(node.op, F.col("value"), right))
        if frames == (False, True):
            return right.withColumn("value", S.arithmetic(node.op, left, F.col("value")))
        other = right.groupBy("k", "labels_key").agg(F.min_by("value", "name").alias("right_value"))
        return left.join(other, ["k", "labels_key"]).withColumn("value", S.arithmetic(node.op, F.col("value"), F.col("right_value"))).select(*COLUMNS)

    def _quantile(self, node: promql.Quantile) -> DataFrame:
        q = self.eval(node.q)
        inner = self._vector(self.eval(node.inner))
        if isinstance(q, DataFrame):
            raise BadRequest("the quantile is a number")
        rest = S.drop_labels(F.col("labels"), ["le", promql.NAME])
        le = S.label(F.col("labels"), "le")
        bound = F.when(le == "+Inf", F.lit(S.INF)).otherwise(S.parse_number(le))
        rows = inner.select("k", rest.alias("labels"), S.label_key(rest).alias("labels_key"), bound.alias("bound"), "value").where("bound is not null")
        if not 0 <= q <= 1:  # NaN too: one row for each input series
            return rows.select("k", "labels", "labels_key", F.lit(-S.INF if q < 0 else S.INF).alias("value"), F.lit("").alias("name"))
        buckets = rows.groupBy("k", "labels_key").agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("bound", F.col("value").alias("count")))).alias("b"))
        total = F.element_at("b", -1)["count"]
        buckets = buckets.withColumn("wanted", total * F.lit(float(q))).where((total > 0) & ~F.isnan(total))
        hit = F.filter(F.sequence(F.lit(1), F.size("b")), lambda i: (F.element_at("b", i)["count"] >= F.col("wanted")) & ~F.isnan(F.element_at("b", i)["count"]))
        buckets = buckets.withColumn("i", F.get(hit, F.lit(0))).where("i is not null")
        here = F.element_at("b", F.col("i"))
        before = F.when(F.col("i") > 1, F.get("b", F.col("i") - 2))
        low, low_count = F.coalesce(before["bound"], F.lit(0.0)), F.coalesce(before["count"], F.lit(0.0))
        inside = here["count"] - low_count
        value = F.when(here["bound"] == S.INF, low).when(inside <= 0, here["bound"]).otherwise(low + (here["bound"] - low) * F.try_divide(F.col("wanted") - low_count, inside))
        return buckets.select("k", "labels", "labels_key", value.alias("value"), F.lit("").alias("name"))


def instant(samples: DataFrame, text: str, at: int) -> DataFrame:
    """(labels, labels_key, value) at one time; a plain number is one sample without labels."""
    e = Evaluator(samples, Grid(at, at, 1))
    return e._vector(e.eval(promql.parse(text))).select("labels", "labels_key", "value")


def query_range(samples: DataFrame, text: str, start: int, end: int, step: int) -> DataFrame:
    """(timestamp_nanos, labels, labels_key, value) at every point of the grid; a plain number gives no rows."""
    grid = Grid(start, end, step)
    e = Evaluator(samples, grid)
    value = e.eval(promql.parse(text))
    rows = e._vector(value) if isinstance(value, DataFrame) else e._vector(0.0).limit(0)
    return rows.select(grid.time(F.col("k")).alias("timestamp_nanos"), "labels", "labels_key", "value")
