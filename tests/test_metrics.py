"""Known answers of the metric evaluator."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from heliotrace import views as V
from heliotrace.errors import BadRequest, LimitExceeded
from heliotrace.functions import partitions
from heliotrace.operators import metrics

T0, S = 1_750_000_000 * 10**9, 10**9


@pytest.fixture
def ask(spark):
    def run(samples, text, at):
        rows = [(T0 + t * S, i, labels, float(v)) for i, (labels, t, v) in enumerate(samples)]
        df = spark.createDataFrame(rows, "timestamp_nanos bigint, seq bigint, labels map<string,string>, value double")
        return {tuple(sorted(r.labels.items())): r.value for r in metrics.instant(df, text, T0 + at * S).collect()}

    return run


def x(t, v, **labels):
    return ({"__name__": "x", **labels}, t, v)


APP = lambda a: (("app", a),)


def test_newest_in_five_minutes(ask):
    up = [x(0, 1, app="checkout"), x(30, 2, app="checkout"), x(0, 5, app="cart")]
    assert ask(up, "x", 60) == {APP("checkout"): 2, APP("cart"): 5}
    assert ask(up[:1], "x", 299) and not ask(up[:1], "x", 300) and not ask(up[:1], "x", 400)


def test_rates(ask):
    climb = [x(0, 0), x(30, 30), x(60, 60)]
    assert ask(climb, "rate(x[60s])", 60) == {(): 1.0}  # the sample at the window's open end is out
    assert ask(climb, "increase(x[120s])", 60) == {(): 120.0}
    assert ask([x(0, 1), x(0, 2)], "rate(x[60s])", 60) == {}
    assert ask([x(0, 100), x(30, 150), x(40, 10), x(60, 25)], "rate(x[70s])", 60) == {(): pytest.approx(75 / 60)}


def test_aggregations(ask):
    up = [x(0, v, app=a) for a, v in (("a", 1), ("b", 2), ("c", 4))]
    assert [ask(up, f"{op}(x)", 0)[()] for op in ("sum", "count", "min", "max", "avg")] == [7, 3, 1, 4, pytest.approx(7 / 3)]
    assert ask([], "sum(x)", 0) == {}
    assert ask([x(0, math.nan)], "min(x)", 0) == {(): math.inf} and ask([x(0, math.nan), x(0, 3, a="b")], "max(x)", 0) == {(): 3}
    assert ask([x(0, 1, a="1", b="2"), x(0, 2, a="1")], "sum by (b) (x)", 0) == {(("b", "2"),): 1, (): 2}


def test_counter_increase_form(ask):
    text = "clamp_min(x - (x offset 5m or x * 0), 0)"
    assert ask([x(0, 42)], text, 0) == {(): 42}
    assert ask([x(0, 100, app="checkout"), x(300, 250, app="checkout")], text, 300) == {APP("checkout"): 150}
    assert ask([x(0, 10), x(300, 50)], "x - (x offset 5m)", 300) == {(): 40}


def test_quantiles(ask):
    b = [({"__name__": "b", "le": le, "app": "a"}, 0, v) for le, v in (("0.1", 50), ("0.5", 90), ("+Inf", 100))]
    assert ask(b, "histogram_quantile(0.5, b)", 0)[APP("a")] == pytest.approx(0.1)
    assert ask(b, "histogram_quantile(0.9, b)", 0)[APP("a")] == pytest.approx(0.5)
    assert ask(b, "histogram_quantile(0.99, b)", 0)[APP("a")] == 0.5
    assert ask(b, "histogram_quantile(2, b)", 0) == {APP("a"): math.inf}
    assert ask([({"__name__": "b", "le": "+Inf"}, 0, 0)], "histogram_quantile(0.5, b)", 0) == {}


def test_matching_and_arithmetic(ask):
    ab = [({"__name__": "a", "app": "checkout"}, 0, 10), ({"__name__": "a", "app": "cart"}, 0, 7), ({"__name__": "b", "app": "checkout"}, 0, 4)]
    assert ask(ab, "a - b", 0) == {APP("checkout"): 6}
    assert ask(ab, "b or a", 0) == {APP("checkout"): 4, APP("cart"): 7}
    assert ask(ab, "a / 0", 0) == {APP("checkout"): math.inf, APP("cart"): math.inf}
    assert math.isnan(ask(ab, "a % 0", 0)[APP("cart")])
    assert ask(ab, "2 ^ 3", 0) == {(): 8}
    assert ask([x(0, math.nan)], "clamp_max(x, 5)", 0) == {(): 5}
    assert ask([x(0, -3)], "abs(x)", 0) == {(): 3} and ask([x(0, -3)], "-x", 0) == {(): 3}


def test_grid(spark):
    df = spark.createDataFrame([(T0, 0, {"__name__": "x"}, 1.0)], "timestamp_nanos bigint, seq bigint, labels map<string,string>, value double")
    times = sorted((r.timestamp_nanos - T0) // S for r in metrics.query_range(df, "x", T0, T0 + 25 * S, 10 * S).collect())
    assert times == [0, 10, 20, 25]
    assert metrics.query_range(df, "1 + 1", T0, T0 + S, S).count() == 0
    with pytest.raises(LimitExceeded):
        metrics.Grid(0, 12_000, 1)
    with pytest.raises(BadRequest):
        metrics.Grid(0, 1, 0)


def test_grid_positions_match_brute_force(spark):
    g = metrics.Grid(1_000, 1_095, 10)
    times = [*range(1_000, 1_091, 10), 1_095]
    rows = spark.range(880, 1_100).select(F.col("id"), g.visible(F.col("id"), 37).alias("k")).collect()
    for r in rows:
        assert sorted(r.k) == [i for i, at in enumerate(times) if r.id <= at < r.id + 37]


def test_plan_reads_once_and_prunes(spark):
    df = spark.range(10).select((F.col("id") * S).alias("timestamp_nanos"), F.col("id").alias("seq"), F.create_map(F.lit("__name__"), F.lit("x")).alias("labels"), F.lit(1.0).alias("value"))
    plan = metrics.instant(df, "sum(x)", 5 * S)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "Join" not in plan


def test_first_metric_by_name_matches(spark):
    """Two metrics have equal labels once their names are gone: a right side matches with the first by name, not with the least value."""
    rows = [(T0, 0, {"__name__": "a", "x": "1"}, 10.0), (T0, 1, {"__name__": "b", "x": "1"}, 3.0)]
    df = spark.createDataFrame(rows, "timestamp_nanos bigint, seq bigint, labels map<string,string>, value double")
    values = lambda text: sorted(r.value for r in metrics.instant(df, text, T0).collect())
    assert values('a - {x="1"}') == [0.0] and values('b - {x="1"}') == [-7.0] and values('{x="1"} - {x="1"}') == [-7.0, 0.0]
    assert values('c or {x="1"}') == [10.0] and values('{x="1"} or a') == [3.0, 10.0]


SAMPLES = "timestamp_nanos bigint, seq bigint, labels map<string,string>, value double"


def brute_rates(rows, times, window):
    """(time, app) -> rate, sample by sample."""
    out = {}
    for at in times:
        by = {}
        for t, i, labels, v in sorted(rows, key=lambda r: r[:2]):
            if at - window < t <= at:
                by.setdefault(labels["app"], []).append((t, v))
        for app, own in by.items():
            span = own[-1][0] - own[0][0]
            pairs = [(a, b) for (_, a), (_, b) in zip(own, own[1:], strict=False) if a is not None and b is not None]
            rise = sum(b if not math.isnan(a) and (b < a and not math.isnan(b)) else b - a for a, b in pairs)
            if len(own) > 1 and span > 0:
                out[at, app] = rise / (span / 1e9)
    return out


@pytest.mark.parametrize(("window", "step"), [(40, 10), (45, 10), (7, 10), (100, 10), (1, 1), (33, 50)])
def test_rates_by_panes_match_brute_force(spark, window, step):
    """Resets, gaps, ties in time, nulls, NaN, windows that are no multiple of the step, an end off the grid."""
    draw, rows = random.Random(window * step), []
    for i in range(400):
        t, app = draw.randrange(-60, 240), draw.choice("ab")
        v = None if i % 41 == 0 else math.nan if i % 67 == 0 and app == "b" else float(draw.randrange(50))
        rows.append((T0 + t * S, i, {"__name__": "x", "app": app}, v))
    end = T0 + 205 * S if step > 1 else T0 + 200 * S
    times = sorted({*range(T0, end + 1, step * S), end})
    df = metrics.query_range(spark.createDataFrame(rows, SAMPLES), f"rate(x[{window}s])", T0, end, step * S)
    got = {(r.timestamp_nanos, r.labels["app"]): r.value for r in df.collect()}
    assert got == pytest.approx(brute_rates(rows, times, window * S), nan_ok=True) and (got or window == 1)


def test_rates_are_summed_before_points_see_them(spark, tmp_path):
    """Samples are sorted once, not once for each point, and a series is dealt over tasks; both grew with windows and density."""
    rows = spark.range(20_000).select((F.lit(T0) + F.col("id") * S).alias("timestamp_nanos"), F.col("id").alias("seq"), F.create_map(F.lit("__name__"), F.lit("x")).alias("labels"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(f"{tmp_path}/x")
    ask = lambda: metrics.query_range(spark.read.parquet(f"{tmp_path}/x"), "rate(x[8000s])", T0, T0 + 20_000 * S, 1_000 * S)
    plan = ask()._jdf.queryExecution().optimizedPlan().toString()
    kinds = [k for line in plan.splitlines() for k in ("Window", "Generate") if line.lstrip(" :+-").startswith(k)]
    assert kinds == ["Window", "Generate", "Window"]
    e = metrics.Evaluator(spark.read.parquet(f"{tmp_path}/x"), metrics.Grid(T0, T0 + 20_000 * S, 1_000 * S))
    panes = e._panes(metrics.promql.parse("rate(x[8000s])").selector)
    shares = [r["n"] for r in panes.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
    assert sum(shares) == 20_000 and max(shares) < 8_000


def test_partitions_follow_the_sources(spark, tmp_path):
    assert [partitions.count_for(n << 20) for n in (0, 1, 100, 720, 3_200, 6_400)] == [12, 12, 25, 180, 200, 400]
    spark.range(1_000).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    assert 0 < partitions.source_bytes(t.join(t, "id")) < 1 << 20
    assert partitions.source_bytes(spark.createDataFrame([(1,)], "id bigint").union(t)) is None
    assert partitions.spread(t, 100 << 20, "id").rdd.getNumPartitions() == 25


def test_counter_numbers_events_in_many_tasks(spark, tmp_path):
    """Of one app and event type: before, all events met in one task. Events without a time, a user or a type are numbered as well."""
    at = lambda i: f"2024-01-{1 + i // 24 % 28:02d} {i % 24:02d}:30:00"
    rows = [(i, None if i % 97 == 0 else at(i * 7), None if i % 89 == 0 else 5, None if i % 83 == 0 else "click", 1.0, '{"k": 1}') for i in range(3_000)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = V.counter(spark, str(tmp_path))
    shares = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("value")).collect()]
    assert sum(shares) == 3_000 and max(shares) < 1_000
    groups = {}
    for i, t, user, kind, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0])):
        groups.setdefault((None if user is None else "app-0", kind), []).append(i)
    want = {i: float(n % 200 + 1) for own in groups.values() for n, i in enumerate(own)}
    assert {r.seq: r.value for r in got.collect()} == want


@pytest.mark.parametrize("name", ["prom_vector_arith", "prom_sum_by", "prom_sum_without"])
def test_queries_sort_events_before_points_see_them(spark, name):
    """Below each explode to points there is the sort for rates, besides those that number the events."""
    from heliotrace.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i in [i for i, line in enumerate(plan) if line.lstrip(" :+-").startswith("Generate")]:
        below = list(itertools.takewhile(lambda line: depth(line) > depth(plan[i]), plan[i + 1 :]))
        assert sum(line.lstrip(" :+-").startswith("Window") for line in below) == 3  # rates, numbers within hours, hours before
