"""Parsers: what they read, what they refuse by name, and that they never fail in other ways."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliotrace.errors import BadRequest, QueryError, Unsupported
from heliotrace.functions import semantics as S
from heliotrace.plans import logql, promql, traceql
from heliotrace.plans.lexer import duration_nanos, tokenize


def test_log_query_parts():
    q = logql.parse('{app="a", level=~"w.*"} |= "x" != `y` | json | a="1" and b!="2" or c=~"3"')
    assert [m.op for m in q.matchers] == ["=", "=~"]
    assert [type(s).__name__ for s in q.stages] == ["LineFilter", "LineFilter", "Parser", "LabelFilter"]
    assert [len(g) for g in q.stages[-1].any_of] == [2, 1]


@pytest.mark.parametrize("text", ['rate({a="b"}[5m])', 'sum(rate({a="b"}[5m]))', 'count_over_time({a="b"}[1m])', '{a="b"} | line_format "x"', '{a="b"} | label_format x=y', '{a="b"} | unwrap x', '{a="b"} | pattern "x"', '{a="b"} | regexp "x"', '{a="b"} | drop x', '{a="b"} | keep x', '{a="b"} | decolorize', '{a="b"} | distinct x', '{a="b"} | json x="y"', '{a="b"} | status > 5', '{a="b"} | status = 5', '{a="b"} |= ip("1.2.3.4")'])
def test_log_refusals(text):
    with pytest.raises(Unsupported) as e:
        logql.parse(text)
    assert e.value.body()["error"]["feature"]


@pytest.mark.parametrize("text", ["{}", '{a=""}', '{a=~".*"}', '{a!="b"}', '{a="b"', '{a="b"} |=', '{a="b"} x', '{a=~"("}', '{a=~"(?=x)"}', r'{a=~"(x)\\1"}'])
def test_log_bad_requests(text):
    with pytest.raises(BadRequest):
        logql.parse(text)


def test_metric_precedence():
    n = promql.parse("2 * 3 ^ 2")  # the same level, from the left
    assert (n.op, n.left.op) == ("^", "*")
    assert promql.parse("-2 ^ 2").left.value == -2.0
    assert promql.parse("a or b + c").op == "or"
    by = promql.parse("sum by (x, y) (rate(m[5m] offset 1h))")
    assert by.by == ("x", "y") and by.inner.selector.offset == 3600 * 10**9
    assert promql.parse("sum(m) without (x)").without == ("x",)
    assert promql.lookback(promql.parse("rate(x[10m] offset 1h) + y")) == 70 * 60 * 10**9
    assert promql.lookback(promql.parse("x offset 1h")) == 65 * 60 * 10**9


@pytest.mark.parametrize("text", ["a and b", "a unless b", "topk(5, a)", "rate(a[5m:1m])", "a @ 5", "absent(a)", "a offset -5m", "(a + b)[5m]"])
def test_metric_refusals(text):
    with pytest.raises(Unsupported):
        promql.parse(text)


@pytest.mark.parametrize("text", ["up > 5", "rate(a)", "rate(1)", "", "a +", "(a", "sum a", "{}", "abs(a, b)", "a[5m", "(" * 200 + "1" + ")" * 200, ".5"])
def test_metric_bad_requests(text):
    with pytest.raises(BadRequest):
        promql.parse(text)


def test_trace_conditions():
    q = traceql.parse('{ resource.service.name = "x" && duration > 1.5s && .a.b != nil and status = error } | select(span.x)')
    assert [(c.scope, c.field) for c in q] == [("resource", "service.name"), ("intrinsic", "duration"), ("any", "a.b"), ("intrinsic", "status")]
    assert q[1].value == 1_500_000_000 and q[2].value is None
    assert traceql.parse("") == () == traceql.parse("{}")


@pytest.mark.parametrize("text", ['{ .a = "x" || .b = "y" }', '{ name !~ "x" }', "{ } | count() > 2", "{ rootName = `x` }", "{ traceDuration > 1s }", "{ .a = 1 } && { .b = 2 }"])
def test_trace_refusals(text):
    with pytest.raises(Unsupported):
        traceql.parse(text)


def test_durations_and_strings():
    assert duration_nanos("1h30m") == 5400 * 10**9
    assert [t.value for t in tokenize(r'"a\n\"b" `c\d`')[:2]] == ['a\n"b', "c\\d"]
    with pytest.raises(BadRequest):
        tokenize('"open')


ALPHABET = st.text(alphabet='{}()[]=~!|&"`\\.,+-*/%^ abjsonrate5mby\n', max_size=40)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_parsers_only_raise_query_errors(text):
    for parse in (logql.parse, promql.parse, traceql.parse):
        try:
            parse(text)
        except QueryError:
            pass


def test_scalar_arithmetic():
    assert S.scalar("/", 1.0, 0.0) == float("inf") and S.scalar("/", -1.0, 0.0) == float("-inf")
    assert str(S.scalar("/", 0.0, 0.0)) == str(S.scalar("%", 5.0, 0.0)) == str(S.scalar("^", -8.0, 0.5)) == "nan"
    assert S.scalar("%", -7.0, 3.0) == -1.0 and S.scalar("^", 0.0, -1.0) == float("inf")


def test_number_text():
    assert [S.format_number(x) for x in (60.0, 0.1, 1e20, float("nan"), float("inf"), -float("inf"))] == ["60", "0.1", "100000000000000000000", "NaN", "+Inf", "-Inf"]


def test_names():
    assert [S.sanitize_name(n) for n in ("a.b", "9x", "", "é-", "ok_1")] == ["a_b", "_x", "_", "__", "ok_1"]


@pytest.mark.parametrize("pattern", ["a*+b", "a++", "a?+", "x{2}+", "x{2,}+", "(?>a)b", r"a\Z", r"\Ga", r"\R", r"\\++"])
def test_java_only_patterns_are_refused(pattern):
    with pytest.raises(BadRequest):
        S.java_regex(pattern)


@pytest.mark.parametrize("pattern", ["[*+]+", r"a\++", r"a\*+", r"[a\]*+]+x", "a+?", "(a+)+", r"\[a+\]+", "[[:alpha:]+]+", "[]*+]+", r"\\+"])
def test_plain_patterns_are_not(pattern):
    assert S.java_regex(pattern)
