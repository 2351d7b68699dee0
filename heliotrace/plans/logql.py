"""The log language: a stream selector and a pipeline of line filters, parsers and label filters."""

from __future__ import annotations

from dataclasses import dataclass

from heliotrace.errors import BadRequest, Unsupported
from heliotrace.functions.semantics import java_regex, matches_empty
from heliotrace.plans.lexer import Cursor

METRIC_QUERIES = {
    "rate", "count_over_time", "bytes_rate", "bytes_over_time", "absent_over_time", "sum_over_time", "avg_over_time", "max_over_time", "min_over_time",
    "first_over_time", "last_over_time", "quantile_over_time", "stddev_over_time", "stdvar_over_time", "rate_counter",
    "sum", "avg", "min", "max", "count", "topk", "bottomk", "stddev", "stdvar", "sort", "sort_desc",
}
REFUSED_STAGES = {"line_format", "label_format", "unwrap", "pattern", "regexp", "drop", "keep", "decolorize", "distinct", "unpack"}


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str
    value: str

    @property
    def selective(self) -> bool:
        return (self.op == "=" and self.value != "") or (self.op == "=~" and not matches_empty(self.value))


@dataclass(frozen=True)
class LineFilter:
    op: str
    value: str


@dataclass(frozen=True)
class Parser:
    kind: str


@dataclass(frozen=True)
class LabelFilter:
    """Alternatives of conjunctions: ``and`` binds tighter than ``or``."""

    any_of: tuple[tuple[Matcher, ...], ...]


@dataclass(frozen=True)
class LogQuery:
    matchers: tuple[Matcher, ...]
    stages: tuple[LineFilter | Parser | LabelFilter, ...]


def selector(c: Cursor) -> tuple[Matcher, ...]:
    c.expect("{")
    out = []
    while not c.accept("}"):
        name = c.kind("name", "a label name").text
        op = c.expect("=", "!=", "=~", "!~").text
        value = str(c.kind("string", "a quoted value").value)
        if op in ("=~", "!~"):
            java_regex(value)
        out.append(Matcher(name, op, value))
        if not c.accept(","):
            c.expect("}")
            break
    return tuple(out)


def _condition(c: Cursor) -> Matcher:
    if c.now.text == "(":
        raise Unsupported("parentheses in a label filter")
    name = c.kind("name", "a label name").text
    if name == "ip" or c.now.text in ("==", ">", "<", ">=", "<="):
        raise Unsupported("ip filter" if name == "ip" else "numeric label filter")
    op = c.expect("=", "!=", "=~", "!~").text
    if c.now.kind in ("number", "duration"):
        raise Unsupported("numeric label filter")
    if c.now.text == "ip":
        raise Unsupported("ip filter")
    value = str(c.kind("string", "a quoted value").value)
    if op in ("=~", "!~"):
        java_regex(value)
    return Matcher(name, op, value)


def _stage(c: Cursor) -> Parser | LabelFilter:
    word = c.now.text
    if word in ("json", "logfmt") and c.peek().text not in ("=", "!=", "=~", "!~"):
        c.take()
        if c.now.kind == "name":
            raise Unsupported(f"{word} with expressions")
        return Parser(word)
    if word in REFUSED_STAGES and c.peek().text not in ("=", "!=", "=~", "!~"):
        raise Unsupported(word)
    alternatives, current = [], [_condition(c)]
    while True:
        if c.accept("and", ","):
            current.append(_condition(c))
        elif c.accept("or"):
            alternatives.append(tuple(current))
            current = [_condition(c)]
        else:
            return LabelFilter((*alternatives, tuple(current)))


def parse(text: str) -> LogQuery:
    c = Cursor(text)
    if c.now.kind == "name" and c.now.text in METRIC_QUERIES:
        raise Unsupported(f"metric query {c.now.text}", "query the metrics language instead")
    matchers = selector(c)
    if not any(m.selective for m in matchers):
        raise BadRequest("a selector needs at least one matcher that does not match the empty string")
    stages: list[LineFilter | Parser | LabelFilter] = []
    while c.now.kind != "end":
        if op := c.accept("|=", "!=", "|~", "!~"):
            if c.now.text == "ip":
                raise Unsupported("ip filter")
            value = str(c.kind("string", "a quoted pattern").value)
            if op.text in ("|~", "!~"):
                java_regex(value)
            stages.append(LineFilter(op.text, value))
        elif c.accept("|"):
            stages.append(_stage(c))
        else:
            c.finish()
    return LogQuery(matchers, tuple(stages))
