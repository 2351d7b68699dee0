"""The metric language: selectors, rate and increase, five aggregations, arithmetic, ``or``, a few functions.

``^`` binds like ``*`` and from the left; unary minus binds tighter than ``^``; ``or`` is loosest.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from heliotrace.errors import BadRequest, Unsupported
from heliotrace.functions.semantics import java_regex
from heliotrace.plans.lexer import Cursor
from heliotrace.plans.logql import Matcher

LOOKBACK = 300 * 10**9
MAX_DEPTH = 100
AGGREGATIONS = ("sum", "avg", "min", "max", "count")
NAME = "__name__"


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Selector:
    matchers: tuple[Matcher, ...]
    range: int = 0
    offset: int = 0


@dataclass(frozen=True)
class Rate:
    selector: Selector
    increase: bool


@dataclass(frozen=True)
class Aggregate:
    op: str
    by: tuple[str, ...] | None
    without: tuple[str, ...] | None
    inner: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Negate:
    inner: object


@dataclass(frozen=True)
class Absolute:
    inner: object


@dataclass(frozen=True)
class Clamp:
    upper: bool
    inner: object
    bound: object


@dataclass(frozen=True)
class Quantile:
    q: object
    inner: object


class _Parser:
    def __init__(self, text: str):
        self.c, self.depth = Cursor(text), 0

    def expression(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise BadRequest(f"the query nests deeper than {MAX_DEPTH}")
        left = self.additive()
        while self.c.now.kind == "name" and self.c.now.text in ("or", "and", "unless"):
            word = self.c.take().text
            if word != "or":
                raise Unsupported(word)
            left = Binary("or", left, self.additive())
        self.depth -= 1
        return left

    def additive(self):
        left = self.multiplicative()
        while op := self.c.accept("+", "-"):
            left = Binary(op.text, left, self.multiplicative())
        return left

    def multiplicative(self):
        left = self.unary()
        while op := self.c.accept("*", "/", "%", "^"):
            left = Binary(op.text, left, self.unary())
        return left

    def unary(self):
        minus = 0
        while op := self.c.accept("-", "+"):
            minus += op.text == "-"
        inner = self.postfix(self.atom())
        for _ in range(minus % 2):
            inner = Number(-inner.value) if isinstance(inner, Number) else Negate(inner)
        return inner

    def labels(self) -> tuple[str, ...]:
        self.c.expect("(")
        out = []
        while not self.c.accept(")"):
            out.append(self.c.kind("name", "a label name").text)
            if not self.c.accept(","):
                self.c.expect(")")
                break
        return tuple(out)

    def matchers(self) -> tuple[Matcher, ...]:
        self.c.expect("{")
        out = []
        while not self.c.accept("}"):
            name = self.c.kind("name", "a label name").text
            op = self.c.expect("=", "!=", "=~", "!~").text
            value = str(self.c.kind("string", "a quoted value").value)
            if op in ("=~", "!~"):
                java_regex(value)
            out.append(Matcher(name, op, value))
            if not self.c.accept(","):
                self.c.expect("}")
                break
        return tuple(out)

    def atom(self):
        c = self.c
        if c.now.kind == "number":
            return Number(float(c.take().value))
        if c.accept("("):
            inner = self.expression()
            c.expect(")")
            return inner
        if c.now.text == "{":
            matchers = self.matchers()
            if not matchers:
                raise BadRequest("an empty selector matches everything")
            return Selector(matchers)
        word = c.kind("name", "an expression").text
        if word.lower() in ("inf", "nan") and c.now.text != "{":
            return Number(float(word))
        if word in AGGREGATIONS and c.now.text in ("(", "by", "without"):
            return self.aggregate(word)
        if c.now.text == "(":
            return self.call(word)
        while c.now.text == ":" and c.peek().kind == "name":  # names of recording rules
            c.take()
            word += ":" + c.take().text
        return Selector((Matcher(NAME, "=", word), *(self.matchers() if c.now.text == "{" else ())))

    def aggregate(self, op: str):
        c, by, without = self.c, None, None

        def grouping():
            nonlocal by, without
            if c.accept("by"):
                by = self.labels()
            elif c.accept("without"):
                without = self.labels()

        grouping()
        c.expect("(")
        inner = self.expression()
        c.expect(")")
        if by is None and without is None:
            grouping()
        return Aggregate(op, by, without, inner)

    def call(self, name: str):
        arity = {"rate": 1, "increase": 1, "abs": 1, "clamp_min": 2, "clamp_max": 2, "histogram_quantile": 2}
        if name not in arity:
            raise Unsupported(f"function {name}")
        self.c.expect("(")
        arguments = [self.expression()]
        while self.c.accept(","):
            arguments.append(self.expression())
        self.c.expect(")")
        if len(arguments) != arity[name]:
            raise BadRequest(f"{name} takes {arity[name]} argument{'s' * (arity[name] > 1)}")
        if name in ("rate", "increase"):
            if not isinstance(arguments[0], Selector) or not arguments[0].range:
                raise BadRequest(f"{name} takes a selector with a range, such as x[5m]")
            return Rate(arguments[0], name == "increase")
        if name == "abs":
            return Absolute(arguments[0])
        if name == "histogram_quantile":
            return Quantile(*arguments)
        return Clamp(name == "clamp_max", *arguments)

    def postfix(self, inner):
        c = self.c
        while True:
            if c.accept("["):
                span = int(c.kind("duration", "a duration").value)
                if c.now.text == ":":
                    raise Unsupported("subquery")
                c.expect("]")
                if not isinstance(inner, Selector) or inner.range:
                    raise Unsupported("subquery") if not isinstance(inner, Selector) else BadRequest("a second range")
                inner = replace(inner, range=span)
            elif c.now.kind == "name" and c.now.text == "offset":
                c.take()
                if c.now.text == "-":
                    raise Unsupported("negative offset")
                span = int(c.kind("duration", "a duration").value)
                if isinstance(inner, Selector):
                    inner = replace(inner, offset=span)
                elif isinstance(inner, Rate):
                    inner = replace(inner, selector=replace(inner.selector, offset=span))
                else:
                    raise BadRequest("offset follows a selector")
            elif c.now.text == "@":
                raise Unsupported("@ modifier")
            else:
                return inner


def parse(text: str):
    p = _Parser(text)
    out = p.expression()
    p.c.finish()
    return out


def selectors(node) -> list[Selector]:
    if isinstance(node, Selector):
        return [node]
    return [s for v in vars(node).values() if hasattr(v, "__dataclass_fields__") for s in selectors(v)]


def lookback(node) -> int:
    """How far before an evaluation point samples can matter."""
    return max([LOOKBACK, *((s.range or LOOKBACK) + s.offset for s in selectors(node))])
