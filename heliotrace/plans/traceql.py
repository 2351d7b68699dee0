"""The trace language: one set of span conditions joined by ``&&``."""

from __future__ import annotations

from dataclasses import dataclass

from heliotrace.errors import BadRequest, Unsupported
from heliotrace.functions.semantics import java_regex
from heliotrace.plans.lexer import Cursor

INTRINSICS = ("duration", "status", "kind", "name")
REFUSED = ("rootName", "rootServiceName", "traceDuration")


@dataclass(frozen=True)
class Condition:
    """scope: intrinsic, resource, span or any; value: text, float, nanoseconds (int), or None for nil."""

    scope: str
    field: str
    op: str
    value: str | float | int | None


def _field(c: Cursor) -> tuple[str, str]:
    scope = "any"
    if c.accept("."):
        pass
    elif c.now.text in ("resource", "span") and c.peek().text == ".":
        scope = c.take().text
        c.take()
    name = c.kind("name", "a field").text
    if name in REFUSED and scope == "any":
        raise Unsupported(name)
    bare = scope == "any" and c.tokens[c.at - 2].text != "."
    while c.now.text in (".", "-", ":", "/") and c.peek().kind == "name" and c.now.at == c.tokens[c.at - 1].at + len(c.tokens[c.at - 1].text):
        name += c.take().text + c.take().text
        bare = False
    return ("intrinsic" if bare and name in INTRINSICS else scope), name


def _value(c: Cursor) -> str | float | int | None:
    token = c.now
    if token.kind in ("string", "number", "duration"):
        c.take()
        return token.value  # type: ignore[return-value]
    if c.accept("-"):
        return -float(c.kind("number", "a number").value)  # type: ignore[arg-type]
    word = c.kind("name", "a value").text
    return None if word == "nil" else word


def parse(text: str) -> tuple[Condition, ...]:
    if not text.strip():
        return ()
    c = Cursor(text)
    c.expect("{")
    out = []
    while not c.accept("}"):
        scope, name = _field(c)
        if c.now.text == "!~":
            raise Unsupported("!~")
        op = c.expect("=", "!=", ">", "<", ">=", "<=", "=~").text
        value = _value(c)
        if op == "=~":
            if not isinstance(value, str):
                raise BadRequest("=~ takes a quoted pattern")
            java_regex(value)
        out.append(Condition(scope, name, op, value))
        if c.now.text == "||":
            raise Unsupported("||")
        if c.accept("&&", "and"):
            continue
        c.expect("}")
        break
    if c.accept("|"):
        word = c.kind("name", "a stage").text
        if word != "select":
            raise Unsupported(f"| {word}")
        c.expect("(")
        while not c.accept(")"):
            if c.now.kind == "end":
                raise BadRequest("expected ) at the end of the query")
            c.take()
    if c.now.text in ("&&", "||", ">", ">>", "<", "~", "{"):
        raise Unsupported("a second set of spans")
    c.finish()
    return tuple(out)
