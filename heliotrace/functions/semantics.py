"""Scalar semantics that Spark does not have by itself, as JVM-side column expressions.

Regular expressions are given in the linear-time flavour (no look-around, no back-references),
translated to Java's; numbers follow IEEE 754; NaN compares as unequal to everything.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliotrace.errors import BadRequest, Unsupported

NUMBER = r"(?i)\A[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)\z"
_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "xdigit": "XDigit"}
NAN, INF = float("nan"), float("inf")


def java_regex(pattern: str) -> str:
    """The pattern in Java's flavour, refused where Java would silently accept more."""
    if re.search(r"(?<!\\)(?:\\\\)*\(\?(?:=|!|<=|<!|>)", pattern):
        raise BadRequest("look-around is not part of the regular expressions here", feature="look-around")
    if re.search(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)", pattern):
        raise BadRequest("back-references are not part of the regular expressions here", feature="back-reference")
    plain = re.sub(r"\[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]\\])*\]", "x", re.sub(r"\\[^\[\]]", "x", pattern))
    if re.search(r"(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})\+", plain):
        raise BadRequest("possessive quantifiers are not part of the regular expressions here", feature="possessive quantifier")
    if re.search(r"(?<!\\)(?:\\\\)*\\[ZGRXhHV]", pattern):
        raise BadRequest("an escape of the regular expression is not part of those here")
    for flags in re.findall(r"(?<!\\)\(\?([a-zA-Z-]+)[:)]", pattern):
        if set(flags) - set("imsx-"):
            raise BadRequest(f"regular expression flag in (?{flags}) is not supported")
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"\[:(\^?)(\w+):\]", lambda m: rf"\{'P' if m[1] else 'p'}{{{_POSIX.get(m[2], m[2])}}}", out)
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", re.sub(r"\\[pP]\{[^}]*\}|\\z|\\A", "x", out)))
    except re.error as e:
        raise BadRequest(f"invalid regular expression: {e}") from e
    return out


def full_match(value: Column, pattern: str) -> Column:
    return value.rlike(rf"(?dU)\A(?:{java_regex(pattern)})\z")


def search(value: Column, pattern: str) -> Column:
    return value.rlike(f"(?dU){java_regex(pattern)}")


def matches_empty(pattern: str) -> bool:
    """Whether the anchored pattern matches the empty string."""
    own = re.sub(r"\\[pP]\{[^}]*\}", "x", re.sub(r"\[:\^?\w+:\]", "x", pattern))
    try:
        return re.fullmatch(own, "") is not None
    except re.error as e:
        raise BadRequest(f"invalid regular expression: {e}") from e


def sanitize_name(name: str) -> str:
    out = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return (re.sub(r"\A[0-9]", "_", out)) or "_"


def sanitize(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), "^[0-9]", "_")
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*\\z"), name).when(name == "", F.lit("_")).otherwise(out)


def label_key(labels: Column) -> Column:
    """One text for each label set: maps are neither comparable nor join keys."""
    return F.to_json(F.array_sort(F.map_entries(labels)))


def label(labels: Column, name: str) -> Column:
    """A label's value; an absent label is the empty string."""
    return F.coalesce(F.element_at(labels, F.lit(name)), F.lit(""))


def relaxed(labels: Column, name: str) -> Column:
    """The value under the exact name, else under the first name in order that sanitises to the same."""
    same = F.array_sort(F.filter(F.map_keys(labels), lambda k: sanitize(k) == sanitize_name(name)))
    return F.coalesce(F.element_at(labels, F.lit(name)), F.element_at(labels, F.get(same, F.lit(0))))


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def merge(*maps: Column) -> Column:
    """Maps joined, later ones winning, whatever the session does with repeated keys."""
    out = maps[0]
    for m in maps[1:]:
        out = (lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))(out, m)
    return out


def to_map(entries: Column) -> Column:
    """A map of an array of (key, value); of a repeated key the last value stays, null keys go. Arrays without either are taken as they are."""

    def of(own: Column) -> Column:
        last = F.filter(own, lambda e, i: e["key"].isNotNull() & ~F.exists(F.slice(own, i + 2, F.size(own)), lambda x: x["key"] == e["key"]))
        keys = F.transform(own, lambda e: e["key"])
        plain = (F.size(F.array_distinct(keys)) == F.size(own)) & ~F.exists(keys, lambda k: k.isNull())
        return F.map_from_entries(F.when(plain, own).otherwise(last))

    own = F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>"))
    return F.element_at(F.transform(F.array(own), of), 1)  # bound once, as a lambda's variable


def keep_labels(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: k.isin(names)) if names else empty_map()


def drop_labels(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(names)) if names else labels


def parse_number(text: Column) -> Column:
    """A double where the text is a number by the strict grammar, else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _both(a, b) -> tuple[Column, Column]:
    return tuple(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))


def ieee_divide(a, b) -> Column:
    a, b = _both(a, b)
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def ieee_remainder(a, b) -> Column:
    a, b = _both(a, b)
    infinite = lambda x: F.abs(x) == INF
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | infinite(a), F.lit(NAN)).when(infinite(b), a).otherwise(F.try_mod(a, b))


def nan_min(value: Column) -> Column:
    """Least value that is a number; +Inf over NaN alone."""
    return F.coalesce(F.min(F.when(~F.isnan(value), value)), F.lit(INF))


def nan_max(value: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.lit(-INF))


def clamp_min(value: Column, bound: float) -> Column:
    return value if math.isnan(bound) else F.when(F.isnan(value), F.lit(bound)).otherwise(F.greatest(value, F.lit(bound)))


def clamp_max(value: Column, bound: float) -> Column:
    return value if math.isnan(bound) else F.when(F.isnan(value), F.lit(bound)).otherwise(F.least(value, F.lit(bound)))


def scalar(op: str, a: float, b: float) -> float:
    """IEEE arithmetic of two plain numbers."""
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        if b == 0:
            return NAN if a == 0 or math.isnan(a) else math.copysign(INF, a)
        return a / b
    if op == "%":
        return NAN if b == 0 or math.isinf(a) or math.isnan(a) or math.isnan(b) else math.fmod(a, b)
    try:
        out = a**b
        return NAN if isinstance(out, complex) else out
    except ZeroDivisionError:
        return INF
    except OverflowError:
        return -INF if a < 0 and b == int(b) and int(b) % 2 else INF


def arithmetic(op: str, a, b) -> Column:
    if op == "/":
        return ieee_divide(a, b)
    if op == "%":
        return ieee_remainder(a, b)
    a, b = _both(a, b)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: F.pow(a, b)}[op]()


def format_number(value: float) -> str:
    """Shortest round-trip text without an exponent or a trailing ``.0``; NaN, +Inf, -Inf."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "+Inf" if value > 0 else "-Inf"
    from decimal import Decimal

    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text
