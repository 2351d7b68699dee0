"""Fields of log lines as maps, by Arrow-batched functions, for what no built-in expression can say."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from heliotrace.functions.semantics import sanitize_name

MAX_DEPTH = 128


def _not_json(constant: str) -> None:
    raise ValueError(constant)


def json_fields(line: str | None) -> dict[str, str]:
    """Nested objects flattened by ``_``; nulls skipped; arrays and scalars as compact JSON text; a repeated key keeps its last value."""
    try:
        top = json.loads(line or "", parse_constant=_not_json)
    except (ValueError, RecursionError):
        return {}
    out: dict[str, str] = {}

    def walk(value: object, path: str, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise RecursionError
        if isinstance(value, dict):
            for k in sorted(value):
                walk(value[k], f"{path}_{sanitize_name(k)}" if path else sanitize_name(k), depth + 1)
        elif isinstance(value, list):
            out[path] = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        elif value is not None:
            out[path] = value if isinstance(value, str) else json.dumps(value)

    try:
        if isinstance(top, dict):
            walk(top, "", 0)
    except RecursionError:
        return {}
    return out


def logfmt_fields(line: str | None) -> dict[str, str]:
    """``k=v``, ``k="quoted"`` with escapes, bare ``k`` as empty; an open quote runs to the end."""
    out: dict[str, str] = {}
    text, at = line or "", 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        begin = at
        while at < len(text) and text[at] != "=" and not text[at].isspace():
            at += 1
        key, value = text[begin:at], ""
        if at < len(text) and text[at] == "=":
            at += 1
            if at < len(text) and text[at] == '"':
                at += 1
                parts = []
                while at < len(text) and text[at] != '"':
                    if text[at] == "\\" and at + 1 < len(text):
                        at += 1
                        parts.append({"n": "\n", "t": "\t"}.get(text[at], text[at]))
                    else:
                        parts.append(text[at])
                    at += 1
                at += 1
                value = "".join(parts)
            else:
                begin = at
                while at < len(text) and not text[at].isspace():
                    at += 1
                value = text[begin:at]
        if key:
            out[sanitize_name(key)] = value
    return out


def _map_function(fields):
    @F.pandas_udf(MapType(StringType(), StringType()))
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(fields)

    return run


def flatten_json(column: str) -> Column:
    return _map_function(json_fields)(F.col(column))


def parse_logfmt(column: str) -> Column:
    return _map_function(logfmt_fields)(F.col(column))
