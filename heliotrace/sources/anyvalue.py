"""Decode-time expressions shared by the three OTLP sources."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from heliotrace.functions import semantics as S

#: Every scalar is read as text: numbers may come as strings and the other way round.
ANY = "struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,bytesValue:string,arrayValue:string,kvlistValue:string>"
ATTRIBUTES = f"array<struct<key:string,value:{ANY}>>"
RESOURCE = f"struct<attributes:{ATTRIBUTES}>"
SCOPE = f"struct<name:string,version:string,attributes:{ATTRIBUTES}>"

EARLIEST, LATEST = 978_307_200, 4_102_444_800  # fixed values: seconds of 2001 and 2100


def unsigned(text: Column) -> Column:
    """A whole number of up to 20 digits given as number or text; malformed or negative is absent."""
    value = F.when(text.rlike(r"\A[0-9]{19,20}\z"), text.try_cast("decimal(20,0)"))
    long = F.when(value <= F.lit(S_MAX).cast("decimal(20,0)"), value.cast("long"))
    return F.when(text.rlike(r"\A[0-9]{1,18}\z"), text.try_cast("long")).otherwise(long)


S_MAX = (1 << 63) - 1


def signed(text: Column) -> Column:
    return F.when(text.rlike(r"\A-?[0-9]{1,19}\z"), text.try_cast("long"))


def enum(text: Column, names: dict[str, int]) -> Column:
    """A number, a number as text, or one of the names."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.when(text.rlike(r"\A[0-9]{1,9}\z"), text.try_cast("int")), F.element_at(table, text))


def _plain(value: object) -> object:
    if not isinstance(value, dict):
        return value
    for key, own in value.items():
        if key == "arrayValue":
            return [_plain(v) for v in (own or {}).get("values") or []]
        if key == "kvlistValue":
            return {v.get("key", ""): _plain(v.get("value") or {}) for v in (own or {}).get("values") or []}
        if key == "intValue":
            return int(own)
        if key in ("stringValue", "boolValue", "doubleValue", "bytesValue"):
            return own
    return None


def composite_text(array: str | None, kvlist: str | None) -> str | None:
    """A list or a key-value list as plain compact JSON."""
    try:
        if array:
            return json.dumps(_plain({"arrayValue": json.loads(array)}), separators=(",", ":"), ensure_ascii=False)
        if kvlist:
            return json.dumps(_plain({"kvlistValue": json.loads(kvlist)}), separators=(",", ":"), ensure_ascii=False)
    except (ValueError, TypeError, AttributeError):
        return None
    return None


def composites(array: Column, kvlist: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(array: pd.Series, kvlist: pd.Series) -> pd.Series:
        return pd.Series([composite_text(a, k) for a, k in zip(array, kvlist, strict=True)], dtype=object)

    return run(array, kvlist)


def scalar_text(value: Column) -> Column:
    """Text of a value that is not a list; precedence string, bool, int, double, bytes. Whole doubles lose their ``.0``."""
    double = F.regexp_replace(value["doubleValue"], r"\A(-?[0-9]{1,15})\.0+\z", "$1")
    return F.coalesce(value["stringValue"], value["boolValue"], value["intValue"], double, value["bytesValue"], value["arrayValue"], value["kvlistValue"])


def attributes(entries: Column, *, sanitised: bool = False) -> Column:
    """An attribute list as a map; a repeated key keeps its last value, values that are absent go."""
    own = F.transform(F.coalesce(entries, F.array().cast(ATTRIBUTES)), lambda e: F.struct((S.sanitize(e["key"]) if sanitised else e["key"]).alias("key"), scalar_text(e["value"]).alias("value")))
    return S.to_map(F.filter(own, lambda e: e["key"].isNotNull() & e["value"].isNotNull()))


def normalise_id(text: Column) -> Column:
    """Lower-cased hex; empty, all-zero or other text is absent. The length is not checked."""
    own = F.trim(text)
    return F.when(own.rlike("^[0-9A-Fa-f]+$") & ~own.rlike("^0+$"), F.lower(own))


def rescale(time: Column) -> Column:
    """Nanoseconds from a time whose unit its size tells: s, ms, us or ns between 2001 and 2100; else absent."""

    def of(t: Column) -> Column:
        out = F.when((t >= F.lit(EARLIEST * 10**9)) & (t < F.lit(LATEST * 10**9)), t).when((t >= EARLIEST) & (t < LATEST), t * 1_000_000_000)
        for unit in (10**3, 10**6):
            out = out.when((t >= F.lit(EARLIEST * unit)) & (t < F.lit(LATEST * unit)), t * (10**9 // unit))
        return out

    return F.element_at(F.transform(F.array(time), of), 1)  # bound once, as a lambda's variable
