"""Log queries as DataFrame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotrace.errors import BadRequest
from heliotrace.functions import semantics as S
from heliotrace.functions.logfields import flatten_json, parse_logfmt
from heliotrace.plans import logql

DEFAULT_LIMIT, MAX_LIMIT = 100, 5_000


def matches(value: Column, op: str, wanted: str) -> Column:
    """A label matcher; regular expressions are anchored at both ends."""
    if op == "=":
        return value == wanted
    if op == "!=":
        return value != wanted
    return S.full_match(value, wanted) if op == "=~" else ~S.full_match(value, wanted)


def select_streams(df: DataFrame, matchers, column: str = "stream") -> DataFrame:
    return df.where(reduce(Column.__and__, (matches(S.label(F.col(column), m.name), m.op, m.value) for m in matchers))) if matchers else df


def in_range(df: DataFrame, start: int | None, end: int | None, column: str = "timestamp_nanos") -> DataFrame:
    """Both ends are inside."""
    if start is not None:
        df = df.where(F.col(column) >= start)
    return df.where(F.col(column) <= end) if end is not None else df


def _line(f: logql.LineFilter) -> Column:
    body = F.col("body")
    if f.op in ("|=", "!="):
        hit = body.contains(f.value)
        return hit if f.op == "|=" else ~hit
    hit = S.search(body, f.value)
    return hit if f.op == "|~" else ~hit


def _base_label(name: str) -> Column:
    """An attribute by its own name, else the last one whose sanitised name is the same, else a stream label."""
    attributes, stream = (F.coalesce(c, S.empty_map()) for c in ("attributes", "stream"))
    same = F.filter(F.map_keys(attributes), lambda k: (F.length(k) == len(name)) & (S.sanitize(k) == name))
    return F.coalesce(F.element_at(attributes, F.lit(name)), F.element_at(attributes, F.array_max(same)), F.element_at(stream, F.lit(name)))


def _json_fields(stages, after: int) -> list[str] | None:
    """Names the filters behind a json stage ask for, if each can only be a top-level key; else None."""
    names = sorted({m.name for s in stages[after + 1 :] if isinstance(s, logql.LabelFilter) for group in s.any_of for m in group})
    return names if all("_" not in n for n in names) else None


def _json_struct(names: list[str]) -> Column:
    """Named top-level fields of a JSON object, parsed once; all null where the body is something else."""
    return F.from_json(F.when(F.ltrim("body").startswith("{"), F.col("body")), ", ".join(f"`{n}` variant" for n in names))


def _json_text(value: Column) -> Column:
    """A top-level scalar or array of a JSON body as text; objects are not fields. Only text that looks like one of them asks for its type."""
    text = F.try_variant_get(value, "$", "string")
    kind = F.schema_of_variant(value)
    nested = F.when(kind.startswith("ARRAY"), F.to_json(value)).when(~kind.startswith("OBJECT"), text)
    return F.when(F.substring(text, 1, 1).isin("[", "{"), nested).otherwise(text)


def _holds(filters: list[logql.LabelFilter], parsers: list[tuple[str, Column, list[str]]], found: tuple = ()) -> Column:
    """Whether label filters hold. Only the labels they name are looked up; a parsed body is bound once, as a lambda's variable."""
    if parsers:
        (kind, fields, names), *rest = parsers
        if kind == "struct":
            return F.exists(F.array(fields), lambda p: _holds(filters, rest, (*found, lambda n: _json_text(p[n]) if n in names else None)))
        return _holds(filters, rest, (*found, lambda n: F.element_at(fields, F.lit(n))))

    def value(name: str) -> Column:
        parsed = [v for v in (f(name) for f in reversed(found)) if v is not None]
        return F.coalesce(*parsed, _base_label(name), F.lit(""))

    groups = [reduce(Column.__or__, (reduce(Column.__and__, (matches(value(m.name), m.op, m.value) for m in group)) for group in f.any_of)) for f in filters]
    return reduce(Column.__and__, groups)


def run_pipeline(df: DataFrame, query: logql.LogQuery) -> DataFrame:
    """The records that pass; a label filter sees what earlier stages extracted. Columns stay as they are."""
    columns = df.columns
    df = select_streams(df, query.matchers)
    for stage in query.stages:  # every line filter looks at the body alone, so all of them go below the parsers
        if isinstance(stage, logql.LineFilter):
            df = df.where(_line(stage))
    parsers: list[tuple[str, Column, list[str]]] = []
    for at, stage in enumerate(query.stages):
        if isinstance(stage, logql.Parser) and any(isinstance(s, logql.LabelFilter) for s in query.stages[at:]):
            names = _json_fields(query.stages, at) if stage.kind == "json" else None
            if names is not None:
                parsers.append(("struct", _json_struct(names), names))
            else:
                df = df.withColumn(f"__fields_{at}", parse_logfmt("body") if stage.kind == "logfmt" else flatten_json("body"))
                parsers.append(("map", F.col(f"__fields_{at}"), []))
        elif isinstance(stage, logql.LabelFilter):
            df = df.where(_holds([stage], parsers))
    return df.select(*columns)


def limit_of(limit: int | None) -> int:
    if limit == 0:
        raise BadRequest("limit must be positive")
    return min(DEFAULT_LIMIT if limit is None else limit, MAX_LIMIT)


def newest(df: DataFrame, limit: int, *, forward: bool = False) -> DataFrame:
    """The newest (or oldest) records in order, ties by arrival: a bounded top-k on each task, no sort of all matches."""
    order = [F.col("timestamp_nanos"), F.col("seq")]
    df = df.orderBy(*(c if forward else c.desc() for c in order))
    return df.limit(limit) if limit else df


def query_range(df: DataFrame, text: str, start: int | None = None, end: int | None = None, *, limit: int | None = None, forward: bool = False) -> DataFrame:
    """Records of a log query: parse, filter, and the first ``limit`` in the wanted direction."""
    return newest(run_pipeline(in_range(df, start, end), logql.parse(text)), limit_of(limit), forward=forward)


def group_streams(df: DataFrame, *, forward: bool = False) -> DataFrame:
    """(stream, values): each stream's records in order, for results that are bounded by a limit."""
    value_sorted = F.array_sort(F.collect_list(F.struct("timestamp_nanos", "seq", "body", F.array_sort(F.map_entries(F.coalesce("attributes", S.empty_map()))).alias("attributes"))))
    grouped = df.groupBy(S.label_key(F.col("stream")).alias("stream_key")).agg(F.first("stream").alias("stream"), value_sorted.alias("values"))
    return grouped if forward else grouped.withColumn("values", F.reverse("values"))


def newest_by_day(read_day, days: list[str], text: str, *, limit: int | None = None) -> DataFrame:
    """The newest records of a table partitioned by day, reading from the last day back until there are enough."""
    wanted, out = limit_of(limit), None
    for day in sorted(days, reverse=True):
        part = query_range(read_day(day), text, limit=wanted)
        out = part if out is None else newest(out.unionByName(part), wanted)
        if out.count() >= wanted:
            break
    return out
