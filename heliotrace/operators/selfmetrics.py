"""The engine's own figures as metric samples, and as the text that scrapers read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliotrace.functions import semantics as S
from heliotrace.operators import discovery

FIGURES = {  # name -> (kind, help)
    "heliotrace_records_appended_total": ("counter", "Records in the stored tables"),
    "heliotrace_ingest_rejected_total": ("counter", "Records refused, by reason"),
    "heliotrace_segments": ("gauge", "Stored files"),
    "heliotrace_disk_used_bytes": ("gauge", "Bytes of the stored files"),
    "heliotrace_disk_budget_bytes": ("gauge", "Bytes that the stored files may take"),
    "heliotrace_storage_over_budget": ("gauge", "1 if the stored files take more than that"),
    "heliotrace_series_active": ("gauge", "Distinct label sets"),
    "heliotrace_series_limit": ("gauge", "Label sets that admission lets in"),
    "heliotrace_app_rows": ("gauge", "Records of each app"),
    "heliotrace_app_series": ("gauge", "Label sets of each app"),
    "heliotrace_app_bytes_estimate": ("gauge", "Share of each app in the bytes, by its records"),
}


def _sample(df: DataFrame, name: str, value: Column, **labels: Column) -> DataFrame:
    named = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), v.cast("string"))]) if labels else S.empty_map()
    return df.select(F.lit(name).alias("name"), named.alias("labels"), value.cast("double").alias("value"))


def figures(tables: dict[str, DataFrame], *, files: DataFrame | None = None, rejects: DataFrame | None = None, budget_bytes: int | None = None, max_series: int | None = None) -> DataFrame:
    """(name, labels, value): ``tables`` are the signals' records, ``files`` (signal, bytes) their files, ``rejects`` (signal, reason, records) the refusals."""
    out = []
    for signal, df in tables.items():
        column = "labels" if signal == "metrics" else "stream"
        own = F.lit(signal)
        by_app = discovery.usage(df, 0, column=column)
        total = by_app.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("series"), F.lit(0)).alias("series"))
        out += [_sample(total, "heliotrace_records_appended_total", F.col("records"), signal=own), _sample(total, "heliotrace_series_active", F.col("series"), signal=own)]
        out += [_sample(by_app, "heliotrace_app_rows", F.col("records"), signal=own, app=F.col("app")), _sample(by_app, "heliotrace_app_series", F.col("series"), signal=own, app=F.col("app"))]
        if files is not None:
            used = files.where(F.col("signal") == signal).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("used"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
            share = by_app.select("app", "records").join(F.broadcast(used)).join(F.broadcast(total.select(F.greatest("records", F.lit(1)).alias("all_records"))))
            out.append(_sample(share, "heliotrace_app_bytes_estimate", F.floor(F.col("used").cast("decimal(38,0)") * F.col("records") / F.col("all_records")), signal=own, app=F.col("app")))
    if files is not None:
        by_signal = files.groupBy("signal").agg(F.count("*").alias("n"), F.sum("bytes").alias("used"))
        out += [_sample(by_signal, "heliotrace_segments", F.col("n"), signal=F.col("signal")), _sample(by_signal, "heliotrace_disk_used_bytes", F.col("used"), signal=F.col("signal"))]
        if budget_bytes is not None:
            used = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("used"))
            out += [_sample(used, "heliotrace_disk_budget_bytes", F.lit(budget_bytes)), _sample(used, "heliotrace_storage_over_budget", (F.col("used") > budget_bytes).cast("int"))]
    if rejects is not None:
        out.append(_sample(rejects.groupBy("signal", "reason").agg(F.sum("records").alias("n")), "heliotrace_ingest_rejected_total", F.col("n"), signal=F.col("signal"), reason=F.col("reason")))
    if max_series is not None and out:
        out.append(_sample(out[0].sparkSession.range(1), "heliotrace_series_limit", F.lit(max_series)))
    return reduce(DataFrame.unionByName, out)


def exposition(spark: SparkSession, samples: DataFrame) -> str:
    """The text format: help and type of every figure, then its samples in order of their labels. Bounded by apps and reasons."""
    lines: dict[str, list[str]] = {}
    escape = lambda v: v.replace("\\", "\\\\").replace("\n", "\\n").replace('"', '\\"')
    for r in samples.collect():
        labels = ",".join(f'{k}="{escape(v)}"' for k, v in sorted(r.labels.items()))
        lines.setdefault(r.name, []).append(f"{r.name}{'{' + labels + '}' if labels else ''} {S.format_number(r.value)}")
    return "".join(f"# HELP {name} {text}\n# TYPE {name} {kind}\n" + "".join(f"{x}\n" for x in sorted(lines.get(name, ()))) for name, (kind, text) in FIGURES.items())
