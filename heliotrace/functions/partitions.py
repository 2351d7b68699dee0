"""Exchanges in front of sorts, in partitions by the size of the sources.

Left to itself, Spark joins partitions of an exchange up to a compressed size, of which sorted rows of
samples are 30 times and more; a number that is asked for stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

EACH, MOST, LEAST = 4 << 20, 16 << 20, 12
BYPASS = 200  # up to so many partitions, Spark's map tasks write without holding their rows


def source_bytes(df: DataFrame) -> int | None:
    """Bytes of the files under a plan; None where Spark does not know a source's size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 1 << 55 else None


def count_for(n_bytes: int) -> int:
    """Partitions of 4 MB of sources, of up to 16 MB where that keeps them at 200."""
    return max(LEAST, -(-n_bytes // MOST), min(BYPASS, -(-n_bytes // EACH)))


def spread(df: DataFrame, n_bytes: int | None, *keys: str) -> DataFrame:
    """Rows dealt by the keys; without a size, by the session's number."""
    return df.repartition(*keys) if n_bytes is None else df.repartition(count_for(n_bytes), *keys)
