"""Shared helpers: tables in the cluster's shared folder, sizes, and compact array payloads.

Large exchanges in this package move *blocks*: one row carries the zstd-compressed numpy arrays
of many documents, so the JVM handles thousands of rows where a row per token would be billions.
A block is bounded by its number of tokens, not by its number of documents.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where driver and tasks share one machine may it be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="heliotrace-"))
    return _FALLBACK[0]


class Stored:
    """A table written to the shared folder: it cuts lineage and survives the loss of executors."""

    _all: dict[str, SparkSession] = {}

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tables/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        Stored._all[self.path] = self.spark

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        if Stored._all.pop(self.path, None) is not None:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(Stored._all.items()):
        try:
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone; its folder goes with it
            return


def store(df: DataFrame, name: str) -> Stored:
    return Stored(df, name)


class StoredBuckets(Stored):
    """A stored table whose rows are bucketed by a column, so that joins by it do not move them."""

    def __init__(self, df: DataFrame, name: str, by: str, n: int):
        self.spark, self.n = df.sparkSession, n
        self.table = f"{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/tables/{self.table}"
        df.write.format("parquet").bucketBy(n, by).option("path", self.path).option("compression", "zstd").saveAsTable(self.table)
        Stored._all[self.path] = self.spark

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        super().drop()


def store_buckets(df: DataFrame, name: str, by: str, n: int) -> StoredBuckets:
    return StoredBuckets(df, name, by, n)


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs: it does so when the driver's garbage is collected.

    The last execution stays referenced by the event listeners until another one ends, so a small one comes first.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()


def estimated_bytes(df: DataFrame, text: str | None = None) -> int:
    """Size of a DataFrame from its plan's statistics; counted over ``text`` where the plan has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 55 or text is None:
        return size
    return int(df.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0)


def shards_for(n_bytes: int, each: int, least: int = 12) -> int:
    return max(least, -(-n_bytes // each))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any numeric kinds as one compressed payload; the bytes of equal rank stand together, which compresses better."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<3sq", a.dtype.str[:3].encode(), a.size) for a in arrays)
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if a.size else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 11 * n, []
    for i in range(n):
        kind, size = struct.unpack_from("<3sq", raw, 4 + 11 * i)
        kind = np.dtype(kind.decode())
        own = np.frombuffer(raw, np.uint8, size * kind.itemsize, at)
        out.append(np.ascontiguousarray(own.reshape(kind.itemsize, -1).T).view(kind).ravel() if size else np.array([], kind))
        at += own.size
    return out


def release_memory() -> None:
    """Gives freed memory of a Python worker back: workers live on between tasks and share their machine with the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64
_POWERS: list[np.ndarray] = []


def _byte_table() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number for each byte, the same for A-Z and a-z, and 0 for ASCII white space; and whether it is white space."""
    space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
    with np.errstate(over="ignore"):
        x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    x[65:91] = x[97:123]
    x[space] = 0
    return x, space


_NUMBERS, _SPACE = _byte_table()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or _POWERS[0].size < n:
        size = max(1 << 20, 1 << n.bit_length())
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and each text's number of words.

    Words are parted by ASCII white space and A-Z counts as a-z. A word's hash is a polynomial in
    its bytes, taken from running sums of all bytes at once, then mixed with its length.
    """
    raw = [(t or "").encode() + b" " for t in texts]
    data = np.frombuffer(b" " + b"".join(raw), np.uint8)
    power, inverse = _powers(data.size)
    with np.errstate(over="ignore"):
        sums = np.cumsum(_NUMBERS[data] * power[: data.size])
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1])
        first, last = edge[0::2], edge[1::2]  # the white space before each word, and its last byte
        x = (sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    ends = np.cumsum([len(r) for r in raw])
    counts = np.diff(np.searchsorted(first, ends, side="left"), prepend=0)
    return x, counts


def text_hash(text: str | None) -> int:
    """What F.xxhash64 gives for a text."""
    import xxhash

    if text is None:
        return 42
    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


MAX_BROADCAST_IDS = 1_000_000


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id and text are not in ``gone``, which has the ids (may be null) and the texts' xxhash64.

    Up to MAX_BROADCAST_IDS of them are broadcast; more are joined by a shuffle.
    """
    gone = store(gone.toDF("__gone", "__hash").distinct(), "gone").read()
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__gone")) & (F.xxhash64(docs[text_col]) == F.col("__hash")), "left_anti")
