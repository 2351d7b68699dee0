"""URL filters: a Bloom filter cascade gives exact membership over the corpus's key universe.

A list of keys is encoded for one universe, all keys that the corpus can ask for. Level 1 holds
the listed keys; level 2 holds the universe's false positives of level 1; level 3 the listed keys
that level 2 wrongly holds; and so on until a level has no false positive. A key of the universe
is listed exactly if the first level that lacks it has an even number. Only the first level
scans the universe; later levels work on false positives, about as many as there are listed keys.
A level has ``FILTER_BYTES`` at most: longer lists are dealt by a hash into shards with a cascade
each, and ``PASS_SHARDS`` of them at a time are sent to the tasks, so neither driver nor tasks hold
more than a bounded filter however long the list is.

Rules are pairs of host and path. A url's candidate keys are its host's suffixes, with as many
labels as some rule has, joined to its path's prefixes, as long as some rule's. The longest
candidate that is listed, to allow or to block, decides; where none is, the filter allows.

Defined results: a url that is null or has no ``://`` has an empty host and path and no candidate;
null ids stay null; repeated urls give repeated rows; empty tables and empty lists work; a rule
listed to allow and to block blocks; columns other than the id and the url are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotrace.llm.common import Stored, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTER_BYTES = 8 << 20
PASS_SHARDS = 8
MAX_LEVELS = 60


def host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host_: Column, path_: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    """A url's keys, longest first. Their number is bounded by the rules, not by the url."""
    labels = F.split(host_, r"\.", -1)
    keys = [
        F.when((host_ != "") & (F.size(labels) >= n) & (F.length(path_) >= size), F.concat(F.array_join(F.slice(labels, F.size(labels) - F.lit(n) + 1, n) if n else F.array().cast("array<string>"), "."), F.substring(path_, 1, size)))
        for n in label_counts
        for size in path_lengths
    ]
    if not keys:
        return F.array().cast("array<string>")
    by_size = F.transform(F.array_compact(F.array(*keys)), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))
    return F.transform(F.array_sort(by_size), lambda x: x["k"])


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


@dataclass
class Level:
    bits: np.ndarray
    n_bits: int
    n_hashes: int
    salt: int

    def positions(self, h1: np.ndarray, h2: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = h1.view(np.uint64) + np.uint64(self.salt * 64 + k) * (h2.view(np.uint64) | np.uint64(1))
            x ^= x >> np.uint64(33)
            x *= np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(33)
        return x % np.uint64(self.n_bits)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for k in range(self.n_hashes):
            p = self.positions(h1, h2, k)
            np.bitwise_or.at(self.bits, (p >> np.uint64(3)).astype(np.int64), (1 << (p & np.uint64(7))).astype(np.uint8))

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(h1.size, bool)
        for k in range(self.n_hashes):
            p = self.positions(h1, h2, k)
            out &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _empty_level(n: int, rate: float, salt: int) -> Level:
    n_bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    return Level(np.zeros(-(-n_bits // 8), np.uint8), n_bits, max(1, round(math.log2(1 / rate))), salt)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key, given by its two hashes, is listed: exact for keys of the universe."""
        out, open_ = np.zeros(h1.size, bool), np.arange(h1.size)
        for i, level in enumerate(self.levels):
            kept = open_[level.holds(h1[open_], h2[open_])]
            if i % 2 == 0:
                out[kept] = True
            else:
                out[kept] = False
            open_ = kept
        return out


GATHERED = 16  # bit arrays that the driver gets of a level


def _fill(level: Level, keys: DataFrame) -> None:
    """Sets the bits of all keys: each partition makes one bit array, and these are joined in tasks before a few come to the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Level(np.zeros_like(level.bits), level.n_bits, level.n_hashes, level.salt)
        for b in batches:
            own.add(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GATHERED], pa.int32()), pa.array([own.bits.tobytes()], pa.binary())], names=["to", "bits"])

    def join(table: pa.Table) -> pa.Table:
        out = np.zeros_like(level.bits)
        for x in table.column("bits"):
            out |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"bits": pa.array([out.tobytes()], pa.binary())})

    for row in keys.select(*_hashes(F.col("key"))).mapInArrow(bits, "to int, bits binary").groupBy("to").applyInArrow(join, "bits binary").toLocalIterator():
        level.bits |= np.frombuffer(row.bits, np.uint8)


def _passing(level: Level, keys: DataFrame) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["key"]).filter(pa.array(level.holds(b.column(1).to_numpy(), b.column(2).to_numpy())))

    return keys.select("key", *_hashes(F.col("key"))).mapInArrow(keep, "key string").distinct()


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """``listed`` and ``universe`` have a column ``key``; the universe may repeat keys and need not hold the listed ones."""
    tables: list[Stored] = []

    def kept(df: DataFrame) -> DataFrame:
        tables.append(store(df, "keys"))
        return tables[-1].read()

    listed = kept(listed.select("key").where("key is not null").distinct())
    universe = universe.select("key").where("key is not null")
    n_listed = listed.count()
    if not n_listed:
        return Cascade()
    n_universe = max(1, universe.agg(F.approx_count_distinct("key").alias("n")).first().n)
    level = _empty_level(n_listed, min(0.5, max(1e-9, n_listed * math.sqrt(0.5) / n_universe)), 0)
    _fill(level, listed)
    # False positives of the first level: about as many as listed keys. Only these meet the list in a join.
    other = kept(_passing(level, universe).join(listed, "key", "left_anti"))
    cascade, inside = Cascade([level]), listed
    while n := other.count():
        if len(cascade.levels) >= MAX_LEVELS:
            raise ValueError("two different keys share both hashes")
        level = _empty_level(n, 0.5, len(cascade.levels))
        _fill(level, other)
        cascade.levels.append(level)
        inside, other = other, kept(_passing(level, inside))
    for t in tables:
        t.drop()
    return cascade


def shards_of(n_listed: int) -> int:
    """Shards of a list, so that a level of the rarest false positives (1e-9) keeps within FILTER_BYTES."""
    return max(1, math.ceil(n_listed * math.log(1e9) / math.log(2) ** 2 / 8 / FILTER_BYTES))


def filter_urls(urls: DataFrame, id_col: str, url_col: str, rules: DataFrame) -> DataFrame:
    """(id, host, path, rule, verdict) of each row; ``rules`` has host, path and verdict (allow or block)."""
    keyed = rules.where("host is not null and path is not null and verdict in ('allow', 'block')").select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("size"), "verdict")
    shapes = keyed.agg(F.collect_set("labels").alias("l"), F.collect_set("size").alias("s")).first()  # a host has 127 labels at most, a path has a url's length
    split = urls.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    split = split.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), sorted(shapes.l), sorted(shapes.s)))
    universe = split.select(F.explode("keys").alias("key"))
    n_shards = shards_of(keyed.count())
    shard_of = F.pmod(F.hash(F.col("key")), F.lit(n_shards))
    kind = urls.schema[id_col].dataType.simpleString()
    # verdicts: for each candidate key 0, 1 if it is listed to allow, 2 if it is listed to block
    judged = split.withColumn("verdicts", F.transform("keys", lambda k: F.lit(0).cast("tinyint")))
    for first in range(0, n_shards, PASS_SHARDS):
        shards = range(first, min(n_shards, first + PASS_SHARDS))
        cascades = {(v, k): build_cascade(keyed.where((F.col("verdict") == v) & (shard_of == k)), universe.where(shard_of == k)) for v in ("block", "allow") for k in shards}
        judged = _judged(judged, cascades, n_shards, kind)
        if len(shards) < n_shards:
            judged = store(judged, "judged").read()
    number = F.coalesce(F.array_position(F.transform("verdicts", lambda v: v > 0), F.lit(True)), F.lit(0)).cast("int")
    rule, verdict = F.get("keys", number - 1), F.get("verdicts", number - 1)
    return judged.select(F.col("id").alias(id_col), "host", "path", F.when(number > 0, rule).alias("rule"), F.when((number > 0) & (verdict == 2), "block").otherwise("allow").alias("verdict"))


def _judged(rows: DataFrame, cascades: dict[tuple[str, int], Cascade], n_shards: int, kind: str) -> DataFrame:
    """Rows with the verdicts of the keys whose shards have a cascade here."""
    shards = sorted({k for _, k in cascades})
    each = lambda f: F.transform("keys", f)
    hashed = rows.select("id", "host", "path", "keys", "verdicts", each(lambda k: _hashes(k)[0]).alias("h1"), each(lambda k: _hashes(k)[1]).alias("h2"), each(lambda k: F.pmod(F.hash(k), F.lit(n_shards))).alias("shard"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets = b.column(4).offsets
            verdicts = b.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int8)
            h1, h2, shard = (b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (5, 6, 7))
            for k in shards:
                own = np.flatnonzero(shard == k)
                for code, verdict in ((1, "allow"), (2, "block")):  # listed both ways blocks
                    verdicts[own[cascades[verdict, k].listed(h1[own], h2[own])]] = code
            offsets = pa.array(offsets.to_numpy() - offsets[0].as_py(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.ListArray.from_arrays(offsets, pa.array(verdicts, pa.int8()))], names=["id", "host", "path", "keys", "verdicts"])

    return hashed.mapInArrow(judge, f"id {kind}, host string, path string, keys array<string>, verdicts array<tinyint>")


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, "page_id", "url", spark.createDataFrame(RULES, "host string, path string, verdict string"))


ORACLE = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
                 coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM rest),
fits AS (SELECT p.n, u.rhost || u.rpath AS rule, u.verdict,
                row_number() OVER (PARTITION BY p.n ORDER BY length(u.rhost || u.rpath) DESC) AS k
         FROM parts p JOIN rules u ON (p.host = u.rhost OR ends_with(p.host, '.' || u.rhost)) AND starts_with(p.path, u.rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.k = 1
"""
