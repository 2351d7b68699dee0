"""Document fingerprints: a canonical exact digest, from DataFrame functions only.

The canonical form of a text is its compatibility composition with full case folding, with every
run of white space as one space and none at its ends. Two 64-bit xxhash digests of it are its
wide hash. Equal hashes alone do not make texts equal: in buckets that several rows share, the
canonical bytes are compared, by the least and the greatest of them, which pre-aggregates before
the shuffle, so a bucket with a third of all rows is a row for each task. Where bytes differ
inside a bucket, the fingerprints of its rows carry a SHA-256 of the canonical form as well.
Fingerprints are therefore equal exactly if canonical forms are.

Defined results: a null text counts as empty; a null id stays null and sorts first; rows that
repeat an id are ordered by text; an empty table gives an empty table; columns other than the id
and the text are not read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliotrace.llm.common import estimated_bytes, shards_for, store

#: Buckets whose keys are broadcast to find their rows; beyond, the rows are shuffled to the keys.
MAX_BROADCAST_KEYS = 500_000
RANGE_BYTES = 1 << 20
MAX_RANGES = 100_000  # of a GB each at 100 TB


def canonical(text: Column) -> Column:
    composed = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), r"[\p{IsWhite_Space}\x1c-\x1f]+", " "))


def wide_hash(canon: Column) -> Column:
    # the salt comes first: arguments are chained, so a salt behind the text would only rehash the first half
    return F.struct(F.xxhash64(canon).alias("a"), F.xxhash64(F.lit(1), canon).alias("b"))


def _hex(h: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h["a"]), 16, "0"), F.lpad(F.hex(h["b"]), 16, "0")))


def shared_buckets(hashes: DataFrame) -> DataFrame:
    """Keys (a, b) of the buckets with several rows, from a column ``h`` of wide hashes."""
    return hashes.groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b")).count().where("count > 1").select("a", "b")


def rows_in(texts: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """(a, b, canon) of the rows of ``texts`` (a column ``text``) whose bucket is one of ``keys``."""
    canon = texts.select(canonical(F.col("text")).alias("canon")).select("canon", wide_hash(F.col("canon")).alias("h")).select("h.a", "h.b", "canon")
    return canon.join(F.broadcast(keys) if n_keys <= MAX_BROADCAST_KEYS else keys, ["a", "b"], "left_semi")


def unequal_buckets(members: DataFrame) -> DataFrame:
    """Keys of buckets that hold different canonical bytes."""
    return members.groupBy("a", "b").agg(F.min("canon").alias("x"), F.max("canon").alias("y")).where("x <> y").select("a", "b")


def fingerprint(h: Column, sha: Column, unequal: list[tuple[int, int]]) -> Column:
    """The wide hash in hex; with ``sha``, the canonical form's SHA-256, inside unequal buckets."""
    out = _hex(h)
    for a, b in unequal:
        out = F.when((h["a"] == a) & (h["b"] == b), F.concat(_hex(h), F.lit("-"), sha)).otherwise(out)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    small = store(own.select("id", canonical(F.col("text")).alias("c")).select("id", wide_hash(F.col("c")).alias("h"), F.sha2("c", 256).alias("sha")), "hashes")
    keys = shared_buckets(small.read())
    unequal = [(r.a, r.b) for r in unequal_buckets(rows_in(own.select("text"), keys, keys.count())).collect()]  # none, but for a collision of 128 bits
    return small.read().select(F.col("id").alias(id_col), fingerprint(F.col("h"), F.col("sha"), unequal).alias("fingerprint"))


def _range_bounds(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 ids that part the table into ranges of about as many rows each."""
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("p")).first().p if n > 1 else None
    return sorted(set(found or []))


def _range_of(id_: Column, bounds: list[int]) -> Column:
    """Number of bounds below an id, by binary search; null ids are in range 0. The bounds are one folded constant."""
    if not bounds:
        return F.lit(0)
    steps, top = [], 1
    while top <= len(bounds):
        top *= 2
    while top > 1:
        top //= 2
        steps.append(top)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    below = F.aggregate(F.lit(steps), F.lit(0), lambda acc, s: acc + F.when(F.coalesce(F.get(table, acc + s - 1) < id_, F.lit(False)), s).otherwise(0))
    return F.coalesce(below, F.lit(0))


def with_next(docs: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Each row's ``columns``, which ``derive`` makes, and, as next_..., those of the row with the next id (of the first, behind the last).

    One shuffle of the texts, by ranges of ids: of ``RANGE_BYTES``, or larger ones beyond ``MAX_RANGES``.
    Each range also gets a copy of the first row of the next one that has rows, found by a small join,
    so no range needs another and no task holds more than a range.
    """
    bounds = _range_bounds(docs, min(MAX_RANGES, shards_for(estimated_bytes(docs, "text"), RANGE_BYTES, 1)))
    ranged = derive(docs).withColumn("part", _range_of(F.col("doc_id"), bounds)).withColumn("copy", F.lit(0))
    firsts = docs.select("doc_id", _range_of(F.col("doc_id"), bounds).alias("part")).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"))).alias("m"))
    order = Window.orderBy("part")  # a row for each range, MAX_RANGES at most
    firsts = firsts.select("m.id", "part", F.lag("part").over(order).alias("before"), F.max("part").over(Window.partitionBy(F.lit(0))).alias("last"))
    firsts = store(firsts.select(F.col("id").alias("first_id"), F.coalesce("before", "last").alias("target")), "range-heads").read()
    heads = derive(docs.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id"))))
    heads = heads.groupBy("target", "doc_id").agg(F.min(F.struct(*[F.col(c) for c in columns])).alias("x"))
    heads = heads.select("doc_id", "x.*", F.col("target").alias("part"), F.lit(1).alias("copy"))
    both = ranged.select("doc_id", *columns, "part", "copy").unionByName(heads)
    w = Window.partitionBy("part").orderBy("copy", F.col("doc_id").asc_nulls_first(), *columns)
    return both.select("doc_id", *columns, "copy", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns if c != "sha")).where("copy = 0")


def _edited(text: Column, following: Column) -> Column:
    k = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(following, F.lit(1), k))


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digests = lambda df: df.withColumn("canon", canonical(F.col("text"))).withColumn("h", wide_hash(F.col("canon"))).withColumn("sha", F.sha2("canon", 256)).drop("canon")
    pairs = with_next(docs, ["text", "h", "sha"], digests).select("doc_id", F.length("text").cast("long").alias("n_chars"), "h", "next_h", "sha", _edited(F.col("text"), F.col("next_text")).alias("edited"))
    pairs = pairs.select("doc_id", "n_chars", "h", "next_h", "sha", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("edited")).alias("c"))
    small = store(pairs.select("doc_id", "n_chars", "h", "next_h", "sha", "edited_sha256", wide_hash(F.col("c")).alias("eh"), F.sha2("c", 256).alias("edited_canon_sha")), "fingerprints").read()

    # Bytes are compared in every bucket that several rows share, be they texts or edited texts.
    keys = shared_buckets(small.select("h").unionByName(small.select(F.col("eh").alias("h"))))
    n_keys = keys.count()
    members = rows_in(docs, keys, n_keys)
    touched = small.join(F.broadcast(keys) if n_keys <= MAX_BROADCAST_KEYS else keys, (F.col("eh.a") == F.col("a")) & (F.col("eh.b") == F.col("b")), "left_semi")
    sure = touched.where("n_chars < 4").select(F.col("doc_id"))  # their edited text is their text
    again = touched.join(sure, "doc_id", "left_anti").select("doc_id", "eh")
    if again.limit(1).count():
        texts = with_next(docs, ["text"]).select("doc_id", _edited(F.col("text"), F.col("next_text")).alias("text"))
        members = members.unionByName(rows_in(texts, keys, n_keys))
    unequal = [(r.a, r.b) for r in unequal_buckets(members).collect()]  # none, but for a collision of 128 bits
    near = lambda other: (F.col("h") == F.col(other)).cast("double")
    return small.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("h"), F.col("sha"), unequal).alias("fingerprint"), fingerprint(F.col("eh"), F.col("edited_canon_sha"), unequal).alias("edited_fingerprint"), near("eh").alias("near_edited"), near("next_h").alias("near_next"))
