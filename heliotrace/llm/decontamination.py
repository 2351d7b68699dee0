"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed in segments of about ``SEGMENT_WORDS`` words: for each term its sorted
positions in the segment, stored as one row with delta-coded, compressed postings. A document
lies in one segment. A phrase is searched in each segment from its rarest term: that term's
positions, moved to the phrase's start, are intersected with the moved lists of the other terms
in order of their length. Phrases with a term the segment lacks are dropped at once. A proximity
search (``near_items``) takes the same lists and asks for all terms within a span of words, in any
order.

Test items are sent to the tasks in blocks of bounded size (``BLOCK_WORDS``).

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters.

Defined results: a null text has no words and no hits; an item without words is never found; rows
with a null item id are left out; items that repeat an id count as one item; ids of documents may
be null or repeat; empty tables work; columns other than ids and texts are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotrace.llm.common import Stored, pack, release_memory, store, unpack, without_rows

SEGMENT_WORDS = 2_000_000
BLOCK_WORDS = 1_000_000
WINDOW = 8
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


class Segment:
    """Postings of some documents: term -> sorted positions; a document's words have consecutive positions."""

    def __init__(self, terms: bytes, postings: bytes):
        starts, counts, deltas = unpack(postings)
        self.doc_starts = starts
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.firsts = self.ends - counts
        running = np.cumsum(deltas, dtype=np.int64)
        before = np.where(self.firsts > 0, running[np.maximum(self.firsts, 1) - 1], 0) if counts.size else self.firsts
        self.positions = running - np.repeat(before, counts) if counts.size else running
        self.number = {t: k for k, t in enumerate(terms.split(b" "))} if terms else {}

    def numbers(self, terms: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(t, -1) for t in terms), np.int64, len(terms))

    def postings(self, number: int) -> np.ndarray:
        return self.positions[self.firsts[number] : self.ends[number]]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, positions, side="right") - 1

    def phrase(self, numbers: np.ndarray) -> np.ndarray:
        """Start positions of the exact phrase, inside one document."""
        sizes = self.ends[numbers] - self.firsts[numbers]
        order = np.argsort(sizes, kind="stable")
        starts = self.postings(numbers[order[0]]) - order[0]
        for j in order[1:]:
            if not starts.size:
                return starts
            other = self.postings(numbers[j]) - j
            at = np.searchsorted(other, starts)
            starts = starts[(at < other.size) & (other[np.minimum(at, other.size - 1)] == starts)]
        starts = starts[starts >= 0]
        return starts[self.doc_of(starts) == self.doc_of(starts + len(numbers) - 1)]

    def near(self, numbers: np.ndarray, span: int) -> np.ndarray:
        """Positions of the rarest term around which all terms lie within ``span`` words of one document."""
        numbers = np.unique(numbers)
        sizes = self.ends[numbers] - self.firsts[numbers]
        order = np.argsort(sizes, kind="stable")
        anchors = self.postings(numbers[order[0]])
        lists = [self.postings(numbers[j]) for j in order]
        keep = []
        for p in anchors.tolist():
            doc = int(self.doc_of(np.array([p]))[0])
            low, high = int(self.doc_starts[doc]), int(self.doc_starts[doc + 1]) if doc + 1 < self.doc_starts.size else int(self.positions.size)
            for a in range(max(low, p - span + 1), p + 1):  # every placement of the span that holds the anchor
                b = min(high, a + span)
                if all(np.searchsorted(x, a) < np.searchsorted(x, b) for x in lists):
                    keep.append(p)
                    break
        return np.array(keep, np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, segment_words: int = SEGMENT_WORDS) -> Stored:
    """The index as a stored table: (doc_ids, n_words, terms, postings), a row for each segment."""
    id_kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_ids", "n_words", "terms", "postings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            own = np.concatenate(parts) if parts else np.array([], np.int32)
            order = np.argsort(own, kind="stable").astype(np.int64)
            counts = np.bincount(own, minlength=len(number)).astype(np.int32)
            firsts = np.cumsum(counts) - counts
            deltas = np.diff(order, prepend=0)
            if order.size:
                deltas[firsts] = order[firsts]  # each term starts anew
            sizes = np.array(lengths, np.int64)
            payload = pack(np.cumsum(sizes) - sizes, counts, deltas.astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([b" ".join(number)], pa.binary()), pa.array([payload], pa.binary())], names=names)

        number: dict[bytes, int] = {}
        parts, lengths, total, ids = [], [], 0, None
        for batch in batches:
            first = 0
            texts = batch.column(1)
            for k in range(batch.num_rows):
                own = words(texts[k].as_py())
                parts.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int32, len(own)))
                lengths.append(len(own))
                total += len(own) + 1
                if total >= segment_words or k + 1 == batch.num_rows:
                    piece = batch.column(0).slice(first, k + 1 - first)
                    ids, first = piece if ids is None else pa.concat_arrays([ids, piece]), k + 1
                if total >= segment_words:
                    yield close()
                    number, parts, lengths, total, ids = {}, [], [], 0, None
                    release_memory()
        if ids is not None:
            yield close()
        del number, parts
        release_memory()

    schema = f"doc_ids array<{id_kind}>, n_words array<bigint>, terms binary, postings binary"
    return store(docs.select(id_col, text_col).mapInArrow(run, schema), "index")


def test_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, window: int = WINDOW) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """Blocks of windows, each with the ids of its items as strings; a short item is one window."""
    block: dict[tuple[bytes, ...], list[str]] = {}
    for row in items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        own = words(row.text)
        for at in range(max(1, len(own) - window + 1) if own else 0):
            owners = block.setdefault(tuple(own[at : at + window]), [])
            if row.id not in owners[-1:]:
                owners.append(row.id)
        if len(block) * window >= BLOCK_WORDS:
            yield block
            block = {}
    if block:
        yield block


def search(index: DataFrame, blocks: list, id_col: str, id_kind: str) -> DataFrame:
    """(id, n_words, n_hit, items): of each document its words, those inside found windows, and the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths = batch.column(0)[row].values, batch.column(1)[row].values.to_numpy(zero_copy_only=False).astype(np.int64)
                segment = Segment(batch.column(2)[row].as_py(), batch.column(3)[row].as_py())
                hit = np.zeros(int(lengths.sum()) + 1, bool)
                found: dict[int, set[str]] = {}
                for block in blocks:
                    payload = block.value
                    terms, shapes = payload["terms"], payload["shapes"]
                    local = segment.numbers(terms)
                    for windows, owners in shapes:
                        numbers = local[windows]
                        for k in np.flatnonzero((numbers >= 0).all(axis=1)).tolist():
                            starts = segment.phrase(numbers[k])
                            if starts.size:
                                hit[(starts[:, None] + np.arange(numbers.shape[1])).ravel()] = True
                                for doc in np.unique(segment.doc_of(starts)).tolist():
                                    found.setdefault(doc, set()).update(owners[k])
                    if len(blocks) > 1 and hasattr(block, "_value"):
                        del block._value  # one block at a time in memory; the worker keeps the file
                ends = np.cumsum(lengths)
                hits = np.concatenate(([0], np.cumsum(hit[:-1])))
                items = pa.array([sorted(found.get(d, ())) for d in range(len(ids))], pa.list_(pa.string()))
                for at in range(0, len(ids), 10_000):
                    part = slice(at, at + 10_000)
                    yield pa.RecordBatch.from_arrays([ids.slice(at, 10_000), pa.array(lengths[part]), pa.array(hits[ends][part] - hits[ends - lengths][part]), items.slice(at, 10_000)], names=[id_col, "n_words", "n_hit", "items"])
                del segment, hit, hits, items
                release_memory()

    return index.select("doc_ids", "n_words", "terms", "postings").mapInArrow(run, f"`{id_col}` {id_kind}, n_words bigint, n_hit bigint, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, items) of every row of ``docs``."""
    spark = docs.sparkSession
    blocks = []
    for block in test_windows(items, window=window):
        terms = sorted({t for w in block for t in w})
        number = {t: k for k, t in enumerate(terms)}
        by_size: dict[int, list] = {}
        for w, owners in block.items():
            by_size.setdefault(len(w), []).append(([number[t] for t in w], owners))
        shapes = [(np.array([w for w, _ in same], np.int64), [o for _, o in same]) for same in by_size.values()]
        blocks.append(spark.sparkContext.broadcast({"terms": terms, "shapes": shapes}))
    index = build_index(docs, id_col, text_col)
    return search(index.read(), blocks, id_col, docs.schema[id_col].dataType.simpleString())


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_items: int = 1) -> DataFrame:
    """The rows of ``docs`` with windows of fewer than ``least_items`` items; rows are told apart by id and text, so ids may be null or repeat."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("key"), F.col(text_col).alias("text"))
    found = contamination(keyed, items, "key", "text").where(F.size("items") >= least_items)
    return without_rows(docs, found.select("key.id", "key.hash"), id_col, text_col)


def near_items(docs: DataFrame, items: DataFrame, span: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, items): of each document the items all of whose words occur, in any order, within ``span`` words of it.

    Items without words, or with more different words than the span has places, are found nowhere.
    """
    spark, id_kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    blocks = []
    for block in test_windows(items, window=1 << 30):  # whole items
        wanted = [(sorted(set(w)), owners) for w, owners in block.items() if len(set(w)) <= span]
        blocks.append(spark.sparkContext.broadcast(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].values
                segment = Segment(batch.column(1)[row].as_py(), batch.column(2)[row].as_py())
                found: dict[int, set[str]] = {}
                for block in blocks:
                    for terms, owners in block.value:
                        numbers = segment.numbers(terms)
                        if (numbers >= 0).all():
                            for doc in np.unique(segment.doc_of(segment.near(numbers, span))).tolist():
                                found.setdefault(doc, set()).update(owners)
                    if len(blocks) > 1 and hasattr(block, "_value"):
                        del block._value
                yield pa.RecordBatch.from_arrays([ids, pa.array([sorted(found.get(d, ())) for d in range(len(ids))], pa.list_(pa.string()))], names=[id_col, "items"])
                release_memory()

    return build_index(docs, id_col, text_col).read().select("doc_ids", "terms", "postings").mapInArrow(run, f"`{id_col}` {id_kind}, items array<string>")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    n_items = F.size("items").cast("long")
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS k, least(8, len(w)) AS size FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 6))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT n, i, s.size, array_to_string(w[i:i + s.size - 1], ' ') AS k FROM (SELECT n, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN (SELECT DISTINCT size FROM bw) s ON i + s.size - 1 <= len(w)),
m AS (SELECT dw.n, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (k, size)),
h AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS p FROM m) GROUP BY n),
f AS (SELECT n, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY n)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(f.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (n) LEFT JOIN f USING (n)
"""
