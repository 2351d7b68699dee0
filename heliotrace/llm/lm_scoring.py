"""LM scoring with a sharded Elias-Fano n-gram trie.

The model has up to three orders. P1(w) = (c(w) + 1/2) / (N + (V + 1) / 2),
P2(w | v) = (c(vw) + m2(v) P1(w)) / (c(v) + m2(v)) and
P3(w | uv) = (c(uvw) + m3(uv) P2(w | v)) / (c(uv) + m3(uv)), where m(h) = a c(h)^b is the number of
different successors that a context of count c(h) has, fitted for each order over all blocks of the
corpus. All are proper distributions over the V training words and one class of unknown words. A
text's score is the sum of log10 P over its words and its end; before the first word stands a
start mark, and the first word has the start mark alone as context.

Each shard of an order is a trie: its contexts, their quantised back-off weights, and their
successors in one monotone Elias-Fano sequence (context's rank, then the successor's code relative
to that context) with monotone pointers per context and 8-bit codes of the quantised log
probabilities. A shard is packed into an anonymous memory map and queried by successor search
inside the context's range; only counts of bits per 32 bytes are held beside it. Contexts of more
than ``SPLIT`` tokens lie in several shards, by successor, so no shard gathers a frequent word.

Texts are turned into blocks of word hashes once; the blocks are stored, bucketed by their number,
so they meet answers without being moved. Word counts per block are summed per shard of words and
return to the blocks. Each block's distinct bigrams go to the shards of the second order, which
return the quantised P2, c(vw), and whether the bigram occurs again in the corpus. A trigram whose
two bigrams do not both occur again occurs once, so its count is known in its block; all others go
to the shards of the third order with their documents, and sums per document return.

Words are known by 64-bit hashes, contexts by 40 bits within their shard, and successors by 32 (third
order: 24) bits within their context, 8 fewer where it has few tokens (``FEW``), so two successors of a
context of k are taken for one about once in 2^33 / k^2 (2^25 / k^2), or 2^25 / k^2 (2^17 / k^2)
contexts. Defined results: a null text counts as empty: one token,
its end; rows with a null id are scored but not learned from (held_out is null); repeated rows count
and are scored each; without training tokens every word is unknown; an empty table gives an empty
table; columns other than the id and the text are not read, so names cannot clash.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotrace.llm.common import collect_garbage, estimated_bytes, pack, release_memory, shards_for, store, store_buckets, unpack, word_hashes

ORDER = 3
BLOCK_TOKENS = 750_000
SHARD_BYTES = 2 << 20
SPLIT = 1_000_000
CODE_BITS = {2: 32, 3: 24}
CONTEXT_SHIFT = np.uint64(24)
FEW = {2: 4096, 3: 256}  # contexts of fewer tokens have few successors: 8 bits fewer tell these apart
END, START = np.uint64(0x9D8B7C6A5F4E3D21), np.uint64(0x123456789ABCDEF1)  # marks; words have hashes of their bytes


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if a.size else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


_PLACE = np.zeros((256, 8), np.uint8)  # of each one of a byte, from its highest bit
for _byte in range(256):
    _at = [i for i in range(8) if _byte >> (7 - i) & 1]
    _PLACE[_byte, : len(_at)] = _at
_GROUP = 32  # bytes whose bits are counted together: four numbers of 64 bits
_LOW, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)  # the lowest and the highest bit of each byte


def _distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which for large arrays is much faster than the table that np.unique makes."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if a.size else a


def _ones_in_bytes(x: np.ndarray) -> np.ndarray:
    """Each byte's number of ones, in that byte."""
    x = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
    return (x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)


class EliasFano:
    """A monotone sequence: low bits as they are, high parts in unary. ``find`` is a successor search.

    Both parts stay as they are packed; beside them stands the number of ones before each 32 bytes.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, low_bits: int):
        self.low, self.high, self.n, self.low_bits = low, high, n, low_bits
        self.words = high.view("<u8").reshape(-1, _GROUP // 8)
        self.ones_before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))))
        self.zeros_before = np.arange(self.ones_before.size, dtype=np.int64) * 8 * _GROUP - self.ones_before
        self.high_parts = int(8 * high.size - self.ones_before[-1])

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[np.ndarray, np.ndarray, int]:
        n = values.size
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        low = values & np.uint64((1 << low_bits) - 1)
        width = 1 if low_bits <= 8 else 2 if low_bits <= 16 else 4 if low_bits <= 32 else 5 if low_bits <= 40 else 8
        top = (values >> np.uint64(low_bits)).astype(np.int64)
        size = n + (int(universe) >> low_bits) + 2
        bits = np.zeros(size + -size % (8 * _GROUP), np.uint8)  # whole groups
        bits[top + np.arange(n)] = 1
        raw = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return np.ascontiguousarray(raw).ravel(), np.packbits(bits), low_bits

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th one (or zero), counted from 0."""
        before = self.ones_before if one else self.zeros_before
        out = np.empty(k.size, np.int64)
        for at in range(0, k.size, 1 << 16):
            own = k[at : at + (1 << 16)]
            group = np.searchsorted(before, own, side="right") - 1
            left = own - before[group]
            words = self.words[group] if one else ~self.words[group]
            upto = np.cumsum(np.bitwise_count(words).T[:-1], axis=0, dtype=np.int64)
            number = (left >= upto).sum(axis=0)  # of the word in its group
            left -= np.where(number > 0, np.take_along_axis(upto, np.maximum(number - 1, 0)[None], 0)[0], 0)
            word, inside = words[np.arange(own.size), number], left.astype(np.uint64)
            with np.errstate(over="ignore"):
                upto_byte = _ones_in_bytes(word) * _LOW  # in each byte the number of ones up to its end
                byte = np.bitwise_count(((inside * _LOW | _HIGH) - upto_byte) & _HIGH).astype(np.uint64)  # bytes that end before the wanted one
            shift = byte << np.uint64(3)
            inside -= ((upto_byte << np.uint64(8)) >> shift) & np.uint64(255)
            out[at : at + own.size] = (group * _GROUP + number * 8 + byte.astype(np.int64)) * 8 + _PLACE[(word >> shift) & np.uint64(255), inside]
        return out

    def _low(self, at: np.ndarray) -> np.ndarray:
        width = 1 if self.low_bits <= 8 else 2 if self.low_bits <= 16 else 4 if self.low_bits <= 32 else 5 if self.low_bits <= 40 else 8
        out = np.zeros(at.size, np.uint64)
        for j in range(width):
            out |= self.low[at * width + j].astype(np.uint64) << np.uint64(8 * j)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self._select(at, True) - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def find(self, values: np.ndarray, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Index of each value inside its range [first, behind), or -1."""
        out = np.full(values.size, -1, np.int64)
        if not self.n or not values.size:
            return out
        top = (values >> np.uint64(self.low_bits)).astype(np.int64)
        known = top < self.high_parts
        top = np.where(known, top, 0)
        start = np.where(top > 0, self._select(np.maximum(top - 1, 0), False) - (top - 1), 0)
        left, right = np.maximum(start, first), np.minimum(self._select(top, False) - top, behind)
        left, right = np.where(known, left, 0), np.where(known, right, 0)
        want = values & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(left < right)
        end = right.copy()
        while open_.size:  # binary search over the low bits of one high part
            mid = (left[open_] + right[open_]) // 2
            less = self._low(mid) < want[open_]
            left[open_[less]] = mid[less] + 1
            right[open_[~less]] = mid[~less]
            open_ = open_[left[open_] < right[open_]]
        at = np.flatnonzero(left < end)
        hit = self._low(left[at]) == want[at]
        out[at[hit]] = left[at[hit]]
        return out


def quantise(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Codes and code book: equally filled bins, each standing for its mean."""
    if not values.size:
        return np.array([], np.uint8), np.zeros(1)
    distinct = _distinct(values)
    if distinct.size <= levels:
        return np.searchsorted(distinct, values).astype(np.uint8), distinct
    edges = np.unique(np.quantile(values, np.linspace(0, 1, levels + 1)[1:-1]))
    codes = np.searchsorted(edges, values, side="right")
    sums, n = np.bincount(codes, values, edges.size + 1), np.bincount(codes, minlength=edges.size + 1)
    return codes.astype(np.uint8), sums / np.maximum(n, 1)


class Trie:
    """Contexts and their successors, over a buffer that may be a memory map."""

    FIELDS = ("contexts", "backoff", "backoff_book", "pointer_low", "pointer_high", "low", "high", "codes", "book", "shape")

    def __init__(self, buffer):
        raw = np.frombuffer(buffer, np.uint8)
        sizes = raw[: 8 * len(self.FIELDS)].view(np.int64)
        kinds = dict(contexts=np.uint64, backoff_book=np.float64, book=np.float64, shape=np.int64)
        at = 8 * len(self.FIELDS)
        for name, size in zip(self.FIELDS, sizes.tolist(), strict=True):
            setattr(self, name, raw[at : at + size].view(kinds.get(name, np.uint8)))
            at += -(-size // 8) * 8
        n, low_bits, n_contexts, pointer_bits, self.code_bits = self.shape.tolist()
        self.pointers = EliasFano(self.pointer_low, self.pointer_high, n_contexts + 1, pointer_bits)
        self.successors = EliasFano(self.low, self.high, n, low_bits)

    @classmethod
    def packed(cls, contexts: np.ndarray, backoff: np.ndarray, rank: np.ndarray, code: np.ndarray, log_p: np.ndarray, code_bits: int) -> bytes:
        """Contexts are sorted hashes; the successors are sorted by their context's rank, then by code."""
        values = (rank.astype(np.uint64) << np.uint64(code_bits)) | code
        low, high, low_bits = EliasFano.parts(values, (contexts.size + 1) << code_bits)
        pointers = np.concatenate(([0], np.cumsum(np.bincount(rank, minlength=contexts.size)))).astype(np.uint64)
        p_low, p_high, p_bits = EliasFano.parts(pointers, int(pointers[-1]) + 1)
        codes, book = quantise(log_p)
        b_codes, b_book = quantise(backoff)
        fields = [contexts, b_codes, b_book, p_low, p_high, low, high, codes, book, np.array([values.size, low_bits, contexts.size, p_bits, code_bits], np.int64)]
        return np.array([a.nbytes for a in fields], np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8) for a in fields)

    def log10(self, contexts: np.ndarray, code: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 P of successors; ``lower`` is their log10 P in the order below."""
        if not self.contexts.size:
            return lower.copy()
        rank = np.minimum(np.searchsorted(self.contexts, contexts), self.contexts.size - 1)
        known = self.contexts[rank] == contexts
        fresh = np.concatenate(([True], rank[1:] != rank[:-1])) if rank.size else np.array([], bool)
        one, run = rank[fresh], np.cumsum(fresh) - 1  # n-grams of one context stand together: its range is looked up once
        first, behind = self.pointers.get(one).astype(np.int64)[run], self.pointers.get(one + 1).astype(np.int64)[run]
        at = self.successors.find((rank.astype(np.uint64) << np.uint64(self.code_bits)) | code, first, np.where(known, behind, first))
        out = np.where(known, self.backoff_book[self.backoff[rank]], 0.0) + lower
        out[at >= 0] = self.book[self.codes[at[at >= 0]]]
        return out


def _code(context: np.ndarray, word: np.ndarray, count: np.ndarray, order: int) -> np.ndarray:
    """Codes of words within contexts of some count; low bits that are not needed are 0, which compresses."""
    with np.errstate(over="ignore"):
        code = _mix(word ^ (context * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - CODE_BITS[order])
    return np.where(count < FEW[order], code & ~np.uint64(0xFF), code)


class _Scale:
    """log10 probabilities as 12-bit codes, finer towards 0, between the least that the model gives and 0."""

    def __init__(self, n: int, v: int):
        self.least = float(np.log10(0.5 / (n + 0.5 * (v + 1)))) - 6  # a back-off weight m / (c + m) is hardly below 1e-6

    def codes(self, log_p: np.ndarray) -> np.ndarray:
        return np.rint(np.sqrt(np.clip(log_p / self.least, 0, 1)) * 4095).astype(np.uint16)

    def values(self, codes: np.ndarray) -> np.ndarray:
        return (codes / 4095) ** 2 * self.least


def _fit(context: np.ndarray, word: np.ndarray, n_contexts: int) -> np.ndarray:
    """Sums for the fit of m: over contexts, of the logarithms of their counts and of their numbers of successors."""
    counts = np.bincount(context, minlength=n_contexts)
    pairs = _distinct((context << 32) | word)
    followers = np.bincount(pairs >> 32, minlength=n_contexts)
    use = followers > 0
    x, y = np.log(counts[use]), np.log(followers[use])
    return np.array([x.size, x.sum(), y.sum(), (x * x).sum(), (x * y).sum()])


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, held, payload): about BLOCK_TOKENS tokens in each block."""
    names = ["block", "doc_id", "held", "payload"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, made = TaskContext.get().partitionId(), 0
        parts, lengths, ids, held, total = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            hashes, tokens = np.unique(np.concatenate(parts), return_inverse=True)
            sizes, end = np.concatenate(lengths), int(np.searchsorted(hashes, END))
            learn = np.repeat(np.array([h is False for h in held]), sizes)
            counts = np.bincount(tokens[learn], minlength=hashes.size)
            inner = learn[:-1] & (tokens[:-1] != end)
            v, w = tokens[:-1][inner], tokens[1:][inner]
            follows = inner[:-1] & inner[1:] if inner.size else inner
            u3, v3, w3 = tokens[:-2][follows], tokens[1:-1][follows], tokens[2:][follows]
            pairs, which = np.unique((u3 << 32) | v3, return_inverse=True)
            fit = np.concatenate([_fit(v, w, hashes.size), _fit(which, w3, pairs.size)])
            payload = pack(np.diff(hashes, prepend=np.uint64(0)), _small(counts), _small(tokens), sizes, fit)
            return pa.RecordBatch.from_arrays([pa.array([(partition << 32) | made], pa.int64()), pa.array([ids], pa.list_(batch.column(0).type)), pa.array([held], pa.list_(pa.bool_())), pa.array([payload], pa.binary())], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                flat, counts = word_hashes(piece.column(1).to_pylist())
                parts.append(np.insert(flat, np.cumsum(counts), END))
                lengths.append(counts + 1)
                ids += piece.column(0).to_pylist()
                held += piece.column(2).to_pylist()
                total += flat.size + counts.size
                if total >= BLOCK_TOKENS:
                    yield close()
                    made += 1
                    parts, lengths, ids, held, total = [], [], [], [], 0
                    release_memory()
        if ids:
            yield close()

    return docs.mapInArrow(run, f"block bigint, doc_id array<{kind}>, held array<boolean>, payload binary")


def _word_counts(blocks: DataFrame, n_shards: int) -> DataFrame:
    """Rows per shard and block with the corpus counts of the block's words; a row with block -1 has the shard's N, V and fit."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                deltas, counts, _, _, fit = unpack(payload)
                hashes = np.cumsum(deltas, dtype=np.uint64)
                ends = np.searchsorted((hashes >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32), np.arange(n_shards + 1))
                rows = [(k, pack(np.diff(hashes[ends[k] : ends[k + 1]], prepend=np.uint64(0)), counts[ends[k] : ends[k + 1]], fit if k == block % n_shards else fit[:0])) for k in range(n_shards)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([block] * n_shards, pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["shard", "block", "payload"])

    def add(table: pa.Table) -> pa.Table:
        blocks_, own = table.column("block").to_pylist(), [unpack(p) for p in table.column("payload").to_pylist()]
        hashes, counts = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in own]), np.concatenate([x[1].astype(np.int64) for x in own])
        fits = sum((x[2] for x in own if x[2].size), np.zeros(10))
        distinct, inverse = np.unique(hashes, return_inverse=True)
        sums = np.bincount(inverse, counts, distinct.size).astype(np.int64)
        ends = np.cumsum([x[0].size for x in own])
        out = [pack(_small(sums[inverse[e - x[0].size : e]])) for x, e in zip(own, ends, strict=True)]
        stats = [float(sums.sum()), float((sums > 0).sum()), *fits.tolist()]
        shard = table.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard] * (len(out) + 1), pa.int32()), "block": pa.array([*blocks_, -1], pa.int64()), "payload": pa.array([*out, None], pa.binary()), "stats": pa.array([None] * len(out) + [stats], pa.list_(pa.float64()))})

    dealt = blocks.select("block", "payload").mapInArrow(deal, "shard int, block bigint, payload binary")
    return dealt.groupBy("shard").applyInArrow(add, "shard int, block bigint, payload binary, stats array<double>")


def _steps(contexts: np.ndarray) -> np.ndarray:
    """Contexts of a row as differences; they ascend but for the start mark, and differences may wrap."""
    with np.errstate(over="ignore"):
        return np.diff(contexts >> CONTEXT_SHIFT, prepend=np.uint64(0))


class _Grouped:
    """A block's n-grams, each once, in the order of the shards of their contexts."""

    def __init__(self, names: np.ndarray, splits: np.ndarray, context: np.ndarray, code: np.ndarray, bits: int, n_shards: int):
        part = code.astype(np.int64) % splits[context]
        offset = np.cumsum(splits) - splits
        owner = np.repeat(np.arange(names.size), splits)
        number = np.arange(owner.size) - offset[owner]
        with np.errstate(over="ignore"):
            shard = (_mix(names[owner] + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(n_shards)).astype(np.int64)
        by_shard = np.argsort(shard, kind="stable")
        rank = np.empty_like(by_shard)
        rank[by_shard] = np.arange(by_shard.size)
        key = (rank[offset[context] + part].astype(np.uint64) << np.uint64(bits)) | code
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        fresh = np.concatenate(([True], key[1:] != key[:-1])) if key.size else np.array([], bool)
        self.starts = np.append(np.flatnonzero(fresh), key.size)
        key = key[self.starts[:-1]]
        self.rank, self.code = (key >> np.uint64(bits)).astype(np.int64), key & np.uint64((1 << bits) - 1)
        self.times = np.diff(self.starts)
        self.context = owner[by_shard[self.rank]]
        self.ends = np.searchsorted(shard[by_shard][self.rank], np.arange(n_shards + 1))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums of a column of the tokens for each n-gram."""
        return np.add.reduceat(x[self.order].astype(np.int64), self.starts[:-1]) if self.rank.size else np.array([], np.int64)

    def of_token(self) -> np.ndarray:
        """Each token's n-gram."""
        out = np.empty(self.order.size, np.int64)
        out[self.order] = np.repeat(np.arange(self.rank.size), self.times)
        return out

    def cuts(self) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """(shard, its n-grams, its contexts, the number of n-grams of each)."""
        for k in range(self.ends.size - 1):
            cut = slice(int(self.ends[k]), int(self.ends[k + 1]))
            if cut.start < cut.stop:
                _, first, sizes = np.unique(self.rank[cut], return_index=True, return_counts=True)
                yield k, cut, self.context[cut][first], sizes


class _Tokens:
    """A stored block with the corpus counts of its words, and its bigrams."""

    def __init__(self, payload: bytes, held: list, counts: list, n_shards: int, n: int):
        deltas, _, tokens, self.lengths, _ = unpack(payload)
        hashes = np.cumsum(deltas, dtype=np.uint64)
        self.tokens = tokens.astype(np.int64)
        self.counts = np.concatenate([unpack(x["payload"])[0].astype(np.int64) for x in sorted(counts, key=lambda x: x["shard"])])
        self.doc = np.repeat(np.arange(self.lengths.size), self.lengths)
        self.learn = np.array([h is False for h in held])[self.doc]
        self.first = np.cumsum(self.lengths) - self.lengths
        # the start mark stands before each text; its count is that of training texts, found where it is needed
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = hashes.size
        self.names = np.append(hashes, START)
        splits = np.append(1 + self.counts // SPLIT, 1 + n // (64 * SPLIT))
        count = np.append(self.counts, np.iinfo(np.int64).max)[before]
        self.bigrams = _Grouped(self.names, splits, before, _code(self.names[before], hashes[self.tokens], count, 2), CODE_BITS[2], n_shards)

    def log_p1(self, n: int, v: int) -> np.ndarray:
        return np.log10((self.counts + 0.5) / (n + 0.5 * (v + 1)))


def _bigrams(blocks: DataFrame, n_shards: int, n: int, v: int) -> DataFrame:
    """(shard, block, payload): the distinct bigrams of each block by shard of the second order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = _Scale(n, v)
        for batch in batches:
            for block, held, payload, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "held", "payload", "counts")), strict=True):
                own = _Tokens(payload, held, counts, n_shards, n)
                g = own.bigrams
                lower = (scale.codes(own.log_p1(n, v)) & np.uint16(0xFFFC) | np.uint16(2))[own.tokens[g.order[g.starts[:-1]]]]  # 10 bits will do
                trained, of_context = g.sums(own.learn), np.append(own.counts, -1)
                rows = [(k, pack(_steps(own.names[contexts]), of_context[contexts], _small(sizes), g.code[cut].astype(np.uint32), lower[cut], _small(trained[cut]), _small(g.times[cut]))) for k, cut, contexts, sizes in g.cuts()]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["shard", "block", "payload"])
                del own, g, rows
                release_memory()

    return blocks.select("block", "held", "payload", "counts").mapInArrow(run, "shard int, block bigint, payload binary")


def _order(own: list[list[np.ndarray]], scale: _Scale, a: float, b: float, bits: int, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all n-grams of a shard's rows, one behind the other: log10 P by the shard's trie, their training and their whole count."""
    contexts, inverse = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in own]), return_inverse=True)
    count = np.zeros(contexts.size, np.int64)
    count[inverse] = np.concatenate([x[1] for x in own])
    count[count < 0] = n_texts
    at = np.cumsum([0, *(x[0].size for x in own)])
    rank = np.concatenate([np.repeat(inverse[i:j], x[2]) for x, i, j in zip(own, at[:-1], at[1:], strict=True)])
    key = (rank.astype(np.uint64) << np.uint64(bits)) | np.concatenate([x[3] for x in own])
    del rank
    key, first, which = np.unique(key, return_index=True, return_inverse=True)
    trained = np.bincount(which, np.concatenate([x[5] for x in own])).astype(np.int64)
    whole = np.bincount(which, np.concatenate([x[6] for x in own])).astype(np.int64)
    lower = scale.values(np.concatenate([x[4] for x in own])[first])
    rank, code = (key >> np.uint64(bits)).astype(np.int64), key & np.uint64((1 << bits) - 1)
    strength = np.where(count > 0, a * np.maximum(count, 1).astype(float) ** b, 1.0)
    backoff = np.log10(strength / (count + strength))
    seen = trained > 0
    m, c = strength[rank[seen]], count[rank[seen]]
    log_p = np.log10((trained[seen] + m * 10.0 ** lower[seen]) / np.maximum(c + m, trained[seen]))
    raw = Trie.packed(contexts, backoff, rank[seen], code[seen], log_p, bits)
    with mmap.mmap(-1, len(raw)) as mapped:
        mapped.write(raw)
        trie = Trie(mapped)
        found = trie.log10(contexts[rank], code, lower)
        del trie  # its arrays are views of the map
    return found[which], trained[which], whole[which]


def _answers(bigrams: DataFrame, n: int, v: int, n_texts: int, a: float, b: float) -> DataFrame:
    """(block, shard, payload): for each bigram of a block its quantised log10 P2, its training count, and whether it occurs again."""

    def run(table: pa.Table) -> pa.Table:
        scale = _Scale(n, v)
        own = [unpack(p) for p in table.column("payload").to_pylist()]
        found, trained, whole = _order(own, scale, a, b, CODE_BITS[2], n_texts)
        codes, again = scale.codes(found), whole > 1
        out, at = [], 0
        for x in own:
            cut = slice(at, at + x[3].size)
            out.append(pack(codes[cut], _small(trained[cut]), np.packbits(again[cut])))
            at = cut.stop
        del own, found, trained, whole, codes, again
        release_memory()
        return table.set_column(table.column_names.index("payload"), "payload", pa.array(out, pa.binary()))

    return bigrams.groupBy("shard").applyInArrow(run, "shard int, block bigint, payload binary")


def _trigrams(blocks: DataFrame, order: int, n_shards: int, n_shards_3: int, n: int, v: int, fit: tuple[float, float]) -> DataFrame:
    """(shard, block, payload, doc_id, held): trigrams that may occur again by shard of the third order; shards below 0 have the block's documents with the sums of all else."""
    kind = blocks.schema["doc_id"].dataType.simpleString()
    a, b = fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = _Scale(n, v)
        for batch in batches:
            for row in range(batch.num_rows):
                block, held = batch.column("block")[row].as_py(), batch.column("held")[row].as_py()
                own = _Tokens(batch.column("payload")[row].as_py(), held, batch.column("counts")[row].as_py(), n_shards, n)
                g, answers = own.bigrams, [unpack(x["payload"]) for x in sorted(batch.column("answers")[row].as_py(), key=lambda x: x["shard"])]
                codes, count = np.concatenate([x[0] for x in answers]), np.concatenate([x[1].astype(np.int64) for x in answers])
                again = np.concatenate([np.unpackbits(x[2], count=x[0].size).astype(bool) for x in answers])
                of_token = g.of_token()
                size = own.lengths.size
                base = np.bincount(own.doc, own.log_p1(n, v)[own.tokens], size)
                known = np.bincount(own.doc, own.counts[own.tokens] > 0, size)
                log_p = scale.values(codes)[of_token]
                rows: list[tuple[int, bytes]] = []
                if order > 2:
                    context = np.empty_like(of_token)
                    context[1:] = of_token[:-1]
                    context[own.first] = -1  # a first word has the start mark alone
                    inner = np.flatnonzero((context >= 0) & (count[context] > 0))
                    sent = again[context[inner]] & again[of_token[inner]]
                    at = inner[~sent]  # these occur once, here
                    c = count[context[at]]
                    m = a * c.astype(float) ** b
                    log_p[at] = np.log10((own.learn[at] + m * 10.0 ** log_p[at]) / (c + m))
                    at = inner[sent]
                    used, which = np.unique(context[at], return_inverse=True)
                    one = g.order[g.starts[used]]  # a token that ends each context
                    with np.errstate(over="ignore"):
                        names = _mix(own.names[own.tokens[one]] + _mix(own.names[g.context[used]]) * np.uint64(0x9E3779B97F4A7C15))
                    by_name = np.argsort(names)
                    place = np.empty_like(by_name)
                    place[by_name] = np.arange(by_name.size)
                    names, of_context, which = names[by_name], count[used][by_name], place[which]
                    h = _Grouped(names, 1 + of_context // SPLIT, which, _code(names[which], own.names[own.tokens[at]], of_context[which], 3), CODE_BITS[3], n_shards_3)
                    lower, trained, docs = codes[of_token[at]][h.order[h.starts[:-1]]], h.sums(own.learn[at]), own.doc[at][h.order]
                    log_p[at] = 0.0
                    for k, cut, contexts, sizes in h.cuts():
                        rows.append((k, pack(_steps(names[contexts]), _small(of_context[contexts]), _small(sizes), h.code[cut].astype(np.uint32), lower[cut], _small(trained[cut]), _small(h.times[cut]), _small(docs[h.starts[cut.start] : h.starts[cut.stop]]), np.array([size]))))
                    del h, names, docs
                rows.append((-1 - block % n_shards, pack(own.lengths, known.astype(np.int64), base, np.bincount(own.doc, log_p, size))))
                nothing = [None] * (len(rows) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary()), pa.array([*nothing, batch.column("doc_id")[row].as_py()], batch.column("doc_id").type), pa.array([*nothing, held], pa.list_(pa.bool_()))], names=["shard", "block", "payload", "doc_id", "held"])
                del rows, own, g, answers, codes, count, again, of_token, log_p
                release_memory()

    return blocks.select("block", "doc_id", "held", "payload", "counts", "answers").mapInArrow(run, f"shard int, block bigint, payload binary, doc_id {kind}, held array<boolean>")


TOGETHER = 4  # shards whose sums return together


def _score_shards(trigrams: DataFrame, n: int, v: int, a: float, b: float) -> DataFrame:
    """(block, payload, doc_id, held): sums of log10 P per block and group of shards; a block's documents pass through."""
    kind = trigrams.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:
            return table.select(["block", "payload", "doc_id", "held"])
        scale = _Scale(n, v)
        blocks, shards, payloads = np.array(table.column("block").to_pylist()), np.array(table.column("shard").to_pylist()), table.column("payload")
        sums: dict[int, np.ndarray] = {}
        for shard in np.unique(shards).tolist():
            rows = np.flatnonzero(shards == shard)
            rows = rows[np.argsort(blocks[rows], kind="stable")].tolist()
            own = [unpack(payloads[i].as_py()) for i in rows]
            found, _, _ = _order(own, scale, a, b, CODE_BITS[3], 0)
            at = 0
            for i, x in zip(rows, own, strict=True):
                part = np.bincount(x[7], np.repeat(found[at : at + x[3].size], x[6]), int(x[8][0]))
                sums[int(blocks[i])] = sums[int(blocks[i])] + part if int(blocks[i]) in sums else part
                at += x[3].size
            del own, found
            release_memory()
        out = pa.array([pack(x.astype(np.float32)) for x in sums.values()], pa.binary())
        return pa.table({"block": pa.array(list(sums), pa.int64()), "payload": out, "doc_id": pa.nulls(len(sums), table.column("doc_id").type), "held": pa.nulls(len(sums), pa.list_(pa.bool_()))})

    return trigrams.groupBy(F.floor(F.col("shard") / TOGETHER)).applyInArrow(run, f"block bigint, payload binary, doc_id {kind}, held array<boolean>")


def _sum_blocks(parts: DataFrame, kind: str, n: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        ids, held = table.column("doc_id").to_pylist(), table.column("held").to_pylist()
        payloads = table.column("payload").to_pylist()
        head = next(i for i, x in enumerate(ids) if x is not None)
        lengths, known, base, local = unpack(payloads[head])
        sums = sorted(p for i, p in enumerate(payloads) if i != head)  # a fixed order of addition
        score = sum((unpack(p)[0].astype(np.float64) for p in sums), local)
        return pa.table({
            "doc_id": pa.array(ids[head], table.column("doc_id").type.value_type), "held_out": pa.array(held[head], pa.bool_()), "n_tokens": pa.array(lengths), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(lengths.size, n, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
        })

    return parts.groupBy("block").applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _power(points: float, sx: float, sy: float, sxx: float, sxy: float) -> tuple[float, float]:
    """a and b of m = a c^b from the sums of all blocks."""
    spread = points * sxx - sx * sx
    b = min(1.0, max(0.0, (points * sxy - sx * sy) / spread)) if spread > 1e-9 else 0.5
    return (float(np.exp((sy - b * sx) / points)) if points else 1.0), b


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, held_out: int = 1, folds: int = 5, order: int = ORDER) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; ``order`` is 2 or 3."""
    if order not in CODE_BITS:
        raise ValueError("the model has order 2 or 3")
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold == held_out).alias("held"))
    kind = own.schema["doc_id"].dataType.simpleString()
    size = estimated_bytes(docs, text_col)
    blocks = store_buckets(_blocks(own), "lm_blocks", "block", shards_for(size, 8 << 20))
    counted = store(_word_counts(blocks.read(), shards_for(size, 16 * SHARD_BYTES)), "word-counts")
    collect_garbage(docs.sparkSession)
    stats = counted.read().where("block = -1").select(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(12)]).first()
    n, v = int(stats.s0 or 0), int(stats.s1 or 0)
    fits = {2: _power(*(float(stats[i] or 0) for i in range(2, 7))), 3: _power(*(float(stats[i] or 0) for i in range(7, 12)))}
    n_texts = own.where("held = false").count()
    counts = counted.read().where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "payload")).alias("counts"))
    n_shards, n_shards_3 = shards_for(size, SHARD_BYTES), shards_for(size, 2 * SHARD_BYTES)
    answered = _answers(_bigrams(blocks.read().join(counts, "block"), n_shards, n, v), n, v, n_texts, *fits[2])
    answered = store_buckets(answered.repartition(blocks.n, "block"), "lm_answers", "block", blocks.n)  # a file for each bucket
    collect_garbage(docs.sparkSession)
    answers = answered.read().groupBy("block").agg(F.collect_list(F.struct("shard", "payload")).alias("answers"))
    joined = blocks.read().join(counts, "block").join(answers, "block")
    scored = _score_shards(_trigrams(joined, order, n_shards, n_shards_3, n, v, fits[3]), n, v, *fits[3])
    return _sum_blocks(scored, kind, n).withColumnRenamed("doc_id", id_col)


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
