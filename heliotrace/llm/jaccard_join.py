"""N-gram Jaccard self-join with token-combination prefixes.

A document's set has the 64-bit hashes of its distinct 5-word shingles (of the whole sequence, if
shorter). Two documents link if 100 * |intersection| >= 75 * |union|, so at least 75 % of the
tokens of a linked set occur in another set. Tokens are first counted over all documents, by
shards of a hash just wide enough for their number, and each shard returns how many of a
document's tokens are repeated: sets with fewer than 75 % repeated tokens link with no other set
and are settled. The other distinct sets are the candidates; only their texts are stored.

Among candidates the numbers of sets that hold each token are counted exactly and returned to the
blocks of sets that hold it, so the order of tokens needs no list that grows with the data. Tokens
are ordered rare before frequent, then by hash. Linked sets of size s share a token among the
first s - ceil(0.75 s) + 1 of each (the prefix). If a shared one is rare, single rare tokens of
the prefix find the pair (rare tokens come by the logarithm of their sets' number, then by hash).
If not, all tokens they share are frequent, and the prefix extended by b tokens shares b + 1;
dealt into b classes by hash, some class holds two of them, so pairs of frequent tokens within a
class find the pair. b grows with s, which keeps the number of pairs in proportion to s. Both
indexes are exact. Frequent are tokens in 32 sets or more.

Buckets of sets with a common key are not expanded into pairs. Each is verified first as stars
around its smallest members. Stars hold each bucket's comparable members together, so members
that may link but have not been compared lie in components joined by edges of stars that did not
verify. Such components form a cluster, and each cluster is joined exactly inside a task, by
counting common tokens along the lists of its tokens. A cluster of more than ``cluster_block``
sets is dealt in blocks, and each pair of blocks is one unit of work. A unit returns a spanning
forest of its links. Whole sets are compared; a set is sent once to each unit. Keys whose frequent
tokens would gather more than ``split`` sets are split by set. A part gives the center, the least
and the greatest size of each of its runs of comparable sizes; all runs of a key are chained by
size in the same way, wherever one may hold a set comparable to another's, so a key's parts meet
at every size.

Sets are known by a 64-bit hash of their tokens (128 bits where copies are grouped), so joining
does not depend on ids. A block's rows carry a key of the block's content and are counted where
they meet again: input whose order changes between attempts of a task raises an error.

Defined results: a null or empty text has the empty set, size 0, and is its own component; rows
with equal sets are linked; a null id has its set's component (the least id of its class), or null
where its class has no id; rows that repeat an id with other texts link only by their sets; an
empty table gives an empty table; columns other than the id and the text are not read, so names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotrace.llm.common import estimated_bytes, pack, release_memory, shards_for, store, text_hash, unpack, without_rows, word_hashes

WIDTH, PERCENT = 5, 75
SHARD_BYTES = 6 << 20
MAX_BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Limits:
    """Sizes of units of work; results do not depend on them."""

    block_shingles: int = 600_000
    combine: int = 5  # logarithm of the sets from which tokens are combined
    split: int = 4_096
    cluster_block: int = 512
    star: int = 256  # members verified beside one copy of their center


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes. Words are cut at ASCII white space; A-Z is lower-cased."""

    def __init__(self, width: int = WIDTH):
        self.width = width

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        w = self.width
        flat, sizes = word_hashes(texts)
        n = flat.size
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, n - w + 1), np.uint64)
            for j in range(w if rolled.size else 0):
                rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + flat[j : n - w + 1 + j] + np.uint64(j + 1))
            out, at = [], 0
            for size in sizes.tolist():
                if size >= w:
                    own = np.sort(rolled[at : at + size - w + 1])
                    out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
                elif size:
                    one = np.full(1, size, np.uint64)
                    for j in range(size):
                        one = _mix(one * np.uint64(0xC2B2AE3D27D4EB4F) + flat[at + j])
                    out.append(one)
                else:
                    out.append(rolled[:0])
                at += size
        return out


def _set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    both = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    flat = np.frombuffer(b"".join(both), ">i8").reshape(-1, 2).astype(np.int64)
    return flat[:, 0], flat[:, 1]


def _blocks(batches: Iterator[pa.RecordBatch], width: int, block_shingles: int) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    """(ids, texts, sets) of about ``block_shingles`` shingles each; the ids come first in a batch, the texts second."""
    shingler, ids, texts, sets, total = Shingler(width), [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            raw = part.column(1).to_pylist()
            own = shingler(raw)
            ids += part.column(0).to_pylist()
            texts += raw
            sets += own
            total += sum(s.size for s in own)
            if total >= block_shingles:
                yield ids, texts, sets
                ids, texts, sets, total = [], [], [], 0
                release_memory()
    if ids:
        yield ids, texts, sets
    release_memory()


def _cut(shards: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Slices of equal shard numbers in a sorted array."""
    ends = np.searchsorted(shards, np.arange(n + 1))
    for k in range(n):
        if ends[k] < ends[k + 1]:
            yield k, slice(int(ends[k]), int(ends[k + 1]))


def _token_rows(sets: list[np.ndarray], bits: int, n_shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, distinct tokens of ``bits`` bits, their times, the positions of the sets that hold them) of a block's sets."""
    if not sets:
        return
    flat = np.concatenate(sets) >> np.uint64(64 - bits)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [s.size for s in sets])[order]
    flat = flat[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if flat.size else np.array([], np.int64)
    times, tokens, starts = np.diff(np.append(first, flat.size)), flat[first], np.append(first, flat.size)
    shards = ((tokens >> np.uint64(bits - 24)) * np.uint64(n_shards) >> np.uint64(24)).astype(np.int64)
    for k, cut in _cut(shards, n_shards):
        yield k, tokens[cut], times[cut], owner[starts[cut.start] : starts[cut.stop]]


def _deltas(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted array as its first value and its differences, in as few bytes as these need."""
    gaps = np.diff(tokens, prepend=tokens[:1])
    return tokens[:1], gaps.astype(np.uint16 if gaps.max(initial=0) < 1 << 16 else np.uint32 if gaps.max(initial=0) < 1 << 32 else np.uint64)


def _undone(first: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    return first + np.cumsum(gaps.astype(np.uint64), dtype=np.uint64)


def _sums(tokens: list[np.ndarray], times: list[np.ndarray]) -> np.ndarray:
    """For each of some blocks' tokens, one behind the other, the sum of its times over all of them."""
    _, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    return np.bincount(inverse, np.concatenate(times)).astype(np.int64)[inverse]


def _few(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _repeated(docs: DataFrame, n_shards: int, bits: int, width: int, limits: Limits) -> DataFrame:
    """(doc_id, hashed, n, a, b, repeated): each row's set, its size and at least the number of its tokens that other sets hold too."""
    names = ["shard", "block", "payload", "parts", "doc_id", "hashed", "a", "b", "n", "of"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), *[pa.list_(pa.int64())] * 6]
    schema = "shard int, block bigint, payload binary, parts int, doc_id array<bigint>, hashed array<bigint>, a array<bigint>, b array<bigint>, n array<bigint>, of array<bigint>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        partition, made = TaskContext.get().partitionId(), 0
        for ids, texts, sets in _blocks(batches, width, limits.block_shingles):
            a, b = _set_ids(sets)
            hashed = [text_hash(t) for t in texts]
            _, one, of = np.unique(a, return_index=True, return_inverse=True)  # a copy counts once in a block
            block = xxhash.xxh3_64_intdigest(f"{partition} {made} {ids}".encode() + a.tobytes()) >> 1
            made += 1
            rows = [(k, pack(*_deltas(tokens), np.flatnonzero(times > 1).astype(np.uint32), _few(times[times > 1]), _few(owner), np.array([one.size]))) for k, tokens, times, owner in _token_rows([sets[i] for i in one.tolist()], bits, n_shards)]
            n = np.array([s.size for s in sets], np.int64)
            home = [-1 - block % n_shards, block, None, len(rows), ids, hashed, a, b, n, of]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(home, kinds, strict=True)], names=names)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary()), *(pa.nulls(len(rows), kind) for kind in kinds[3:])], names=names)

    def count(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:
            return table
        tokens, times, owners, sizes = [], [], [], []
        for payload in table.column("payload").to_pylist():
            first, gaps, at, more, owner, size = unpack(payload)
            tokens.append(_undone(first, gaps))
            own = np.ones(gaps.size, np.int64)
            own[at] = more
            times.append(own)
            owners.append(owner)
            sizes.append(int(size[0]))
        again = _sums(tokens, times) >= 2
        out, at = [], 0
        for own, owner, size in zip(times, owners, sizes, strict=True):
            out.append(pack(_few(np.bincount(owner[np.repeat(again[at : at + own.size], own)], minlength=size))))
            at += own.size
        del tokens, times, owners, again
        release_memory()
        return table.set_column(2, "payload", pa.array(out, pa.binary()))

    def add(table: pa.Table) -> pa.Table:
        home = next((r for r in table.select(["parts", "doc_id", "hashed", "a", "b", "n", "of"]).to_pylist() if r["doc_id"] is not None), None)
        payloads = [p for p in table.column("payload").to_pylist() if p is not None]
        if home is None or home["parts"] != len(payloads):
            raise ValueError("a block of documents was cut in another way when its task ran again: store the input first")
        of = np.array(home["of"], np.int64)
        repeated = sum((unpack(p)[0].astype(np.int64) for p in payloads), np.zeros(int(of.max()) + 1, np.int64))[of]
        return pa.table({"doc_id": pa.array(home["doc_id"], pa.int64()), "hashed": pa.array(home["hashed"], pa.int64()), "n": pa.array(home["n"], pa.int64()), "a": pa.array(home["a"], pa.int64()), "b": pa.array(home["b"], pa.int64()), "repeated": pa.array(repeated)})

    counted = docs.mapInArrow(deal, schema).groupBy("shard").applyInArrow(count, schema)
    return counted.groupBy("block").applyInArrow(add, "doc_id bigint, hashed bigint, n bigint, a bigint, b bigint, repeated bigint")


def _candidate_blocks(candidates: DataFrame, width: int, limits: Limits) -> DataFrame:
    """(block, a, payload): blocks of candidates' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, made = TaskContext.get().partitionId(), 0
        for a, texts, _ in _blocks(batches, width, limits.block_shingles):
            raw = [(t or "").encode() for t in texts]
            payload = pack(np.array([len(r) for r in raw]), np.frombuffer(b"".join(raw), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([(partition << 32) | made], pa.int64()), pa.array([a], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["block", "a", "payload"])
            made += 1

    return candidates.select("a", "text").mapInArrow(run, "block bigint, a array<bigint>, payload binary")


def _sets_of(a: list[int], payload: bytes, shingler: Shingler) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct sets of a block, by their hash."""
    lengths, data = unpack(payload)
    ends, raw = np.cumsum(lengths).tolist(), data.tobytes()
    marks, one = np.unique(np.array(a, np.int64), return_index=True)
    sets: list[np.ndarray] = []
    for at in range(0, one.size, 64):
        sets += shingler([raw[ends[i] - int(lengths[i]) : ends[i]].decode() for i in one[at : at + 64].tolist()])
    return marks, sets


def _levels(blocks: DataFrame, n_shards: int, width: int) -> DataFrame:
    """(block, shard, levels): for each block's distinct 40-bit tokens of a shard, in order, the binary logarithm of the number of sets with it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for block, a, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "a", "payload")), strict=True):
                rows = [(k, pack(*_deltas(tokens), _few(times))) for k, tokens, times, _ in _token_rows(_sets_of(a, payload, shingler)[1], 40, n_shards)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["shard", "block", "payload"])
                release_memory()

    def count(table: pa.Table) -> pa.Table:
        own = [unpack(p) for p in table.column("payload").to_pylist()]
        level = np.log2(_sums([_undone(first, gaps) for first, gaps, _ in own], [t for _, _, t in own])).astype(np.uint8)
        ends = np.cumsum([gaps.size for _, gaps, _ in own]).tolist()
        out = [pack(level[e - x[1].size : e]) for x, e in zip(own, ends, strict=True)]
        del own, level
        release_memory()
        return table.set_column(2, "payload", pa.array(out, pa.binary()))

    schema = "shard int, block bigint, payload binary"
    return blocks.mapInArrow(deal, schema).groupBy("shard").applyInArrow(count, schema)


def prefix_keys(s: np.ndarray, level: np.ndarray, combine: int = Limits.combine) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a sorted set and, for each, the logarithm of the sets it may gather, from each token's level."""
    n = s.size
    prefix = n - -(-PERCENT * n // 100) + 1
    rare = s[level < combine]
    if rare.size and level.any():
        rare = rare[np.argsort(level[level < combine], kind="stable")]
    singles = rare[:prefix]
    if singles.size == prefix or n < 2:
        return singles, np.zeros(singles.size, np.uint8)
    frequent, own_level = s[level >= combine], level[level >= combine]
    keys, levels = [singles], [np.zeros(singles.size, np.uint8)]
    for classes in sorted({_classes(n), _classes(n * 100 // PERCENT)}):
        m = min(frequent.size, prefix + classes - rare.size) if rare.size < prefix + classes else 0
        if m < 2:
            continue
        with np.errstate(over="ignore"):
            dealt = (_mix(frequent[:m]) >> np.uint64(40)).astype(np.int64) % classes
        order = np.argsort(dealt, kind="stable")
        dealt, tokens, lv = dealt[order], frequent[:m][order], own_level[:m][order]
        for gap in range(1, m):
            same = np.flatnonzero(dealt[gap:] == dealt[:-gap])
            if not same.size:
                break
            with np.errstate(over="ignore"):
                keys.append(_mix(_mix(tokens[same] + np.uint64(classes)) * np.uint64(3) + tokens[same + gap]))
            levels.append(np.minimum(lv[same], lv[same + gap]))
    return np.concatenate(keys), np.concatenate(levels)


def _classes(n: int) -> int:
    """Number of hash classes for sets of n tokens: a power of two near n / 8, so that pairs stay few."""
    return 1 << max(0, (n // 8).bit_length() - 1)


def _postings(blocks: DataFrame, n_shards: int, width: int, limits: Limits) -> DataFrame:
    """(shard, payload): the keys of all sets that may link, from blocks with their tokens' levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, top = Shingler(width), limits.split.bit_length() - 1
        for batch in batches:
            for a, payload, levels in zip(*(batch.column(c).to_pylist() for c in ("a", "payload", "levels")), strict=True):
                marks, sets = _sets_of(a, payload, shingler)
                known = np.concatenate([unpack(x["payload"])[0] for x in sorted(levels, key=lambda x: x["shard"])])
                _, code = np.unique(np.concatenate(sets) >> np.uint64(24), return_inverse=True)
                level = known[code]
                keys, key_levels, owner, at = [], [], [], 0
                for k, s in enumerate(sets):
                    own = level[at : at + s.size]
                    at += s.size
                    if 100 * int((own > 0).sum()) < PERCENT * s.size:
                        continue  # no other set has enough of its tokens
                    found, lv = prefix_keys(s, own, limits.combine)
                    keys.append(found)
                    key_levels.append(lv)
                    owner.append(np.full(found.size, k, np.int32))
                if not keys:
                    continue
                keys, key_levels, owner = np.concatenate(keys), np.concatenate(key_levels).astype(np.int64), np.concatenate(owner)
                sizes = np.array([s.size for s in sets], np.int32)
                # Keys that may gather more than ``split`` sets are split by set; their shard depends on the part.
                parts = np.left_shift(1, np.maximum(0, key_levels - top))
                part = marks[owner].view(np.uint64) % parts.astype(np.uint64)
                with np.errstate(over="ignore"):
                    place = _mix(keys + part)
                shards = (((place >> np.uint64(32)) * np.uint64(n_shards)) >> np.uint64(32)).astype(np.int64)
                order = np.lexsort((keys, shards))
                keys, owner, part, parts, shards = keys[order], owner[order], part[order], parts[order], shards[order]
                rows = []
                for k, cut in _cut(shards, n_shards):
                    used, local = np.unique(owner[cut], return_inverse=True)
                    divided = np.flatnonzero(parts[cut] > 1).astype(np.int32)
                    rows.append((k, pack(keys[cut], local.astype(np.uint16 if used.size < 1 << 16 else np.int32), marks[used], sizes[used], divided, part[cut][divided].astype(np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["shard", "payload"])
                release_memory()

    return blocks.mapInArrow(run, "shard int, payload binary")


def _stars(ids: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a bucket's members, by size, each with the smallest one of its run of comparable sizes."""
    out, center, floor = [], 0, int(sizes[0])
    for k in range(1, ids.size):
        if PERCENT * int(sizes[k]) <= 100 * floor:
            out.append((center, k))
        else:
            if PERCENT * int(sizes[k]) <= 100 * int(sizes[k - 1]):
                out.append((k - 1, k))
            center, floor = k, int(sizes[k])
    return out


def _runs(sizes: np.ndarray) -> list[tuple[int, int]]:
    """First and last member of each of ``_stars``' runs."""
    out, i = [], 0
    while i < sizes.size:
        behind = int(np.searchsorted(PERCENT * sizes.astype(np.int64), 100 * int(sizes[i]), side="right"))
        out.append((i, behind - 1))
        i = behind
    return out


def _chain(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Pairs of centers that join all runs (least size, center, greatest size) of a key that may hold comparable sets.

    A center pairs with the smallest one of its run of comparable centers. The first beyond pairs with
    the center before it if any run so far reaches a comparable size; if none does, no later one is reached either.
    """
    runs = sorted(runs)
    out, (floor, center, reach), before = [], runs[0], runs[0][1]
    for size, own, last in runs[1:]:
        if PERCENT * size <= 100 * floor:
            out.append((center, own))
        else:
            if PERCENT * size <= 100 * reach:
                out.append((before, own))
            floor, center = size, own
        before, reach = own, max(reach, last)
    return out


def _center_pairs(buckets: DataFrame) -> DataFrame:
    """(x, y, open): pairs that join the parts of split keys, by the runs of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for runs in batch.column(0).to_pylist():
                pairs = _chain([(r["least"], r["center"], r["greatest"]) for r in runs])
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64()), pa.array([True] * len(pairs), pa.bool_())], names=["x", "y", "open"])

    runs = buckets.select(F.explode(F.arrays_zip("parent", "least", "center", "greatest")).alias("z")).groupBy("z.parent").agg(F.collect_set(F.struct("z.least", "z.center", "z.greatest")).alias("runs"))
    return runs.where(F.size("runs") > 1).select("runs").mapInArrow(run, "x bigint, y bigint, open boolean")


def _buckets(postings: DataFrame) -> DataFrame:
    """(a, b, open, parent, least, center, greatest): pairs of stars, open if their buckets have more members; and the runs of split buckets' parts."""

    def run(table: pa.Table) -> pa.Table:
        keys, ids, sizes, part = [], [], [], []
        for payload in table.column("payload").to_pylist():
            k, local, own, size, split, which = unpack(payload)
            keys.append(k)
            ids.append(own[local])
            sizes.append(size[local])
            p = np.full(k.size, -1, np.int64)
            p[split] = which
            part.append(p)
        keys, ids, sizes, part = map(np.concatenate, (keys, ids, sizes, part))
        order = np.lexsort((ids, sizes, part, keys))
        keys, ids, sizes, part = keys[order], ids[order], sizes[order], part[order]
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (part[1:] != part[:-1])))
        keys, ids, sizes, part = keys[fresh], ids[fresh], sizes[fresh], part[fresh]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (part[1:] != part[:-1]))))
        ends = np.append(first[1:], keys.size)
        pairs: dict[tuple[int, int], bool] = {}
        seen: set[tuple[bytes, bool]] = set()
        parents, least, centers, greatest = [], [], [], []
        for i, j in zip(first.tolist(), ends.tolist(), strict=True):
            whole = part[i] < 0
            for x, y in () if whole else _runs(sizes[i:j]):
                parents.append(int(keys[i].view(np.int64)))
                least.append(int(sizes[i + x]))
                centers.append(int(ids[i + x]))
                greatest.append(int(sizes[i + y]))
            own = ids[i:j]
            more = j - i > 2 or not whole
            if j - i < 2 or (own.tobytes(), more) in seen:
                continue
            seen.add((own.tobytes(), more))
            for x, y in _stars(own, sizes[i:j]):
                pair = int(own[x]), int(own[y])
                pairs[pair] = more or pairs.get(pair, False)
        del keys, ids, sizes, part, seen
        release_memory()
        return pa.table({
            "a": pa.array([[x for x, _ in pairs]], pa.list_(pa.int64())), "b": pa.array([[y for _, y in pairs]], pa.list_(pa.int64())), "open": pa.array([list(pairs.values())], pa.list_(pa.bool_())),
            "parent": pa.array([parents], pa.list_(pa.int64())), "least": pa.array([least], pa.list_(pa.int64())), "center": pa.array([centers], pa.list_(pa.int64())), "greatest": pa.array([greatest], pa.list_(pa.int64())),
        })

    return postings.groupBy("shard").applyInArrow(run, "a array<bigint>, b array<bigint>, open array<boolean>, parent array<bigint>, least array<bigint>, center array<bigint>, greatest array<bigint>")


def _sets_at(candidates: DataFrame, need: DataFrame, width: int) -> DataFrame:
    """(g, unit, a, tokens): the token sets of the candidates in ``need`` (set, place) at each of their places."""
    need = store(need.groupBy("set").agg(F.collect_set("place").alias("places")), "needed").read()
    texts = candidates.join(F.broadcast(need) if need.count() <= MAX_BROADCAST_ROWS else need, candidates["a"] == need["set"])
    texts = texts.select("a", "text", F.col("places.g").alias("gs"), F.col("places.unit").alias("units"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = shingler(part.column(1).to_pylist())
                g, units, ids, raw = [], [], [], []
                for a, gs, us, s in zip(*(part.column(c).to_pylist() for c in (0, 2, 3)), sets, strict=True):
                    g += gs
                    units += us
                    ids += [a] * len(gs)
                    raw += [s.tobytes()] * len(gs)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(units, pa.int64()), pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["g", "unit", "a", "tokens"])
        release_memory()

    return texts.mapInArrow(send, "g int, unit bigint, a bigint, tokens binary")


def link_sets(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of all links among some sets: for each set the common tokens with every other are counted at once."""
    m = len(sets)
    sizes = np.array([s.size for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    _, code, times = np.unique(tokens, return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    by_token = owner[np.argsort(code, kind="stable")]  # owners of each token, in order
    last = np.cumsum(times)
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(m):
        own = code[ends[i] - sizes[i] : ends[i]]
        own = own[times[own] > 1]
        shared = np.zeros(m, np.int64)
        for t in own.tolist():
            shared[by_token[last[t] - times[t] : last[t]]] += 1
        for j in np.flatnonzero(100 * shared >= PERCENT * (sizes + sizes[i] - shared)).tolist():
            if j > i and find(i) != find(j):
                root[find(j)] = find(i)
                out.append((ids[i], ids[j]))
    return out


def _cluster_links(candidates: DataFrame, labels: DataFrame, unsettled: DataFrame, width: int, limits: Limits) -> DataFrame:
    """Links (x, y) among all sets of components joined by ``unsettled`` (x, y) pairs of labels, as a spanning forest of each unit.

    ``labels`` has a (the set's hash), n and label for every candidate.
    """
    clusters = components(unsettled)
    both = clusters.union(clusters.select("root", "root")).distinct()
    own = labels.join(both, F.col("label") == F.col("node")).select("a", "n", "root")
    blocks = own.groupBy("root").agg(F.ceil(F.count("*") / limits.cluster_block).cast("int").alias("blocks"))
    own = store(own.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")), "clusters").read()
    total = own.agg(F.sum(F.col("n") * F.col("blocks")).alias("s")).first().s or 0
    groups = shards_for(int(total) * 8, SHARD_BYTES // 2)
    unit = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("root", F.least("block", j), F.greatest("block", j)))
    need = own.select(F.col("a").alias("set"), F.explode(unit).alias("unit")).select("set", F.struct(F.pmod("unit", F.lit(groups)).cast("int").alias("g"), "unit").alias("place"))

    def link(table: pa.Table) -> pa.Table:
        units: dict[int, list[int]] = {}
        for row, u in enumerate(table.column("unit").to_pylist()):
            units.setdefault(u, []).append(row)
        ids, tokens, out = table.column("a").to_pylist(), table.column("tokens"), []
        for rows in units.values():
            out += link_sets([ids[r] for r in rows], [np.frombuffer(tokens[r].as_py(), np.uint64) for r in rows])
            release_memory()
        return pa.table({"x": pa.array([x for x, _ in out], pa.int64()), "y": pa.array([y for _, y in out], pa.int64())})

    return _sets_at(candidates, need, width).groupBy("g").applyInArrow(link, "x bigint, y bigint")


def _verify(candidates: DataFrame, pairs: DataFrame, width: int, limits: Limits) -> DataFrame:
    """Of pairs (x, y, x_n, y_n) of sets with their sizes, those (x, y) that link."""
    totals = pairs.agg(F.count("*").alias("n"), F.sum(F.col("x_n") + F.col("y_n")).alias("s")).first()
    if not totals.n:
        return pairs.select("x", "y")
    groups = shards_for(int(totals.s) * 8, SHARD_BYTES // 2)
    star = pairs.groupBy("x").agg(F.count("*").alias("star"))
    dealt = store(pairs.join(star, "x").withColumn("g", F.pmod(F.xxhash64("x", F.pmod(F.xxhash64("y"), F.ceil(F.col("star") / limits.star))), F.lit(groups)).cast("int")), "pairs")
    side = lambda p: dealt.read().select(F.col(p).alias("set"), F.struct("g", F.lit(0).cast("long").alias("unit")).alias("place"))
    need = side("x").unionByName(side("y"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {k: np.frombuffer(t, np.uint64) for k, t in zip(left.column("a").to_pylist(), left.column("tokens").to_pylist(), strict=True)}
        xs, ys = [], []
        for x, y in zip(*(right.column(c).to_pylist() for c in ("x", "y")), strict=True):
            p, q = sets[x], sets[y]
            if p.size > q.size:
                p, q = q, p
            at = np.searchsorted(q, p)
            shared = int((q[np.minimum(at, q.size - 1)] == p).sum())
            if 100 * shared >= PERCENT * (p.size + q.size - shared):
                xs.append(x)
                ys.append(y)
        del sets
        release_memory()
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    return _sets_at(candidates, need, width).groupBy("g").cogroup(dealt.read().select("g", "x", "y").groupBy("g")).applyInArrow(compare, "x bigint, y bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges (x, y) the least node it can reach. Large-star and small-star rounds."""
    now = store(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), "edges")
    mark = None
    while True:
        e = now.read()
        new = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).first()
        if (new.n, new.h) == mark or not new.n:
            return e.select(F.col("x").alias("node"), F.col("y").alias("root"))
        mark = (new.n, new.h)
        both = e.union(e.select("y", "x"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        joined = large.join(least, "x")
        small = joined.where("y <> m").select(F.greatest("y", "m").alias("x"), F.least("y", "m").alias("y")).union(joined.select("x", F.col("m").alias("y"))).distinct()
        old, now = now, store(small, "edges")
        old.drop()


def _candidates(docs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(a, text): a text of each set in ``sets`` (a, rep, by_text). Texts without an id are found by a hash."""
    with_id = docs.where("doc_id is not null").select(F.col("doc_id").alias("at"), F.lit(False).alias("hashed"), "text")
    without = docs.where("doc_id is null").groupBy(F.xxhash64("text").alias("at")).agg(F.first("text").alias("text")).select("at", F.lit(True).alias("hashed"), "text")
    wanted = F.broadcast(sets) if sets.count() <= MAX_BROADCAST_ROWS else sets
    rows = with_id.unionByName(without).join(wanted, (F.col("at") == F.col("rep")) & (F.col("hashed") == F.col("by_text"))).select("a", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for a, texts, own in _blocks(batches, width, Limits.block_shingles):
            marks, _ = _set_ids(own)
            keep = []
            for i, (want, mark) in enumerate(zip(a, marks.tolist(), strict=True)):
                if want == mark and want not in seen:  # an id may repeat, with the same or with other texts
                    seen.add(want)
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([texts[i] for i in keep], pa.string())], names=["a", "text"])

    return rows.mapInArrow(run, "a bigint, text string")


def _classified(docs: DataFrame, width: int, limits: Limits) -> DataFrame:
    """(doc_id, hashed, n, component_id) of every row of (doc_id, text); ``hashed`` is the text's xxhash64."""
    size = estimated_bytes(docs, "text")
    members = store(_repeated(docs, shards_for(size, SHARD_BYTES), min(40, max(24, size.bit_length() + 4)), width, limits), "members")
    sets = members.read().where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.min("hashed").alias("hashed"), F.max("n").alias("n"), F.max("repeated").alias("repeated"))
    sets = store(sets, "sets")
    wanted = sets.read().where(f"100 * repeated >= {PERCENT} * n").select("a", F.coalesce("rep", "hashed").alias("rep"), F.col("rep").isNull().alias("by_text"))
    candidates = store(_candidates(docs, store(wanted, "wanted").read(), width), "candidates")
    few = candidates.read()
    size = estimated_bytes(few, "text")

    blocks = store(_candidate_blocks(few, width, limits), "blocks")
    levels = store(_levels(blocks.read(), shards_for(size, SHARD_BYTES), width), "levels")
    of_block = levels.read().groupBy("block").agg(F.collect_list(F.struct("shard", "payload")).alias("levels"))
    found = store(_buckets(_postings(blocks.read().join(of_block, "block"), shards_for(size, SHARD_BYTES), width, limits)), "buckets")
    blocks.drop()
    levels.drop()
    side = lambda p: sets.read().select(F.col("a").alias(p), F.col("n").alias(f"{p}_n"))
    comparable = f"100 * least(x_n, y_n) >= {PERCENT} * greatest(x_n, y_n)"
    stars = found.read().select(F.explode(F.arrays_zip("a", "b", "open")).alias("z")).select(F.col("z.a").alias("x"), F.col("z.b").alias("y"), F.col("z.open").alias("open"))
    pairs = stars.unionByName(_center_pairs(found.read())).groupBy("x", "y").agg(F.max("open").alias("open"))
    tried = store(pairs.where("x <> y").join(side("x"), "x").join(side("y"), "y"), "tried")
    found.drop()
    links = store(_verify(few, tried.read().where(comparable).drop("open"), width, limits), "links")
    joined = components(links.read())

    # Pairs of open buckets whose ends are in different components: those components meet in clusters.
    labels = sets.read().join(few.select("a"), "a", "left_semi").select("a", "n").join(joined, F.col("a") == F.col("node"), "left")
    labels = store(labels.select("a", "n", F.coalesce("root", "a").alias("label")), "labels").read()
    end = lambda p: labels.select(F.col("a").alias(p), F.col("label").alias(f"{p}_label"))
    unsettled = tried.read().where("open").select("x", "y").join(end("x"), "x").join(end("y"), "y").where("x_label <> y_label").select(F.col("x_label").alias("x"), F.col("y_label").alias("y"))
    unsettled = store(unsettled.distinct(), "unsettled")
    if unsettled.read().limit(1).count():
        late = store(_cluster_links(few, labels, unsettled.read(), width, limits), "late")
        joined = components(links.read().unionByName(late.read()))
    tried.drop()
    candidates.drop()

    # The least id of each class, for its sets and then for the rows.
    linked = joined.union(joined.select("root", "root")).distinct()
    least = linked.join(sets.read().select("a", "rep"), F.col("node") == F.col("a")).groupBy("root").agg(F.min("rep").alias("least"))
    least = store(linked.join(least, "root").select("node", "least"), "least").read()
    ends = sets.read().join(least, F.col("a") == F.col("node"), "left").select("a", "b", F.coalesce("least", "rep").alias("least"))
    out = members.read().join(ends, ["a", "b"], "left")
    return out.select("doc_id", "hashed", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, limits: Limits = Limits()) -> DataFrame:
    """(id, n_shingles, component_id) of every row; ids are integers."""
    return _classified(_two_columns(docs, id_col, text_col), width, limits).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that have their class's least id, with all their columns.

    A row without an id goes if its class has one; rows of a class without ids stay, as do rows that repeat the least id.
    """
    classes = _classified(_two_columns(docs, id_col, text_col), width, limits)
    copies = classes.where("component_id is not null and (doc_id is null or doc_id <> component_id)").select("doc_id", "hashed")
    return without_rows(docs, copies, id_col, text_col)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, i, hash(w[k:k + 4]) AS t FROM (SELECT doc_id, i, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM d WHERE len(w) > 0)),
c AS (SELECT i, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY i),
p AS (SELECT x.i AS i, y.i AS j, count(*) AS shared FROM s x JOIN s y ON x.t = y.t AND x.i <> y.i GROUP BY ALL),
e AS (SELECT p.i, p.j FROM p JOIN c a ON a.i = p.i JOIN c b ON b.i = p.j WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
r(i, root) AS (SELECT i, doc_id FROM c UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.i)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM d LEFT JOIN c USING (i) LEFT JOIN (SELECT i, min(root) AS root FROM r GROUP BY i) m USING (i)
"""
