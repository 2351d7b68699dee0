"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Training. A word's features are itself and its first 4, 5 and 6 letters, so that an inflected
form is known by its stem. Counts in toxic and clean documents give each feature's log-odds with
an informative Dirichlet prior: its pseudo-count is its share of all training words times
``PRIOR_SHARE`` of their number. Features that pass ``CANDIDATE_Z`` are counted again by distinct
neighbouring words, which near copies of one document share, and must then pass ``LEAST_Z`` and
``LEAST_ODDS``, since a great sample makes any slight difference significant and a text that repeats
one such word would collect it.
A word scores its best feature's log-odds less ``DRIFT``, and -``DRIFT`` without any, so that
text without evidence drifts down.
Scoring. A linear scan finds all maximal scoring segments of a document. For segment score S in
a text of n tokens the expected number of equally good chance segments is E = K n exp(-lambda S);
lambda solves sum p(w) exp(lambda s(w)) = 1 over clean tokens, and K is the least value for which
no score is reached by more segments of clean documents than expected. It is 1 at most: by lambda's
equation a segment from a given word reaches S with a chance of at most exp(-lambda S), which also
bounds what wrong labels can do. A mean of the documents' best scores would not do for K: documents
without any evidence draw it so low that weak segments of every text count. Segments with E of at
most ``LEAST_E`` are the reported passages; the document's statistic is the sum of their ln(1/E),
and a logistic curve of its logarithm, fitted on documents held back from the token counts, turns it
into a score. The logarithm keeps a few texts of very much evidence from flattening the curve.

Only labelled rows outside the held-out fold are learned from: at most ``MAX_TRAIN_DOCS``
documents, chosen by a hash of the id. Everything learned is therefore bounded, features included:
those that pass are a small part of the different words of the sample.

Defined results: a null text counts as empty and gets the score of no evidence; a null id is
scored too (held_out is null); an id with several labels counts as toxic if any says so; a null
label is no label; without toxic and clean examples every score is 0; an empty table gives an
empty table; columns other than id, text and toxic are not read, so names cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotrace.llm.common import release_memory, store

MAX_TRAIN_DOCS = 20_000
PRIOR_SHARE = 0.1
CANDIDATE_Z = 2.5
LEAST_Z = 3.2
LEAST_ODDS = math.log(2)
LEAST_COUNT = 4
STEMS = (4, 5, 6)
KEPT_WORDS = 200_000
DRIFT = 0.1
LEAST_E = 0.5
LEVELS = 4  # of a segment's lambda S, for each whole number
MAX_LEVEL = 1_000
_SPACES = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def tokens(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPACES).split()


def features(word: bytes) -> list[bytes]:
    """The word and its stems, as bytes; a stem is marked so that it isn't a short word."""
    letters = word.decode("utf-8", "replace")
    return [word, *(letters[:n].encode() + b"*" for n in STEMS if len(letters) >= n)]


class _Words(dict):
    """Word -> score, filled as words are met, of bounded size."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores

    def __missing__(self, word: bytes) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        get = self.scores.get
        score = max(get(f, -DRIFT) for f in features(word))
        self[word] = score
        return score


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    offset: float = -math.inf

    def __post_init__(self):
        self.words = _Words(self.scores)

    def __getstate__(self):
        return self.scores, self.lam, self.k, self.slope, self.offset

    def __setstate__(self, state):
        self.scores, self.lam, self.k, self.slope, self.offset = state
        self.words = _Words(self.scores)

    def forget(self) -> None:
        """Drops the words met so far and gives their memory back: workers live on between tasks."""
        self.words.clear()
        release_memory()

    def segments(self, words: list[bytes]) -> list[tuple[float, int, int]]:
        """All maximal scoring segments (score, first word, behind last word), left to right."""
        if not self.scores or not words:
            return []
        s = np.fromiter(map(self.words.__getitem__, words), np.float64, len(words))
        if s.max() <= 0:
            return []
        total = np.concatenate(([0.0], np.cumsum(s)))
        stack: list[tuple[float, float, int, int]] = []  # cumulative score before and after, first, behind
        for i in np.flatnonzero(s > 0).tolist():
            left, right, first = float(total[i]), float(total[i + 1]), i
            while True:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] >= left:
                    k -= 1
                if k < 0 or stack[k][1] >= right:
                    stack.append((left, right, first, i + 1))
                    break
                left, first = stack[k][0], stack[k][2]
                del stack[k:]
        return [(right - left, first, behind) for left, right, first, behind in stack]

    def evidence(self, words: list[bytes]) -> tuple[float, list[tuple[float, int, int]]]:
        """Sum of ln(1/E) over the significant segments, and those segments."""
        out, floor = [], math.log(self.k * max(1, len(words)))
        total = 0.0
        for score, first, behind in self.segments(words):
            e = floor - self.lam * score
            if e <= math.log(LEAST_E):
                total -= e
                out.append((score, first, behind))
        return total, out

    def probability(self, evidence: float) -> float:
        x = self.offset + self.slope * math.log1p(evidence)
        return 0.0 if x < -700 else 1.0 / (1.0 + math.exp(-x))


def _fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_docs: int) -> DataFrame:
    """(fold, toxic, text) of a bounded sample of the labelled rows outside fold 0."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.where(_fold("id") != 0).orderBy(F.xxhash64("id"), "id").limit(max_docs)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return text.join(F.broadcast(chosen), "id").select(_fold("id").alias("fold"), "toxic", "text")  # at most max_docs short rows are broadcast


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    rows = training_rows(docs, labels, id_col, text_col, max_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for fold, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fold != 4:
                    seen[int(toxic > 0)].update(tokens(text))
        sums = {}
        for kind, words in seen.items():
            for word, n in words.items():
                for f in features(word):
                    sums.setdefault(f, [0, 0])[kind] += n
        rows = list(sums.items())
        del seen, sums
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.binary()), *(pa.array([n[k] for _, n in part], pa.int64()) for k in (1, 0))], names=["word", "toxic", "clean"])
        del rows
        release_memory()

    counts = store(rows.mapInArrow(count, "word binary, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "features")
    letters = F.col("word").cast("string")
    class_ = F.when(letters.endswith("*"), F.length(letters)).otherwise(0)
    totals = {r["class"]: (int(r.t), int(r.c)) for r in counts.read().groupBy(class_.alias("class")).agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).collect()}
    n_t, n_c = totals.get(0, (0, 0))
    if not n_t or not n_c:
        return Model()

    def strong(df: DataFrame, least: float) -> DataFrame:
        """Features by z, each against the totals (and one more) of its class: words, or stems of one length."""
        a = (F.col("toxic") + F.col("clean")) * F.lit(PRIOR_SHARE)
        of = lambda k: F.coalesce(*(F.when(class_ == c, F.lit(t[k] + 1)) for c, t in totals.items()))
        prior = (of(0) + of(1)) * F.lit(PRIOR_SHARE)
        odds = F.log((F.col("toxic") + a) / (of(0) + prior - F.col("toxic") - a)) - F.log((F.col("clean") + a) / (of(1) + prior - F.col("clean") - a))
        z = odds / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
        return df.select("word", odds.alias("odds"), z.alias("z"), (F.col("clean") / n_c).alias("p")).where(F.col("z") >= least)

    candidates = {bytes(r.word) for r in strong(counts.read().where(F.col("toxic") + F.col("clean") >= LEAST_COUNT), CANDIDATE_Z).select("word").collect()}
    counts.drop()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(dict.fromkeys(candidates, 1.0))
        for batch in batches:
            found = set()
            for fold, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens(text) if fold != 4 else []
                for i, w in enumerate(words):
                    if known[w] > 0:
                        around = b" ".join(words[max(0, i - 1) : i + 2])
                        found.update((f, around, int(toxic > 0)) for f in features(w) if f in candidates)
            out = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int32())], names=["word", "around", "kind"])
        known.clear()
        release_memory()

    distinct = rows.mapInArrow(contexts, "word binary, around binary, kind int").distinct().groupBy("word").agg(F.sum("kind").alias("toxic"), F.sum(1 - F.col("kind")).alias("clean"))
    found = strong(distinct, LEAST_Z).where(F.col("odds") >= LEAST_ODDS).orderBy("word").collect()
    model = Model({bytes(r.word): r.odds - DRIFT for r in found})
    model.lam = _lambda([(r.odds - DRIFT, r.p) for r in found])

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column(2).to_pylist():
                words = tokens(text)
                n += len(words)
                seen.update(min(MAX_LEVEL, int(model.lam * s * LEVELS)) for s, _, _ in model.segments(words))
        seen[-1] = n  # beside the levels, the number of words
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["level", "n"])
        model.forget()

    levels = rows.where("toxic = 0 and fold <> 4").mapInArrow(chance, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()
    model.k = _k({r.level: int(r.n) for r in levels})

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([model.evidence(tokens(t))[0] for t in batch.column(2).to_pylist()], pa.float64())], names=["toxic", "evidence"])
        model.forget()

    held = rows.where("fold = 4").mapInArrow(evidence, "toxic int, evidence double").groupBy("toxic", F.round(F.log1p("evidence"), 2).alias("x")).count().collect()  # a bounded sample's histogram
    model.slope, model.offset = _logistic([(r.x, int(r.toxic > 0), r["count"]) for r in held])
    return model


def _lambda(steps: list[tuple[float, float]]) -> float:
    """The positive root of sum p exp(lambda s) = 1; unseen clean evidence counts a millionth at least."""
    steps = [(s, max(p, 1e-6 / max(1, len(steps)))) for s, p in steps]
    rest = max(1e-9, 1 - sum(p for _, p in steps))
    f = lambda x: rest * math.exp(-x * DRIFT) + sum(p * math.exp(min(700.0, x * s)) for s, p in steps) - 1
    low, high = 1e-9, 1.0
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def _k(levels: dict[int, int]) -> float:
    """The least K, 1 at most, with which the expected segments at each level are not fewer than those of clean text; under -1 stands its number of words."""
    n, above, most = max(1, levels.get(-1, 0)), 0, 0.0
    for level in sorted(levels.keys() - {-1}, reverse=True):
        above += levels[level]
        most = max(most, above * math.exp(min(700.0, level / LEVELS)))
    return min(1.0, max(1.0, most) / n)


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope (never negative) and offset of a lightly regularised logistic fit, by Newton steps."""
    if not points or len({y for _, y, _ in points}) < 2:
        return 1.25, -2.0
    x, y, n = (np.array(c, float) for c in zip(*points, strict=True))
    scale = max(1.0, float(np.abs(x).max()))
    b = np.zeros(2)
    design = np.stack([x / scale, np.ones_like(x)], 1)
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        gradient = design.T @ (n * (y - p)) - ridge @ b
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge, gradient)
        b += np.clip(step, -5, 5)
    return max(0.0, float(b[0] / scale)), float(b[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, passages: bool = True) -> DataFrame:
    """(id, score, n_passages, best_segment[, passages]): passages are spans of words with their segment scores."""
    more = ", passages array<struct<score:double,first_word:int,behind_word:int>>" if passages else ""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, n_passages int, best_segment double{more}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("score", pa.float64()), ("first_word", pa.int32()), ("behind_word", pa.int32())]))
        for batch in batches:
            found = [model.evidence(tokens(t or "")) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([model.probability(e) for e, _ in found], pa.float64()), pa.array([len(s) for _, s in found], pa.int32()), pa.array([max((x for x, _, _ in s), default=0.0) for _, s in found], pa.float64())]
            if passages:
                columns.append(pa.array([[{"score": x, "first_word": a, "behind_word": b} for x, a, b in s] for _, s in found], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "score", "n_passages", "best_segment", *["passages"] * passages])
        model.forget()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """The rows that the model does not call toxic, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.probability(model.evidence(tokens(t or ""))[0]) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))
        model.forget()

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, passages=False)
    return scored.select("doc_id", (_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
