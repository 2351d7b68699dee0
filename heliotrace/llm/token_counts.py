"""Token counts of whole texts, with huge texts encoded as overlapping chunks.

A text above ``chunk_chars`` code points is cut into chunks that overlap by ``overlap_chars``.
Neighbouring encodings are spliced at a boundary of pre-tokens that both found. Such a boundary
is stable: the pre-tokeniser scans from left to right and looks ahead by one character only, so
from a common start on, both encodings scan alike until the text of the left chunk runs out;
merges never cross a pre-token. The left chunk's last two pre-tokens are not trusted, since its
cut may have changed them. A text whose overlap has no common boundary is encoded again with a
chunk wider by that overlap, doubled until one is found or the chunk reaches the text's end.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated
rows give repeated rows; an empty table gives an empty table; columns other than the id and the
text are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024


class LibraryEncoder:
    """The tokenizers library; boundaries are the starts of its pre-tokens."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def many(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def one(self, text: str, base: int) -> tuple[list[int], dict[int, int]]:
        """Ids, and character position of each pre-token's start -> index of its first token."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        out: dict[int, int] = {}
        last: object = object()
        for k, (word, (start, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word is None or word != last:
                out.setdefault(base + start, k)
            last = word
        return e.ids, out


class RankEncoder:
    """The same vocabulary given as ranks, several times as fast.

    Boundaries are token starts at a white-space character after another character: no pre-token
    of the pattern has white space behind its first character, unless it is white space alone.
    """

    def __init__(self, ranks_file: str, pattern: str, special: dict[str, int]):
        import base64

        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for piece, k in [*ranks.items(), *((t.encode(), k) for t, k in special.items())]:
            self.lengths[k] = len(piece)

    def _ids(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special="all")

    def many(self, texts: list[str]) -> list[list[int]]:
        return [self._ids(t) for t in texts]

    def one(self, text: str, base: int) -> tuple[list[int], dict[int, int]]:
        ids = self._ids(text)
        raw = np.frombuffer(text.encode(), np.uint8)
        first_byte = (raw & 0xC0) != 0x80
        char_of = np.cumsum(first_byte) - 1
        sizes = self.lengths[ids]
        starts = np.cumsum(sizes) - sizes
        keep = np.flatnonzero(first_byte[starts])
        out = {}
        for k, c in zip(keep.tolist(), char_of[starts[keep]].tolist(), strict=True):
            if c and text[c].isspace() and not text[c - 1].isspace():
                out[base + c] = k
        return ids, out


def _safe_cut(text: str, at: int) -> int:
    """A cut that does not part a special string's ``<|...|>``."""
    left = text.rfind("<|", max(0, at - 64), at)
    if left >= 0 and text.find("|>", left, at) < 0:
        return left if left > 0 else at
    return at


def encode_long(encoder, text: str, chunk: int, overlap: int) -> list[int]:
    """Ids of a long text, equal to those of the encoder over the whole text."""
    ids: list[int] = []
    start, end = 0, min(len(text), _safe_cut(text, chunk) if len(text) > chunk else len(text))
    left, mine = encoder.one(text[start:end], start)
    first = 0  # first token of the left encoding that is not spliced away
    while end < len(text):
        width = overlap
        while True:
            new_start = max(start + 1, _safe_cut(text, max(0, end - width)))
            new_end = len(text) if new_start + chunk >= len(text) else max(end + 1, _safe_cut(text, new_start + chunk))
            right, other = encoder.one(text[new_start:new_end], new_start)
            trusted = sorted(mine)[:-2]
            # The right chunk's first pre-tokens may be torn by its cut: two agreeing starts in a row prove alignment.
            pairs = [p for p, q in zip(trusted, trusted[1:], strict=False) if p > new_start and mine[p] >= first and p in other and q in other]
            if pairs:
                p = pairs[len(pairs) // 2]
                ids += left[first : mine[p]]
                left, mine, start, end, first = right, other, new_start, new_end, other[p]
                break
            if width >= end - start - 1:  # the whole left chunk has no common boundary: widen it instead
                end = min(len(text), max(end + 1, end + (end - start)))
                left, mine = encoder.one(text[start:end], start)
                if end >= len(text):
                    break
                width = overlap
                continue
            width *= 2
    return ids + left[first:]


def tokenize(df: DataFrame, id_col: str, text_col: str, tokenizer_file: str, *, ranks_file: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, with_ids: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens[, ids]) for every row.

    ``ranks_file``, ``pattern`` and ``special`` name the same vocabulary in the faster library's
    form. It is used for texts whose characters both libraries class alike (below U+0250); others
    go to the library of ``tokenizer_file``. The files are part of the installation where tasks run.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = LibraryEncoder(tokenizer_file)
        fast = RankEncoder(ranks_file, pattern, special or {}) if ranks_file else None
        odd = re.compile("[^\x00-\u024f]")
        for batch in batches:
            at, column = 0, batch.column(1)
            while at < batch.num_rows:  # few rows at a time: encodings are much larger than their texts
                texts = [t or "" for t in column.slice(at, 64).to_pylist()]
                ids: list = [None] * len(texts)
                for encoder, own in ((fast, [k for k, t in enumerate(texts) if fast and not odd.search(t)]), (library, [k for k, t in enumerate(texts) if not fast or odd.search(t)])):
                    short = [k for k in own if len(texts[k]) <= chunk_chars]
                    for k, e in zip(short, encoder.many([texts[k] for k in short]) if short else [], strict=True):
                        ids[k] = e
                    for k in own:
                        if ids[k] is None:
                            ids[k] = encode_long(encoder, texts[k], chunk_chars, overlap_chars)
                columns = [batch.column(0).slice(at, len(texts)), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([len(x) for x in ids], pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_tokens", *["ids"] * with_ids])
                at += 64

    return df.select(id_col, text_col).mapInArrow(run, schema)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = tokenize(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), ranks_file=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, special={"<|endoftext|>": 50256})
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
