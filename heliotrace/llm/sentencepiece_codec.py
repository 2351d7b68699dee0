"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces runs once over the normalised text. At each position
its output links give every piece that ends there, and each relaxes the best score of the position
(Viterbi). The best path's pieces are the encoding; a character without a piece becomes byte
pieces where the model has them, else the unknown piece. Where no piece holds a word mark behind
another character, the best path of a text is made of the best paths of its words, and where the model has
byte pieces also of those of a word's runs of characters that pieces join (letters, signs), so these are
encoded once and kept in a bounded table of two halves: when the newer half is full, it becomes the
older one, out of which words that are met again are taken over. A word's pieces are decoded when it
enters the table; a text of words that all come back as they were decodes to its words, and any other
is decoded as a whole.

The scores of the model file are taken as a unigram model's log probabilities. A file trained by
merges holds ranks as scores: its best-scoring path is well defined and decodes to the same text,
but it is not the order in which the merges would have been applied.

Defined results: a null text counts as empty and has no pieces; a null id stays null; repeated
rows give repeated rows; an empty table gives an empty table; equal scores are settled by the
longer last piece; columns other than the id and the text are not read, so names cannot clash.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotrace.llm.common import release_memory

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the library
KEPT_WORDS = 300_000
_CODECS: dict[str, Codec] = {}


class Codec:
    """A model file as an automaton."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()) if spec.precompiled_charsmap or spec.remove_extra_whitespaces else None
        self.prefix = spec.add_dummy_prefix
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.pieces, self.bytes, self.byte_value = [p.piece for p in proto.pieces], {}, {}
        self.automaton, self.single, self.whole_words = ahocorasick.Automaton(), set(), True
        self.unknown, self.control, scores = 0, set(), []
        for k, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[value], self.byte_value[k] = k, value
            elif p.type == kinds.UNKNOWN:
                self.unknown = k
            elif p.type == kinds.CONTROL:
                self.control.add(k)
            elif p.piece and p.type != kinds.UNUSED:
                self.automaton.add_word(p.piece, (len(p.piece), p.score, k))
                scores.append(p.score)
                if len(p.piece) == 1:
                    self.single.add(p.piece)
                self.whole_words &= MARK not in p.piece.lstrip(MARK)
        self.automaton.make_automaton()
        self.split = _splitter([p.piece for p in proto.pieces if p.type not in (kinds.BYTE, kinds.UNKNOWN, kinds.CONTROL, kinds.UNUSED)]) if self.bytes else _WORDS
        self.unknown_score = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.special = np.zeros(len(self.pieces), bool)
        self.special[[*self.byte_value, self.unknown, *self.control]] = True
        self.plain = ["\ud800" if self.special[k] else p for k, p in enumerate(self.pieces)]  # no text holds this

    def normalize(self, text: str) -> str:
        if self.library is not None:
            return self.library.normalize(text).replace(" ", MARK)
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def best_path(self, chunk: str) -> array:
        n = len(chunk)
        if self.single.issuperset(chunk):  # no unknown character is needed
            best, last = [0.0] + [float("-inf")] * n, [(1, 0.0, -1)] * (n + 1)
            for end, piece in self.automaton.iter(chunk):
                score = best[end + 1 - piece[0]] + piece[1]
                if score > best[end + 1]:
                    best[end + 1], last[end + 1] = score, piece
            out, j = [], n
            while j:
                size, _, k = last[j]
                out.append(k)
                j -= size
            return array("i", reversed(out))
        best, length, piece = [0.0] + [float("-inf")] * n, [1] * (n + 1), [-1] * (n + 1)
        done = 0  # positions whose unknown character has been offered
        for end, (size, score, k) in self.automaton.iter(chunk):
            j = end + 1
            while done < j:
                done += 1
                if chunk[done - 1] not in self.single:
                    best[done] = best[done - 1] + self.unknown_score
            score += best[j - size]
            if score > best[j]:
                best[j], length[j], piece[j] = score, size, k
        while done < n:
            done += 1
            if chunk[done - 1] not in self.single:
                best[done] = best[done - 1] + self.unknown_score
        out, j = [], n
        while j:
            i = j - length[j]
            if piece[j] >= 0:
                out.append(piece[j])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(chunk[i:j].encode()))
            elif not (out and out[-1] == self.unknown and piece[j] < 0):
                out.append(self.unknown)
            j = i
        return array("i", reversed(out))

    def encode(self, text: str) -> array:
        out = array("i")
        out.frombytes(self.coded(self.normalize(text))[0])
        return out

    def verified(self, text: str) -> tuple[bytes, bool]:
        """The ids as bytes, and whether decoding gives the text back."""
        normal = self.normalize(text)
        raw, whole = self.coded(normal)
        return raw, (self.unmarked(normal) if whole else self.decode(np.frombuffer(raw, np.int32).tolist())) == text

    def coded(self, normal: str) -> tuple[bytes, bool]:
        """The ids of a normalised text as bytes, and whether it is known that their pieces make up this text."""
        if not self.whole_words:
            return self.best_path(normal).tobytes(), False
        words = self.split(normal)
        out, whole = list(map(self.words.get, words)), True
        if None in out:
            for i, raw in enumerate(out):
                if raw is None:
                    out[i], same = self.met(words[i])
                    whole &= same
        return b"".join(out), whole

    def met(self, word: str) -> tuple[bytes, bool]:
        """A word that the newer half of the table lacks. Words whose pieces do not make them up again never enter it."""
        raw = self.words.get(word) or self.older.get(word)
        if raw is None:
            ids = self.best_path(word)
            raw = ids.tobytes()
            if "".join([self.plain[k] for k in ids]) != word and self.joined(ids) != word:
                return raw, False
        if len(word) <= 64:
            if len(self.words) >= KEPT_WORDS // 2:
                self.words, self.older = {}, self.words
            self.words[word] = raw
        return raw, True

    def forget(self) -> None:
        self.words, self.older = {}, {}

    def joined(self, ids) -> str:
        """The pieces of ids, one behind the other, with their word marks."""
        own = np.asarray(ids, np.int32)
        pieces = self.pieces
        if not own.size:
            return ""
        if not self.special[own].any():
            return "".join(map(pieces.__getitem__, ids))
        parts, raw = [], bytearray()
        for k in ids:
            if k in self.byte_value:
                raw.append(self.byte_value[k])
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if k not in self.control:
                parts.append(" ⁇ " if k == self.unknown else pieces[k])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        return "".join(parts)

    def unmarked(self, text: str) -> str:
        text = text.replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def decode(self, ids) -> str:
        return self.unmarked(self.joined(ids))


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


def _splitter(pieces: list[str]) -> Callable[[str], list[str]]:
    """Splits a text where no piece can span: word marks go with what follows, and characters stay together that pieces join, directly or by others."""
    group: dict[str, set[str]] = {}
    for piece in pieces:
        own = set(piece) - {MARK}
        if len(own) > 1 or len(piece.lstrip(MARK)) > 1:
            for other in {id(g): g for c in own if (g := group.get(c)) is not None}.values():
                own |= other
            group.update(dict.fromkeys(own, own))
    runs = [f"[{re.escape(''.join(sorted(g)))}]+" for g in sorted({id(g): g for g in group.values()}.values(), key=len, reverse=True)]
    return re.compile(f"{MARK}*(?:{'|'.join([*runs, f'[^{MARK}]'])})|{MARK}+").findall


def codec(model_file: str) -> Codec:
    """One codec for each model in a worker; tasks empty its table of words when they end."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def encode(df: DataFrame, id_col: str, text_col: str, model_file: str, *, verify: bool = False) -> DataFrame:
    """(id, ids array<int>[, round_trip boolean]): ``round_trip`` tells whether decoding gives the text back."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>" + (", round_trip boolean" if verify else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                values, offsets, same, first = [], [0], [], at
                while at < batch.num_rows and offsets[-1] < 1 << 20:
                    text = batch.column(1)[at].as_py() or ""
                    if verify:
                        raw, good = own.verified(text)
                        same.append(good)
                    else:
                        raw = own.coded(own.normalize(text))[0]
                    values.append(raw)
                    offsets.append(offsets[-1] + len(raw) // 4)
                    at += 1
                lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.frombuffer(b"".join(values), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), lists, *[pa.array(same, pa.bool_())] * verify], names=[id_col, "ids", *["round_trip"] * verify])
                del values, lists
        own.forget()
        release_memory()

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str, ids_col: str, model_file: str) -> DataFrame:
    """(id, text) from lists of ids; a null list decodes to the empty text."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = encode(docs, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"), verify=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"), "round_trip")
