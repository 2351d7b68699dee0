"""Request bodies: bounded decompression, raw snappy, and the two protobuf messages of the metrics protocol."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotrace.errors import BadRequest, LimitExceeded, QueryError, Unsupported

MAX_BODY = 64 << 20


def _inflate(body: bytes, window: int, most: int) -> bytes:
    stream = zlib.decompressobj(window)
    out = stream.decompress(body, most + 1)
    if len(out) > most:
        raise LimitExceeded(f"the body is larger than {most} bytes when decompressed")
    if not stream.eof:
        raise BadRequest("the compressed body ends early")
    return out


def decompress(body: bytes, encoding: str | None, most: int = MAX_BODY) -> bytes:
    """gzip, x-gzip, deflate (with or without its header), zstd or identity; others are refused by name."""
    name = (encoding or "identity").strip().lower()
    if name == "identity":
        if len(body) > most:
            raise LimitExceeded(f"the body is larger than {most} bytes")
        return body
    try:
        if name in ("gzip", "x-gzip"):
            return _inflate(body, 31, most)
        if name == "deflate":
            try:
                return _inflate(body, 15, most)
            except zlib.error:
                return _inflate(body, -15, most)
        if name == "zstd":
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(body) as reader:
                out = reader.read(most + 1)
            if len(out) > most:
                raise LimitExceeded(f"the body is larger than {most} bytes when decompressed")
            return out
    except (zlib.error, EOFError, gzip.BadGzipFile) as e:
        raise BadRequest(f"the body is not valid {name}: {e}") from e
    except Exception as e:
        if type(e).__name__ == "ZstdError":
            raise BadRequest(f"the body is not valid zstd: {e}") from e
        raise
    raise Unsupported(f"content encoding {name}")


def encoding_of(path: Column) -> Column:
    """The content encoding that a file's name tells; none of these is identity."""
    return F.when(path.rlike(r"\.gz\z"), "gzip").when(path.rlike(r"\.(?:deflate|zz)\z"), "deflate").when(path.rlike(r"\.zst\z"), "zstd").otherwise("identity")


def bodies(requests: DataFrame, most: int = MAX_BODY) -> DataFrame:
    """(body, received_nanos) of requests (content, encoding, received_nanos): each decompressed within ``most`` bytes.

    A body that cannot be read is null, which the decoders refuse as ``invalid_request``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, encoding, received in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    text = decompress(content or b"", encoding, most).decode()
                except (QueryError, UnicodeDecodeError):
                    text = None
                yield pa.RecordBatch.from_arrays([pa.array([text], pa.string()), pa.array([received], pa.int64())], names=["body", "received_nanos"])

    return requests.select("content", "encoding", "received_nanos").mapInArrow(run, "body string, received_nanos bigint")


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise BadRequest("a number runs over the end of the message")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & ((1 << 64) - 1), at
        shift += 7


def write_varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def snappy_decode(data: bytes, most: int = MAX_BODY) -> bytes:
    """The raw block format. The stated size is checked before anything is allocated."""
    size, at = varint(data, 0)
    if size > most:
        raise LimitExceeded(f"the body claims {size} bytes; the limit is {most}")
    out = bytearray()
    while at < len(data):
        tag = data[at]
        at += 1
        if tag & 3 == 0:
            n = tag >> 2
            if n >= 60:
                extra = n - 59
                n = int.from_bytes(data[at : at + extra], "little")
                at += extra
            n += 1
            if at + n > len(data):
                raise BadRequest("a snappy literal runs over the end")
            out += data[at : at + n]
            at += n
        else:
            if tag & 3 == 1:
                n, back, width = (tag >> 2 & 7) + 4, (tag >> 5) << 8, 1
            else:
                n, back, width = (tag >> 2) + 1, 0, 2 if tag & 3 == 2 else 4
            if at + width > len(data):
                raise BadRequest("a snappy copy runs over the end")
            back |= int.from_bytes(data[at : at + width], "little")
            at += width
            if not 0 < back <= len(out):
                raise BadRequest("a snappy copy starts before the text")
            for _ in range(n):
                out.append(out[-back])
        if len(out) > size:
            raise BadRequest("a snappy body is longer than it claims")
    if len(out) != size:
        raise BadRequest("a snappy body is shorter than it claims")
    return bytes(out)


def snappy_encode(data: bytes) -> bytes:
    """Literals only: valid, if not small."""
    out = bytearray(write_varint(len(data)))
    for at in range(0, len(data), 65_536):
        part = data[at : at + 65_536]
        out += bytes([61 << 2]) + (len(part) - 1).to_bytes(2, "little") + part
    return bytes(out)


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if not number:
            raise BadRequest("field number 0")
        if kind == 0:
            value, at = varint(data, at)
            yield number, kind, value
            continue
        if kind == 2:
            size, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise BadRequest(f"wire type {kind} is not used")
        if at + size > len(data):
            raise BadRequest("a field runs over the end of the message")
        yield number, kind, data[at : at + size]
        at += size


def message(*parts: tuple[int, int | bytes | float | str]) -> bytes:
    """A protobuf message of (number, value): ints as varints, floats as doubles, text and bytes by length."""
    out = bytearray()
    for number, value in parts:
        if isinstance(value, float):
            out += write_varint(number << 3 | 1) + struct.pack("<d", value)
        elif isinstance(value, int):
            out += write_varint(number << 3) + write_varint(value)
        else:
            raw = value.encode() if isinstance(value, str) else value
            out += write_varint(number << 3 | 2) + write_varint(len(raw)) + raw
    return bytes(out)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def time_series(data: bytes) -> tuple[dict[str, str], list[tuple[int, float]]]:
    """Labels and (milliseconds, value) of a TimeSeries message."""
    labels, samples = {}, []
    for number, kind, value in fields(data):
        if number == 1 and kind == 2:
            pair = {1: "", 2: ""}
            for n, k, v in fields(value):
                if k == 2 and n in pair:
                    pair[n] = v.decode("utf-8", "replace")
            labels[pair[1]] = pair[2]
        elif number == 2 and kind == 2:
            at, amount = 0, 0.0
            for n, k, v in fields(value):
                if n == 1 and k == 1:
                    (amount,) = struct.unpack("<d", v)
                elif n == 2 and k == 0:
                    at = signed(v)
            samples.append((at, amount))
    return labels, samples


def encode_series(labels: dict[str, str], samples: list[tuple[int, float]]) -> bytes:
    return message(*[(1, message((1, k), (2, v))) for k, v in sorted(labels.items())], *[(2, message((1, float(x)), (2, t))) for t, x in samples])
