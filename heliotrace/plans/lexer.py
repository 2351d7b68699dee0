"""One tokenizer for the three query languages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from heliotrace.errors import BadRequest

UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "y": 365 * 86400 * 10**9}
_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<duration>(?:[0-9]+(?:\.[0-9]+)?(?:ns|us|ms|s|m|h|d|w|y))+(?![A-Za-z0-9_]))
    |(?P<number>0x[0-9A-Fa-f]+|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?(?![A-Za-z_]))
    |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<raw>`[^`]*`)
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<symbol>\|=|\|~|!=|!~|=~|==|>=|<=|&&|\|\||[{}()\[\],=<>|+\-*/%^@.:!~])""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "`": "`", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int
    value: object = None


def duration_nanos(text: str) -> int:
    return sum(round(float(n) * UNITS[u]) for n, u in re.findall(r"([0-9]+(?:\.[0-9]+)?)(ns|us|ms|s|m|h|d|w|y)", text))


def _unescape(body: str, at: int) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "xuU":
            return chr(int(c[1:], 16))
        if c not in _ESCAPES:
            raise BadRequest(f"unknown escape \\{c} in the string at {at}")
        return _ESCAPES[c]

    return re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, body, flags=re.S)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise BadRequest("unterminated string" if text[at] in "\"'`" else f"unexpected character {text[at]!r} at {at}")
        kind, own = m.lastgroup, m.group()
        value: object = own
        if kind == "duration":
            value = duration_nanos(own)
        elif kind == "number":
            value = float(int(own, 16)) if own.startswith("0x") else float(own)
        elif kind == "string":
            value = _unescape(own[1:-1], at)
        elif kind == "raw":
            kind, value = "string", own[1:-1]
        if kind != "space":
            out.append(Token(kind, own, at, value))
        at = m.end()
    return [*out, Token("end", "", len(text))]


class Cursor:
    """A position in a token list, shared by the parsers."""

    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        out = self.now
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return out

    def accept(self, *texts: str) -> Token | None:
        if self.now.kind in ("symbol", "name") and self.now.text in texts:
            return self.take()
        return None

    def expect(self, *texts: str) -> Token:
        out = self.accept(*texts)
        if out is None:
            raise BadRequest(f"expected {' or '.join(texts)} at {self.now.at}, found {self.now.text or 'the end'}")
        return out

    def kind(self, kind: str, what: str) -> Token:
        if self.now.kind != kind:
            raise BadRequest(f"expected {what} at {self.now.at}, found {self.now.text or 'the end'}")
        return self.take()

    def finish(self) -> None:
        if self.now.kind != "end":
            raise BadRequest(f"expected the end of the query at {self.now.at}, found {self.now.text}")
