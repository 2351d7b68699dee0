"""Errors a query can end with. Each names what was asked for, so a refusal is never silent."""

from __future__ import annotations


class QueryError(ValueError):
    code = "bad_request"

    def __init__(self, message: str, *, feature: str | None = None, hint: str | None = None):
        super().__init__(message)
        self.message, self.feature, self.hint = message, feature, hint

    def body(self) -> dict:
        out = {"code": self.code, "message": self.message}
        if self.feature:
            out["feature"] = self.feature
        if self.hint:
            out["hint"] = self.hint
        return {"error": out}


class BadRequest(QueryError):
    """The query cannot be read, or asks for something impossible."""


class Unsupported(QueryError):
    """The query is valid in its language but outside the subset; ``feature`` names what."""

    code = "unsupported"

    def __init__(self, feature: str, hint: str | None = None):
        super().__init__(f"{feature} is not supported", feature=feature, hint=hint)


class LimitExceeded(QueryError):
    code = "limit_exceeded"


class NotFound(QueryError):
    code = "not_found"
