"""Conditions that an audit raises; each carries the diagnostics that led to it."""

from __future__ import annotations


class AuditError(Exception):
    """Base of all; ``diagnostics`` is a list of dicts with the columns of DIAGNOSTICS.

    Of very many it holds the first ones, and ``frame`` is a DataFrame of them all, in order.
    """

    def __init__(self, message: str, diagnostics: list[dict] | None = None, frame=None) -> None:
        super().__init__(message)
        self.diagnostics = diagnostics or []
        self.frame = frame

    @property
    def codes(self) -> list[str]:
        return [d["code"] for d in self.diagnostics]


class ArgumentError(AuditError):
    """A bad argument. Nothing was read or written."""

    def __init__(self, message: str) -> None:
        super().__init__(message, [diagnostic("argument", "INVALID_ARGUMENT", message)])


class InputError(AuditError):
    """Sources or graph break a rule; all broken rules are reported."""


class OperationalError(AuditError):
    """Something outside the inputs failed."""


def diagnostic(category: str, code: str, message: str, **fields) -> dict:
    row = {"category": category, "code": code, "message": message, "path": None, "line": None, "identifier": None, "position": None, "symbol": None, "details": {}}
    return row | fields
