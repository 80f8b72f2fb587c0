"""Shared pieces of the parsers."""

from __future__ import annotations

from typing import NamedTuple

#: Distinct shapes remembered per table and worker.
MEMO = 200_000


class Error(NamedTuple):
    line: int
    cause: str


class Bad(Exception):
    """A syntax error at token `at`."""

    def __init__(self, cause: str, at: int = 0):
        super().__init__(cause)
        self.cause, self.at = cause, at


class Cursor:
    """Tokens and a position."""

    def __init__(self, toks: list[str]):
        self.t, self.i, self.n = toks, 0, len(toks)

    def peek(self) -> str:
        return self.t[self.i] if self.i < self.n else ""

    def ahead(self, k: int = 1) -> str:
        return self.t[self.i + k] if self.i + k < self.n else ""

    def take(self, tok: str) -> bool:
        if self.i < self.n and self.t[self.i] == tok:
            self.i += 1
            return True
        return False

    def need(self, tok: str) -> None:
        if not self.take(tok):
            raise Bad(f"expected {tok!r}", self.i)

    def fail(self, cause: str):
        raise Bad(cause, self.i)


def remember(table: dict, key, value):
    if len(table) >= MEMO:
        table.clear()
    table[key] = value
    return value
