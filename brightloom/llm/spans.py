"""Spans of text as kind:start:end, in code points with an exclusive end."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable

Span = tuple[str, int, int]


def listed(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """Comma-joined, by start, then kind as listed, then end."""
    order = sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Cover:
    """Spans that don't let others overlap them; a look-up takes a binary search."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b)
        return at == 0 or self.ends[at - 1] <= a

    def add(self, a: int, b: int) -> None:
        """Takes a span that is free."""
        at = bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)
