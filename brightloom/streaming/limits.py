"""Requests under limits: a sliding minute of requests and of tokens, and a daily quota, for each key.

A request is sent at the first moment, not before it is asked for nor before the one ahead of it, at which the minute
behind has room for it. It is refused if it can never fit, or if its day's quota is used up; days end at midnight of a
zone. What is kept of a key is the last minute, the day's count and the clock: the same fold goes over sorted rows of a
batch, a row at a time, and over a stream, where Spark keeps the state between micro-batches. Times are whole
microseconds. Requests of a key are taken in the order of time, then id; of a stream, in the order of its micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MINUTE = 60_000_000
EPOCH = datetime(1970, 1, 1, tzinfo=ZoneInfo("UTC"))
STATE = "sent array<long>, tokens array<long>, day string, used long, clock long"


@dataclass(frozen=True)
class Limits:
    requests: int
    tokens: int
    per_day: int
    zone: str = "America/Los_Angeles"


@dataclass
class Spent:
    """What the limits of a key have to know of its past."""

    sent: list[int] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)
    day: str = ""
    used: int = 0
    clock: int = -(1 << 62)

    def day_of(self, at: int, limits: Limits) -> str:
        return (EPOCH + timedelta(microseconds=at)).astimezone(ZoneInfo(limits.zone)).date().isoformat()

    def asked(self, at: int, tokens: int, limits: Limits) -> tuple[int | None, str]:
        """When the request is sent, and `sent`, `never` or `quota`."""
        now = max(at, self.clock)
        if tokens > limits.tokens or limits.requests < 1:
            return None, "never"
        today = self.day_of(now, limits)
        if (self.used if today == self.day else 0) >= limits.per_day:
            return None, "quota"
        while True:
            while self.sent and self.sent[0] <= now - MINUTE:
                self.sent.pop(0), self.tokens.pop(0)
            if len(self.sent) < limits.requests and sum(self.tokens) + tokens <= limits.tokens:
                break
            now = self.sent[0] + MINUTE
        self.sent.append(now), self.tokens.append(tokens)
        today = self.day_of(now, limits)
        self.day, self.used = today, (self.used if today == self.day else 0) + 1
        self.clock = now
        return now, "sent"


def _schema(rows: DataFrame, key: str, request: str) -> str:
    kinds = dict(rows.dtypes)
    return f"`{key}` {kinds[key]}, `{request}` {kinds[request]}, at long, sent_at long, outcome string"


def _frame(rows: list[tuple], key: str, request: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[key, request, "at", "sent_at", "outcome"])
    return out.astype({"sent_at": "Int64"})


def limited(requests: DataFrame, key: str, request: str, limits: Limits) -> DataFrame:
    """key, request, at, sent_at (null if refused) and outcome, from requests with at (microseconds) and tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, Spent()
        for b in batches:
            rows = []
            for k, r, at, tokens in b.itertuples(index=False):
                if k != now:
                    now, state = k, Spent()
                rows.append((k, r, at, *state.asked(int(at), int(tokens), limits)))
            yield _frame(rows, key, request)

    own = requests.select(key, request, "at", "tokens").where(f"`{key}` is not null and at is not null and tokens is not null")
    return own.repartition(key).sortWithinPartitions(key, "at", request).mapInPandas(run, _schema(requests, key, request))


def limited_stream(requests: DataFrame, key: str, request: str, limits: Limits) -> DataFrame:
    """The same over a stream: Spark keeps each key's minute, day and clock."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = Spent(*(list(v) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") else v for v in held.get)) if held.exists else Spent()
        rows = []
        for r, at, tokens in pd.concat(list(frames)).sort_values(["at", request])[[request, "at", "tokens"]].itertuples(index=False):
            rows.append((name[0], r, at, *state.asked(int(at), int(tokens), limits)))
        held.update(([int(x) for x in state.sent], [int(x) for x in state.tokens], state.day, state.used, state.clock))
        yield _frame(rows, key, request)

    own = requests.where(f"`{key}` is not null and at is not null and tokens is not null")
    return own.groupBy(key).applyInPandasWithState(run, _schema(requests, key, request), STATE, "append", GroupStateTimeout.NoTimeout)
