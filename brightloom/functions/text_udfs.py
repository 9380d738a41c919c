"""The few text functions without a built-in counterpart, as Arrow batches."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def keyed_hash(salt: bytes):
    """HMAC-SHA-256 in hex of a column's text."""

    @F.pandas_udf(StringType())
    def keyed(value: pd.Series) -> pd.Series:
        return value.map(lambda v: None if v is None else hmac.new(salt, v.encode(), hashlib.sha256).hexdigest())

    return keyed


def longest_run(x: list[str], y: list[str]) -> int:
    """Words in the longest run that two lists share, by a suffix automaton of the shorter one: linear in both."""
    short, long = sorted((x, y), key=len)
    following: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for word in short:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        at, last = last, new
        while at >= 0 and word not in following[at]:
            following[at][word] = new
            at = link[at]
        if at < 0:
            continue
        met = following[at][word]
        if length[met] == length[at] + 1:
            link[new] = met
            continue
        copy = len(following)
        following.append(dict(following[met]))
        length.append(length[at] + 1)
        link.append(link[met])
        while at >= 0 and following[at].get(word) == met:
            following[at][word] = copy
            at = link[at]
        link[met] = link[new] = copy
    best = run = state = 0
    for word in long:
        while state and word not in following[state]:
            state = link[state]
            run = length[state]
        if word in following[state]:
            state = following[state][word]
            run += 1
            best = max(best, run)
    return best


@F.pandas_udf(IntegerType())
def longest_shared_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words in the longest run that two texts share, in lower case; 0 with a null."""
    return pd.Series([longest_run((x or "").lower().split(), (y or "").lower().split()) for x, y in zip(a, b)], dtype="int32")
