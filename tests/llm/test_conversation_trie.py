"""Operator 13 against a trie made by plain loops."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from brightloom.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, seq string, bucket long, depth string"


def by_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[c] for c in children[p])
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if built[c] == p).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -(10**9), len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items()
    )


def got(spark, rows, most):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    out = ct.trie(ct.rebuilt(ct.coded(df)), most).collect()
    return sorted(tuple(-(10**9) if v is None else v for v in r) for r in out)


def random_rows(seed, n, turns, texts):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-60, 4 * n), n):
        for t in range(draw.randint(1, turns)):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(texts)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_nodes_equal_brute_force(spark, most):
    rows = random_rows(1, 160, 7, ["a", "b c", "d  e\tf", ""])
    assert got(spark, rows, most) == by_force(rows)


@pytest.mark.parametrize("most", [3, 10**6])
def test_copies_long_conversations_and_odd_rows(spark, most):
    long = [(20, t, "user", f"turn {t % 9}") for t in range(300)] + [(21, t, "user", f"turn {t % 9}") for t in range(290)]
    copies = [(c, t, "user", "same text") for c in range(1000, 1300) for t in range(3)]
    odd = [(None, 0, "user", "nobody"), (7, None, None, None), (7, 2, "x", "y"), (40, 0, "a", "b"), (47, 0, "", ""), (2**60, 0, "u", "w"), (-5, 1, "user", "p q")]
    huge = [(60, 0, "user", "word " * 50_000), (61, 0, "user", "word " * 50_000)]
    rows = long + copies + odd + huge
    assert got(spark, rows, most) == by_force(rows)


def test_ties_and_repeated_rows_have_one_result(spark):
    rows = [(20, 1, "u", "b"), (20, 1, "u", "a"), (20, 1, "u", "a"), (40, 1, "u", "a"), (40, 1, "u", "a"), (40, 1, "u", "b")]
    one, other = got(spark, rows, 2), got(spark, rows[::-1], 2)
    assert one == other and one[0][3] == 2
    assert sum(r[1] == 3 for r in one) == 1 or zlib.crc32(b"20") % 4 != zlib.crc32(b"40") % 4


def test_no_conversations(spark):
    assert got(spark, [], 5) == []
    assert got(spark, [(None, 1, "u", "t")], 5) == []


def test_many_copies_are_hashed_in_order(spark):
    rows = [(c, 0, "u", "t") for c in range(1, 6000, 2)]
    assert got(spark, rows, 10) == by_force(rows)
