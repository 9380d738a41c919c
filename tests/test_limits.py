"""Limits of requests: by hand, against a search over moments, and the same by stream and by batch."""

import random

from brightloom.operators import monitoring
from brightloom.streaming.limits import MINUTE, Limits, Spent, limited, limited_stream

S = 1_000_000
SCHEMA = "key string, id long, at long, tokens long"


def by_search(rows, limits, day):
    """Each request at the first candidate moment that has room."""
    out, sent, last, used = [], [], -(1 << 62), {}
    for at, tokens in rows:
        now = max(at, last)
        if tokens > limits.tokens:
            out.append((None, "never"))
        elif used.get(day(now), 0) >= limits.per_day:
            out.append((None, "quota"))
        else:
            for t in sorted({now, *(s + MINUTE for s, _ in sent if s + MINUTE > now)}):
                inside = [n for s, n in sent if s > t - MINUTE]
                if len(inside) < limits.requests and sum(inside) + tokens <= limits.tokens:
                    break
            sent.append((t, tokens))
            last = t
            used[day(t)] = used.get(day(t), 0) + 1
            out.append((t, "sent"))
    return out


def drawn(seed, n=150):
    draw = random.Random(seed)
    at = 0
    for _ in range(n):
        at += draw.choice([0, 1, 5, 30, 90]) * S
        yield at, draw.choice([1, 10, 40, 101])


def test_moments_equal_a_search():
    limits = Limits(4, 100, 60, "UTC")
    for seed in range(5):
        rows, state = list(drawn(seed)), Spent()
        got = [state.asked(at, n, limits) for at, n in rows]
        assert got == by_search(rows, limits, lambda t: t // (86_400 * S))


def test_quota_ends_at_midnight_of_the_zone():
    limits, state = Limits(9, 9, 1), Spent()
    noon = 1_720_000_000 * S - 1_720_000_000 * S % (86_400 * S) + 12 * 3600 * S  # in summer, 5:00 in Los Angeles
    assert [state.asked(noon + h * 3600 * S, 1, limits)[1] for h in (0, 18, 19, 20)] == ["sent", "quota", "sent", "quota"]


def test_stream_equals_batch(spark, tmp_path):
    limits = Limits(4, 100, 60, "UTC")
    rows = [(k, i, at, n) for k in ("a", "b") for i, (at, n) in enumerate(drawn(ord(k), 90))]
    df = spark.createDataFrame([*rows, ("a", 999, None, 1), (None, 1, 2, 3)], SCHEMA)
    want = sorted(tuple(r) for r in limited(df, "key", "id", limits).collect())
    assert [r[3:] for r in want if r[0] == "a"] == by_search([(at, n) for k, _, at, n in rows if k == "a"], limits, lambda t: t // (86_400 * S))
    source = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 30 == part], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        query = limited_stream(spark.readStream.schema(SCHEMA).parquet(str(source)), "key", "id", limits).writeStream.format("parquet")
        query.option("checkpointLocation", str(tmp_path / "saved")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(240)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_retraining_is_owed_once(spark):
    def owed(weeks, log):
        judged = spark.createDataFrame([("k", "m", w, b) for w, b in weeks], "k string, metric string, window_end int, breached boolean")
        return monitoring.drift_pending(judged, spark.createDataFrame([("k", i, kind, w) for i, (kind, w) in enumerate(log)], "k string, at int, kind string, window_end int"), "k").first().pending

    calm, fresh, still = [(1, False), (2, False)], [(1, False), (2, True)], [(1, True), (2, True)]
    assert not owed(calm, []) and owed(fresh, []) and not owed(still, [])
    assert owed([(2, True)], []) and owed([(1, None), (2, True)], [])
    assert not owed(fresh, [("requested", 2), ("decision", None)]) and owed(fresh, [("requested", 1), ("decision", None)])
    assert owed(still, [("requested", 1)]) and not owed(still, [("requested", 1), ("requested", 2)]) and not owed(still, [("requested", 1), ("decision", None)])
    assert owed(still, [("decision", None), ("requested", 1)])
