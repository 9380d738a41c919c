"""Ranges that are spread over tasks against their plain loops."""

import collections
import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from brightloom.operators import estimators, intervals


def plain_weight(seed, cluster, replicate):
    digest = hashlib.md5(f"{seed}:{cluster}:{replicate // 4}".encode()).hexdigest()
    u = int(digest[8 * (replicate % 4) :][:8], 16) / 2**32
    return sum(u >= x for x in intervals.poisson_steps())


def test_poisson_weights_have_mean_and_variance_one():
    w = np.array([plain_weight(1, c, r) for c in range(200) for r in range(100)])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05


def test_bootstrap_of_ratios_equals_plain_loops(spark):
    rows = [("a", i % 7, i % 3, i % 5) for i in range(60)] + [("b", 1, 2, 0), ("b", 2, None, 0), ("c", None, 1, 2)]
    df = spark.createDataFrame(rows, "g string, cluster long, x int, y int").withColumn("one", F.lit(1))
    got = {(r.g, r.name): r for r in intervals.bootstrap_ratios(df.repartition(7), ["g"], "cluster", {"r": ("x", "y"), "m": ("x", "one")}, [("r", "m")], samples=50, seed=3).collect()}
    sums = collections.defaultdict(lambda: np.zeros(3))
    for g, c, x, y in rows:
        sums[g, c] += [x or 0, y, 1]
    ratio = lambda s: (s[0] / s[1] if s[1] else math.nan, s[0] / s[2] if s[2] else math.nan)
    for g in "ab":
        own = {c: s for (k, c), s in sums.items() if k == g}
        each = np.array([ratio(sum(plain_weight(3, c, r) * s for c, s in own.items())) for r in range(50)])
        each = np.column_stack([each, each[:, 0] - each[:, 1]])
        for j, name in enumerate(("r", "m", "r - m")):
            known = each[:, j][~np.isnan(each[:, j])]
            row = got[g, name]
            if len(known):
                assert np.allclose((row.lo, row.hi), np.percentile(known, [2.5, 97.5]))
            else:
                assert row.value is None and row.lo is None
    assert got["a", "m"].clusters == 7 and got["c", "r"].value == 0.5


def test_ranges_of_parts_equal_the_draws(spark):
    cells = [("a", b, 10 * b, 40, 5 * b + 3, 30 + b) for b in range(3)] + [("e", 0, 1, 2, 0, 0)]
    df = spark.createDataFrame(cells, "g string, b int, p0 int, n0 int, p1 int, n1 int")
    got = {(r.g, r.part): (r.lo, r.hi) for r in intervals.decomposition_intervals(df, ["g"], "b", 300).collect()}
    want = estimators.decomposition_draws(*(np.array([c[k] for c in cells[:3]], float) for k in (2, 3, 4, 5)), resamples=300)
    assert got == {("a", k): v for k, v in want.items()}


def made(spark, moved, names=6, days=100, horizon=10):
    draw = np.random.default_rng(8)
    season = 0.5 + 0.2 * np.sin(np.arange(days) / 9)
    counts = {f"n{i}": (60 + draw.integers(0, 9, days), None) for i in range(names)}
    rows = []
    for i, (name, (n, _)) in enumerate(counts.items()):
        share = np.clip(season + 0.02 * i + draw.normal(0, 0.01, days) + (moved if name == "n0" else 0) * (np.arange(days) >= days - horizon), 0, 1)
        rows.append((name, 0, np.round(share * n).astype(int).tolist(), n.astype(int).tolist(), [True] * days))
    arrays = spark.createDataFrame(rows, "name string, first int, positives array<int>, totals array<int>, observed array<boolean>")
    units = spark.createDataFrame([(f"{t}/{k}", t, days - horizon, horizon, k) for t in ("n0", "n1") for k in ("share", "volume")], "unit string, target string, start int, horizon int, kind string")
    members = units.select("unit", "target").crossJoin(arrays).withColumn("treated", F.col("name") == F.col("target")).drop("target")
    return rows, units.drop("target"), members


def test_conformal_ranges_equal_the_loop(spark):
    rows, units, members = made(spark, 0.06)
    late = units.where("unit = 'n0/share'").withColumns({"unit": F.lit("late"), "start": F.lit(95)})
    every = members.unionByName(members.where("unit = 'n0/share'").withColumn("unit", F.lit("late")))
    got = {r.unit: r for r in intervals.conformal_intervals(units.unionByName(late), every, block=7).collect()}
    held = {name: estimators.to_series(f, p, t, o) for name, f, p, t, o in rows}
    for r in units.collect():
        target = r.unit.split("/")[0]
        donors = {k: v for k, v in held.items() if k != target}
        want = estimators.conformal_interval(held[target], donors, r.start, r.horizon, r.kind)
        mine = got[r.unit]
        assert (mine.reason if isinstance(want, str) else (mine.lo90, mine.hi90)) == want
        assert abs(mine.effect - estimators.synth(held[target], donors, r.start, r.horizon, r.kind)["effect"]) < 1e-9
    assert got["late"].reason == "window not complete" and got["late"].lo90 is None
    assert got["n0/share"].lo90 > 0


def test_trials_of_both_methods(spark):
    _, units, members = made(spark, 0.0)
    own = units.where("kind = 'share'").drop("kind").withColumn("earlier", F.array().cast("array<int>"))
    trials = intervals.paired_trials(own, members, {"share": [0.0, -12.0], "volume": [-40.0]}, ["step"], 2, 5).cache()
    assert trials.count() == 2 * 3 * 2 * 2
    report = {(r.kind, r.planted, r.method): r for r in intervals.trial_report(trials).collect()}
    assert report["share", -12.0, "synth"].rmse < 4 and report["share", 0.0, "synth"].power is None
    assert abs(report["volume", -40.0, "regression"].rmse) < 15
    few = intervals.paired_trials(own, members.where("name < 'n3'"), {"share": [0.0]}, ["step"], 1, 5).collect()
    assert all(r.fallback for r in few if r.method == "synth") and not any(r.fallback for r in few if r.method == "regression")
    assert {r.method for r in intervals.method_choice(trials).where("chosen").collect()} <= {"synth", "regression"}


def test_planted_volumes():
    series = estimators.Series(0, np.full(60, 500.0), np.full(60, 1000.0), np.ones(60, bool))
    hit = intervals.thinned(series, 30, -30, "step", 1)
    assert (hit.totals[:30] == 1000).all() and abs(hit.totals[30:].mean() - 700) < 10 and abs(hit.positives[30:].mean() - 350) < 10
    ramp = intervals.thinned(series, 30, -70, "ramp", 1)
    assert ramp.totals[30] > ramp.totals[33] > ramp.totals[40]
    assert abs(intervals.true_effect(-30, "step", 14, "volume") + 30) < 1e-9 and intervals.true_effect(-7, "ramp", 7, "share") == -4
