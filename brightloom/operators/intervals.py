"""Ranges spread over tasks: Poisson bootstraps of ratios, draws of the shift-share parts, and conformal ranges by grid points.

A bootstrap replicate weighs every cluster by a Poisson number that a hash of the cluster and the replicate gives, so one
pass over the rows with partial sums makes all replicates, whatever the partitioning, and no group is ever held. A
conformal range tests every effect of a grid; a unit's grid is cut into blocks, and blocks are tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import estimators
from .estimators import GRIDS, LEVEL, PRE_DAYS, Series, simplex_weights, synth, to_series

#: Poisson numbers with mean one beyond this many have a chance under 1e-12.
MOST = 14
#: Replicates that one digest serves, eight hex digits each.
LANES = 4


def poisson_steps(most: int = MOST) -> list[float]:
    """The chances of at most 0, 1, 2, ... of a Poisson number with mean one."""
    out, chance, total = [], math.exp(-1), 0.0
    for k in range(most):
        total += chance
        out.append(total)
        chance /= k + 1
    return out


def poisson_weight(digest: Column, lane: int) -> Column:
    """The Poisson number that eight hex digits of a digest stand for."""
    u = F.conv(F.substring(digest, 8 * lane + 1, 8), 16, 10).cast("double") / float(1 << 32)
    return reduce(lambda a, b: a + b, [(u >= step).cast("int") for step in poisson_steps()])


def bootstrap_ratios(rows: DataFrame, by: list[str], cluster: str, ratios: dict[str, tuple[str, str]], differences: list[tuple[str, str]] = [], samples: int = 2000, seed: int = 20261021, alpha: float = 0.05) -> DataFrame:  # noqa: B006
    """by, name, value, lo, hi, clusters: pooled numerators over denominators with percentile ranges over clusters.

    ratios: numerator and denominator columns by name; a mean is a ratio with ones below. differences: pairs of names,
    both scored on the same replicate each time. Rows of a cluster are summed first; nulls count as nothing. A replicate
    whose denominators sum to zero has no ratio and is left out.
    """
    columns = sorted({c for pair in ratios.values() for c in pair})
    sums = rows.groupBy(*by, cluster).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in columns])
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-samples // LANES) - 1))).alias("_block")
    each = sums.select("*", blocks).withColumn("_digest", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(cluster).cast("string"), F.col("_block").cast("string"))))
    for lane in range(LANES):
        each = each.withColumn(f"_w{lane}", poisson_weight(F.col("_digest"), lane))
    drawn = each.groupBy(*by, "_block").agg(*[F.sum(F.col(f"_w{k}") * F.col(c)).alias(f"{c}_{k}") for c in columns for k in range(LANES)])
    lanes = F.explode(F.array(*[F.struct((F.col("_block") * LANES + k).alias("replicate"), *[F.col(f"{c}_{k}").alias(c) for c in columns]) for k in range(LANES)])).alias("r")
    replicates = drawn.select(*by, lanes).select(*by, "r.*").where(F.col("replicate") < samples)
    point = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns], F.count(F.lit(1)).alias("clusters"))

    def values(df: DataFrame, *more: str) -> DataFrame:
        found = {n: F.when(F.col(b) != 0, F.col(a) / F.col(b)) for n, (a, b) in ratios.items()}
        found |= {f"{a} - {b}": found[a] - found[b] for a, b in differences}
        named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in found.items()])).alias("v")
        return df.select(*by, *more, named).select(*by, *more, "v.*")

    ends = values(replicates).groupBy(*by, "name").agg(*[F.percentile("value", q).alias(n) for n, q in (("lo", alpha / 2), ("hi", 1 - alpha / 2))])
    return values(point, "clusters").join(ends, [*by, "name"]).select(*by, "name", "value", "lo", "hi", "clusters")


def decomposition_intervals(cells: DataFrame, by: list[str], bucket: str, resamples: int = 2000, seed: int = 20261021, level: float = LEVEL) -> DataFrame:
    """by, part, lo, hi of the shift-share parts from cells (by, bucket, p0, n0, p1, n1), which are few for a group.

    A group with an empty period has no ranges.
    """
    names = [c.strip() for c in by]
    kinds = dict(cells.dtypes)
    sums = cells.groupBy(*names, bucket).agg(*[F.sum(c).cast("double").alias(c) for c in ("p0", "n0", "p1", "n1")])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(bucket)
        own = dict(zip(names, key))
        if not group["n0"].sum() or not group["n1"].sum():
            return pd.DataFrame(columns=[*names, "part", "lo", "hi"], dtype=object)
        found = estimators.decomposition_draws(*(group[c].to_numpy(float) for c in ("p0", "n0", "p1", "n1")), resamples=resamples, seed=seed, level=level)
        return pd.DataFrame([{**own, "part": k, "lo": lo, "hi": hi} for k, (lo, hi) in found.items()])

    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "part string, lo double, hi double"])
    return sums.groupBy(*names).applyInPandas(run, schema)


# --- conformal ranges

PANEL = "unit string, kind string, effect double, reason string, treated array<double>, donors array<double>, post array<boolean>"


def panels(units: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each unit: its estimate, or why there is none, and its days with data with those of its donors, donor by
    donor. units and members: as estimators.synth_effects takes them."""
    first, until = F.col("start") - PRE_DAYS, F.col("start") + F.col("horizon") - 1
    at = F.greatest(first - F.col("first") + 1, F.lit(1))
    length = F.greatest(until - F.greatest(first, F.col("first")) + 1, F.lit(0))
    each = members.join(units, "unit")
    each = each.select(F.col("unit").cast("string").alias("unit"), F.col("name").cast("string").alias("name"), "treated", "start", "horizon", "kind", F.greatest(first, F.col("first")).alias("first"), *[F.slice(F.col(c), at, length).alias(c) for c in ("positives", "totals", "observed")])

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        start, horizon, kind = group[["start", "horizon", "kind"]].iloc[0]
        held = {r.name: to_series(r.first, r.positives, r.totals, r.observed) for r in group[~group["treated"]].itertuples(index=False)}
        own = [to_series(r.first, r.positives, r.totals, r.observed) for r in group[group["treated"]].itertuples(index=False)]
        found = synth(own[0], held, int(start), int(horizon), kind) if own else {"reason": "no series"}
        row = {"unit": key[0], "kind": kind, "effect": found.get("effect"), "reason": found.get("reason")}
        if "effect" in found:
            p = estimators.panel(own[0], held, int(start) - PRE_DAYS, int(start + horizon) - 1, int(start), kind)
            row |= {"treated": p.treated.tolist(), "donors": p.donors.T.ravel().tolist(), "post": p.post.tolist()}
        return estimators.plain_frame([row], [c.split()[0] for c in PANEL.split(", ")])

    return each.groupBy("unit").applyInPandas(one, PANEL)


def shift_p_value(treated: np.ndarray, donors: np.ndarray, post: np.ndarray, effect: float, kind: str) -> float:
    """How large a share of the cyclic shifts of the residuals has a mean over the window at least as far from zero, when
    an effect of that size is taken away."""
    target = treated - (effect / 100 if kind == "share" else math.log1p(effect / 100)) * post
    weights = simplex_weights(target, donors)
    gaps = (target - target.mean()) - (donors - donors.mean(axis=0)) @ weights
    # means over the window of all shifts at once: a circular correlation
    sums = np.array([gaps[np.flatnonzero(post) - k].sum() for k in range(len(gaps))])
    means = np.abs(sums / post.sum())
    return float(np.mean(means >= means[0] - 1e-15))


def conformal_intervals(units: DataFrame, members: DataFrame, level: float = LEVEL, block: int = 8) -> DataFrame:
    """unit, effect, lo90, hi90, reason: the effects on a grid that cyclic shifts don't reject, out from the estimate to the
    first rejected ones.

    A unit's panel travels once for each block of its grid, and a block's points are tested in its task; the ends are
    picked by aggregates. No range where the estimate itself is rejected, or nothing is within the grid.
    """
    made = panels(units, members)
    step = reduce(lambda a, k: a.when(F.col("kind") == k, F.lit(GRIDS[k][0])), list(GRIDS)[1:], F.when(F.col("kind") == list(GRIDS)[0], F.lit(GRIDS[list(GRIDS)[0]][0])))
    span = reduce(lambda a, k: a.when(F.col("kind") == k, F.lit(GRIDS[k][1])), list(GRIDS)[1:], F.when(F.col("kind") == list(GRIDS)[0], F.lit(GRIDS[list(GRIDS)[0]][1])))
    made = made.withColumns({"step": step, "most": F.floor(span / step + 1e-9).cast("int"), "wide": F.abs("effect") > span})
    tested = made.where("reason is null and not wide")
    grid = tested.withColumn("from", F.explode(F.sequence(-F.col("most") - 1, F.col("most"), F.lit(block))))  # one block holds the estimate too

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b.itertuples(index=False):
                treated, post = np.asarray(u.treated, float), np.asarray(u.post, bool)
                donors = np.asarray(u.donors, float).reshape(-1, len(treated)).T
                points = [k for k in range(int(u[b.columns.get_loc("from")]), int(u[b.columns.get_loc("from")]) + block) if -u.most <= k <= u.most]
                rows += [(u.unit, k, shift_p_value(treated, donors, post, k * u.step, u.kind)) for k in points]
                if u[b.columns.get_loc("from")] == -u.most - 1:
                    rows.append((u.unit, None, shift_p_value(treated, donors, post, u.effect, u.kind)))
            yield pd.DataFrame(rows, columns=["unit", "k", "p"]).astype({"k": "Int32"})

    dealt = grid.repartition("unit", "from")
    p = dealt.mapInPandas(run, "unit string, k int, p double").join(tested.select("unit", "effect", "step"), "unit")
    out = p.where(~(F.col("p") > 1 - level))
    ends = out.groupBy("unit").agg(
        F.max(F.when(F.col("k") <= F.floor(F.col("effect") / F.col("step")), F.col("k") * F.col("step"))).alias("lo90"),
        F.min(F.when(F.col("k") >= F.ceil(F.col("effect") / F.col("step")), F.col("k") * F.col("step"))).alias("hi90"),
        F.max(F.col("k").isNull()).alias("empty"),
    )
    both = made.join(ends, "unit", "left")
    empty, missing = F.coalesce("empty", F.lit(False)), F.col("lo90").isNull() | F.col("hi90").isNull()
    why = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("wide"), "interval wider than the grid").when(empty, "interval empty: no effect size passed").when(missing, "interval wider than the grid")
    return both.select("unit", "effect", *[F.when(why.isNull(), F.col(c)).alias(c) for c in ("lo90", "hi90")], why.alias("reason"))


# --- planted effects


def thinned(series: Series, start: int, per_cent: float, shape: str, seed: int, ramp: int = 7) -> Series:
    """The series with fewer rows from start on, at once or over `ramp` days: each is kept with a chance of 1 + effect."""
    if per_cent > 0:
        raise ValueError("volume effects only take rows away")
    keep = np.clip(1 + per_cent / 100 * reach(series.first + np.arange(len(series.totals)) - start + 1, shape, ramp), 0, 1)
    draw = np.random.default_rng(seed)
    held = [draw.binomial(x.astype(np.int64), keep) for x in (series.positives, series.totals - series.positives)]
    return Series(series.first, held[0].astype(float), (held[0] + held[1]).astype(float), series.observed)


def reach(age: np.ndarray, shape: str, ramp: int = 7) -> np.ndarray:
    """The part of an effect that a day has, the first being 1."""
    return (age >= 1).astype(float) if shape == "step" else np.clip(age / ramp, 0, 1)


def true_effect(effect: float, shape: str, horizon: int, kind: str) -> float:
    """What an estimate over the horizon should find: the mean for shares, the mean change of the logarithm for volumes."""
    part = reach(np.arange(1, horizon + 1), shape)
    return float(effect * part.mean()) if kind == "share" else 100 * math.expm1(float(np.mean(np.log1p(effect / 100 * part))))


TRIAL = "unit string, kind string, shape string, planted double, truth double, draw int, method string, estimate double, lo double, hi double, fallback boolean"


def paired_trials(units: DataFrame, members: DataFrame, effects: dict[str, list[float]], shapes: list[str], per_cell: int, seed: int, least_donors: int = 5) -> DataFrame:
    """The benchmark of both methods: every unit with every planted effect and shape, `per_cell` times, on the same series.

    units: unit, start, horizon, earlier. members: unit, name, treated, first, positives, totals, observed; donors are the
    clean ones of a unit. The synthetic control falls back to the regression where it has too few donors, does not fit or
    has no range. A trial is a task's row; its donors come with it as one array.
    """
    held = F.struct("name", "first", "positives", "totals", "observed")
    sides = members.groupBy("unit").agg(F.max(F.when(F.col("treated"), held)).alias("own"), F.collect_list(F.when(~F.col("treated"), held)).alias("others"))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("shape"), F.lit(float(e)).alias("planted")) for k, v in effects.items() for s in shapes for e in v])).alias("c")
    rows = units.select(F.col("unit"), "start", "horizon", "earlier", cells).select("unit", "start", "horizon", "earlier", "c.*", F.explode(F.sequence(F.lit(0), F.lit(per_cell - 1))).alias("draw"))
    rows = rows.withColumn("seed", F.pmod(F.xxhash64("unit", "kind", "shape", "planted", "draw", F.lit(seed)), F.lit(2**31)))
    rows = rows.join(sides, "unit").repartition("unit", "kind", "shape", "planted", "draw")
    names = [c.split()[0] for c in TRIAL.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u in b.itertuples(index=False):
                base = to_series(u.own["first"], u.own["positives"], u.own["totals"], u.own["observed"])
                start, horizon = int(u.start), int(u.horizon)
                plant = estimators.injected if u.kind == "share" else thinned
                s = plant(base, start, u.planted, u.shape, int(u.seed))
                truth = true_effect(u.planted, u.shape, horizon, u.kind)
                its = estimators.its(s, start, horizon, [int(e) for e in u.earlier], u.kind)
                first = (its.get("effect"), its.get("lo90"), its.get("hi90"))
                second, fallback = first, True
                donors = {d["name"]: to_series(d["first"], d["positives"], d["totals"], d["observed"]) for d in u.others}
                if len(donors) >= least_donors:
                    fit = synth(s, donors, start, horizon, u.kind)
                    ends = estimators.conformal_interval(s, donors, start, horizon, u.kind) if fit.get("fit_ok") else ""
                    if not isinstance(ends, str):
                        second, fallback = (fit["effect"], *ends), False
                for method, found, other in (("regression", first, False), ("synth", second, fallback)):
                    out.append(dict(zip(names, (u.unit, u.kind, u.shape, u.planted, truth, int(u.draw), method, *found, other))))
            yield estimators.plain_frame(out, names)

    return rows.mapInPandas(run, TRIAL)


def trial_report(trials: DataFrame) -> DataFrame:
    """For each cell and method: how often the range holds the truth, is away from zero, and the error of the estimates."""
    known = F.col("estimate").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull()
    away = (F.col("lo") > 0) | (F.col("hi") < 0)
    mean = lambda c: F.avg(F.when(known, c.cast("double")))
    return trials.groupBy("kind", "shape", "planted", "method").agg(
        F.count("*").alias("trials"), F.count_if(known).alias("estimated"), F.count_if("fallback").alias("fallbacks"),
        mean((F.col("lo") <= F.col("truth")) & (F.col("truth") <= F.col("hi"))).alias("coverage"),
        F.when(F.col("planted") == 0, mean(away)).alias("false_alarms"), F.when(F.col("planted") != 0, mean(away)).alias("power"),
        F.sqrt(mean(F.pow(F.col("estimate") - F.col("truth"), 2))).alias("rmse"),
    )


# What a method's ranges must do to be the default.
COVERAGE, FALSE_ALARMS = (0.85, 0.95), 0.10


def method_choice(trials: DataFrame, kind: str = "share", fallback: str = "regression") -> DataFrame:
    """Methods with coverage of planted effects, false alarms without one and error over all trials of a kind; `chosen` marks
    the one with the least error of those that meet the bounds, or the fallback, which is not `validated` then."""
    own = trials.where((F.col("kind") == kind) & F.col("estimate").isNotNull())
    held = (F.col("lo") <= F.col("truth")) & (F.col("truth") <= F.col("hi"))
    away = (F.col("lo") > 0) | (F.col("hi") < 0)
    judged = own.groupBy("method").agg(
        F.avg(F.when(F.col("planted") != 0, held.cast("double"))).alias("coverage"),
        F.avg(F.when(F.col("planted") == 0, away.cast("double"))).alias("false_alarms"),
        F.sqrt(F.avg(F.pow(F.col("estimate") - F.col("truth"), 2))).alias("rmse"),
    )
    judged = judged.withColumn("allowed", F.coalesce(F.col("coverage").between(*COVERAGE) & (F.col("false_alarms") <= FALSE_ALARMS), F.lit(False)))
    best = judged.agg(F.min(F.when(F.col("allowed"), F.struct("rmse", "method"))).alias("best")).select(F.col("best.method").alias("best"))
    named = judged.crossJoin(F.broadcast(best))  # a row for each method, beside one row
    return named.select("method", "coverage", "false_alarms", "rmse", (F.col("method") == F.coalesce("best", F.lit(fallback))).alias("chosen"), F.col("best").isNotNull().alias("validated"))
