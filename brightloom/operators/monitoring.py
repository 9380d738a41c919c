"""Weekly drift as long metric rows, alert outcomes, and the state of alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import measures

METRIC = ("family", "metric", "scope", "window_start", "window_end", "value", "lo", "hi", "n")


def metric_rows(values: DataFrame, family: str, metric: str, scope: Column, start: Column, end: Column) -> DataFrame:
    """Rows of the long metric table from a column `value` (and lo, hi, n where there are any)."""
    have = set(values.columns)
    more = [F.col(c).cast("double").alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in ("lo", "hi")]
    n = F.col("n").cast("long") if "n" in have else F.lit(None).cast("long")
    return values.select(F.lit(family).alias("family"), F.lit(metric).alias("metric"), scope.alias("scope"), start.alias("window_start"), end.alias("window_end"), F.col("value").cast("double").alias("value"), *more, n.alias("n"))


def full_weeks(rows: DataFrame, day: str) -> DataFrame:
    """rows with the Monday of their week, of weeks that lie between the first and the last day."""
    ends = rows.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    monday = F.date_trunc("week", F.col(day)).cast("date")
    both = rows.withColumn("week", monday).crossJoin(F.broadcast(ends))
    return both.where((F.col("week") >= F.col("_a")) & (F.date_add("week", 6) <= F.col("_b"))).drop("_a", "_b")


def drift(weekly: DataFrame, reference: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """Population stability index of each category of each week against the reference."""
    parts = []
    for name, category in categories.items():
        base = measures.shares(reference, [], category)
        now = measures.shares(weekly, ["week"], category)
        against = now.select("week").distinct().crossJoin(base.select("category", "share"))
        value = measures.psi(against, now, ["week"]).withColumnRenamed("psi", "value")
        parts.append(metric_rows(value, "drift", f"psi_{name}", F.lit("all"), F.col("week"), F.date_add("week", 6)))
    return reduce(DataFrame.unionByName, parts)


def outcomes(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """breached, ok, or null where a value or threshold is missing."""
    return metrics.join(thresholds.select("metric", "threshold"), "metric", "left").withColumn("breached", F.col("value") > F.col("threshold"))


def latest_windows(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The two latest window ends (of each `by`) with their place, 1 the latest; as many rows as there are groups, twice."""
    keys = by or []
    ends = judged.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set("window_end"), asc=False), 1, 2).alias("_e")) if keys else None
    if ends is not None:
        return ends.select(*keys, F.posexplode("_e").alias("_p", "window_end")).withColumn("_p", F.col("_p") + 1)
    two = judged.select("window_end").distinct().orderBy(F.col("window_end").desc()).limit(2)
    return two.select("window_end", F.row_number().over(Window.orderBy(F.col("window_end").desc())).alias("_p"))  # two rows


def new_breaches(judged: DataFrame) -> DataFrame:
    """Metrics breached in the latest window and not in the one before."""
    last = judged.join(F.broadcast(latest_windows(judged)), "window_end")
    last = last.groupBy("metric").agg(F.max(F.when(F.col("_p") == 1, F.col("breached"))).alias("now"), F.max(F.when(F.col("_p") == 2, F.col("breached"))).alias("before"))
    return last.where(F.col("now") & ~F.coalesce("before", F.lit(False))).select("metric")


def drift_pending(judged: DataFrame, log: DataFrame, by: str) -> DataFrame:
    """by and whether a retraining for drift is owed, for every group with a weekly metric.

    judged: by, metric, window_end, breached (null: not measured). log: by, at (in order), kind (requested or decision),
    window_end. Owed is one whose latest week has a breach that the week before had not, unless one was asked for since
    that week ended; or whose latest week has a breach, while one request is without a decision: it is asked once more only.
    """
    two = judged.join(latest_windows(judged, [by]), [by, "window_end"]).groupBy(by, "metric").agg(
        F.coalesce(F.max(F.when(F.col("_p") == 1, F.col("breached"))), F.lit(False)).alias("now"),
        F.coalesce(F.max(F.when(F.col("_p") == 2, F.col("breached"))), F.lit(False)).alias("before"),
    )
    weeks = judged.groupBy(by).agg(F.max("window_end").alias("latest"))
    state = two.groupBy(by).agg(F.max("now").alias("any"), F.max(F.col("now") & ~F.col("before")).alias("fresh")).join(weeks, by)
    requested = F.col("kind") == "requested"
    decided = log.groupBy(by).agg(F.max(F.when(F.col("kind") == "decision", F.col("at"))).alias("decided"), F.max(F.when(requested, F.col("window_end"))).alias("asked"))
    open_ = log.where(requested).join(decided.select(by, "decided"), by).where(F.col("decided").isNull() | (F.col("at") > F.col("decided"))).groupBy(by).agg(F.count("*").alias("open"))
    both = state.join(decided.select(by, "asked"), by, "left").join(open_, by, "left")
    asked = F.coalesce(F.col("asked") >= F.col("latest"), F.lit(False))
    owed = F.col("any") & ((F.col("fresh") & ~asked) | (F.coalesce("open", F.lit(0)) == 1))
    return both.select(by, owed.alias("pending"))


def alert_state(log: DataFrame) -> DataFrame:
    """Open alerts: the last measured outcome of a rule decides; drills open but never resolve."""
    counted = log.where(F.col("breached").isNotNull() & ~(F.col("drill") & ~F.col("breached")))
    return counted.groupBy("rule").agg(F.max_by("breached", "at").alias("open"))


def thresholds(weekly_metrics: DataFrame, percentile: float = 0.99, least: int = 200) -> DataFrame:
    return measures.percentile_thresholds(weekly_metrics.where(F.coalesce(F.col("n"), F.lit(least)) >= least), ["metric"], "value", percentile)


def regressions(now: DataFrame, base: DataFrame, tolerance: DataFrame) -> DataFrame:
    """Metrics that fell by more than their tolerance; those without a baseline are only reported."""
    both = now.select("metric", "value").join(base.select("metric", F.col("value").alias("base")), "metric", "left").join(tolerance, "metric", "left")
    fell = F.when(F.col("higher_is_better"), F.col("base") - F.col("value")).otherwise(F.col("value") - F.col("base"))
    return both.withColumn("regressed", F.when(F.col("base").isNotNull(), fell > F.col("tolerance") + 1e-9))


def promoted(gain: float, gain_low: float, margin: float, worst_drop: float, most_drop: float, dev_drop: float, speed: float, least_speed: float) -> tuple[bool, list[str]]:
    """Whether a challenger replaces the champion, and every check it fails."""
    failed = [
        name
        for name, bad in (
            ("gain", gain < margin or gain_low <= 0),
            ("language", worst_drop > most_drop),
            ("dev", dev_drop > most_drop),
            ("speed", speed < least_speed),
        )
        if bad
    ]
    return not failed, failed


def last_failure(runs: DataFrame, start: str, end: str, status: str, failed: str = "failed") -> DataFrame:
    """The latest finished run, if it failed."""
    last = runs.where(F.col(end).isNotNull()).agg(F.max_by(F.struct("*"), start).alias("r")).select("r.*")
    return last.where(F.col(status) == failed)


def run_log(starts: DataFrame, ends: DataFrame, run: str) -> DataFrame:
    """A row for each run; those without an end are still open."""
    return starts.join(ends, run, "left")
