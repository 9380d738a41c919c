"""The nightly run: pages to versions, marts, index and effects. Every step is a DataFrame written once for the run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import checks, series, versions

Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class Night:
    """Paths of a run, and what is pluggable: a scorer adds label columns to rows with text."""

    store: str
    run_id: int
    scorer: Scorer | None = None
    checks: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


def stored(spark: SparkSession, night: Night, name: str, run_id: int) -> DataFrame:
    return spark.read.parquet(f"{night.store}/{name}/run={run_id}")


def kept(df: DataFrame, night: Night, name: str) -> DataFrame:
    """Written under the run, never over what it reads: a failed night leaves the last one as it was."""
    df.write.mode("overwrite").parquet(f"{night.store}/{name}/run={night.run_id}")
    return stored(df.sparkSession, night, name, night.run_id)


def run_nightly(spark: SparkSession, night: Night, incoming: DataFrame, before: int | None = None) -> dict[str, DataFrame]:
    """incoming: review_id, version, run_id, entity, day, text, positive, minutes. before: the last run, if any."""
    order = [F.col("version").desc(), F.col("run_id").desc()]
    rows = versions.latest(incoming, ["review_id", "version"], [F.col("run_id").desc()])
    if before is not None:
        rows = versions.upserted(stored(spark, night, "versions", before), rows, ["review_id", "version"], ["run_id"], order)
    out = {"versions": kept(rows, night, "versions")}
    latest = versions.latest(out["versions"], ["review_id"], order)
    out["latest"] = kept(latest if night.scorer is None else night.scorer(latest), night, "latest")

    def mart(part: DataFrame) -> DataFrame:
        return part.groupBy("entity", "day").agg(F.count("*").alias("n"), F.count_if("positive").alias("x"), F.count_if(F.col("minutes") < 600).alias("new"))

    if before is None:
        days = mart(out["latest"])
    else:
        old = stored(spark, night, "latest", before)
        new = incoming.select("review_id").distinct()
        keys = versions.affected_days(out["latest"].join(new, "review_id", "left_semi"), old.join(new, "review_id", "left_semi"), out["latest"].limit(0), ["entity", "day"])
        days = versions.replaced(stored(spark, night, "days", before), keys, mart(out["latest"].join(keys, ["entity", "day"], "left_semi")), ["entity", "day"])
    out["days"] = kept(days, night, "days")
    lo, hi = c.wilson("x", "n")
    dense = series.dense(out["days"], ["entity"], "day", ["n", "x", "new"])
    out["daily"] = kept(dense.withColumns({"share": c.ratio("x", "n"), "lo": lo, "hi": hi}), night, "daily")
    found = {"unique": checks.repeated(out["latest"], ["review_id"]), "in_unit": checks.outside_unit(out["daily"], "share")}
    found |= {n: f(out["daily"]) for n, f in night.checks.items()}
    out["quality"] = kept(checks.report(found), night, "quality")
    return out
