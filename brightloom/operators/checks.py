"""Data-quality checks: each gives the violating rows; report() counts them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import days_around


def nulls(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNull())


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Children whose parent is missing; a null key passes."""
    some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    named = parent.select(*[F.col(p).alias(k) for k, p in keys.items()]).distinct()
    return child.where(some).join(named, list(keys), "left_anti")


def unaccepted(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(values))


def outside_unit(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(~F.col(column).between(0, 1))


def more_than(rows: DataFrame, part: str, whole: str) -> DataFrame:
    return rows.where(F.col(part) > F.col(whole))


def unreconciled(whole: DataFrame, parts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Rows whose parts don't add up to them; missing parts count 0."""
    added = parts.groupBy(*keys).agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    differs = reduce(lambda a, b: a | b, [F.col(s) != F.coalesce(f"_{s}", F.lit(0)) for s in sums])
    return whole.join(added, keys, "left").where(differs)


def over_cap(members: DataFrame, anchors: DataFrame, entity: str, day: str, cap: int, window: int) -> DataFrame:
    """Entities with more members outside every anchor's window than the cap."""
    near = days_around(anchors.select(entity, day), day, window, window).distinct()
    return members.join(near, [entity, day], "left_anti").groupBy(entity).count().where(F.col("count") > cap)


def stale_tables(rows: DataFrame, at: str, now: str, warn_hours: float = 36, error_hours: float = 48) -> DataFrame:
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.max(at).cast("timestamp"))) / 3600
    return rows.agg(age.alias("age_hours")).withColumn("state", F.when(F.col("age_hours") > error_hours, "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("ok"))


def report(named: dict[str, DataFrame]) -> DataFrame:
    """Number of violations of each check."""
    each = [v.agg(F.count("*").alias("violations")).select(F.lit(n).alias("name"), "violations") for n, v in named.items()]
    return reduce(DataFrame.unionByName, each)


def logged(found: DataFrame, run_id: int, severity: str) -> DataFrame:
    """Rows for the log, with details cut to 2,000 characters."""
    return found.select(F.lit(run_id).alias("run_id"), F.col("name").alias("check"), F.lit(severity).alias("severity"), F.substring(F.to_json(F.struct("*")), 1, 2000).alias("detail"))
