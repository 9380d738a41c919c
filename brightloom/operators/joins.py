"""Joins that plain keys don't express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """left with the value of the last right row of its keys at or before its time.

    Both sides are ordered once by key and time; no pairs are made. Right values come first at equal times.
    """
    columns = left.columns
    l = left.select(*columns, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    r = right.select(*keys, at, F.lit(0).alias("_side"), F.col(value).alias("_value"))
    both = l.unionByName(r, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn(name, F.last("_value", ignorenulls=True).over(before))
    return seen.where("_side = 1").select(*columns, name)


def with_flag(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Whether right has the keys, without multiplying rows."""
    return left.join(right.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def days_around(anchors: DataFrame, day: str, before: int, after: int) -> DataFrame:
    """Each anchor once for every day from `before` days before it to `after` after; name of the day: `day`."""
    return anchors.withColumn(day, F.explode(F.sequence(F.date_add(F.col(day), -before), F.date_add(F.col(day), after))))


def near_anchor(rows: DataFrame, anchors: DataFrame, keys: list[str], day: str, before: int, after: int, name: str) -> DataFrame:
    """Whether an anchor of the same keys lies within the window: an equi join on days instead of a range join."""
    return with_flag(rows, days_around(anchors.select(*keys, day), day, before, after), [*keys, day], name)


def in_intervals(rows: DataFrame, intervals: DataFrame, day: str, start: str, end: str, name: str) -> DataFrame:
    """Whether a day lies in any interval. Intervals become days, so the join is on equal days."""
    days = intervals.select(F.explode(F.sequence(F.col(start), F.col(end))).alias(day))
    return with_flag(rows, days, [day], name)


def densified(spine: DataFrame, values: DataFrame, facts: DataFrame, keys: list[str], fill: list[str]) -> DataFrame:
    """Every spine row with every value, and facts where there are any; counts 0 elsewhere. Spark broadcasts short lists."""
    return spine.crossJoin(values).join(facts, keys, "left").na.fill(0, fill)


def unpivoted(rows: DataFrame, keys: list[str], pairs: dict[str, tuple[str, ...]], names: tuple[str, ...], code: str) -> DataFrame:
    """A row for each code, with its columns under common names."""
    each = F.array(*[F.struct(F.lit(k).alias(code), *[F.col(c).alias(n) for c, n in zip(cols, names)]) for k, cols in pairs.items()])
    return rows.select(*keys, F.inline(each))


def with_newest(rows: DataFrame, other: DataFrame, keys: list[str], order: list[Column], take: list[str]) -> DataFrame:
    """The newest other row of each key beside it, null if there is none."""
    best = other.groupBy(*keys).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("_best"))
    return rows.join(best, keys, "left").select(*rows.columns, *[F.col(f"_best.{c}").alias(c) for c in take])


def holding(rows: DataFrame, array_json: str, value: str, run: str, upto: int | None = None) -> DataFrame:
    """The latest row whose JSON array holds the value, as of a run."""
    found = rows.where(F.array_contains(F.from_json(array_json, "array<string>"), value))
    found = found if upto is None else found.where(F.col(run) <= upto)
    return found.orderBy(F.col(run).desc()).limit(1)


def later_of(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    return a.select(key, value).unionByName(b.select(key, value)).groupBy(key).agg(F.max(value).alias(value))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of cases that both sides have one for, with their difference."""
    x = a.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("base"))
    y = b.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("other"))
    return x.join(y, keys).withColumn("difference", F.col("other") - F.col("base"))


def served(rows: DataFrame, keys: list[str], method: str, fallback: str, reason: str) -> DataFrame:
    """The row of a method, or of the fallback with the first one's reason where that has no effect."""
    mine = F.max_by(F.struct("*"), F.when(F.col("method") == method, 1))
    other = F.max_by(F.struct("*"), F.when(F.col("method") == fallback, 1))
    both = rows.groupBy(*keys).agg(mine.alias("m"), other.alias("f"))
    use = F.when(F.col("m.effect").isNotNull() | F.col("f.effect").isNull(), F.col("m")).otherwise(F.col("f"))
    chosen = both.select(use.alias("u"), F.col(f"m.{reason}").alias("fell_back"), F.col("m.method").alias("asked"))
    return chosen.select("u.*", F.when(F.col("u.method") != F.col("asked"), F.col("fell_back")).alias("fallback_reason"))
