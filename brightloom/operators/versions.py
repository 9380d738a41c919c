"""Versioned rows: latest versions, merges into stored tables, differences, and what must be rebuilt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order, which should break all ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_with_history(rows: DataFrame, keys: list[str], order: list[Column], first_seen: str, last_seen: str) -> DataFrame:
    """The latest version, with the first and last run that saw any version; one shuffle for both."""
    whole = Window.partitionBy(*keys)
    seen = rows.withColumns({"_first": F.min(first_seen).over(whole), "_last": F.max(last_seen).over(whole)})
    out = latest(seen, keys, order)
    return out.withColumns({first_seen: F.col("_first"), last_seen: F.col("_last")}).drop("_first", "_last")


def latest_as_of(rows: DataFrame, keys: list[str], run: str, as_of: int | None = None) -> DataFrame:
    """The newest row of each key among those of run as_of or before."""
    seen = rows if as_of is None else rows.where(F.col(run) <= as_of)
    return latest(seen, keys, [F.col(run).desc()])


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str], refresh: list[str], order: list[Column]) -> DataFrame:
    """stored with the refresh columns of rows seen again, and rows not seen before; the last incoming row of a key wins."""
    new = latest(incoming, keys, order)
    changes = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in refresh], F.lit(True).alias("_seen"))
    kept = stored.join(changes, keys, "left")
    kept = kept.withColumns({c: F.when(F.col("_seen"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in refresh})
    return kept.select(*stored.columns).unionByName(new.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def inserted_if_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return stored.unionByName(missing(incoming.dropDuplicates(keys), stored, keys))


def missing(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a stored counterpart; unlike NOT IN, a null among the stored keys changes nothing."""
    return wanted.join(held.select(*keys).distinct(), keys, "left_anti")


def appended_if_changed(stored: DataFrame, incoming: DataFrame, keys: list[str], print_column: str, run: str) -> DataFrame:
    """stored and those incoming rows whose fingerprint differs from the newest stored one of their key."""
    now = latest_as_of(stored, keys, run).select(*keys, F.col(print_column).alias("_held"))
    changed = incoming.join(now, keys, "left").where(~F.col("_held").eqNullSafe(F.col(print_column)))
    return stored.unionByName(changed.select(*stored.columns))


def replaced(stored: DataFrame, changed_keys: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete and insert: rows of changed keys go, also where new has none for them."""
    return missing(stored, changed_keys, keys).unionByName(new.select(*stored.columns))


def overlaid(low: DataFrame, high: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which the rows of high win."""
    return high.unionByName(missing(low, high, keys).select(*high.columns))


def sync_plan(target: DataFrame, mirror: DataFrame, keys: list[str], version: str, print_column: str) -> DataFrame:
    """What makes the mirror equal the target: delete, upsert (another version) or update (other fields)."""
    t = target.select(*keys, F.col(version).alias("_tv"), F.col(print_column).alias("_tf"), F.lit(1).alias("_t"))
    m = mirror.select(*keys, F.col(version).alias("_mv"), F.col(print_column).alias("_mf"), F.lit(1).alias("_m"))
    action = (
        F.when(F.col("_t").isNull(), "delete")
        .when(F.col("_m").isNull() | ~F.col("_tv").eqNullSafe(F.col("_mv")), "upsert")
        .when(~F.col("_tf").eqNullSafe(F.col("_mf")), "update")
    )
    return t.join(m, keys, "full_outer").withColumn("action", action).where("action is not null").select(*keys, "action")


def synced(mirror: DataFrame, target: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """The mirror after the plan was applied and confirmed."""
    fresh = target.join(plan.where("action != 'delete'").select(*keys), keys, "left_semi")
    return replaced(mirror, plan.select(*keys), fresh, keys)


def reconciled(target: DataFrame, mirror: DataFrame, by: list[str]) -> DataFrame:
    """Counts of both sides for each group and their difference."""
    t = target.groupBy(*by).agg(F.count("*").alias("n_target"))
    m = mirror.groupBy(*by).agg(F.count("*").alias("n_mirror"))
    both = t.join(m, by, "full_outer").na.fill(0, ["n_target", "n_mirror"])
    return both.withColumn("difference", F.abs(F.col("n_target") - F.col("n_mirror")))


def strays_and_lacking(held: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with their side. Both sides are counted together, so neither is held by a task as a whole;
    a null key has no counterpart."""
    both = held.select(*keys, F.lit(1).alias("_held")).unionByName(wanted.select(*keys, F.lit(2).alias("_held")))
    sides = both.groupBy(*keys).agg(F.bit_or("_held").alias("_held"))
    some_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    side = F.when(F.col("_held") == 1, F.array(F.lit("stray"))).when(F.col("_held") == 2, F.array(F.lit("lacking"))).when(some_null, F.array(F.lit("stray"), F.lit("lacking")))
    return sides.select(*keys, F.explode(side).alias("side"))


def affected_days(changed: DataFrame, recent: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a build must do again: of changed rows, of days still open, of days whose flags changed."""
    return changed.select(*keys).union(recent.select(*keys)).union(flags.select(*keys)).distinct()


def above_mark(rows: DataFrame, run: str, built: DataFrame | None) -> DataFrame:
    """Rows of runs after the highest one that a built table holds."""
    if built is None:
        return rows
    mark = built.agg(F.coalesce(F.max(run), F.lit(0)).alias("_mark"))  # one row
    return rows.join(F.broadcast(mark), F.col(run) > F.col("_mark")).drop("_mark")


def to_recompute(wanted: DataFrame, stored: DataFrame, keys: list[str], print_column: str) -> DataFrame:
    """Wanted units of work whose fingerprint isn't stored under their key."""
    return missing(wanted, stored, [*keys, print_column])


def field_updates(rows: DataFrame, key: str, fields: list[str], most: int = 10_000) -> DataFrame:
    """Operations for each set of new values, with their keys: about `most` at a time.

    Rows of a set are counted first and dealt by the hash of the key to as many parts as they need, so no task orders
    or gathers all rows of a common one.
    """
    sizes = rows.groupBy(*fields).agg(F.ceil(F.count("*") / most).alias("_parts"))
    dealt = rows.join(sizes, fields).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")))
    return dealt.groupBy(*fields, "_part").agg(F.sort_array(F.collect_list(key)).alias("keys")).drop("_part")


def outranked(scores: DataFrame, keys: list[str], model: str, run: str, current: str) -> DataFrame:
    """Rows of the current model that a later run of another model outranks."""
    other = F.max(F.when(F.col(model) != current, F.col(run))).over(Window.partitionBy(*keys))
    return scores.withColumn("_other", other).where((F.col(model) == current) & (F.col("_other") > F.col(run))).drop("_other")


def backlog(latest_rows: DataFrame, scores: DataFrame, keys: list[str], model: str, version: str, order: list[Column], most: int | None = None) -> DataFrame:
    """Latest rows that the model version has not scored, in order; at most `most`, a run's budget."""
    todo = missing(latest_rows, scores.where(F.col(model) == version), keys).orderBy(*order)
    return todo if most is None else todo.limit(most)


def rolled_up(parts: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Totals of a mart that is finer than wanted."""
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])


def round_robin(cases: DataFrame, hosts: DataFrame, order: str, host_order: str) -> DataFrame:
    """The i-th case goes to host i modulo their number. Both are small lists, as of tests."""
    n = hosts.count()
    numbered = cases.withColumn("_i", (F.row_number().over(Window.orderBy(order)) - 1) % n)
    return numbered.join(hosts.withColumn("_i", F.row_number().over(Window.orderBy(host_order)) - 1), "_i").drop("_i")


def aligned_labels(labels: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Labels with the current row of their key beside them; `missing` marks those without one, which callers count."""
    return labels.join(current.withColumn("_there", F.lit(True)), key, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def retrain_set(silver: DataFrame, spot: DataFrame, current: DataFrame, key: str, day: str, newest: Column, held_out_weeks: int = 8) -> DataFrame:
    """Training labels: spot labels win over silver ones, joined to current texts; the last weeks are held out."""
    rows = aligned_labels(overlaid(silver, spot, [key]), current, key).where(~F.col("missing")).drop("missing")
    return rows.withColumn("held_out", F.datediff(newest, F.col(day)) < 7 * held_out_weeks)


def to_reclassify(items: DataFrame, labels: DataFrame, key: str, version: str, current: str) -> DataFrame:
    """Items that the current version of the rules has not labelled."""
    return missing(items, labels.where(F.col(version) == current), [key])


def with_watermark(rows: DataFrame, source: DataFrame, run: str, name: str = "watermark") -> DataFrame:
    """rows stamped with the highest run that the build has read (one row)."""
    return rows.crossJoin(F.broadcast(source.agg(F.max(run).alias(name))))


def last_mismatches(log: DataFrame, run: str, before: int, keys: list[str]) -> DataFrame:
    """Keys that the latest run before this one found unequal."""
    earlier = log.where(F.col(run) < before)
    last = earlier.agg(F.max(run).alias("_last"))  # one row
    return earlier.join(F.broadcast(last), F.col(run) == F.col("_last")).where("mismatched").select(*keys).distinct()


def decision_changes(stored: DataFrame, fresh: DataFrame, keys: list[str], decision: str) -> DataFrame:
    """Claims whose decision is another one now, also those that only one side has."""
    a = stored.select(*keys, F.col(decision).alias("before"))
    b = fresh.select(*keys, F.col(decision).alias("after"))
    return a.join(b, keys, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
