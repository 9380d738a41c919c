"""The evidence of a report: a fixed plan of calls, their results, and what the hypotheses read from them.

A call is a tool and its arguments; a fingerprint of both names it, so a call that many reports make is answered once.
Answers are joins: a call's days meet the day's cells, whichever tool it is, and every result is a JSON text made of its
arguments and the sources alone. So a trace (scope, name, tool, args, fingerprint, result) can be answered again from
itself, and shows what has changed since. Cells are the rows of a day, counted before any call is looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import newcombe, ratio, wilson
from . import intervals, measures

# Days before a window, and days around a start.
BASELINE_DAYS, NEAR_DAYS = 28, 3
ARGS = "entity string, bundle_id string, start date, end date, base_start date, base_end date"
_ARG_NAMES = [a.split()[0] for a in ARGS.split(", ")]


@dataclass(frozen=True)
class Sources:
    """cells: entity, day, bucket, n, positives, new, scored (negatives), off_topic (of these). prices: entity, day, sale,
    discount (null: not tracked); a row for each day. estimates: bundle_id, horizon, effect, lo90, hi90, method, p_value,
    outcome, sample, flags. ranges: whether the parts of a change get intervals, which are draws."""

    cells: DataFrame
    prices: DataFrame
    estimates: DataFrame
    ranges: bool = True
    resamples: int = 2000


def fingerprinted(calls: DataFrame) -> DataFrame:
    """calls (tool and arguments) with args, the arguments that are there as JSON, and a fingerprint of both."""
    with_args = calls.withColumn("args", F.to_json(F.struct(*_ARG_NAMES)))
    return with_args.withColumn("fingerprint", F.sha2(F.concat_ws("|", "tool", "args"), 256))


def planned(scopes: DataFrame) -> DataFrame:
    """The calls of each scope (scope_id, entity, start, horizon, bundle_id or null): the same ones for every report."""
    end, before = F.date_add("start", F.col("horizon") - 1), F.date_add("start", -1)
    base = F.date_add("start", -BASELINE_DAYS)
    no, none = F.lit(None).cast("date"), F.lit(None).cast("string")

    def call(name: str, tool: str, bundle: Column = none, a: Column = no, b: Column = no, c: Column = no, d: Column = no) -> Column:
        whose = none if tool == "estimate" else F.col("entity").cast("string")
        return F.struct(F.lit(name).alias("name"), F.lit(tool).alias("tool"), *[x.alias(n) for x, n in zip((whose, bundle, a, b, c, d), _ARG_NAMES)])

    each = [
        call("overview", "overview"),
        call("window", "timeseries", a=F.col("start"), b=end),
        call("baseline", "timeseries", a=base, b=before),
        call("near_start", "timeseries", a=F.date_add("start", -NEAR_DAYS), b=F.date_add("start", NEAR_DAYS)),
        call("aspects", "aspects", a=F.col("start"), b=end, c=base, d=before),
        call("decomposition", "decomposition", a=F.col("start"), b=end, c=base, d=before),
        call("estimate", "estimate", bundle=F.col("bundle_id").cast("string")),
    ]
    calls = scopes.select("scope_id", F.explode(F.array(*each)).alias("c")).select("scope_id", "c.*")
    return fingerprinted(calls.where("tool <> 'estimate' or bundle_id is not null"))


def _days(calls: DataFrame, start: str, end: str, period: str) -> DataFrame:
    return calls.select("fingerprint", "entity", F.lit(period).alias("period"), F.explode(F.sequence(start, end)).alias("day"))


def _percent(x: Column) -> Column:
    return F.round(100 * x, 2)


def answered(calls: DataFrame, sources: Sources) -> DataFrame:
    """fingerprint and result of every different call."""
    once = calls.select("fingerprint", "tool", *_ARG_NAMES).dropDuplicates(["fingerprint"])
    own = {t: once.where(F.col("tool") == t) for t in ("overview", "timeseries", "aspects", "decomposition", "estimate")}
    counts = ("n", "positives", "new", "scored", "off_topic")
    daily = sources.cells.groupBy(F.col("entity").cast("string").alias("entity"), "day").agg(*[F.sum(c).alias(c) for c in counts])
    total = {c: F.coalesce(F.sum(c), F.lit(0)) for c in counts}

    whole = daily.groupBy("entity").agg(F.sum("n").alias("reviews"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    overview = own["overview"].select("fingerprint", "entity").join(whole, "entity", "left").select("fingerprint", F.to_json(F.struct(F.struct("reviews", "first_day", "last_day").alias("total"))).alias("result"))

    days = _days(own["timeseries"], "start", "end", "window")
    prices = sources.prices.select(F.col("entity").cast("string").alias("entity"), "day", "sale", "discount")
    sums = days.join(daily, ["entity", "day"], "left").join(prices, ["entity", "day"], "left").groupBy("fingerprint").agg(
        total["n"].alias("reviews"), total["positives"].alias("positives"), total["new"].alias("new_players"), F.count_if("sale").alias("sale_days"), F.count_if("discount").alias("discount_days"), F.count_if(F.col("discount").isNull()).alias("price_unknown_days")
    )
    low, high = wilson("positives", "reviews")
    shares = sums.withColumns({"share": _percent(ratio("positives", "reviews")), "lo90": _percent(low), "hi90": _percent(high), "new_players_share": _percent(ratio("new_players", "reviews"))})
    series = shares.select("fingerprint", F.to_json(F.struct(F.struct(*[c for c in shares.columns if c != "fingerprint"]).alias("total"))).alias("result"))

    both = _days(own["aspects"].unionByName(own["decomposition"]), "start", "end", "window").unionByName(_days(own["aspects"].unionByName(own["decomposition"]), "base_start", "base_end", "baseline"))
    now = F.col("period") == "window"
    side = lambda c, p: F.coalesce(F.sum(F.when(p, F.col(c))), F.lit(0))
    off = both.join(daily, ["entity", "day"]).groupBy("fingerprint").agg(*[side(c, p).alias(f"{n}_{m}") for c, m in (("off_topic", "mentions"), ("scored", "scored")) for n, p in (("window", now), ("baseline", ~now))])
    off = own["aspects"].select("fingerprint").join(off, "fingerprint", "left").na.fill(0)
    low, high = newcombe("window_mentions", "window_scored", "baseline_mentions", "baseline_scored")
    change = ratio("window_mentions", "window_scored") - ratio("baseline_mentions", "baseline_scored")
    negative = F.struct("window_mentions", "window_scored", "baseline_mentions", "baseline_scored", *[_percent(c).alias(n) for c, n in ((change, "change"), (low, "lo90"), (high, "hi90"))])
    aspects = off.select("fingerprint", F.to_json(F.struct(F.struct(F.struct(negative.alias("negative")).alias("off_topic")).alias("aspects"))).alias("result"))

    cells = both.join(sources.cells.select(F.col("entity").cast("string").alias("entity"), "day", "bucket", "n", "positives"), ["entity", "day"]).join(own["decomposition"].select("fingerprint"), "fingerprint", "left_semi")
    cells = cells.groupBy("fingerprint", "bucket").agg(side("positives", ~now).alias("p0"), side("n", ~now).alias("n0"), side("positives", now).alias("p1"), side("n", now).alias("n1"))
    sizes = cells.groupBy("fingerprint").agg(F.sum("n1").alias("window_reviews"), F.sum("n0").alias("baseline_reviews"))
    full = cells.join(sizes.where("window_reviews > 0 and baseline_reviews > 0").select("fingerprint"), "fingerprint", "left_semi")
    names = ("total", "composition", "within", "interaction")
    parts = measures.decomposition(full, ["fingerprint"])
    parts = parts.select("fingerprint", *[(F.round(p, 4) + 0.0).alias(p) for p in names])  # no negative zero
    if sources.ranges:
        ends = intervals.decomposition_intervals(full, ["fingerprint"], "bucket", resamples=sources.resamples)
        ends = ends.groupBy("fingerprint").agg(F.map_from_entries(F.collect_list(F.struct("part", F.array(F.round("lo", 4), F.round("hi", 4))))).alias("intervals"))
        parts = parts.join(ends, "fingerprint")
    empty = F.when(F.col("total").isNull(), "a period without rows").alias("error")
    inner = F.struct("window_reviews", "baseline_reviews", *names, *(["intervals"] if sources.ranges else []), empty)
    split = own["decomposition"].select("fingerprint").join(sizes, "fingerprint", "left").na.fill(0).join(parts, "fingerprint", "left").select("fingerprint", F.to_json(inner).alias("result"))

    fields = [c for c in sources.estimates.columns if c not in ("bundle_id", "horizon")]
    rows = sources.estimates.select(F.col("bundle_id").cast("string").alias("bundle_id"), F.col("horizon").cast("string").alias("h"), F.struct(*fields).alias("row"))
    served = rows.groupBy("bundle_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("h", "row")))).alias("horizons"))  # a row or two for each bundle
    estimate = own["estimate"].select("fingerprint", "bundle_id").join(served, "bundle_id", "left").select("fingerprint", F.to_json(F.struct("horizons")).alias("result"))
    return reduce(DataFrame.unionByName, (overview, series, aspects, split, estimate))


def traced(scopes: DataFrame, sources: Sources) -> DataFrame:
    """scope_id, name, tool, args, fingerprint and result of every call of the plan."""
    calls = planned(scopes)
    return calls.select("scope_id", "name", "tool", "args", "fingerprint").join(answered(calls, sources), "fingerprint")


def again(trace: DataFrame, sources: Sources) -> DataFrame:
    """Every different call of a trace, answered again from its arguments alone: fingerprint, tool, result, same."""
    calls = trace.select("fingerprint", "tool", "args", F.col("result").alias("before")).dropDuplicates(["fingerprint"])
    parsed = calls.withColumn("_a", F.from_json("args", ARGS)).select("fingerprint", "tool", "_a.*")
    return calls.join(answered(parsed, sources), "fingerprint").select("fingerprint", "tool", "result", F.col("result").eqNullSafe(F.col("before")).alias("same"))


def core_evidence(trace: DataFrame, scopes: DataFrame, sources: Sources) -> DataFrame:
    """A row for each scope with the columns that rules.hypotheses reads, and the calls behind them."""
    names = ("window", "baseline", "near_start", "aspects", "decomposition", "estimate")
    wide = trace.groupBy("scope_id").agg(*[F.max(F.when(F.col("name") == n, F.col("result"))).alias(f"_{n}") for n in names], F.map_from_entries(F.collect_list(F.struct("name", "fingerprint"))).alias("calls"))
    kinds = dict(sources.estimates.dtypes)
    fields = {c: k for c, k in kinds.items() if c not in ("bundle_id", "horizon")}
    row = ", ".join(f"{c}: {k}" for c, k in fields.items())
    rows = wide.join(scopes.select("scope_id", "horizon"), "scope_id").withColumn("_row", F.try_element_at(F.from_json("_estimate", f"horizons map<string, struct<{row}>>")["horizons"], F.col("horizon").cast("string")))

    def number(call: str, path: str) -> Column:
        return F.get_json_object(f"_{call}", path).cast("double")

    w, b = ([number(c, f"$.total.{x}") for x in ("new_players", "reviews")] for c in ("window", "baseline"))
    low, high = newcombe(*w, *b)
    near = {x: number("near_start", f"$.total.{x}").cast("long") for x in ("sale_days", "discount_days", "price_unknown_days")}
    off = {f"off_topic_{x}": number("aspects", f"$.aspects.off_topic.negative.{x}") for x in ("change", "lo90", "hi90")}
    ends = {f"{n}_{x}": number("decomposition", f"$.intervals.{p}[{i}]") for p, n in (("composition", "composition"), ("total", "total")) for i, x in enumerate(("lo90", "hi90"))}
    return rows.select(
        "scope_id", "calls", *[F.col("_row")[c].alias(c) for c in fields], F.col("_row").isNotNull().alias("has_estimate"),
        *[number(c, "$.total.share").alias(f"{c}_share") for c in ("window", "baseline")], *[number(c, "$.total.reviews").cast("long").alias(f"{c}_reviews") for c in ("window", "baseline")],
        *[v.alias(k) for k, v in near.items()], _percent(ratio(*w) - ratio(*b)).alias("new_players_change"), _percent(low).alias("new_players_lo90"), _percent(high).alias("new_players_hi90"),
        *[v.alias(k) for k, v in off.items()], number("decomposition", "$.composition").alias("composition"), number("decomposition", "$.total").alias("total_change"), *[v.alias(k) for k, v in ends.items()],
    )
