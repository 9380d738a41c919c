"""Queries of overviews, calendar weeks, served estimates, spikes and weekly drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import joins, measures, monitoring, retrieval, series
from .analysis import _DENSE, _VEC, _dense, _queries
from .tables import read


def entity_overview(s: SparkSession, d: str) -> DataFrame:
    """Totals, first and last day, and the pooled share of the last 30 days of each entity."""
    daily = _dense(s, d)
    last = daily.groupBy("entity").agg(F.max("day").alias("last"))
    both = daily.join(last, "entity")
    recent = F.datediff("last", "day") < 30
    return both.groupBy("entity").agg(
        F.sum("n").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"),
        F.round(F.sum(F.when(recent, F.col("x"))) / F.sum(F.when(recent, F.col("n"))), 6).alias("recent_share"),
    )


def calendar_weeks(s: SparkSession, d: str) -> DataFrame:
    """Monday weeks, each present, with no share under a least number of rows."""
    week = F.date_trunc("week", F.col("day")).cast("date")
    by = _dense(s, d).groupBy("entity", week.alias("week")).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return by.select("entity", "week", "n", F.round(F.when(F.col("n") >= 15, F.col("x") / F.col("n")), 6).alias("share"))


def later_of_two(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    parts = [o.where(F.col("o_orderpriority") == p).groupBy("o_custkey").agg(F.max("day").alias("day")) for p in ("1-URGENT", "5-LOW")]
    return joins.later_of(*parts, "o_custkey", "day")


def window_overlap(s: SparkSession, d: str) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    iou = c.window_iou(start, F.date_add(start, 29), F.lit("1996-06-01").cast("date"), F.lit("1996-08-31").cast("date"))
    return read(s, d, "orders").select("o_orderkey", F.round(iou, 6).alias("iou")).where("iou > 0")


def ranking_pool(s: SparkSession, d: str) -> DataFrame:
    run = retrieval.dense_search(*_queries(s, d), "item_id", "query_id", "embedding", 20, 6)
    return retrieval.pool(run, 5, "query_id", "item_id")


def served_estimates(s: SparkSession, d: str) -> DataFrame:
    """The second method's row where it has an effect, else the first's with the reason."""
    o = read(s, d, "orders").select("o_orderkey", "o_totalprice")
    its = o.select("o_orderkey", F.lit("its").alias("method"), F.col("o_totalprice").alias("effect"), F.lit(None).cast("string").alias("reason"))
    poor = F.col("o_orderkey") % 3 == 0
    synth = o.select("o_orderkey", F.lit("synth").alias("method"), F.when(~poor, F.col("o_totalprice") / 2).alias("effect"), F.when(poor, "poor fit").alias("reason"))
    return joins.served(its.unionByName(synth), ["o_orderkey"], "synth", "its", "reason").select("o_orderkey", "method", F.round("effect", 4).alias("effect"), "fallback_reason")


def spike_days(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return series.spike_days(e, ["event_type"], "day", "n", 7, 1.0).select("event_type", "day", "spike")


def weekly_drift(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select(F.col("ts").cast("date").alias("day"), "event_type")
    out = monitoring.drift(monitoring.full_weeks(e, "day"), e, {"event_type": F.col("event_type")})
    return out.select("metric", "window_start", F.round("value", 6).alias("value"))


def promoted_thresholds(s: SparkSession, d: str) -> DataFrame:
    """Outcomes of values against thresholds, null where one is missing."""
    e = read(s, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    t = measures.percentile_thresholds(read(s, d, "events").where("event_type <> 'click'"), ["event_type"], "value", 0.5).withColumnRenamed("event_type", "metric")
    return monitoring.outcomes(e, t).select("metric", "breached")


QUERIES = {f.__name__: f for f in (
    entity_overview, calendar_weeks, later_of_two, window_overlap, ranking_pool, served_estimates, spike_days, weekly_drift, promoted_thresholds,
)}

SQL = {
    "entity_overview": f"WITH {_DENSE} SELECT d.entity, sum(n)::BIGINT AS n, min(day) AS first, max(day) AS last, round(sum(x) FILTER (b - day < 30) / sum(n) FILTER (b - day < 30), 6) AS recent_share FROM dense d JOIN ends USING (entity) GROUP BY 1",
    "calendar_weeks": f"WITH {_DENSE} SELECT entity, CAST(date_trunc('week', day) AS DATE) AS week, sum(n)::BIGINT AS n, CASE WHEN sum(n) >= 15 THEN round(sum(x) / sum(n), 6) END AS share FROM dense GROUP BY 1, 2",
    "later_of_two": "SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS day FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1",
    "window_overlap": """WITH w AS (SELECT o_orderkey, greatest(0, least(CAST(o_orderdate AS DATE) + 29, DATE '1996-08-31') - greatest(CAST(o_orderdate AS DATE), DATE '1996-06-01') + 1) AS i FROM orders) SELECT o_orderkey, round(i / (122 - i), 6) AS iou FROM w WHERE i > 0""",
    "ranking_pool": f"WITH {_VEC} SELECT query_id, item_id FROM r WHERE rank <= 5",
    "served_estimates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'its' ELSE 'synth' END AS method, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice / 2 END, 4) AS effect, CASE WHEN o_orderkey % 3 = 0 THEN 'poor fit' END AS fallback_reason FROM orders",
    "spike_days": """WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, avg(ln(1 + n)) OVER w AS m, stddev_pop(ln(1 + n)) OVER w AS sd, avg(n) OVER w AS a, count(*) OVER w AS k FROM c WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
      SELECT event_type, day, CASE WHEN k < 7 THEN false ELSE ln(1 + n) > m + greatest(sd, 1 / sqrt(1 + a)) END AS spike FROM t""",
    "weekly_drift": """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS k FROM events), b AS (SELECT k, count(*) / sum(count(*)) OVER () AS s FROM e GROUP BY 1), w AS (SELECT CAST(date_trunc('week', day) AS DATE) AS wk, k, count(*) AS n FROM e GROUP BY 1, 2),
      f AS (SELECT * FROM w WHERE wk >= (SELECT min(day) FROM e) AND wk + 6 <= (SELECT max(day) FROM e)), g AS (SELECT wk, k, n / sum(n) OVER (PARTITION BY wk) AS s FROM f)
      SELECT 'psi_event_type' AS metric, wk AS window_start, round(sum((g.s - b.s) * ln(g.s / b.s)), 6) AS value FROM g JOIN b ON g.k = b.k GROUP BY wk""",
    "promoted_thresholds": "SELECT event_type AS metric, CASE WHEN event_type <> 'click' THEN avg(value) > quantile_cont(value, 0.5) END AS breached FROM events GROUP BY 1",
}
