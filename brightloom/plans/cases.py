"""Queries of reports: the core evidence of bundles of orders, its trace, and the hypotheses over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import evidence
from .analysis import SQL as ANALYSIS_SQL
from .analysis import anchored_bundles
from .tables import read


def _case(s: SparkSession, d: str) -> tuple[DataFrame, evidence.Sources]:
    """Scopes of the bundles of urgent orders, of which some have no bundle to cite, and sources made of all orders."""
    day = F.col("o_orderdate").cast("date")
    o = read(s, d, "orders").select(F.col("o_orderstatus").alias("entity"), day.alias("day"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    good = F.col("price") > 150_000
    cells = o.groupBy("entity", "day", F.least(F.floor(F.col("price") / 100_000), F.lit(3)).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if(good).alias("positives"), F.count_if(F.col("priority") == "1-URGENT").alias("new"), F.count_if(~good).alias("scored"), F.count_if(~good & (F.col("priority") == "5-LOW")).alias("off_topic")
    )
    spans = o.groupBy("entity").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("entity", F.explode(F.sequence(F.date_add("a", -40), F.date_add("b", 40))).alias("day"))
    prices = spans.select("entity", "day", (F.dayofmonth("day") <= 3).alias("sale"), F.when(F.year("day") >= 1996, F.dayofmonth("day") % 9 == 0).alias("discount"))
    bundles = anchored_bundles(s, d)
    place = F.datediff("start", F.lit("1995-01-01").cast("date"))
    effect = F.when(F.col("n") % 3 != 0, (place % 21 - 10) / 2)
    estimates = bundles.select(
        "bundle_id", F.lit(7).alias("horizon"), effect.alias("effect"), (effect - 1.5).alias("lo90"), (effect + 1.5).alias("hi90"), F.when(place % 4 == 0, "synth").otherwise("its").alias("method"),
        F.when(place % 8 == 0, 0.05).otherwise(0.4).alias("p_value"), F.lit("positive_share").alias("outcome"), F.lit("all").alias("sample"), F.when(place % 5 == 0, F.array(F.lit("volume_spike"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )
    scopes = bundles.select(F.col("bundle_id").alias("scope_id"), "entity", "start", F.lit(7).alias("horizon"), F.when(place % 7 != 0, F.col("bundle_id")).alias("bundle_id"))
    return scopes, evidence.Sources(cells, prices, estimates, ranges=False)


def core_evidence(s: SparkSession, d: str) -> DataFrame:
    """What the hypotheses read of every bundle, and what they say."""
    scopes, sources = _case(s, d)
    out = evidence.core_evidence(evidence.traced(scopes, sources), scopes, sources)
    said = [F.concat_ws("/", h.status, h.rule).alias(k) for k, h in rules.hypotheses().items()]
    return out.select(
        "scope_id", "effect", "has_estimate", "window_share", "baseline_share", "window_reviews", "baseline_reviews", "sale_days", "discount_days", "price_unknown_days", "new_players_change", "new_players_lo90",
        "off_topic_change", "off_topic_lo90", "off_topic_hi90", "composition", "total_change", *said,
    )


def trace_again(s: SparkSession, d: str) -> DataFrame:
    """Calls of the trace by tool, and those whose answer changed after the urgent orders of a year were taken from the cells.
    Tools of one call a scope are listed without any call too: where all bundles start on days without an estimate, none asks for one."""
    scopes, sources = _case(s, d)
    trace = evidence.traced(scopes, sources)
    less = sources.cells.withColumn("n", F.when(F.year("day") == 1997, F.col("n") - F.col("new")).otherwise(F.col("n")))
    changed = evidence.again(trace, evidence.Sources(less, sources.prices, sources.estimates, ranges=False))
    listed = s.range(1).select(F.explode(F.array(*map(F.lit, ("overview", "aspects", "estimate")))).alias("tool"), F.lit(None).cast("boolean").alias("same"))
    return changed.select("tool", "same").unionByName(listed).groupBy("tool").agg(F.count("same").alias("calls"), F.count_if(~F.col("same")).alias("changed"))


QUERIES = {f.__name__: f for f in (core_evidence, trace_again)}


def _wilson(x: str, n: str, sign: str) -> str:
    return f"({x} / {n} + z2 / (2 * {n}) {sign} z * sqrt({x} / {n} * (1 - {x} / {n}) / {n} + z2 / (4 * {n} * {n}))) / (1 + z2 / {n})"


def _newcombe(x1: str, n1: str, x0: str, n0: str, sign: str) -> str:
    other = "-" if sign == "+" else "+"
    p1, p0 = f"{x1} / {n1}", f"{x0} / {n0}"
    a, b = _wilson(x1, n1, sign), _wilson(x0, n0, other)
    a = f"least(1.0, {a})" if sign == "+" else f"greatest(0.0, {a})"
    b = f"least(1.0, {b})" if other == "+" else f"greatest(0.0, {b})"
    return f"CASE WHEN {n1} > 0 AND {n0} > 0 THEN round(100 * (({p1}) - ({p0}) {sign} sqrt(pow(({a}) - ({p1}), 2) + pow(({b}) - ({p0}), 2))), 2) END"


_BASE = f"""g AS (SELECT entity, start, n, bundle_id, start - DATE '1995-01-01' AS place FROM ({ANALYSIS_SQL["anchored_bundles"]}) a),
  o AS (SELECT o_orderstatus AS entity, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price, o_orderpriority AS priority FROM orders),
  p AS (SELECT bundle_id, k.k AS period, least(floor(price / 100000), 3) AS bucket, price > 150000 AS good, priority = '1-URGENT' AS fresh, priority = '5-LOW' AS low, day FROM g JOIN o USING (entity), (VALUES ('w'), ('b'), ('n')) k(k)
    WHERE day BETWEEN start - CASE k.k WHEN 'w' THEN 0 WHEN 'b' THEN 28 ELSE 3 END AND start + CASE k.k WHEN 'w' THEN 6 WHEN 'b' THEN -1 ELSE 3 END)"""

SQL = {
    "core_evidence": f"""WITH z AS (SELECT 1.6449::DOUBLE AS z, 1.6449::DOUBLE * 1.6449::DOUBLE AS z2), {_BASE},
      t AS (SELECT bundle_id, count(*) FILTER (period = 'w') AS nw, count(*) FILTER (period = 'b') AS nb, count(*) FILTER (period = 'w' AND good) AS xw, count(*) FILTER (period = 'b' AND good) AS xb, count(*) FILTER (period = 'w' AND fresh) AS fw, count(*) FILTER (period = 'b' AND fresh) AS fb,
        count(*) FILTER (period = 'w' AND NOT good) AS sw, count(*) FILTER (period = 'b' AND NOT good) AS sb, count(*) FILTER (period = 'w' AND NOT good AND low) AS ow, count(*) FILTER (period = 'b' AND NOT good AND low) AS ob FROM p GROUP BY 1),
      c AS (SELECT bundle_id, bucket, count(*) FILTER (period = 'b' AND good) AS p0, count(*) FILTER (period = 'b') AS n0, count(*) FILTER (period = 'w' AND good) AS p1, count(*) FILTER (period = 'w') AS n1 FROM p WHERE period <> 'n' GROUP BY 1, 2),
      q AS (SELECT bundle_id, n0 / sum(n0) OVER v AS w0, n1 / sum(n1) OVER v AS w1, CASE WHEN n0 > 0 THEN p0 / n0 WHEN n1 > 0 THEN p1 / n1 ELSE 0 END AS s0, CASE WHEN n1 > 0 THEN p1 / n1 WHEN n0 > 0 THEN p0 / n0 ELSE 0 END AS s1, sum(n0) OVER v > 0 AND sum(n1) OVER v > 0 AS ok FROM c WINDOW v AS (PARTITION BY bundle_id)),
      s AS (SELECT bundle_id, round(100 * sum((w1 - w0) * s0), 4) + 0.0 AS composition, round(100 * sum((w1 - w0) * s0) + 100 * sum(w0 * (s1 - s0)) + 100 * sum((w1 - w0) * (s1 - s0)), 4) + 0.0 AS total FROM q WHERE ok GROUP BY 1),
      r AS (SELECT bundle_id, count(*) FILTER (day(x.d) <= 3) AS sale_days, count(*) FILTER (year(x.d) >= 1996 AND day(x.d) % 9 = 0) AS discount_days, count(*) FILTER (year(x.d) < 1996) AS unknown FROM (SELECT bundle_id, unnest(generate_series(start - 3, start + 3, INTERVAL 1 DAY)) AS d FROM g) x GROUP BY 1),
      e AS (SELECT g.bundle_id, place % 7 <> 0 AS has, CASE WHEN place % 7 <> 0 AND n % 3 <> 0 THEN (place % 21 - 10) / 2.0 END AS effect, place FROM g),
      a AS (SELECT e.bundle_id, e.effect, e.has, e.place, CASE WHEN nw > 0 THEN round(100.0 * xw / nw, 2) END AS window_share, CASE WHEN nb > 0 THEN round(100.0 * xb / nb, 2) END AS baseline_share, coalesce(nw, 0) AS nw, coalesce(nb, 0) AS nb, sale_days, discount_days, unknown,
        CASE WHEN nw > 0 AND nb > 0 THEN round(100 * (fw / nw - fb / nb), 2) END AS nc, {_newcombe("fw", "nw", "fb", "nb", "-")} AS nl, CASE WHEN sw > 0 AND sb > 0 THEN round(100 * (ow / sw - ob / sb), 2) END AS oc, {_newcombe("ow", "sw", "ob", "sb", "-")} AS ol, {_newcombe("ow", "sw", "ob", "sb", "+")} AS oh, composition, total
        FROM e LEFT JOIN t USING (bundle_id) LEFT JOIN r USING (bundle_id) LEFT JOIN s USING (bundle_id), z),
      f AS (SELECT *, effect - 1.5 AS lo, effect + 1.5 AS hi, CASE WHEN has THEN place % 5 = 0 END AS spike, CASE WHEN ol IS NOT NULL THEN ol > 0 END AS risen, sale_days > 0 OR discount_days > 0 AS sold, coalesce(nc >= 5 AND nl > 0, false) AS up FROM a),
      h AS (SELECT *, CASE WHEN spike AND risen THEN 'supported/H3.spike_and_off_topic' WHEN NOT spike AND NOT risen THEN 'rejected/H3.neither' WHEN spike IS NULL OR risen IS NULL THEN 'inconclusive/H3.unknown' ELSE 'inconclusive/H3.one_moved' END AS h3,
        CASE WHEN sold AND up THEN 'supported/H2.sale_and_mix' WHEN NOT sold AND unknown = 0 THEN 'rejected/H2.no_sale' WHEN NOT sold THEN 'inconclusive/H2.discounts_unknown' ELSE 'inconclusive/H2.mix_steady' END AS h2,
        CASE WHEN composition IS NULL THEN 'inconclusive/H4.no_decomposition' WHEN abs(composition) < 1 THEN 'rejected/H4.composition_small' ELSE 'inconclusive/H4.otherwise' END AS h4 FROM f),
      k AS (SELECT *, CASE WHEN effect IS NULL THEN 'no_estimate' WHEN lo <= 0 AND hi >= 0 THEN 'range_includes_zero' WHEN place % 4 = 0 AND place % 8 <> 0 THEN 'placebo_failed' WHEN h3 LIKE 'supported%' THEN 'review_bomb' END AS blocked FROM h),
      m AS (SELECT *, CASE WHEN blocked = 'no_estimate' THEN 'inconclusive/H1.no_estimate' WHEN blocked IS NULL THEN 'supported/H1.gate_allows' WHEN lo >= -2 AND lo <= 0 AND hi >= 0 AND hi <= 2 THEN 'rejected/H1.null_band' WHEN lo <= 0 AND hi >= 0 THEN 'inconclusive/H1.wide_range' ELSE 'inconclusive/H1.blocked.' || blocked END AS h1 FROM k)
      SELECT bundle_id AS scope_id, effect, has AS has_estimate, window_share, baseline_share, nw AS window_reviews, nb AS baseline_reviews, sale_days, discount_days, unknown AS price_unknown_days, nc AS new_players_change, nl AS new_players_lo90, oc AS off_topic_change, ol AS off_topic_lo90, oh AS off_topic_hi90,
        composition, total AS total_change, h1 AS H1, h2 AS H2, h3 AS H3, h4 AS H4, CASE WHEN effect IS NOT NULL AND NOT (lo <= 0 AND hi >= 0) THEN 'rejected/H5.change_established' ELSE 'inconclusive/H5.unknown' END AS H5 FROM m""",
    "trace_again": f"""WITH {_BASE}, w AS (SELECT bundle_id, entity, start FROM g), y AS (SELECT DISTINCT entity, day FROM o WHERE year(day) = 1997 AND priority = '1-URGENT'),
      c AS (SELECT bundle_id, entity, 'timeseries' AS tool, start AS a, start + 6 AS b FROM w UNION ALL SELECT bundle_id, entity, 'timeseries', start - 28, start - 1 FROM w UNION ALL SELECT bundle_id, entity, 'timeseries', start - 3, start + 3 FROM w UNION ALL SELECT bundle_id, entity, 'decomposition', start - 28, start + 6 FROM w),
      u AS (SELECT DISTINCT tool, entity, a, b FROM c), v AS (SELECT tool, entity, a, b, (SELECT count(*) > 0 FROM y WHERE y.entity = u.entity AND y.day BETWEEN a AND b) AS other FROM u)
      SELECT tool, count(*) AS calls, count(*) FILTER (other) AS changed FROM v GROUP BY 1
      UNION ALL SELECT 'overview', count(*), count(*) FILTER (other) FROM (SELECT entity, bool_or(year(day) = 1997 AND priority = '1-URGENT') AS other FROM o WHERE entity IN (SELECT entity FROM w) GROUP BY 1)
      UNION ALL SELECT 'aspects', count(DISTINCT (entity, start)), 0 FROM w UNION ALL SELECT 'estimate', count(*), 0 FROM g WHERE place % 7 <> 0""",
}
