"""Queries of series, statistics, rankings, effects and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import rules
from ..operators import estimators, intervals, joins, measures, retrieval, sampling, series, text_model
from .tables import GUESS_SQL, REVIEWS_SQL, guess, read, reviews


def _orders_daily(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("entity"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 150000).alias("x"))


_DAILY = "c AS (SELECT o_orderstatus AS entity, CAST(o_orderdate AS DATE) AS day, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS x FROM orders GROUP BY 1, 2)"
_DENSE = f"""{_DAILY}, ends AS (SELECT entity, min(day) a, max(day) b FROM c GROUP BY 1), spine AS (SELECT entity, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ends),
dense AS (SELECT s.entity, s.day, coalesce(n, 0) AS n, coalesce(x, 0) AS x FROM spine s LEFT JOIN c ON s.entity = c.entity AND s.day = c.day)"""


def _dense(s: SparkSession, d: str) -> DataFrame:
    return series.dense(_orders_daily(s, d), ["entity"], "day", ["n", "x"])


def anchored_bundles(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 400000")
    events = o.select(F.col("o_orderstatus").alias("entity"), F.col("o_orderdate").cast("date").alias("day"), F.format_string("%010d", "o_orderkey").alias("event"))
    return series.anchored_bundles(events, "entity", "day", "event").select("entity", "start", F.size("event_ids").alias("n"), "bundle_id", "allow_long")


def sale_islands(s: SparkSession, d: str) -> DataFrame:
    days = _orders_daily(s, d).where("n >= 2").select("entity", "day")
    return series.islands(days, ["entity"], "day")


def rolling_share(s: SparkSession, d: str) -> DataFrame:
    return series.rolling_share(_dense(s, d), ["entity"], "day", "x", "n").select("entity", "day", F.round("rolling_share", 6).alias("rolling_share"))


def volume_anomaly(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return series.anomalies(e, ["user_id"], "day", "n", 28, 7, 2.0).select("user_id", "day", F.round("z", 5).alias("z"))


def trailing_stats(s: SparkSession, d: str) -> DataFrame:
    t = series.trailing(_dense(s, d), ["entity"], "day", "n")
    return t.select("entity", "day", F.round("trail_mean", 6).alias("m"), F.round("trail_sd", 6).alias("sd"), F.col("trail_n").alias("k"))


def binned_series(s: SparkSession, d: str) -> DataFrame:
    return series.binned(_dense(s, d), ["entity"], "day", F.lit("1997-01-01").cast("date"), 3, ["n", "x"])


def volume_gates(s: SparkSession, d: str) -> DataFrame:
    return series.volume_gates(_dense(s, d), ["entity"], "n", 2, 3.0)


def week_totals(s: SparkSession, d: str) -> DataFrame:
    return series.weeks_from(_dense(s, d), ["entity"], "day", F.lit("1996-05-03").cast("date"), ["n", "x"])


def quiet_windows(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders")
    events = o.where("o_totalprice > 480000").select(F.col("o_orderstatus").alias("entity"), F.col("o_orderdate").cast("date").alias("day"))
    busy = s.createDataFrame([("1997-06-20",), ("1998-12-24",)], "day string").select(F.col("day").cast("date"))
    return series.quiet_windows(_dense(s, d), events, busy, ["entity"], "day", 14, 7, 7)


def event_markers(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").where("o_totalprice > 350000").select(
        F.col("o_orderstatus").alias("entity"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderpriority") == "1-URGENT").alias("treatment"), "o_orderpriority"
    )
    return series.markers(o, ["entity"], "day", "treatment", "o_orderpriority").select("entity", "day", "treatment", F.array_join("titles", ",").alias("titles"))


def donor_eligibility(s: SparkSession, d: str) -> DataFrame:
    """Event types as donors of each other around days of the month."""
    e = read(s, d, "events").select(F.col("event_type").alias("entity"), F.col("ts").cast("date").alias("day"))
    daily = series.dense(e.groupBy("entity", "day").agg(F.count("*").alias("n")), ["entity"], "day", ["n"])
    bundles = e.select("entity").distinct().select(F.concat("entity", F.lit("-1")).alias("bundle_id"), "entity", F.lit("all").alias("group"), F.lit("2024-01-15").cast("date").alias("start"))
    candidates = e.select("entity", F.lit("all").alias("group")).distinct()
    marks = e.where("entity = 'click' and day = date'2024-01-10'").distinct()
    return series.clean_donors(bundles, candidates, marks, daily, "entity", "group", "day", "n", 7, 7, 20.0)


def decompose_parts(s: SparkSession, d: str) -> DataFrame:
    r = reviews(s, d).withColumn("late", F.year("version") >= 1998)
    by = r.groupBy("entity", c.bucket_of_minutes("minutes").alias("bucket")).agg(
        F.count_if(~F.col("late") & (F.col("run_id") <= 3)).alias("p0"), F.count_if(~F.col("late")).alias("n0"), F.count_if(F.col("late") & (F.col("run_id") <= 3)).alias("p1"), F.count_if("late").alias("n1")
    )
    out = measures.decomposition(by, ["entity"])
    return out.select("entity", *[F.round(x, 6).alias(x) for x in ("composition", "within", "interaction", "total")])


def newcombe_change(s: SparkSession, d: str) -> DataFrame:
    g = guess(s, d).groupBy("lang").agg(F.count_if(F.col("truth") & F.col("toxic")).alias("x1"), F.count_if("toxic").alias("n1"), F.count_if(F.col("truth") & ~F.col("toxic")).alias("x0"), F.count_if(~F.col("toxic")).alias("n0"))
    lo, hi = c.newcombe("x1", "n1", "x0", "n0")
    return g.select("lang", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def psi_language(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents")
    kind = measures.top_or_other("lang", ["en", "fr"])
    a = measures.shares(docs.where("doc_id % 2 = 0"), [], kind)
    b = measures.shares(docs.where("doc_id % 2 = 1 and lang <> 'fr'"), [], kind)
    return measures.psi(a, b, []).select(F.round("psi", 6).alias("psi"))


def psi_length(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents")
    kind = measures.length_bin(F.length("text"), [2.0, 2.5, 3.0, 3.5, 4.0])
    a, b = (measures.shares(docs.where(f"doc_id % 2 = {k}"), [], kind) for k in (0, 1))
    return measures.psi(a, b, []).select(F.round("psi", 6).alias("psi"))


def prf(s: SparkSession, d: str) -> DataFrame:
    out = measures.confusion(guess(s, d), ["lang"], "truth", "predicted")
    return out.select("lang", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")], "empty")


def f1_summary(s: SparkSession, d: str) -> DataFrame:
    out = measures.f1_summary(measures.confusion(guess(s, d), ["lang"], "truth", "predicted"))
    return out.select(*[F.round(x, 6).alias(x) for x in ("macro_f1", "assessable_f1", "micro_f1")])


def kappa(s: SparkSession, d: str) -> DataFrame:
    return measures.kappa(guess(s, d), ["lang"], "truth", "predicted").select("lang", "n", F.round("kappa", 6).alias("kappa"))


def weighted_kappa(s: SparkSession, d: str) -> DataFrame:
    l = read(s, d, "labels").select((F.col("quality") + F.col("toxic")).alias("a"), ((F.col("doc_id") + F.col("quality")) % 3).cast("int").alias("b"))
    return measures.weighted_kappa(l, "a", "b", 3).select("n", F.round("kappa", 6).alias("kappa"))


def calibration(s: SparkSession, d: str) -> DataFrame:
    return measures.calibration(guess(s, d), ["lang"], "truth", "p").select("lang", F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


def best_cut(s: SparkSession, d: str) -> DataFrame:
    return measures.best_cut(guess(s, d), ["lang"], "truth", "p").select("lang", F.round("cut", 6).alias("cut"))


def uncertain_share(s: SparkSession, d: str) -> DataFrame:
    g = guess(s, d).withColumn("cut", F.lit(0.5))
    return measures.uncertain_share(g, "p", "cut").select(F.round("uncertain", 6).alias("uncertain"))


def prevalence_pivot(s: SparkSession, d: str) -> DataFrame:
    g = guess(s, d).where("truth").withColumn("code", F.when(F.col("toxic"), "toxic").otherwise("clean"))
    return measures.prevalence(g, "code", "lang", ["en", "fr", "de"])


def class_weights(s: SparkSession, d: str) -> DataFrame:
    return measures.class_weights(guess(s, d), ["lang"], "toxic").select("lang", "positives", "negatives", F.round("weight", 6).alias("weight"))


def percentile_thresholds(s: SparkSession, d: str) -> DataFrame:
    return measures.percentile_thresholds(read(s, d, "events"), ["event_type"], "value", 0.99).select("event_type", F.round("threshold", 6).alias("threshold"))


def latencies(s: SparkSession, d: str) -> DataFrame:
    out = measures.latencies(read(s, d, "events"), ["event_type"], "user_id", "value")
    return out.select("event_type", *[F.round(x, 6).alias(x) for x in ("p50", "p95", "p95_fastest")])


def repeated_calls(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").withColumn("day", F.col("ts").cast("date"))
    return measures.repeated_calls(e, ["day"], "event_type", "user_id", "event_id")


def pooled_rate(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("rate"), F.count("*").alias("n"))
    return measures.pooled_rate(e, "day", "rate", "n").select(F.round("rate", 6).alias("rate"))


def top_code(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    e = e.withColumn("place", F.ascii(F.substring("event_type", 1, 1)) * 1000 + F.ascii(F.substring("event_type", 2, 1)))
    return measures.top_code(e, ["user_id"], "event_type", "n", "place")


def trial_metrics(s: SparkSession, d: str) -> DataFrame:
    l = read(s, d, "lineitem")
    t = l.select("l_returnflag", (F.col("l_discount") * 100).alias("estimate"), F.when(F.col("l_linenumber") == 1, 0.0).otherwise(5.0).alias("truth"), (F.col("l_discount") * 100 - 3).alias("lo"), F.when(F.col("l_tax") < 0.07, F.col("l_discount") * 100 + 3).alias("hi"))
    out = measures.trial_metrics(t, ["l_returnflag"])
    return out.select("l_returnflag", "trials", *[F.round(x, 5).alias(x) for x in ("bias", "rmse", "coverage", "false_alarms", "power")])


def _queries(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = read(s, d, "embeddings")
    return v.select(F.col("vec_id").alias("item_id"), "embedding"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_search(*_queries(s, d), "item_id", "query_id", "embedding", 10, 6)


def lsh_recall(s: SparkSession, d: str) -> DataFrame:
    """Share of the exact neighbours that random projections find."""
    items, asked = _queries(s, d)
    exact = retrieval.dense_search(items, asked, "item_id", "query_id", "embedding", 10).select("query_id", "item_id")
    near = retrieval.lsh_search(items, asked, "item_id", "query_id", "embedding", 10).select("query_id", "item_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "item_id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def _texts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read(s, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    b = read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return docs, b


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    docs, b = _texts(s, d)
    return retrieval.bm25_search(docs, b, "item_id", "text", "query_id", "query", 5, digits=5)


def hybrid_rrf(s: SparkSession, d: str) -> DataFrame:
    """Rankings of benchmark questions by their words and by the vector of their number, fused."""
    docs, b = _texts(s, d)
    v = read(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    asked = v.withColumnRenamed("item_id", "query_id").join(b.select("query_id"), "query_id", "left_semi")
    dense = retrieval.dense_search(v, asked, "item_id", "query_id", "embedding", 50, 6)
    sparse = retrieval.bm25_search(docs, b, "item_id", "text", "query_id", "query", 50, digits=5)
    return retrieval.fused(dense, sparse, "query_id", "item_id", 10).withColumn("score", F.round("score", 9))


def ranking_metrics(s: SparkSession, d: str) -> DataFrame:
    items, asked = _queries(s, d)
    v = read(s, d, "embeddings")
    run = retrieval.dense_search(items, asked, "item_id", "query_id", "embedding", 20, 6)
    grades = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("l")).join(v.select(F.col("vec_id").alias("item_id"), F.col("label").alias("l")), "l")
    grades = grades.select("query_id", "item_id", F.when(F.col("item_id") % 2 == 0, 2).otherwise(1).alias("grade"))
    out = measures.ranking_metrics(run, grades, 10)
    return out.select("query_id", *[F.round(x, 6).alias(x) for x in ("ndcg", "mrr", "recall")])


def shingle_leak(s: SparkSession, d: str) -> DataFrame:
    docs, b = _texts(s, d)
    return retrieval.leaked(docs, b.withColumnRenamed("query", "text"), "item_id", "query_id", "text")


def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").select("doc_id", "lang")
    sizes = sampling.stratum_sizes(docs, "lang")
    return sampling.stratified(docs, "lang", "doc_id", sampling.proportional_allocation(100, sizes), 11)


def _shipments(s: SparkSession, d: str, start: int, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Units, one for each line number and kind of outcome, and their own series with those of their clean donors. A
    day of these series is a week of the table, so that days have rows enough at any scale."""
    week = F.date_add(F.lit("1990-01-01").cast("date"), F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date")) / 7).cast("int"))
    e = read(s, d, "lineitem").groupBy(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("name"), week.alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("x"))
    daily = series.dense(e, ["name"], "day", ["n", "x"])
    begin = F.date_add(F.lit("1990-01-01").cast("date"), start)
    bundles = daily.select("name").distinct().select(F.col("name").alias("bundle_id"), "name", F.lit("ship").alias("group"), begin.alias("start"))
    none = daily.limit(0).select("name", "day")
    chosen = series.clean_donors(bundles, bundles.select("name", "group"), none, daily, "name", "group", "day", "n", pre=estimators.PRE_DAYS, post=horizon, median=10.0)
    arrays = estimators.series_arrays(daily, "name", "day", "x", "n")
    counts = ["first", "positives", "totals", "observed"]
    own = arrays.select(F.col("name").alias("bundle_id"), "name", F.lit(True).alias("treated"), *counts)
    donors = chosen.select("bundle_id", F.col("donor").alias("name")).join(arrays, "name").select("bundle_id", "name", F.lit(False).alias("treated"), *counts)
    kinds = F.explode(F.array(F.lit("share"), F.lit("volume"))).alias("kind")
    units = bundles.select(F.col("bundle_id"), F.datediff("start", F.lit("1970-01-01").cast("date")).alias("start"), F.lit(horizon).alias("horizon"), kinds)
    unit = F.concat_ws("/", "bundle_id", "kind").alias("unit")
    members = own.unionByName(donors).join(units.select("bundle_id", "kind"), "bundle_id").select(unit, "name", "treated", *counts)
    return units.select(unit, "start", "horizon", "kind", F.array().cast("array<int>").alias("earlier")), members


def its_effects(s: SparkSession, d: str) -> DataFrame:
    """Steps at a date, beside an earlier event and with a critical value from quiet dates of the past."""
    units, members = _shipments(s, d, 300, 14)
    own = members.where("treated").drop("name", "treated")
    day = F.col("start")
    return estimators.its_effects(units.drop("earlier").join(own, "unit").withColumns({"earlier": F.array(day - 30), "busy": F.array(day - 100, day - 30)}))


def synth_effects(s: SparkSession, d: str) -> DataFrame:
    """Effects by clean donors with placebo fits and fit checks, and their ranges."""
    units, members = _shipments(s, d, 300, 14)
    units = units.drop("earlier")
    fits = estimators.synth_effects(units, members, interval=False).drop("lo90", "hi90", "reason")
    return fits.join(intervals.conformal_intervals(units, members).select("unit", "lo90", "hi90", "reason"), "unit")


def conformal_ranges(s: SparkSession, d: str) -> DataFrame:
    """Ranges of effects at a date without any, by cyclic shifts."""
    units, members = _shipments(s, d, 300, 14)
    return intervals.conformal_intervals(units.drop("earlier"), members)


def trial_cells(s: SparkSession, d: str) -> DataFrame:
    """Both methods on planted effects: coverage, false alarms, power and error of each cell."""
    units, members = _shipments(s, d, 300, 14)
    found = [intervals.paired_trials(units.where(F.col("kind") == k).drop("kind"), members, {k: v}, ["step", "ramp"], 1, 7) for k, v in (("share", [0.0, -10.0]), ("volume", [0.0, -30.0]))]
    out = intervals.trial_report(found[0].unionByName(found[1]))
    return out.select("kind", "shape", "planted", "method", "trials", "estimated", "fallbacks", *[F.round(c, 6).alias(c) for c in ("coverage", "false_alarms", "power", "rmse")])


def ratio_intervals(s: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the guess for each language, and their difference, over clusters of ten documents."""
    hit = F.col("truth") & F.col("predicted")
    rows = guess(s, d).select("lang", F.floor(F.col("doc_id") / 10).alias("cluster"), *[F.when(c, 1).otherwise(0).alias(n) for n, c in (("hit", hit), ("said", F.col("predicted")), ("true", F.col("truth")))])
    out = intervals.bootstrap_ratios(rows, ["lang"], "cluster", {"precision": ("hit", "said"), "recall": ("hit", "true")}, [("precision", "recall")], samples=200)
    return out.select("lang", "name", "clusters", *[F.round(c, 9).alias(c) for c in ("value", "lo", "hi")])


def decomposition_ranges(s: SparkSession, d: str) -> DataFrame:
    """Ranges of the shift-share parts of each priority's orders by size, from the first half to the second."""
    o = read(s, d, "orders").withColumn("late", F.col("o_orderdate").cast("date") >= F.lit("1998-06-01").cast("date"))
    won = F.col("o_orderstatus") == "F"
    cells = o.groupBy("o_orderpriority", F.least(F.floor(F.col("o_totalprice") / 100_000), F.lit(3)).alias("size")).agg(
        F.count_if(~F.col("late") & won).alias("p0"), F.count_if(~F.col("late")).alias("n0"), F.count_if(F.col("late") & won).alias("p1"), F.count_if("late").alias("n1")
    )
    return intervals.decomposition_intervals(cells, ["o_orderpriority"], "size", resamples=500)


def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    g = guess(s, d).withColumn("right", (F.col("truth") == F.col("predicted")).cast("double"))
    return estimators.bootstrap_means(g, "lang", "right", 400)


def gram_weights(s: SparkSession, d: str) -> DataFrame:
    """For each document and kind of gram: grams, different ones, and the length of the vector of their weights."""
    return text_model.gram_weights(read(s, d, "documents"), "doc_id", "text")


def score_texts(s: SparkSession, d: str) -> DataFrame:
    """Every document scored for two labels by models of the labelled ones with an even id."""
    docs = read(s, d, "documents").select("doc_id", c.clean_text("text", 1 << 30).alias("text"))
    known = read(s, d, "labels").where("doc_id % 2 = 0").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    model = text_model.trained(docs.join(known, "doc_id"), ["good", "toxic"])
    return text_model.scored(docs, model, {"good": 0.5, "toxic": 0.5}).drop("text")


def gate_decisions(s: SparkSession, d: str) -> DataFrame:
    """Gate over rows made of line items."""
    l = read(s, d, "lineitem")
    rows = l.select(
        (F.col("l_discount") * 100 - 5).alias("effect"), (F.col("l_discount") * 100 - 7).alias("lo90"), F.when(F.col("l_tax") < 0.08, F.col("l_discount") * 100 - 3).alias("hi90"),
        F.when(F.col("l_linestatus") == "O", "synth").otherwise("its").alias("method"), F.col("l_tax").alias("p_value"),
        F.when(F.col("l_returnflag") == "A", "volume").otherwise("positive_share").alias("outcome"), F.lit("all").alias("sample"),
        F.when(F.col("l_quantity") > 40, F.array(F.lit("confounded"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )
    return rows.groupBy(F.coalesce(rules.gate_blocker(), F.lit("allowed")).alias("gate")).agg(F.count("*").alias("n"))


def paired_difference(s: SparkSession, d: str) -> DataFrame:
    l = read(s, d, "labels")
    a = l.where("quality = 1").select("doc_id", F.col("toxic").alias("v"))
    b = l.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("quality")).alias("v"))
    return joins.paired(a, b, ["doc_id"], "v")


QUERIES = {f.__name__: f for f in (
    anchored_bundles, sale_islands, rolling_share, volume_anomaly, trailing_stats, binned_series, volume_gates, week_totals, quiet_windows, event_markers,
    donor_eligibility, decompose_parts, newcombe_change, psi_language, psi_length, prf, f1_summary, kappa, weighted_kappa, calibration, best_cut, uncertain_share,
    prevalence_pivot, class_weights, percentile_thresholds, latencies, repeated_calls, pooled_rate, top_code, trial_metrics, dense_topk, lsh_recall, bm25_topk,
    hybrid_rrf, ranking_metrics, shingle_leak, stratified_sample, its_effects, synth_effects, bootstrap_ci, gate_decisions, paired_difference, gram_weights, score_texts, conformal_ranges, trial_cells, ratio_intervals,
    decomposition_ranges,
)}

_VEC = "v AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score, a.label AS la, b.label AS lb FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM v)"
_TOKENS = r"string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"

_BM25 = f"""d AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents), q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark), tf AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d),
      i AS (SELECT doc_id, dl, term, count(*) AS tf FROM tf WHERE term <> '' GROUP BY 1, 2, 3), f0 AS (SELECT term, count(*) AS df FROM i GROUP BY 1), a AS (SELECT count(*) AS n, avg(len(w)) AS avg_dl FROM d),
      s AS (SELECT query_id, doc_id AS item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 5) AS score FROM i JOIN q ON i.term = q.term JOIN f0 ON i.term = f0.term, a GROUP BY 1, 2),
      bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)"""


def _wilson(x: str, n: str, sign: str) -> str:
    return f"(({x} / {n} + z * z / (2 * {n}) {sign} z * sqrt({x} / {n} * (1 - {x} / {n}) / {n} + z * z / (4 * {n} * {n}))) / (1 + z * z / {n}))"


_STEPS = "[" + ", ".join(repr(x) for x in intervals.poisson_steps()) + "]"
SQL = {
    "ratio_intervals": f"""WITH {GUESS_SQL}, k AS (SELECT lang, doc_id // 10 AS cluster, count(*) FILTER (truth AND predicted) AS hit, count(*) FILTER (predicted) AS said, count(*) FILTER (truth) AS yes FROM guess GROUP BY 1, 2),
      w AS (SELECT k.*, b.b * 4 + j.j AS replicate, len(list_filter({_STEPS}, lambda x: x <= ('0x' || substr(md5('20261021:' || cluster || ':' || b.b), CAST(8 * j.j + 1 AS INT), 8))::BIGINT / 4294967296.0)) AS w
        FROM k, (SELECT unnest(range(0, 50)) AS b) b, (SELECT unnest(range(0, 4)) AS j) j),
      r AS (SELECT lang, replicate, sum(w * hit) AS hit, sum(w * said) AS said, sum(w * yes) AS yes FROM w GROUP BY 1, 2),
      a AS (SELECT lang, 'r' AS kind, hit, said, yes FROM r UNION ALL SELECT lang, 'p', sum(hit), sum(said), sum(yes) FROM k GROUP BY 1),
      v AS (SELECT lang, kind, n.name, CASE n.name WHEN 'precision' THEN hit / nullif(said, 0) WHEN 'recall' THEN hit / nullif(yes, 0) ELSE hit / nullif(said, 0) - hit / nullif(yes, 0) END AS value FROM a, (VALUES ('precision'), ('recall'), ('precision - recall')) n(name)),
      c AS (SELECT lang, count(*) AS clusters FROM k GROUP BY 1)
      SELECT lang, name, any_value(clusters) AS clusters, round(max(value) FILTER (kind = 'p'), 9) AS value, round(quantile_cont(value, 0.025) FILTER (kind = 'r'), 9) AS lo, round(quantile_cont(value, 0.975) FILTER (kind = 'r'), 9) AS hi FROM v JOIN c USING (lang) GROUP BY 1, 2""",
    "gram_weights": r"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) AS w, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS t FROM documents),
      c AS (SELECT doc_id, ' ' || unnest(t) || ' ' AS x FROM w),
      g AS (SELECT doc_id, 'words' AS kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM w
        UNION ALL SELECT doc_id, 'chars', substr(x, i.i, n.n) FROM c, (SELECT unnest([3, 4, 5]) AS n) n, LATERAL (SELECT unnest(range(1, length(x) - n.n + 2)) AS i) i WHERE n.n <= length(x)),
      k AS (SELECT doc_id, kind, gram, count(*) AS tf FROM g GROUP BY 1, 2, 3), f AS (SELECT kind, gram, count(*) AS df FROM k GROUP BY 1, 2), n AS (SELECT count(*) AS docs FROM documents)
      SELECT doc_id, kind, sum(tf)::BIGINT AS grams, count(*) AS different, round(sqrt(sum(pow((1 + ln(tf)) * (ln((1 + docs) / (1 + df)) + 1), 2))), 6) AS length FROM k JOIN f USING (kind, gram), n GROUP BY 1, 2""",
    "anchored_bundles": """WITH RECURSIVE e AS (SELECT o_orderstatus AS entity, CAST(o_orderdate AS DATE) AS day, printf('%010d', o_orderkey) AS event FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000),
      b(entity, start) AS (SELECT entity, min(day) FROM e GROUP BY 1 UNION ALL SELECT b.entity, (SELECT min(day) FROM e WHERE e.entity = b.entity AND e.day >= b.start + 7) FROM b WHERE EXISTS (SELECT 1 FROM e WHERE e.entity = b.entity AND e.day >= b.start + 7)),
      g AS (SELECT b.entity, b.start, count(*) AS n, (arg_min(event, (day, event))) AS bundle_id FROM b JOIN e ON e.entity = b.entity AND e.day >= b.start AND e.day < b.start + 7 GROUP BY 1, 2)
      SELECT entity, start, CAST(n AS INT) AS n, bundle_id, coalesce(lead(start) OVER (PARTITION BY entity ORDER BY start) - start >= 14, true) AS allow_long FROM g""",
    "sale_islands": f"WITH {_DAILY}, k AS (SELECT entity, day, day - CAST(row_number() OVER (PARTITION BY entity ORDER BY day) AS INT) AS g FROM c WHERE n >= 2) SELECT entity, min(day) AS start, max(day) AS \"end\", count(*) AS days FROM k GROUP BY entity, g",
    "rolling_share": f"WITH {_DENSE} SELECT entity, day, CASE WHEN sum(n) OVER w > 0 THEN round(sum(x) OVER w / sum(n) OVER w, 6) END AS rolling_share FROM dense WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 6 PRECEDING)",
    "volume_anomaly": """WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, avg(n) OVER w AS m, stddev_samp(n) OVER w AS sd, count(n) OVER w AS k FROM c WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))
      SELECT user_id, day, round((n - m) / sd, 5) AS z FROM t WHERE k >= 7 AND sd > 0 AND abs((n - m) / sd) > 2.0""",
    "trailing_stats": f"WITH {_DENSE} SELECT entity, day, round(avg(n) OVER w, 6) AS m, round(stddev_samp(n) OVER w, 6) AS sd, count(n) OVER w AS k FROM dense WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)",
    "binned_series": f"WITH {_DENSE} SELECT entity, CAST(floor((day - DATE '1997-01-01') / 3.0) AS BIGINT) AS bin, min(day) AS start, count(*) AS size, sum(n)::BIGINT AS n, sum(x)::BIGINT AS x FROM dense GROUP BY 1, 2",
    "volume_gates": f"WITH {_DENSE} SELECT entity, min(n) < 2 AS needs_bins, quantile_cont(n, 0.5) < 3.0 AS too_thin, quantile_cont(n, 0.5)::DOUBLE AS median FROM dense GROUP BY 1",
    "week_totals": f"WITH {_DENSE} SELECT entity, CAST(floor((day - DATE '1996-05-03') / 7.0) AS BIGINT) AS week, min(day) AS start, sum(n)::BIGINT AS n, sum(x)::BIGINT AS x FROM dense GROUP BY 1, 2",
    "quiet_windows": f"""WITH {_DENSE}, e AS (SELECT DISTINCT o_orderstatus AS entity, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 480000)
      SELECT d.entity, d.day AS start FROM dense d JOIN ends USING (entity) WHERE d.day - 14 >= a AND d.day + 6 <= b
        AND NOT (DATE '1997-06-20' BETWEEN d.day - 14 AND d.day + 6) AND NOT (DATE '1998-12-24' BETWEEN d.day - 14 AND d.day + 6)
        AND NOT EXISTS (SELECT 1 FROM e WHERE e.entity = d.entity AND e.day BETWEEN d.day - 21 AND d.day + 6)""",
    "event_markers": "SELECT o_orderstatus AS entity, CAST(o_orderdate AS DATE) AS day, bool_or(o_orderpriority = '1-URGENT') AS treatment, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS titles FROM orders WHERE o_totalprice > 350000 GROUP BY 1, 2",
    "donor_eligibility": """WITH c AS (SELECT event_type AS entity, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT DISTINCT entity FROM c)
      SELECT a.entity || '-1' AS bundle_id, b.entity AS donor, quantile_cont(c.n, 0.5)::DOUBLE AS median FROM k a JOIN k b ON a.entity <> b.entity JOIN c ON c.entity = b.entity AND c.day BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'
      WHERE b.entity <> 'click' GROUP BY 1, 2 HAVING count(*) = 14 AND quantile_cont(c.n, 0.5) >= 20""",
    "decompose_parts": f"""WITH {REVIEWS_SQL}, b AS (SELECT entity, CASE WHEN minutes < 120 THEN 'a' WHEN minutes < 600 THEN 'b' WHEN minutes < 3000 THEN 'c' ELSE 'd' END AS bucket, year(version) >= 1998 AS late, run_id <= 3 AS p FROM reviews),
      g AS (SELECT entity, bucket, count(*) FILTER (NOT late AND p) AS p0, count(*) FILTER (NOT late) AS n0, count(*) FILTER (late AND p) AS p1, count(*) FILTER (late) AS n1 FROM b GROUP BY 1, 2),
      s AS (SELECT entity, n0 / sum(n0) OVER (PARTITION BY entity) AS w0, n1 / sum(n1) OVER (PARTITION BY entity) AS w1, p0 / n0 AS s0, p1 / n1 AS s1 FROM g)
      SELECT entity, round(100 * sum((w1 - w0) * s0), 6) AS composition, round(100 * sum(w0 * (s1 - s0)), 6) AS within, round(100 * sum((w1 - w0) * (s1 - s0)), 6) AS interaction, round(100 * sum((w1 - w0) * s0) + 100 * sum(w0 * (s1 - s0)) + 100 * sum((w1 - w0) * (s1 - s0)), 6) AS total FROM s GROUP BY 1""",
    "newcombe_change": f"""WITH {GUESS_SQL}, g AS (SELECT lang, count(*) FILTER (truth AND toxic) AS x1, count(*) FILTER (toxic) AS n1, count(*) FILTER (truth AND NOT toxic) AS x0, count(*) FILTER (NOT toxic) AS n0, 1.6449::DOUBLE AS z FROM guess GROUP BY 1)
      SELECT lang, round(x1 / n1 - x0 / n0 - sqrt(pow(x1 / n1 - greatest(0.0, {_wilson('x1', 'n1', '-')}), 2) + pow(least(1.0, {_wilson('x0', 'n0', '+')}) - x0 / n0, 2)), 6) AS lo,
        round(x1 / n1 - x0 / n0 + sqrt(pow(least(1.0, {_wilson('x1', 'n1', '+')}) - x1 / n1, 2) + pow(x0 / n0 - greatest(0.0, {_wilson('x0', 'n0', '-')}), 2)), 6) AS hi FROM g""",
    "psi_language": """WITH a AS (SELECT CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'other' END AS k, count(*) / sum(count(*)) OVER () AS s FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'other' END AS k, count(*) / sum(count(*)) OVER () AS s FROM documents WHERE doc_id % 2 = 1 AND lang <> 'fr' GROUP BY 1)
      SELECT round(sum((greatest(coalesce(b.s, 0), 1e-4) - greatest(coalesce(a.s, 0), 1e-4)) * ln(greatest(coalesce(b.s, 0), 1e-4) / greatest(coalesce(a.s, 0), 1e-4))), 6) AS psi FROM a FULL JOIN b ON a.k = b.k""",
    "psi_length": """WITH x AS (SELECT doc_id % 2 AS h, CAST(log10(length(text)) >= 2.0 AS INT) + CAST(log10(length(text)) >= 2.5 AS INT) + CAST(log10(length(text)) >= 3.0 AS INT) + CAST(log10(length(text)) >= 3.5 AS INT) + CAST(log10(length(text)) >= 4.0 AS INT) AS k FROM documents),
      a AS (SELECT k, count(*) / sum(count(*)) OVER () AS s FROM x WHERE h = 0 GROUP BY 1), b AS (SELECT k, count(*) / sum(count(*)) OVER () AS s FROM x WHERE h = 1 GROUP BY 1)
      SELECT round(sum((greatest(coalesce(b.s, 0), 1e-4) - greatest(coalesce(a.s, 0), 1e-4)) * ln(greatest(coalesce(b.s, 0), 1e-4) / greatest(coalesce(a.s, 0), 1e-4))), 6) AS psi FROM a FULL JOIN b ON a.k = b.k""",
    "prf": f"""WITH {GUESS_SQL}, g AS (SELECT lang, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn FROM guess GROUP BY 1)
      SELECT lang, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1, 2 * tp + fp + fn = 0 AS empty FROM g""",
    "f1_summary": f"""WITH {GUESS_SQL}, g AS (SELECT lang, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn FROM guess GROUP BY 1), h AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f1 FROM g)
      SELECT round(avg(f1), 6) AS macro_f1, round(avg(f1) FILTER (tp + fn > 0), 6) AS assessable_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM h""",
    "kappa": f"""WITH {GUESS_SQL}, g AS (SELECT lang, count(*) AS n, avg(CAST(truth = predicted AS INT)) AS o, avg(CAST(truth AS INT)) AS a, avg(CAST(predicted AS INT)) AS b FROM guess GROUP BY 1)
      SELECT lang, n, CASE WHEN a * b + (1 - a) * (1 - b) < 1 THEN round((o - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) END AS kappa FROM g""",
    "weighted_kappa": """WITH x AS (SELECT quality + toxic AS a, (doc_id + quality) % 3 AS b FROM labels), p AS (SELECT sum(pow((x.a - y.b) / 2.0, 2)) AS chance FROM x, x AS y)
      SELECT (SELECT count(*) FROM x) AS n, round(1 - (SELECT sum(pow((a - b) / 2.0, 2)) FROM x) * (SELECT count(*) FROM x) / chance, 6) AS kappa FROM p""",
    "calibration": f"""WITH {GUESS_SQL}, g AS (SELECT lang, least(floor(p * 10), 9) AS b, count(*) AS n, avg(CAST(truth AS INT)) AS r, avg(p) AS m, sum(pow(p - CAST(truth AS INT), 2)) AS q FROM guess GROUP BY 1, 2)
      SELECT lang, round(sum(n * abs(r - m)) / sum(n), 6) AS ece, round(sum(q) / sum(n), 6) AS brier FROM g GROUP BY 1""",
    "best_cut": f"""WITH {GUESS_SQL}, e AS (SELECT lang, p, count(*) FILTER (truth) AS h, count(*) AS n FROM guess GROUP BY 1, 2), w AS (SELECT lang, p, 2 * sum(h) OVER d / (sum(n) OVER d + sum(h) OVER (PARTITION BY lang)) AS f1, coalesce(lead(p) OVER d, 0) AS below FROM e WINDOW d AS (PARTITION BY lang ORDER BY p DESC))
      SELECT lang, round((p + below) / 2, 6) AS cut FROM w QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, p DESC) = 1""",
    "uncertain_share": f"WITH {GUESS_SQL} SELECT round(avg(CAST(abs(p - 0.5) <= 0.1 AS INT)), 6) AS uncertain FROM guess",
    "prevalence_pivot": f"WITH {GUESS_SQL} SELECT CASE WHEN toxic THEN 'toxic' ELSE 'clean' END AS code, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de FROM guess WHERE truth GROUP BY 1",
    "class_weights": f"WITH {GUESS_SQL} SELECT lang, count(*) FILTER (toxic) AS positives, count(*) FILTER (NOT toxic) AS negatives, round(count(*) FILTER (NOT toxic) / count(*) FILTER (toxic), 6) AS weight FROM guess GROUP BY 1",
    "percentile_thresholds": "SELECT event_type, round(quantile_cont(value, 0.99), 6) AS threshold FROM events GROUP BY 1",
    "latencies": """WITH f AS (SELECT event_type, user_id, min(value) AS b FROM events GROUP BY 1, 2), g AS (SELECT event_type, quantile_cont(b, 0.95) AS q FROM f GROUP BY 1)
      SELECT e.event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(any_value(q), 6) AS p95_fastest FROM events e JOIN g ON e.event_type = g.event_type GROUP BY 1""",
    "repeated_calls": "SELECT day, count(*) AS calls, count(*) FILTER (k > 1) AS repeats FROM (SELECT CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type, user_id ORDER BY event_id) AS k FROM events) GROUP BY 1",
    "pooled_rate": "WITH c AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS r, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 10) SELECT CASE WHEN count(*) = 10 THEN round(sum(r * n) / sum(n), 6) END AS rate FROM c",
    "top_code": "SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, ascii(event_type) * 1000 + ascii(substr(event_type, 2, 1))) = 1",
    "trial_metrics": """WITH t AS (SELECT l_returnflag, l_discount * 100 AS e, CASE WHEN l_linenumber = 1 THEN 0.0::DOUBLE ELSE 5.0::DOUBLE END AS t, l_discount * 100 - 3 AS lo, CASE WHEN l_tax < 0.07::DOUBLE THEN l_discount * 100 + 3 ELSE 'infinity'::DOUBLE END AS hi FROM lineitem)
      SELECT l_returnflag, count(*) AS trials, round(avg(e - t), 5) AS bias, round(sqrt(avg(pow(e - t, 2))), 5) AS rmse, round(avg(CAST(lo <= t AND t <= hi AS INT)), 5) AS coverage, round(avg(CAST(lo > 0 OR hi < 0 AS INT)) FILTER (t = 0), 5) AS false_alarms, round(avg(CAST(lo > 0 OR hi < 0 AS INT)) FILTER (t <> 0), 5) AS power FROM t GROUP BY 1""",
    "dense_topk": f"WITH {_VEC} SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM bm WHERE rank <= 5",
    "hybrid_rrf": f"""WITH {_BM25}, {_VEC.replace("a.vec_id % 100 = 0", "a.vec_id IN (SELECT item_id FROM benchmark)")}, x AS (SELECT query_id, item_id, rank FROM r WHERE rank <= 50), y AS (SELECT query_id, item_id, rank FROM bm WHERE rank <= 50),
      f AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.item_id, y.item_id) AS item_id, coalesce(1 / (60 + x.rank), 0) + coalesce(1 / (60 + y.rank), 0) AS score FROM x FULL JOIN y ON x.query_id = y.query_id AND x.item_id = y.item_id)
      SELECT query_id, item_id, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f) WHERE rank <= 10""",
    "ranking_metrics": f"""WITH {_VEC}, g AS (SELECT *, CASE WHEN la = lb THEN CASE WHEN item_id % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS g FROM r), i AS (SELECT query_id, g, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, item_id) AS k FROM g WHERE g > 0)
      SELECT g.query_id, round(sum(g / log2(rank + 1)) FILTER (rank <= 10) / any_value(ideal), 6) AS ndcg, round(coalesce(1 / min(rank) FILTER (rank <= 10 AND g > 0), 0), 6) AS mrr, round(count(*) FILTER (rank <= 10 AND g > 0) / any_value(rel), 6) AS recall
      FROM g JOIN (SELECT query_id, sum(g / log2(k + 1)) FILTER (k <= 10) AS ideal, count(*) AS rel FROM i GROUP BY 1) x ON x.query_id = g.query_id GROUP BY 1""",
    "shingle_leak": f"""WITH d AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS w FROM documents), b AS (SELECT item_id AS id, {_TOKENS.format('text')} AS w FROM benchmark),
      x AS (SELECT DISTINCT id, array_to_string(w[k : k + 7], ' ') AS run FROM d, unnest(range(1, len(w) - 6)) t(k)), y AS (SELECT DISTINCT id, array_to_string(w[k : k + 7], ' ') AS run FROM b, unnest(range(1, len(w) - 6)) t(k))
      SELECT x.id AS item_id, y.id AS query_id, count(*) AS runs FROM x JOIN y ON x.run = y.run GROUP BY 1, 2""",
    "gate_decisions": """SELECT CASE WHEN NOT l_tax < 0.08::DOUBLE THEN 'no_estimate' WHEN l_discount * 100 - 7 <= 0 AND l_discount * 100 - 3 >= 0 THEN 'range_includes_zero' WHEN l_linestatus = 'O' AND l_tax > 0.1 THEN 'placebo_failed' WHEN l_returnflag = 'A' THEN 'not_validated' WHEN l_quantity > 40 THEN 'confounded' ELSE 'allowed' END AS gate, count(*) AS n FROM lineitem GROUP BY 1""",
    "paired_difference": "SELECT doc_id, toxic AS base, quality AS other, quality - toxic AS difference FROM labels WHERE quality = 1 AND doc_id % 3 <> 0",
}
