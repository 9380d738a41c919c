"""Queries of landing, merges, checks, samples, claims and model comparisons on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import rules, schemas, text_udfs
from ..operators import checks, joins, measures, monitoring, retrieval, sampling, series, verify, versions
from ..sources import exports, landing
from ..streaming import limits
from .analysis import _TOKENS
from .tables import GUESS_SQL, REVIEWS_SQL, guess, latest_reviews, read, reviews


def _orders(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


def price_snapshots(s: SparkSession, d: str) -> DataFrame:
    """Price maps of a day, one JSON text for each order: failed ones, free ones without a price, and broken texts."""
    k = F.col("o_orderkey")
    price = F.format_string('"data": {"price_overview": {"currency": "EUR", "initial": %d, "final": %d, "discount_percent": 0}}', F.col("o_custkey").cast("int"), (F.col("o_custkey") - 1).cast("int"))
    inner = F.when(k % 9 == 0, '"success": false').when(k % 5 == 0, '"success": true, "data": {}').when(k % 7 == 0, price).otherwise(F.concat(F.lit('"success": true, '), price))
    body = F.format_string('{"%d": {%s}', k, inner)
    text = F.when(k % 17 != 0, F.when(k % 13 == 0, body).otherwise(F.concat(body, F.lit("}"))))
    return landing.prices(_orders(s, d).select(text.alias("json"), "day"), "json", "day").select("entity", "day", "ok", "initial", "final")


def day_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts of answers, of which some are broken, empty, or lack a side."""
    k = F.col("o_orderkey")
    whole = F.format_string('{"query_summary": {"total_positive": %d, "total_negative": %d}}', "o_custkey", "o_orderkey")
    half = F.format_string('{"query_summary": {"total_negative": %d, "other": "x"}}', "o_orderkey")
    body = F.when(k % 5 == 0, F.concat(F.lit("{"), whole)).when(k % 7 == 0, half).when(k % 11 == 0, "{}").when(k % 13 != 0, whole)
    return landing.day_counts(_orders(s, d).select("o_orderkey", body.alias("json")), "json").select("o_orderkey", "positive", "negative")


def release_days(s: SparkSession, d: str) -> DataFrame:
    """Days in three formats, some of them still to come, unreadable or null."""
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.date_format("day", "d MMM, yyyy")).when(k % 3 == 1, F.date_format("day", "MMM d, yyyy")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    text = F.when(k % 5 == 0, "to be announced").when(k % 11 != 0, F.when(k % 13 == 0, F.concat(text, F.lit(" maybe"))).otherwise(text))
    rows = _orders(s, d).select("o_orderkey", text.alias("text"), (k % 7 == 0).alias("coming"))
    return landing.release_days(rows, "text", "coming").select("o_orderkey", "release_day")


def unknown_fields(s: SparkSession, d: str) -> DataFrame:
    """Fields of landed items that the schema doesn't know."""
    body = F.format_string('[{"id": %d, "author": {"name": 1, "v%d": 2}, "u%d": 3}]', "event_id", F.col("event_id") % 3, F.col("user_id") % 4)
    return landing.schema_drift(read(s, d, "events").select(body.alias("json")), "json", ["id", "author"], "author", ["name"])


def coverage_plan(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d).groupBy(F.col("o_orderstatus").alias("entity")).agg(F.min("o_orderdate").alias("covered_from"), F.max("o_orderdate").alias("covered_to"))
    state = o.withColumn("floor", F.lit("1995-01-01").cast("timestamp"))
    out = landing.coverage_windows(state, "2000-01-01 00:00:00")
    return out.select("entity", *[F.col(x).cast("date").alias(x) for x in ("forward_from", "forward_to", "backward_from", "backward_to")])


def covered_span(s: SparkSession, d: str) -> DataFrame:
    return landing.recomputed_coverage(_orders(s, d), "o_orderstatus", "day")


def history_gaps(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d).groupBy(F.col("o_orderstatus").alias("entity"), "day").agg(F.count_if(F.col("o_totalprice") > 150000).alias("positive"), F.count("*").alias("negative"))
    ends = o.groupBy("entity").agg(F.min("day").alias("first_day"))
    return landing.history_problems(o.where("negative <> 3"), ends, "1998-12-31")


def missing_days(s: SparkSession, d: str) -> DataFrame:
    """The four oldest missing days of each entity."""
    o = _orders(s, d).select(F.col("o_orderpriority").alias("entity"), "day")
    some = o.groupBy("entity", "day").agg(F.count("*").alias("n")).where("n >= 2")
    return landing.catch_up(series.spine(o, ["entity"], "day"), some, 4).select("entity", "day")


def purged_pages(s: SparkSession, d: str) -> DataFrame:
    return landing.purged(read(s, d, "events"), "ts", "2024-02-15 00:00:00").agg(F.count("*").alias("n"))


def windows_done(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d)
    return o.groupBy(landing.window_done(F.col("o_orderkey") % 100, F.lit(90)).alias("done")).agg(F.count("*").alias("n"))


def table_age(s: SparkSession, d: str) -> DataFrame:
    return checks.stale_tables(read(s, d, "orders"), "o_orderdate", "1999-01-02 12:00:00").select(F.round("age_hours", 3).alias("age_hours"), "state")


def inserted_if_absent(s: SparkSession, d: str) -> DataFrame:
    r = reviews(s, d).select("review_id", "run_id", "minutes")
    return versions.inserted_if_absent(r.where("run_id <= 2"), r.where("run_id >= 2"), ["review_id", "run_id"]).groupBy("run_id").agg(F.count("*").alias("n"))


def appended_if_changed(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d)
    old = o.select("o_orderkey", F.lit(1).alias("run"), F.col("o_orderstatus").alias("fp"))
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(2).alias("run"), F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus")).alias("fp"))
    return versions.appended_if_changed(old, new, ["o_orderkey"], "fp", "run")


def latest_as_of(s: SparkSession, d: str) -> DataFrame:
    return versions.latest_as_of(reviews(s, d).select("review_id", "run_id"), ["review_id"], "run_id", 4)


def last_chunk_wins(s: SparkSession, d: str) -> DataFrame:
    """A cache of vectors written in chunks, an id in several of them."""
    v = read(s, d, "embeddings").select("vec_id", F.lit(1).alias("chunk"), "label")
    again = v.where("vec_id % 4 = 0").select("vec_id", F.lit(2).alias("chunk"), (F.col("label") + 100).alias("label"))
    return versions.latest(v.unionByName(again), ["vec_id"], [F.col("chunk").desc()])


def above_mark(s: SparkSession, d: str) -> DataFrame:
    r = reviews(s, d)
    return versions.above_mark(r, "run_id", r.where("run_id <= 4")).groupBy("run_id").agg(F.count("*").alias("n"))


def stamped_rows(s: SparkSession, d: str) -> DataFrame:
    r = reviews(s, d)
    return versions.with_watermark(r.groupBy("entity").agg(F.count("*").alias("n")), r.where("run_id < 7"), "run_id")


def to_recompute(s: SparkSession, d: str) -> DataFrame:
    """Daily units whose fingerprint is not stored."""
    daily = reviews(s, d).groupBy("entity", "version").agg(F.count("*").alias("n"))
    wanted = daily.select("entity", "version", c.fingerprint("entity", "version", "n", charset="UTF-8").alias("fp"))
    stored = daily.select("entity", "version", c.fingerprint("entity", "version", F.when(F.col("n") % 5 == 0, 0).otherwise(F.col("n")), charset="UTF-8").alias("fp"))
    return versions.to_recompute(wanted, stored, ["entity", "version"], "fp")


def scoring_backlog(s: SparkSession, d: str) -> DataFrame:
    r = latest_reviews(s, d)
    scores = r.where("review_id % 3 = 0").select("review_id", F.when(F.col("review_id") % 2 == 0, "m1").otherwise("m2").alias("model"))
    todo = versions.backlog(r, scores, ["review_id"], "model", "m2", [F.col("version").desc(), F.col("review_id")])
    return todo.groupBy("entity").agg(F.count("*").alias("n"), F.max("version").alias("newest"))


def rolled_up(s: SparkSession, d: str) -> DataFrame:
    parts = reviews(s, d).groupBy("entity", "run_id", "version").agg(F.count("*").alias("n"), F.count_if("positive").alias("x"))
    return versions.rolled_up(parts, ["entity", "run_id"], ["n", "x"])


def reclassify(s: SparkSession, d: str) -> DataFrame:
    items = read(s, d, "documents").select("doc_id")
    labels = items.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "v2").otherwise("v1").alias("version"))
    return versions.to_reclassify(items, labels, "doc_id", "version", "v2")


def mismatched_days(s: SparkSession, d: str) -> DataFrame:
    log = reviews(s, d).select("run_id", "entity", "version", (F.col("minutes") > 2500).alias("mismatched"))
    return versions.last_mismatches(log, "run_id", 6, ["entity", "version"])


def labels_aligned(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").where("doc_id % 5 <> 0").select("doc_id", "lang")
    out = versions.aligned_labels(read(s, d, "labels"), docs, "doc_id")
    return out.groupBy("lang", "missing").agg(F.count("*").alias("n"))


def retrain_set(s: SparkSession, d: str) -> DataFrame:
    l = read(s, d, "labels").select("doc_id", "quality")
    spot = l.where("doc_id % 4 = 0").withColumn("quality", 1 - F.col("quality"))
    docs = read(s, d, "documents").where("doc_id % 7 <> 0").select("doc_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 200).cast("int")).alias("day"))
    return versions.retrain_set(l, spot, docs, "doc_id", "day", F.lit("2024-07-18").cast("date"))


def decision_changes(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d)
    before = o.where("o_orderkey % 10 <> 0").select("o_orderkey", F.lit("shipped").alias("decision"))
    after = o.where("o_orderkey % 9 <> 0").select("o_orderkey", F.when(F.col("o_totalprice") > 400000, "withheld:V1").otherwise("shipped").alias("decision"))
    return versions.decision_changes(before, after, ["o_orderkey"], "decision")


def treatment_candidates(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d).select("o_orderkey", "day", F.when(F.col("o_orderpriority") == "1-URGENT", "major_update").otherwise("event").alias("kind"), F.when(F.col("o_orderstatus") == "F", "not_official").otherwise("x").alias("rule"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("1996-06-01").cast("date")).alias("since"))
    return o.where(rules.is_candidate("kind", "rule", "day", "since")).select("o_orderkey")


def event_flags(s: SparkSession, d: str) -> DataFrame:
    """Flags of sales and discounts near the starts of events."""
    o = _orders(s, d)
    bundles = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("bundle_id"), F.col("o_orderstatus").alias("entity"), F.col("day").alias("start"))
    discounts = o.where("o_totalprice > 490000").select(F.col("o_orderstatus").alias("entity"), "day")
    sales = s.createDataFrame([("1996-06-20",), ("1997-12-24",)], "day string").select(F.col("day").cast("date"))
    first = s.createDataFrame([("F", "1996-01-01"), ("O", "1995-06-01")], "entity string, d string").select("entity", F.col("d").cast("date").alias("first_price"))
    return series.day_flags(bundles, discounts, sales, first, "entity", "day").select("bundle_id", F.array_join("flags", ",").alias("flags"))


def complete_windows(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).groupBy(series.complete("day", 14, F.lit("1998-08-01").cast("date")).alias("complete")).agg(F.count("*").alias("n"))


def estimation_plan(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d).where("o_totalprice > 400000")
    b = o.select(F.col("o_orderkey").alias("bundle_id"), F.col("day").alias("start"), (F.col("o_orderkey") % 2 == 0).alias("allow_long"))
    out = series.estimation_plan(b, [("share", "all"), ("volume", "all"), ("share", "established")], ["its", "synth"], F.lit("1998-08-01").cast("date"))
    return out.groupBy("horizon", "outcome", "sample", "method").agg(F.count("*").alias("n"), F.max("start").alias("newest"))


def regressions(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    now = e.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    base = e.where("event_type <> 'error'").groupBy(F.col("event_type").alias("metric")).agg(F.max("value").alias("value"))
    tolerance = e.select(F.col("event_type").alias("metric")).distinct().withColumns({"tolerance": F.lit(1.0), "higher_is_better": F.col("metric") != "click"})
    return monitoring.regressions(now, base, tolerance).select("metric", "regressed")


def alert_states(s: SparkSession, d: str) -> DataFrame:
    log = read(s, d, "events").select(F.col("user_id").alias("rule"), F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") != "view", F.col("value") > 50).alias("breached"), (F.col("event_id") % 5 == 0).alias("drill"))
    return monitoring.alert_state(log)


def new_breaches(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").groupBy(F.col("user_id").cast("string").alias("metric"), F.col("ts").cast("date").alias("window_end")).agg(F.avg("value").alias("v"))
    return monitoring.new_breaches(e.withColumn("breached", F.col("v") > 20))


ORDER_SCHEMA = {
    "type": "object",
    "required": ["id", "status", "lines"],
    "properties": {
        "id": {"type": "integer"},
        "status": {"type": "string", "enum": ["F", "O"]},
        "price": {"type": ["number", "null"], "least": 1000, "most": 400_000},
        "lines": {"type": "array", "least": 1, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "most": 6}, "flag": {"type": "string"}}}},
    },
}


def schema_problems(s: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as JSON, some of them broken, against a schema: a row for each problem."""
    k = F.col("o_orderkey")
    line = F.when(F.col("l_linenumber") % 5 == 4, F.lit('"x"')).otherwise(F.format_string('{"n": %d%s}', "l_linenumber", F.when(F.col("l_returnflag") == "R", ', "extra": 1').when(F.col("l_returnflag") == "A", ', "flag": null').otherwise(', "flag": "N"')))
    lines = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t"))))["t"], ", ").alias("t"))
    price = F.when(k % 6 == 0, "null").when(k % 6 == 1, F.lit('"12"')).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    both = read(s, d, "orders").join(lines, "o_orderkey", "left")
    text = F.concat(F.lit("{"), F.when(k % 9 != 0, F.format_string('"id": %s, ', F.when(k % 10 == 3, F.concat(k.cast("string"), F.lit(".5"))).otherwise(k.cast("string")))).otherwise(""), F.lit('"status": "'), F.col("o_orderstatus"), F.lit('", "price": '), price, F.lit(', "lines": ['), F.coalesce("t", F.lit("")), F.lit("]"), F.when(k % 21 == 0, ', "status": 1').otherwise(""), F.when(k % 23 != 0, "}").otherwise(""))
    found = both.select("o_orderkey", F.explode(schemas.json_problems(text, ORDER_SCHEMA)).alias("p"))
    return found.select("o_orderkey", "p.path", "p.problem")


def longest_runs(s: SparkSession, d: str) -> DataFrame:
    """Words in the longest run that each benchmark item shares with the next but two, with a part of that one put behind it."""
    b = read(s, d, "benchmark")
    part = F.array_join(F.slice(F.split("text", " "), F.lit(3), F.pmod(F.col("item_id"), F.lit(6)).cast("int")), " ")
    other = b.select((F.col("item_id") - 3).alias("item_id"), F.col("text").alias("other"), part.alias("part"))
    own = b.join(other, "item_id").withColumn("text", F.concat_ws(" ", "text", "part"))
    return own.select("item_id", text_udfs.longest_shared_run("text", "other").cast("long").alias("run"))


def limited_requests(s: SparkSession, d: str) -> DataFrame:
    """Events as requests of their type, in a time that runs 400 times as fast, under limits of a minute and a day."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 400).cast("long")
    rows = read(s, d, "events").select("event_type", "event_id", at.alias("at"), (F.floor(F.coalesce("value", F.lit(0.0))) + 1).cast("long").alias("tokens"))
    return limits.limited(rows, "event_type", "event_id", limits.Limits(5, 150, 900, "Etc/GMT+8"))


def drift_pending(s: SparkSession, d: str) -> DataFrame:
    """Users as models: weekly means of a type of event as metrics, purchases as requests and errors as decisions."""
    e = read(s, d, "events").select("user_id", "event_id", "event_type", "value", F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date").alias("window_end"))
    judged = e.groupBy("user_id", F.col("event_type").alias("metric"), "window_end").agg((F.avg("value") > 60).alias("breached"))
    kind = F.when(F.col("event_id") % 29 == 0, "requested").when(F.col("event_id") % 31 == 0, "decision")
    log = e.where(kind.isNotNull()).select("user_id", F.col("event_id").alias("at"), kind.alias("kind"), F.date_add("window_end", -7).alias("window_end"))
    return monitoring.drift_pending(judged, log, "user_id")


def last_failure(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d).select("o_orderkey", F.struct("day", "o_orderkey").alias("start"), F.when(F.col("o_orderkey") % 2 == 0, F.col("day")).alias("end"), F.when(F.col("o_totalprice") > 200_000, "failed").otherwise("done").alias("status"), "o_orderstatus")
    runs = [monitoring.last_failure(o.where(F.col("o_orderstatus") == x), "start", "end", "status") for x in ("F", "O", "P")]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select("o_orderkey", "o_orderstatus", "status")


def run_log(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d).select("o_orderkey", "day")
    return monitoring.run_log(o, o.where("o_orderkey % 4 <> 0").select("o_orderkey", F.lit("ok").alias("status")), "o_orderkey").groupBy("status").agg(F.count("*").alias("n"))


def all_reasons(s: SparkSession, d: str) -> DataFrame:
    """Every reason why an order is screened out."""
    why = rules.Reasons([(F.col("o_totalprice") < 50000, "small"), (F.col("o_orderstatus") == "F", "closed"), (F.col("o_orderpriority") == "5-LOW", "low")])
    return _orders(s, d).groupBy(F.array_join(why.column(), ",").alias("reasons")).agg(F.count("*").alias("n"))


def staleness(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    readable = F.col("event_type") != "error"
    age = F.when(F.col("event_type") != "view", F.col("value"))
    return e.groupBy(rules.stale(age, 40.0, readable).alias("stale")).agg(F.count("*").alias("n"))


def json_membership(s: SparkSession, d: str) -> DataFrame:
    """The latest row whose JSON list holds a value."""
    rows = _orders(s, d).select("o_orderkey", F.format_string('["%s", "%s"]', "o_orderstatus", "o_orderpriority").alias("ids"))
    return joins.holding(rows, "ids", "1-URGENT", "o_orderkey", 9000).select("o_orderkey")


def round_robin(s: SparkSession, d: str) -> DataFrame:
    hosts = read(s, d, "nation").select("n_nationkey")
    return versions.round_robin(read(s, d, "benchmark").select("item_id"), hosts, "item_id", "n_nationkey")


def label_cells(s: SparkSession, d: str) -> DataFrame:
    """Codes of an order's lines in a fixed order."""
    l = read(s, d, "lineitem").select("l_orderkey", "l_returnflag")
    return retrieval.aspects_in_order(l, "l_orderkey", "l_returnflag", ["R", "A", "N"])


def parsed_cells(s: SparkSession, d: str) -> DataFrame:
    """Cells written and read back."""
    cell = F.when(F.col("o_orderkey") % 3 == 0, "none").when(F.col("o_orderkey") % 3 == 1, F.lit("b| a")).otherwise("c")
    labels = c.parsed_labels(cell, ["a", "b", "c"])
    return _orders(s, d).groupBy(c.label_cell(labels).alias("cell")).agg(F.count("*").alias("n"))


def list_parts(s: SparkSession, d: str) -> DataFrame:
    parts = c.list_parts(F.concat_ws(" , ", "o_orderstatus", F.lit(""), "o_orderpriority"))
    return _orders(s, d).select(F.explode(parts).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


def index_filter(s: SparkSession, d: str) -> DataFrame:
    r = reviews(s, d).withColumns({"day": F.col("version"), "outcome": F.col("positive"), "first_run": F.col("run_id"), "bucket": c.bucket_of_minutes("minutes")})
    out = retrieval.filtered(r, entity=F.col("entity") == "N", days=("1996-01-01", "1997-12-31"), outcome=True, run=5, buckets=["lt_2h", "2h_10h"])
    return out.agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"))


def index_over_cap(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d).withColumnRenamed("o_orderpriority", "entity")
    anchors = o.where("o_totalprice > 490000").select("entity", "day")
    return checks.over_cap(o, anchors, "entity", "day", 100, 10).withColumnRenamed("count", "n")


def quality_log(s: SparkSession, d: str) -> DataFrame:
    bad = checks.repeated(read(s, d, "lineitem"), ["l_orderkey", "l_suppkey"]).select(F.lit("unique").alias("name"), "l_orderkey", "l_suppkey", "count")
    out = checks.logged(bad, 7, "warn")
    return out.select("run_id", "check", "severity", F.get_json_object("detail", "$.l_orderkey").cast("long").alias("l_orderkey"), F.get_json_object("detail", "$.l_suppkey").cast("long").alias("l_suppkey"))


def held_quotes(s: SparkSession, d: str) -> DataFrame:
    """Whether four words of a document, with other white space, stand in it, and whether those of the one before do."""
    docs = read(s, d, "documents").select("doc_id", "text")
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    quote = F.when(F.col("doc_id") % 9 != 0, F.array_join(F.slice(words, 3, 4), " \n "))
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), quote.alias("other"))
    both = docs.withColumn("quote", quote).join(before, "doc_id", "left")
    return both.select("doc_id", c.holds_quote("quote", "text").alias("own"), c.holds_quote("other", "text").alias("before"))


def shared_runs(s: SparkSession, d: str) -> DataFrame:
    """Whether a question shares eight words with the next one, or with itself in capitals. Only A-Z become capitals: those
    of other letters may be other words again in lower case (ß, SS, ss)."""
    capitals = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    b = read(s, d, "benchmark").select("item_id", "text")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id").select("item_id", c.share_words_run("text", F.concat(F.lit("so "), capitals)).alias("own"), c.share_words_run("text", "other").alias("next"))


def json_values(s: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("event_id") % 2 == 0, "$.k").otherwise("$.x")
    e = read(s, d, "events").withColumn("path", path)
    return e.select("event_id", verify.value_at("props", "path").alias("value"))


def stage_times(s: SparkSession, d: str) -> DataFrame:
    body = F.format_string('{"read": %d, "note": "x", "score": %d.5}', "o_custkey", "o_orderkey")
    out = exports.durations(_orders(s, d).select("o_orderkey", body.alias("stages")), "stages")
    return out.select("o_orderkey", F.try_element_at("durations", F.lit("read")).alias("read"), F.try_element_at("durations", F.lit("score")).alias("score"), F.size("durations").alias("n"))


def local_midnights(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select("event_id", c.next_local_midnight("ts").alias("m"), c.epoch_seconds("ts").alias("seconds"))
    return e.select("event_id", F.date_format("m", "yyyy-MM-dd HH:mm:ss").alias("midnight"), "seconds")


def row_fingerprints(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").select("c_custkey", c.fingerprint("c_custkey", "c_mktsegment", "c_nationkey", charset="UTF-8").alias("fp"))


def evidence_fingerprints(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").select("c_custkey", c.evidence_fingerprint("c_custkey", "c_mktsegment").alias("fp"))


def asked_questions(s: SparkSession, d: str) -> DataFrame:
    q = read(s, d, "conversations").where("role = 'user'")
    return q.groupBy(c.normalised_question(F.concat(F.lit("  "), "text", F.lit(" "))).alias("q")).agg(F.count("*").alias("n")).select(F.sha2("q", 256).alias("q"), "n")


def sigmoids(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select("event_id", F.round(c.sigmoid((F.col("value") - 30) / 10), 9).alias("p"))


def pooled_vectors(s: SparkSession, d: str) -> DataFrame:
    """Mean of each vector and its reverse, of length 1."""
    v = read(s, d, "embeddings").select("vec_id", F.array("embedding", F.reverse("embedding"), F.transform("embedding", lambda x: x * 0 + 9)).alias("hidden"), F.array(F.lit(1), F.lit(1), F.lit(0)).alias("mask"))
    m = retrieval.mean_pooled("hidden", "mask")
    return v.select("vec_id", m.alias("m")).select("vec_id", F.round(F.element_at("m", 1), 6).alias("first"), F.round(F.element_at("m", -1), 6).alias("last"))


def directions(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, "It rose a lot").when(F.col("o_orderkey") % 3 == 1, "The share fell").otherwise("It stayed")
    change = F.col("o_totalprice") - 200000
    holds = verify.direction_holds(text, change, F.col("o_orderstatus") == "F")
    return _orders(s, d).groupBy(holds.alias("holds")).agg(F.count("*").alias("n"))


def verified_claims(s: SparkSession, d: str) -> DataFrame:
    """A claim of each order about its customer's change from finished to open orders, with every kind of fault."""
    urgent, k = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")
    sides = {x: F.col("o_orderstatus") == y for x, y in (("window", "O"), ("baseline", "F"))}
    share = lambda x: 100 * F.count_if(sides[x] & urgent) / F.nullif(F.count_if(sides[x]), F.lit(0))
    change = (share("window") - share("baseline")).alias("change")
    seen = _orders(s, d).groupBy("o_custkey").agg(change, *[F.count_if(c).alias(x) for x, c in sides.items()])
    result = F.to_json(F.struct(F.round("change", 4).alias("total"), F.col("window").alias("window_reviews"), F.col("baseline").alias("baseline_reviews"), F.lit("9 of 9").alias("note")))
    about = F.coalesce(F.round("change", 1), F.lit(0.0))
    word = F.when(k % 3 == 2, "moved").when((k % 3 == 1) | (F.col("change") > 0), "rose").otherwise("fell")
    text = F.concat(F.lit("The "), F.when(k % 7 == 0, "negative ").otherwise(""), F.lit("share "), word, F.format_string(" %.1f points over 14 days", F.abs(about) + F.when(k % 8 == 4, 2.2).otherwise(0.0)), F.when(k % 13 == 0, " of two").otherwise(""), F.when(k % 5 == 0, " because of it").otherwise(""))
    effect = F.round(F.col("o_totalprice") / 50000 - 4, 2)
    estimate = F.struct(
        F.when(k % 20 != 0, effect).alias("effect"), (effect - 1).alias("lo90"), (effect + 1).alias("hi90"), F.when(k % 15 == 0, "synth").otherwise("its").alias("method"), F.when(k % 2 == 0, 0.05).otherwise(0.3).alias("p_value"),
        F.lit("positive_share").alias("outcome"), F.lit("all").alias("sample"), F.when(k % 35 == 0, F.array(F.lit("confounded"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.lit(14).alias("horizon"),
    )
    source = F.concat(F.lit("Order "), F.col("o_orderpriority"), F.lit(" of "), F.col("o_orderstatus"))
    quote = F.when(k % 6 == 0, F.concat(F.lit(" of   "), F.col("o_orderstatus"))).when(k % 6 == 1, F.lit("5-LOW of"))
    claims = _orders(s, d).join(seen, "o_custkey").select(
        text.alias("text"), F.when(k % 10 == 0, "causal").otherwise("comparative").alias("claim_type"), (about + F.when(k % 4 == 0, 3.0).otherwise(0.0)).alias("value"), F.lit("pp").alias("unit"), F.lit("decomposition").alias("tool"),
        F.lit(None).cast("string").alias("outcome"), F.lit("$.total").alias("path"), F.when(k % 17 != 0, result).alias("result"), verify.numbers_in(result).alias("pool"), F.when(quote.isNotNull(), F.array(F.struct(quote.alias("text"), source.alias("source")))).otherwise(F.array()).alias("quotes"),
        (k % 19 != 0).alias("reviews_found"), F.when(k % 11 == 0, F.array(F.upper(text))).otherwise(F.array(source)).alias("retrieved"), F.when(k % 25 != 0, estimate).alias("estimate"), (k % 4 == 2).alias("review_bomb"),
    )
    return verify.judged(claims).groupBy("decision", "blocked_by").agg(F.count("*").alias("n"), F.sum("based_on").alias("basis"), F.count_if(F.col("final_text").contains("credit the release")).alias("hedged"))


def blame_counts(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, "It fell because of the release").when(F.col("o_orderkey") % 3 == 1, "It fell due to the sale").otherwise("The release came")
    rows = _orders(s, d).select("o_orderstatus", text.alias("text"), F.when(F.col("o_orderkey") % 2 == 0, "shipped").otherwise("withheld:V1").alias("decision"))
    return verify.blame_counts(rows, ["o_orderstatus"], r"(?i)\brelease\b")


def summaries(s: SparkSession, d: str) -> DataFrame:
    text = F.format_string("In all %d orders cost 12.5", "o_orderkey")
    rows = _orders(s, d).select("o_orderkey", text.alias("summary"), F.array(F.lit(12.49), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("double")).otherwise(-1.0)).alias("backed"))
    return rows.groupBy(verify.summary_holds("summary", "backed").alias("holds")).agg(F.count("*").alias("n"))


def supported_categories(s: SparkSession, d: str) -> DataFrame:
    on = F.when(F.col("o_totalprice") > 250000, "supported").otherwise("rejected")
    statuses = F.create_map(F.lit("H2"), on, F.lit("H4"), F.when(F.col("o_orderkey") % 2 == 0, "supported").otherwise("rejected"))
    return _orders(s, d).groupBy(verify.predicted_category(statuses).alias("category")).agg(F.count("*").alias("n"))


def injected_cases(s: SparkSession, d: str) -> DataFrame:
    """Questions as payloads that a draft repeats and a report only marks."""
    b = read(s, d, "benchmark")
    cases = b.select("item_id", F.col("text").alias("payload"), F.array(F.format_string("MARK%d", "item_id")).alias("markers"), F.concat(F.lit("see: "), "text").alias("drafted"), F.when(F.col("item_id") % 2 == 0, F.format_string("has mark%d", "item_id")).otherwise("clean").alias("shipped"))
    return verify.injected(cases).select("item_id", "in_draft", "in_report")


def weekly_agreement(s: SparkSession, d: str) -> DataFrame:
    g = guess(s, d).withColumn("week", F.col("doc_id") % 5)
    return measures.weekly_agreement(g, "week", "lang", "truth", "predicted").select("week", "lang", F.round("f1", 6).alias("f1"), "support", F.round("macro_f1", 6).alias("macro_f1"))


def model_differences(s: SparkSession, d: str) -> DataFrame:
    g = guess(s, d)
    rows = None
    for name, cut in (("a", 0.3), ("b", 0.5), ("c", 0.7)):
        one = g.select("doc_id", F.lit(name).alias("model"), ((F.col("p") >= cut) == F.col("truth")).cast("double").alias("right"))
        rows = one if rows is None else rows.unionByName(one)
    return measures.model_differences(rows, "doc_id", "model", "right").select("model_a", "model_b", F.round("difference", 9).alias("difference"), "cases")


def chosen_model(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.count("*").alias("cost"))
    return measures.chosen(e, "mean", 10.0, 1.0, "cost").select("user_id")


def cross_validated(s: SparkSession, d: str) -> DataFrame:
    g = guess(s, d).withColumn("fold", (F.col("doc_id") % 4).cast("int"))
    return measures.cross_validated_f1(g, "fold", 4, "lang", "truth", "p").select("lang", F.round("f1", 6).alias("f1"))


def mean_of_known(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return measures.mean_of_known(e, ["user_id"], "v").select("user_id", F.round("mean", 6).alias("mean"), "counted", "left_out")


def exported_pool(s: SparkSession, d: str) -> DataFrame:
    judged = read(s, d, "labels").select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 9).alias("query_id"), F.col("quality").alias("grade"))
    items = read(s, d, "documents").select(F.col("doc_id").alias("item_id"), "lang", F.length("text").alias("size"))
    vectors = read(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    return retrieval.exported_pool(judged, items, vectors, "query_id", "item_id")


def newest_texts(s: SparkSession, d: str) -> DataFrame:
    return retrieval.newest_texts(_orders(s, d), [F.col("day").desc(), F.col("o_orderkey")], 256).select("o_orderkey")


def acceptance_picks(s: SparkSession, d: str) -> DataFrame:
    return sampling.most_of_each(_orders(s, d), "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5).select("o_orderpriority", "o_orderkey")


def ranking_files(s: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))
    run = read(s, d, "events").select(F.lit("bm25").alias("system"), F.lit("base").alias("variant"), F.col("user_id").alias("query_id"), rank.alias("rank"), F.col("event_id").alias("item_id"), F.col("value").alias("score"))
    return exports.ranking_rows(run.where("rank <= 10"))


def equal_parts(s: SparkSession, d: str) -> DataFrame:
    """90 documents dealt equally to languages, and by their sizes."""
    sizes = sampling.stratum_sizes(read(s, d, "documents"), "lang")
    equal = sampling.equal_allocation(90, dict.fromkeys(sizes, 25))
    return s.createDataFrame(sorted(equal.items()), "lang string, n long")


QUERIES = {f.__name__: f for f in (
    price_snapshots, day_counts, release_days, unknown_fields, coverage_plan, covered_span, history_gaps, missing_days, purged_pages, windows_done, table_age,
    inserted_if_absent, appended_if_changed, latest_as_of, last_chunk_wins, above_mark, stamped_rows, to_recompute, scoring_backlog, rolled_up, reclassify,
    mismatched_days, labels_aligned, retrain_set, decision_changes, treatment_candidates, limited_requests, drift_pending, schema_problems, longest_runs, event_flags, complete_windows, estimation_plan, regressions, alert_states,
    new_breaches, last_failure, run_log, all_reasons, staleness, json_membership, round_robin, label_cells, parsed_cells, list_parts, index_filter, index_over_cap,
    quality_log, held_quotes, shared_runs, json_values, stage_times, local_midnights, row_fingerprints, evidence_fingerprints, asked_questions, sigmoids, pooled_vectors,
    directions, verified_claims, blame_counts, summaries, supported_categories, injected_cases, weekly_agreement, model_differences, chosen_model, cross_validated,
    mean_of_known, exported_pool, newest_texts, acceptance_picks, ranking_files, equal_parts,
)}

_O = "o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders)"
_RUN8 = "list_transform(range(1, greatest(len(w) - 6, 1)), lambda k: array_to_string(w[k : k + 7], ' '))"

SQL = {
    "price_snapshots": f"WITH {_O} SELECT CAST(o_orderkey AS VARCHAR) AS entity, day, o_orderkey % 9 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 <> 0) AS ok, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 5 <> 0 THEN CAST(o_custkey AS INT) END AS initial, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 5 <> 0 THEN CAST(o_custkey - 1 AS INT) END AS final FROM o WHERE o_orderkey % 17 <> 0 AND o_orderkey % 13 <> 0",
    "day_counts": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN o_custkey END AS positive, CASE WHEN o_orderkey % 5 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0) THEN o_orderkey END AS negative FROM orders",
    "release_days": f"WITH {_O} SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN day END AS release_day FROM o",
    "unknown_fields": "SELECT path, count(*) AS n FROM (SELECT 'author.v' || (event_id % 3) AS path FROM events UNION ALL SELECT 'u' || (user_id % 4) FROM events) GROUP BY 1",
    "coverage_plan": f"WITH {_O} SELECT o_orderstatus AS entity, greatest(max(day) - 3, DATE '1995-01-01') AS forward_from, DATE '2000-01-01' AS forward_to, CASE WHEN min(day) > DATE '1995-01-01' THEN DATE '1995-01-01' END AS backward_from, CASE WHEN min(day) > DATE '1995-01-01' THEN min(day) END AS backward_to FROM o GROUP BY 1",
    "covered_span": f"WITH {_O} SELECT o_orderstatus, min(day) AS covered_from, max(day) AS covered_to FROM o GROUP BY 1",
    "history_gaps": f"""WITH {_O}, k AS (SELECT o_orderstatus AS entity, day, count(*) AS n FROM o GROUP BY 1, 2), e AS (SELECT entity, min(day) AS a FROM k GROUP BY 1), s AS (SELECT entity, CAST(unnest(generate_series(a, DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS day FROM e), h AS (SELECT * FROM k WHERE n <> 3)
      SELECT coalesce(s.entity, h.entity) AS entity, coalesce(s.day, h.day) AS day, CASE WHEN h.n IS NULL THEN 'missing' ELSE 'outside' END AS problem FROM s FULL JOIN h ON s.entity = h.entity AND s.day = h.day WHERE h.n IS NULL OR s.day IS NULL""",
    "missing_days": f"""WITH {_O}, e AS (SELECT o_orderpriority AS entity, min(day) AS a, max(day) AS b FROM o GROUP BY 1), s AS (SELECT entity, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e), h AS (SELECT o_orderpriority AS entity, day FROM o GROUP BY 1, 2 HAVING count(*) >= 2)
      SELECT entity, day FROM (SELECT s.*, row_number() OVER (PARTITION BY s.entity ORDER BY s.day) AS k FROM s ANTI JOIN h ON s.entity = h.entity AND s.day = h.day) WHERE k <= 4""",
    "purged_pages": "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'",
    "windows_done": "SELECT o_orderkey % 100 >= 0.99 * 90 AS done, count(*) AS n FROM orders GROUP BY 1",
    "table_age": "WITH a AS (SELECT epoch(TIMESTAMP '1999-01-02 12:00:00' - max(o_orderdate)) / 3600.0 AS h FROM orders) SELECT round(h, 3)::DOUBLE AS age_hours, CASE WHEN h > 48 THEN 'error' WHEN h > 36 THEN 'warn' ELSE 'ok' END AS state FROM a",
    "inserted_if_absent": f"WITH {REVIEWS_SQL}, k AS (SELECT run_id, minutes FROM reviews WHERE run_id <= 2 UNION ALL SELECT run_id, minutes FROM reviews r WHERE run_id > 2 QUALIFY row_number() OVER (PARTITION BY review_id, run_id) = 1) SELECT run_id, count(*) AS n FROM k GROUP BY 1",
    "appended_if_changed": "SELECT o_orderkey, 1 AS run, o_orderstatus AS fp FROM orders UNION ALL SELECT o_orderkey, 2, 'X' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_orderstatus <> 'X'",
    "latest_as_of": f"WITH {REVIEWS_SQL} SELECT review_id, max(run_id) AS run_id FROM reviews WHERE run_id <= 4 GROUP BY 1",
    "last_chunk_wins": "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END AS chunk, CASE WHEN vec_id % 4 = 0 THEN label + 100 ELSE label END AS label FROM embeddings",
    "above_mark": f"WITH {REVIEWS_SQL} SELECT run_id, count(*) AS n FROM reviews WHERE run_id > 4 GROUP BY 1",
    "stamped_rows": f"WITH {REVIEWS_SQL} SELECT entity, count(*) AS n, (SELECT max(run_id) FROM reviews WHERE run_id < 7) AS watermark FROM reviews GROUP BY 1",
    "to_recompute": f"WITH {REVIEWS_SQL}, k AS (SELECT entity, version, count(*) AS n FROM reviews GROUP BY 1, 2) SELECT entity, version, sha256(entity || '|' || CAST(version AS VARCHAR) || '|' || n) AS fp FROM k WHERE n % 5 = 0",
    "scoring_backlog": f"WITH {REVIEWS_SQL} SELECT entity, count(*) AS n, max(version) AS newest FROM latest WHERE NOT (review_id % 3 = 0 AND review_id % 2 <> 0) GROUP BY 1",
    "rolled_up": f"WITH {REVIEWS_SQL} SELECT entity, run_id, count(*) AS n, count(*) FILTER (positive) AS x FROM reviews GROUP BY 1, 2",
    "reclassify": "SELECT doc_id FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 3 = 0)",
    "mismatched_days": f"WITH {REVIEWS_SQL} SELECT DISTINCT entity, version FROM reviews WHERE run_id = 5 AND minutes > 2500",
    "labels_aligned": "SELECT d.lang, d.doc_id IS NULL AS missing, count(*) AS n FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 5 <> 0) d ON l.doc_id = d.doc_id GROUP BY 1, 2",
    "retrain_set": "SELECT l.doc_id, CASE WHEN l.doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS quality, DATE '2024-01-01' + CAST(l.doc_id % 200 AS INT) AS day, DATE '2024-07-18' - (DATE '2024-01-01' + CAST(l.doc_id % 200 AS INT)) < 56 AS held_out FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id % 7 <> 0",
    "decision_changes": """WITH a AS (SELECT o_orderkey, 'shipped' AS before FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'withheld:V1' ELSE 'shipped' END AS after FROM orders WHERE o_orderkey % 9 <> 0)
      SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, before, after FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE before IS DISTINCT FROM after""",
    "treatment_candidates": f"WITH {_O} SELECT o_orderkey FROM o WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AND NOT (o_orderkey % 2 = 0 AND day < DATE '1996-06-01')",
    "event_flags": f"""WITH {_O}, u AS (SELECT o_orderkey AS bundle_id, o_orderstatus AS e, day AS st, CASE o_orderstatus WHEN 'F' THEN DATE '1996-01-01' WHEN 'O' THEN DATE '1995-06-01' END AS fp FROM o WHERE o_orderpriority = '1-URGENT')
      SELECT bundle_id, concat_ws(',', CASE WHEN EXISTS (SELECT 1 FROM o x WHERE x.o_totalprice > 490000 AND x.o_orderstatus = e AND abs(x.day - st) <= 3) OR abs(st - DATE '1996-06-20') <= 3 OR abs(st - DATE '1997-12-24') <= 3 THEN 'confounded' END, CASE WHEN fp IS NULL OR st - 3 < fp THEN 'discounts_unknown' END) AS flags FROM u""",
    "complete_windows": f"WITH {_O} SELECT day + 13 <= DATE '1998-08-01' AS complete, count(*) AS n FROM o GROUP BY 1",
    "estimation_plan": f"""WITH {_O}, b AS (SELECT day AS st, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [7, 14] ELSE [7] END) AS horizon FROM o WHERE o_totalprice > 400000)
      SELECT horizon, k.outcome, k.sample, m.method, count(*) AS n, max(st) AS newest FROM b, (VALUES ('share', 'all'), ('volume', 'all'), ('share', 'established')) k(outcome, sample), (VALUES ('its'), ('synth')) m(method) WHERE st + horizon - 1 <= DATE '1998-08-01' GROUP BY 1, 2, 3, 4""",
    "regressions": "SELECT event_type AS metric, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN avg(value) - max(value) > 1 + 1e-9 ELSE max(value) - avg(value) > 1 + 1e-9 END AS regressed FROM events GROUP BY 1",
    "alert_states": "WITH k AS (SELECT *, CASE WHEN event_type <> 'view' THEN value > 50 END AS b FROM events) SELECT user_id AS rule, arg_max(b, (ts, event_id)) AS open FROM k WHERE b IS NOT NULL AND NOT (event_id % 5 = 0 AND NOT b) GROUP BY 1",
    "new_breaches": """WITH k AS (SELECT CAST(user_id AS VARCHAR) AS metric, CAST(ts AS DATE) AS d, avg(value) > 20 AS b FROM events GROUP BY 1, 2), l AS (SELECT *, dense_rank() OVER (ORDER BY d DESC) AS p FROM k)
      SELECT metric FROM l WHERE p <= 2 GROUP BY 1 HAVING bool_or(b) FILTER (p = 1) AND NOT coalesce(bool_or(b) FILTER (p = 2), false)""",
    "last_failure": """SELECT o_orderkey, o_orderstatus, 'failed' AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderkey % 2 = 0) WHERE n = 1 AND o_totalprice > 200000""",
    "longest_runs": """WITH b AS (SELECT a.item_id, string_split_regex(trim(lower(concat_ws(' ', a.text, array_to_string(string_split(o.text, ' ')[3:2 + a.part], ' ')))), '\\s+') AS x, string_split_regex(trim(lower(o.text)), '\\s+') AS y
        FROM (SELECT *, (item_id + 3) % 6 AS part FROM benchmark) a JOIN benchmark o ON o.item_id = a.item_id + 3),
      x AS (SELECT item_id, unnest(x) AS w, unnest(range(0, len(x))) AS i FROM b), y AS (SELECT item_id, unnest(y) AS w, unnest(range(0, len(y))) AS j FROM b),
      m AS (SELECT item_id, i - j AS d, i, i - row_number() OVER (PARTITION BY item_id, i - j ORDER BY i) AS g FROM x JOIN y USING (item_id, w)), r AS (SELECT item_id, count(*) AS n FROM m GROUP BY item_id, d, g)
      SELECT b.item_id, coalesce(max(n), 0) AS run FROM b LEFT JOIN r USING (item_id) GROUP BY 1""",
    "schema_problems": """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, list(l_linenumber ORDER BY l_linenumber, t) AS ns, list(f ORDER BY l_linenumber, t) AS fs FROM (SELECT *, l_returnflag AS f, CASE WHEN l_linenumber % 5 = 4 THEN '"x"' ELSE '{"n": ' || l_linenumber || CASE l_returnflag WHEN 'R' THEN ', "extra": 1' WHEN 'A' THEN ', "flag": null' ELSE ', "flag": "N"' END || '}' END AS t FROM lineitem) GROUP BY 1),
      o AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice AS p, coalesce(n, 0) AS n, ns, fs, o_orderkey % 21 = 0 OR o_orderkey % 23 = 0 AS broken FROM orders LEFT JOIN l ON l.k = o_orderkey),
      e AS (SELECT k, unnest(ns) AS ln, unnest(fs) AS f, unnest(range(0, len(ns))) AS i FROM o WHERE NOT broken AND n > 0)
      SELECT k AS o_orderkey, '$' AS path, 'is no JSON or names a field twice' AS problem FROM o WHERE broken
      UNION ALL SELECT k, '$.id', CASE WHEN k % 9 = 0 THEN 'is missing' ELSE 'is decimal, not integer' END FROM o WHERE NOT broken AND (k % 9 = 0 OR k % 10 = 3)
      UNION ALL SELECT k, '$.status', 'is none of the values' FROM o WHERE NOT broken AND st NOT IN ('F', 'O')
      UNION ALL SELECT k, '$.price', 'is string, not number or null' FROM o WHERE NOT broken AND k % 6 = 1
      UNION ALL SELECT k, '$.price', 'is out of bounds' FROM o WHERE NOT broken AND k % 6 > 1 AND (p < 1000 OR p > 400000)
      UNION ALL SELECT k, '$.lines', 'is out of bounds' FROM o WHERE NOT broken AND n = 0
      UNION ALL SELECT k, '$.lines[' || i || ']', 'is string, not object' FROM e WHERE ln % 5 = 4
      UNION ALL SELECT k, '$.lines[' || i || '].n', 'is out of bounds' FROM e WHERE ln % 5 <> 4 AND ln > 6
      UNION ALL SELECT k, '$.lines[' || i || '].extra', 'is unknown' FROM e WHERE ln % 5 <> 4 AND f = 'R'
      UNION ALL SELECT k, '$.lines[' || i || '].flag', 'is void, not string' FROM e WHERE ln % 5 <> 4 AND f = 'A'""",
    "drift_pending": """WITH e AS (SELECT user_id, event_id, event_type, value, CAST(date_trunc('week', ts) AS DATE) AS w FROM events), j AS (SELECT user_id, event_type, w, avg(value) > 60 AS b FROM e GROUP BY 1, 2, 3),
      k AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY w DESC) AS p FROM j), m AS (SELECT user_id, event_type, coalesce(bool_or(b) FILTER (p = 1), false) AS now, coalesce(bool_or(b) FILTER (p = 2), false) AS before FROM k GROUP BY 1, 2),
      t AS (SELECT user_id, bool_or(now) AS any_, bool_or(now AND NOT before) AS fresh FROM m GROUP BY 1), l AS (SELECT user_id, max(w) AS latest FROM e GROUP BY 1),
      g AS (SELECT user_id, event_id, CASE WHEN event_id % 29 = 0 THEN 'r' WHEN event_id % 31 = 0 THEN 'd' END AS kind, w - 7 AS w FROM e),
      h AS (SELECT user_id, max(w) FILTER (kind = 'r') AS asked, max(event_id) FILTER (kind = 'd') AS decided FROM g GROUP BY 1), o AS (SELECT g.user_id, count(*) AS n FROM g JOIN h USING (user_id) WHERE kind = 'r' AND event_id > coalesce(decided, -1) GROUP BY 1)
      SELECT t.user_id, any_ AND (fresh AND NOT coalesce(asked >= latest, false) OR coalesce(n, 0) = 1) AS pending FROM t JOIN l USING (user_id) LEFT JOIN h USING (user_id) LEFT JOIN o USING (user_id)""",
    "limited_requests": """WITH RECURSIVE r AS (SELECT event_type AS k, event_id AS id, CAST(floor(epoch_us(ts) / 400.0) AS BIGINT) AS a, CAST(floor(coalesce(value, 0)) + 1 AS BIGINT) AS n FROM events), q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a, id) AS i FROM r),
      w(k, i, id, a, sent_at, outcome, times, toks, day, used, clock) AS (
        SELECT DISTINCT k, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::BIGINT[], []::BIGINT[], -1::BIGINT, 0::BIGINT, -1::BIGINT FROM q
        UNION ALL SELECT k, i, id, a, CASE WHEN o = 'sent' THEN t END, o, CASE WHEN o = 'sent' THEN list_append(times, t) ELSE times END[-40:], CASE WHEN o = 'sent' THEN list_append(toks, n) ELSE toks END[-40:],
          CASE WHEN o = 'sent' THEN (t // 1000000 - 28800) // 86400 ELSE day END, CASE WHEN o <> 'sent' THEN used WHEN (t // 1000000 - 28800) // 86400 = day THEN used + 1 ELSE 1 END, CASE WHEN o = 'sent' THEN t ELSE clock END
        FROM (SELECT *, CASE WHEN n > 150 THEN 'never' WHEN day = (greatest(a, clock) // 1000000 - 28800) // 86400 AND used >= 900 THEN 'quota' ELSE 'sent' END AS o,
            list_min(list_filter(list_prepend(greatest(a, clock), list_transform(times, lambda x: x + 60000000)), lambda c: c >= greatest(a, clock) AND len(list_filter(times, lambda x: x > c - 60000000)) < 5
              AND n + coalesce(list_sum(list_transform(list_filter(list_zip(times, toks), lambda z: z[1] > c - 60000000), lambda z: z[2])), 0) <= 150)) AS t
          FROM (SELECT q.k, q.i, q.id, q.a, q.n, w.times, w.toks, w.day, w.used, w.clock FROM w JOIN q ON q.k = w.k AND q.i = w.i + 1) x) y)
      SELECT k AS event_type, id AS event_id, a AS "at", sent_at, outcome FROM w WHERE i > 0""",
    "run_log": "SELECT CASE WHEN o_orderkey % 4 <> 0 THEN 'ok' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "all_reasons": "SELECT concat_ws(',', CASE WHEN o_totalprice < 50000 THEN 'small' END, CASE WHEN o_orderstatus = 'F' THEN 'closed' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'low' END) AS reasons, count(*) AS n FROM orders GROUP BY 1",
    "staleness": "SELECT CASE WHEN event_type = 'error' THEN true WHEN event_type <> 'view' THEN value > 40 END AS stale, count(*) AS n FROM events GROUP BY 1",
    "json_membership": "SELECT max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey <= 9000",
    "round_robin": "SELECT b.item_id, n.n_nationkey FROM (SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) % (SELECT count(*) FROM nation) AS i FROM benchmark) b JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) n ON b.i = n.i",
    "label_cells": "SELECT l_orderkey, concat_ws('|', CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' END, CASE WHEN bool_or(l_returnflag = 'A') THEN 'A' END, CASE WHEN bool_or(l_returnflag = 'N') THEN 'N' END) AS aspects FROM lineitem GROUP BY 1",
    "parsed_cells": "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'a|b' ELSE 'c' END AS cell, count(*) AS n FROM orders GROUP BY 1",
    "list_parts": "SELECT part, count(*) AS n FROM (SELECT o_orderstatus AS part FROM orders UNION ALL SELECT o_orderpriority FROM orders) GROUP BY 1",
    "index_filter": f"WITH {REVIEWS_SQL} SELECT count(*) AS n, sum(minutes)::BIGINT AS minutes FROM reviews WHERE entity = 'N' AND version BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND positive AND run_id <= 5 AND minutes < 600",
    "index_over_cap": f"WITH {_O} SELECT o_orderpriority AS entity, count(*) AS n FROM o WHERE NOT EXISTS (SELECT 1 FROM o a WHERE a.o_totalprice > 490000 AND a.o_orderpriority = o.o_orderpriority AND abs(a.day - o.day) <= 10) GROUP BY 1 HAVING count(*) > 100",
    "quality_log": "SELECT 7 AS run_id, 'unique' AS check, 'warn' AS severity, l_orderkey, l_suppkey FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1",
    "held_quotes": r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), q AS (SELECT doc_id, t, CASE WHEN doc_id % 9 <> 0 THEN array_to_string(string_split(t, ' ')[3:6], ' ') END AS q FROM d)
      SELECT a.doc_id, contains(a.t, a.q) AS own, contains(a.t, b.q) AS before FROM q a LEFT JOIN q b ON b.doc_id + 1 = a.doc_id""",
    "shared_runs": f"""WITH b AS (SELECT item_id, list_filter({_TOKENS.format('text')}, lambda x: x <> '') AS w FROM benchmark), r AS (SELECT item_id, len(w) AS n, {_RUN8} AS runs FROM b)
      SELECT a.item_id, a.n >= 8 AS own, a.n >= 8 AND z.n >= 8 AND list_has_any(a.runs, z.runs) AS next FROM r a JOIN r z ON z.item_id = a.item_id + 1""",
    "json_values": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS value FROM events",
    "stage_times": "SELECT o_orderkey, o_custkey::DOUBLE AS read, o_orderkey + 0.5::DOUBLE AS score, 2 AS n FROM orders",
    "local_midnights": "SELECT event_id, strftime(CAST(ts - INTERVAL 8 HOUR AS DATE) + INTERVAL 32 HOUR, '%Y-%m-%d %H:%M:%S') AS midnight, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events",
    "row_fingerprints": "SELECT c_custkey, sha256(c_custkey || '|' || c_mktsegment || '|' || c_nationkey) AS fp FROM customer",
    "evidence_fingerprints": """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS fp FROM customer""",
    "asked_questions": r"SELECT sha256(q) AS q, count(*) AS n FROM (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q FROM conversations WHERE role = 'user') GROUP BY 1",
    "sigmoids": "SELECT event_id, round(1 / (1 + exp(-(value - 30) / 10)), 9) AS p FROM events",
    "pooled_vectors": """WITH v AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE + embedding[len(embedding) + 1 - i]::DOUBLE) / 2) AS m FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(m, m)) AS z FROM v)
      SELECT vec_id, round(m[1] / greatest(z, 1e-12), 6) AS first, round(m[len(m)] / greatest(z, 1e-12), 6) AS last FROM n""",
    "directions": "WITH k AS (SELECT o_orderkey % 3 AS k, CASE WHEN o_orderstatus = 'F' THEN 200000 - o_totalprice ELSE o_totalprice - 200000 END AS s FROM orders) SELECT CASE k WHEN 0 THEN s > 0 WHEN 1 THEN s < 0 ELSE true END AS holds, count(*) AS n FROM k GROUP BY 1",
    "verified_claims": r"""WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS w, count(*) FILTER (o_orderstatus = 'F') AS b,
        100.0 * count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') / nullif(count(*) FILTER (o_orderstatus = 'O'), 0) - 100.0 * count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') / nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS change FROM orders GROUP BY 1
      ), k AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS st, round(change, 4) AS actual, coalesce(round(change, 1), 0) AS about, change, w, b, round(o_totalprice / 50000 - 4, 2) AS e FROM orders JOIN c USING (o_custkey)
      ), v AS (SELECT *, about + CASE WHEN k % 4 = 0 THEN 3 ELSE 0 END AS value, abs(about) + CASE WHEN k % 8 = 4 THEN 2.2 ELSE 0 END AS stated, CASE WHEN k % 3 = 2 THEN 0 WHEN k % 3 = 1 OR change > 0 THEN 1 ELSE -1 END AS way, k % 5 = 0 OR k % 10 = 0 AS causal FROM k
      ), r AS (SELECT *, CASE WHEN NOT causal THEN NULL WHEN k % 25 = 0 THEN 'no_estimate_cited' WHEN k % 20 = 0 THEN 'no_estimate' WHEN e - 1 <= 0 AND e + 1 >= 0 THEN 'range_includes_zero' WHEN k % 15 = 0 AND k % 2 = 1 THEN 'placebo_failed' WHEN k % 35 = 0 THEN 'confounded' WHEN k % 4 = 2 THEN 'review_bomb' END AS blocked_by,
          change IS NOT NULL AND abs(value - actual) <= 0.5 + 1e-9 AND k % 13 <> 0 AND (abs(stated - abs(value)) <= 0.5 + 1e-9 OR least(abs(stated - abs(value)), abs(stated - abs(coalesce(actual, 1e9))), abs(stated - w), abs(stated - b)) <= 0.05 + 1e-9)
          AND (value = 0 OR way = 0 OR sign(way) = sign(CASE WHEN k % 7 = 0 THEN -value ELSE value END)) AS v2 FROM v
      ), f AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'withheld:V1' WHEN NOT v2 THEN 'withheld:V2' WHEN k % 19 = 0 OR (k % 6 = 1 AND p <> '5-LOW') THEN 'withheld:V3' WHEN blocked_by LIKE 'no_estimate%' THEN 'withheld:V4'
          WHEN blocked_by IS NULL AND k % 10 <> 0 AND k % 5 = 0 THEN 'withheld:V5' WHEN k % 11 = 0 AND blocked_by IS NULL THEN 'withheld:V7' WHEN blocked_by IS NOT NULL THEN 'reworded:V4' ELSE 'shipped' END AS decision FROM r)
      SELECT decision, blocked_by, count(*) AS n, sum(w + b) FILTER (decision NOT LIKE 'withheld%')::BIGINT AS basis, count(*) FILTER (decision = 'reworded:V4') AS hedged FROM f GROUP BY 1, 2""",
    "blame_counts": "SELECT o_orderstatus, count(*) FILTER (o_orderkey % 3 = 0) AS drafted, count(*) FILTER (o_orderkey % 6 = 0) AS shipped FROM orders GROUP BY 1",
    "summaries": "SELECT o_orderkey % 2 = 0 OR o_orderkey = 1 OR o_orderkey BETWEEN 1990 AND 2100 AS holds, count(*) AS n FROM orders GROUP BY 1",
    "supported_categories": "SELECT CASE WHEN o_totalprice > 250000 THEN 'price' WHEN o_orderkey % 2 = 0 THEN 'composition' ELSE 'none' END AS category, count(*) AS n FROM orders GROUP BY 1",
    "injected_cases": f"WITH b AS (SELECT item_id, list_filter({_TOKENS.format('text')}, lambda x: x <> '') AS w FROM benchmark) SELECT item_id, len(w) >= 8 AS in_draft, item_id % 2 = 0 AS in_report FROM b",
    "weekly_agreement": f"""WITH {GUESS_SQL}, g AS (SELECT doc_id % 5 AS week, lang, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn FROM guess GROUP BY 1, 2), h AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM g)
      SELECT week, lang, round(f, 6) AS f1, tp + fn AS support, round(avg(CASE WHEN tp + fn > 0 THEN f END) OVER (PARTITION BY week), 6) AS macro_f1 FROM h""",
    "model_differences": f"""WITH {GUESS_SQL}, r AS (SELECT doc_id, m.model, CAST((p >= m.cut) = truth AS INT) AS v FROM guess, (VALUES ('a', 0.3::DOUBLE), ('b', 0.5::DOUBLE), ('c', 0.7::DOUBLE)) m(model, cut))
      SELECT x.model AS model_a, y.model AS model_b, round(avg(x.v - y.v), 9) AS difference, count(*) AS cases FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.model < y.model GROUP BY 1, 2""",
    "chosen_model": "WITH k AS (SELECT user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY 1), b AS (SELECT max(m) AS best FROM k WHERE m >= 10) SELECT user_id FROM k, b WHERE m >= 10 AND m >= best - 1 ORDER BY n, m DESC LIMIT 1",
    "cross_validated": f"""WITH {GUESS_SQL}, g AS (SELECT *, doc_id % 4 AS fold FROM guess), t AS (SELECT k.k, g.* FROM g, (VALUES (0), (1), (2), (3)) k(k) WHERE g.fold <> k.k),
      e AS (SELECT k, lang, p, count(*) FILTER (truth) AS h, count(*) AS n FROM t GROUP BY 1, 2, 3), w AS (SELECT k, lang, p, 2 * sum(h) OVER d / (sum(n) OVER d + sum(h) OVER (PARTITION BY k, lang)) AS f1, coalesce(lead(p) OVER d, 0) AS below, sum(h) OVER (PARTITION BY k, lang) AS pos FROM e WINDOW d AS (PARTITION BY k, lang ORDER BY p DESC)),
      c AS (SELECT k, lang, CASE WHEN pos > 0 THEN (p + below) / 2 ELSE 0.5 END AS cut FROM w QUALIFY row_number() OVER (PARTITION BY k, lang ORDER BY f1 DESC, p DESC) = 1),
      j AS (SELECT g.lang, g.truth, g.p >= c.cut AS said FROM g JOIN c ON g.fold = c.k AND g.lang = c.lang)
      SELECT lang, round(coalesce(2 * count(*) FILTER (truth AND said) / nullif(2 * count(*) FILTER (truth AND said) + count(*) FILTER (truth <> said), 0), 0), 6) AS f1 FROM j GROUP BY 1""",
    "mean_of_known": "SELECT user_id, round(avg(value) FILTER (event_type <> 'view'), 6) AS mean, count(*) FILTER (event_type <> 'view') AS counted, count(*) FILTER (event_type = 'view') AS left_out FROM events GROUP BY 1",
    "exported_pool": "SELECT l.doc_id AS item_id, l.doc_id % 9 AS query_id, quality AS grade, d.lang, CAST(length(d.text) AS INT) AS size, v.label FROM labels l JOIN documents d ON l.doc_id = d.doc_id LEFT JOIN embeddings v ON v.vec_id = l.doc_id",
    "newest_texts": f"WITH {_O} SELECT o_orderkey FROM o ORDER BY day DESC, o_orderkey LIMIT 256",
    "acceptance_picks": "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5",
    "ranking_files": "SELECT 'bm25' AS system, 'base' AS variant, user_id AS query_id, CAST(k AS INT) AS rank, event_id AS item_id, printf('%.6f', value) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 10",
    "equal_parts": "WITH l AS (SELECT DISTINCT lang FROM documents), n AS (SELECT lang, row_number() OVER (ORDER BY lang) AS k, count(*) OVER () AS c FROM l) SELECT lang, CAST(least(25, 90 // c + CASE WHEN k <= 90 % c THEN 1 ELSE 0 END) AS BIGINT) AS n FROM n",
    "plain_pages": r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\{[A-Z_]+\}\S*', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
      SELECT page_id, sha256(substr(t, 1, 400)) AS text, length(t) > 400 AS cut FROM p""",
    "clean_text": r"""WITH a AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
      b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\[/?(?:h1|h2|h3|list|olist|\*|quote|code|table|tr|th|td|hr|previewyoutube)(?:=[^\]]*)?\]', chr(10), 'g'), '(?i)\[/?(?:b|i|u|strike|spoiler|noparse|url|img)(?:=[^\]]*)?\]', '', 'g'), '(?i)(?:https?://|www\.)\S+', '<url>', 'g'), '[^\S\n]+', ' ', 'g') AS t FROM a),
      c AS (SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)), '') AS t FROM b),
      h AS (SELECT doc_id, t, substr(t, 1, 2000) AS head, replace(substr(t, 1, 2000), chr(10), ' ') AS flat FROM c)
      SELECT doc_id, sha256(CASE WHEN length(t) <= 2000 THEN t WHEN strpos(flat, ' ') > 0 AND 2000 - strpos(reverse(flat), ' ') >= 1000 THEN rtrim(substr(head, 1, 2000 - strpos(reverse(flat), ' '))) ELSE head END) AS clean FROM h""",
}
