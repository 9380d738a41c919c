"""Queries of the warehouse: versions, marts, joins, merges, text columns and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import rules
from ..operators import checks, joins, retrieval, series, versions
from .tables import REVIEWS_SQL, WILSON_SQL, latest_reviews, read, reviews


def latest_version(s: SparkSession, d: str) -> DataFrame:
    return latest_reviews(s, d).select("review_id", "version", "run_id", "positive", "minutes")


def seen_runs(s: SparkSession, d: str) -> DataFrame:
    r = reviews(s, d).withColumns({"first_run": F.col("run_id"), "last_run": F.col("run_id")})
    order = [F.col(x).desc() for x in ("version", "run_id", "part", "supplier", "price")]
    return versions.latest_with_history(r, ["review_id"], order, "first_run", "last_run").select("review_id", "version", "first_run", "last_run")


def latest_score_long(s: SparkSession, d: str) -> DataFrame:
    l = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax")
    top = versions.latest(l, ["l_orderkey"], [F.col(x).desc() for x in ("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")])
    top = top.withColumns({"d_on": F.col("l_discount") >= 0.05, "t_on": F.col("l_tax") >= 0.05})
    return joins.unpivoted(top, ["l_orderkey"], {"discount": ("l_discount", "d_on"), "tax": ("l_tax", "t_on")}, ("p", "label"), "code")


#: Beginnings of titles, so that versions, counts and words of every rule meet the texts and pages behind them.
OPENERS = (
    "", "Deep Harbour: 7.1.0", "Deep Harbour: 7.0.0", "Patch 1.2.0 ", "0.1.0", "Version 1.0.0.5", "v1.0 launch", "Farming 2.0 -", "3.0 million players",
    "1.5x rewards", "(7.0)", "1.0f1 -", "5.00c", "Ver.1.030", "Hot-fix", "Beta 0.8.110", "coming soon", "River update out now", "50% off", "Festival", "2.0 – 3.1.0",
)


def announcement_classes(s: SparkSession, d: str) -> DataFrame:
    """Classes of the first lines of documents and of the titles of pages, each behind one of the openers."""
    k = F.array(*map(F.lit, OPENERS))

    def titled(key: str, text: str) -> Column:
        return F.concat_ws(" ", F.element_at(k, (F.pmod(F.col(key), F.lit(len(OPENERS))) + 1).cast("int")), text)

    docs = read(s, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), titled("doc_id", F.regexp_extract("text", r"^[^\n]*", 0)).alias("title"), F.when(F.col("source") != "src0", "official").alias("feed"))
    pages = read(s, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), titled("page_id", F.regexp_extract("html", r"<title>([^<\n]*)", 1)).alias("title"), F.when(F.col("page_id") % 9 == 0, "press").otherwise("official").alias("feed"))
    rows = docs.unionByName(pages).withColumns({"tags": F.when(F.col("id") % 8 == 3, F.array(F.lit("patchnotes"))).when(F.col("id") % 8 != 5, F.array(F.lit("news"))), "entity": (F.col("id") % 10).cast("int")})
    c = rules.announcement_class("title", "feed", "tags", "entity", {4: r"(?i)^river\b"})
    return rows.select("kind", "id", c.alias("c")).select("kind", "id", "c.*")


def playtime_bucket(s: SparkSession, d: str) -> DataFrame:
    return reviews(s, d).groupBy(c.bucket_of_minutes("minutes").alias("bucket")).agg(F.count("*").alias("n"))


def length_eligibility(s: SparkSession, d: str) -> DataFrame:
    ok = c.long_enough("text", "lang", chars=400, words=60, unspaced=("de",))
    return read(s, d, "documents").groupBy("lang").agg(F.count_if(ok).alias("eligible"), F.sum(c.word_count("text")).cast("long").alias("words"))


def hash_holdout(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", c.in_holdout("doc_id").alias("held_out"))


def date_dimension(s: SparkSession, d: str) -> DataFrame:
    """Every day from the first order to the last, whether or not it has orders, with its attributes."""
    ends = read(s, d, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.select("day", *[v.alias(k) for k, v in c.calendar("day").items()])


def _daily(s: SparkSession, d: str) -> DataFrame:
    r = latest_reviews(s, d)
    return r.groupBy("entity", F.col("version").alias("day")).agg(
        F.count("*").alias("n"), F.count_if("positive").alias("x"), F.count_if(F.col("minutes") < 600).alias("new")
    )


def daily_sentiment(s: SparkSession, d: str) -> DataFrame:
    """Counts, share, its interval and the share of new players for every day of each entity."""
    dense = series.dense(_daily(s, d), ["entity"], "day", ["n", "x", "new"])
    lo, hi = c.wilson("x", "n")
    return dense.select("entity", "day", "n", "x", F.round(c.ratio("x", "n"), 6).alias("share"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), F.round(c.ratio("new", "n"), 6).alias("new_share"))


def bucket_sentiment(s: SparkSession, d: str) -> DataFrame:
    r = reviews(s, d)
    return r.groupBy("entity", F.coalesce(c.bucket_of_minutes("minutes"), F.lit("unknown")).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if("positive").alias("x"), F.percentile("minutes", 0.5).alias("median")
    )


def daily_label_share(s: SparkSession, d: str) -> DataFrame:
    """Language by label cells, dense, with mentions among labelled documents."""
    docs = read(s, d, "documents").select("doc_id", "lang")
    labels = read(s, d, "labels")
    long = joins.unpivoted(labels, ["doc_id"], {"quality": ("quality",), "toxic": ("toxic",)}, ("on",), "code")
    facts = docs.join(long, "doc_id").groupBy("lang", "code").agg(F.count("*").alias("scored"), F.count_if(F.col("on") == 1).alias("mentions"))
    codes = s.createDataFrame([("quality",), ("toxic",), ("absent",)], "code string")
    dense = joins.densified(docs.select("lang").distinct(), codes, facts, ["lang", "code"], ["scored", "mentions"])
    return dense.select("lang", "code", "scored", "mentions", F.round(c.ratio("mentions", "scored"), 6).alias("share"))


def _urgent(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000")
    return o.select("o_orderstatus", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")


def event_window(s: SparkSession, d: str) -> DataFrame:
    """Rows 14 days before to 13 after large urgent orders of a status."""
    anchors = _urgent(s, d).select(F.col("o_orderkey").alias("event"), F.col("o_orderstatus").alias("status"), F.col("day").alias("start"))
    days = series.days_around(anchors.withColumn("day", F.col("start")), "day", 14, 13)
    price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total")
    o = read(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"), price)  # a row for each day
    both = days.join(o, ["status", "day"])
    after = F.col("day") >= F.col("start")

    def of(side: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(side, F.col(name))), F.lit(0))

    return both.groupBy("event").agg(of(~after, "n").alias("n_pre"), of(after, "n").alias("n_post"), F.sum(F.when(after, F.col("total"))).cast("double").alias("post_total"))


def comparison_counts(s: SparkSession, d: str) -> DataFrame:
    """Stored daily counts win over a seed for the same day."""
    o = read(s, d, "orders").select(F.col("o_orderstatus").alias("entity"), F.col("o_orderdate").cast("date").alias("day"))
    stored = o.where("year(day) >= 1997").groupBy("entity", "day").agg(F.count("*").alias("n"))
    seed = o.where("year(day) <= 1998").groupBy("entity", "day").agg((F.count("*") * 0 - 1).alias("n"))
    return versions.overlaid(seed, stored, ["entity", "day"])


def index_membership(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("entity"), F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    anchors = _urgent(s, d).where("day < date'1996-01-01'").select(F.col("o_orderstatus").alias("entity"), "day").distinct()
    kept = retrieval.index_members(o, anchors, "entity", "day", [F.col("day").desc(), F.col("o_orderkey").desc()], 500, 10)
    kept = kept.withColumn("fingerprint", c.fingerprint("entity", "day", "o_orderpriority", charset="UTF-8"))
    return kept.select("o_orderkey", "recency_rank", "near", "fingerprint")


def _copies(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = read(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("version"))
    target = o.where("o_orderkey % 7 <> 0").withColumn("fp", F.concat("o_orderstatus", F.lit("a")))
    mirror = o.where("o_orderkey % 5 <> 0").select(
        "o_orderkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 11 == 0, F.date_add("version", -1)).otherwise(F.col("version")).alias("version"),
        F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "b").otherwise("a")).alias("fp"),
    )
    return target, mirror


def sync_plan(s: SparkSession, d: str) -> DataFrame:
    return versions.sync_plan(*_copies(s, d), ["o_orderkey"], "version", "fp")


def sync_applied(s: SparkSession, d: str) -> DataFrame:
    """The mirror after its plan equals the target."""
    target, mirror = _copies(s, d)
    return versions.synced(mirror, target, versions.sync_plan(target, mirror, ["o_orderkey"], "version", "fp"), ["o_orderkey"])


def upsert_result(s: SparkSession, d: str) -> DataFrame:
    target, mirror = _copies(s, d)
    return versions.upserted(mirror, target, ["o_orderkey"], ["version"], [F.col("version").desc()]).select("o_orderkey", "version", "fp")


def changed_days(s: SparkSession, d: str) -> DataFrame:
    r = reviews(s, d)
    day = F.col("version").alias("day")
    changed = versions.above_mark(r, "run_id", r.where("run_id <= 5")).select("entity", day)
    recent = r.groupBy("entity").agg(F.max("version").alias("m")).select("entity", F.explode(F.sequence(F.date_add("m", -3), F.col("m"))).alias("day"))
    flags = r.where("minutes > 2940").select("entity", day)
    return versions.affected_days(changed, recent, flags, ["entity", "day"])


def incremental_equals_full(s: SparkSession, d: str) -> DataFrame:
    """A mart built on early runs, then only its changed days again."""
    r = reviews(s, d).select("entity", F.col("version").alias("day"), "run_id", "positive")

    def mart(rows: DataFrame) -> DataFrame:
        return rows.groupBy("entity", "day").agg(F.count("*").alias("n"), F.count_if("positive").alias("x"))

    old = mart(r.where("run_id <= 4"))
    keys = r.where("run_id > 4").select("entity", "day").distinct()
    return versions.replaced(old, keys, mart(r.join(keys, ["entity", "day"], "left_semi")), ["entity", "day"])


def as_of_event(s: SparkSession, d: str) -> DataFrame:
    """The last purchase of a user at or before each of their events."""
    e = read(s, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(e.select("event_id", "user_id", "ts"), buys, ["user_id"], "ts", "value", "last_value").select("event_id", F.round("last_value", 6).alias("last_value"))


def newest_beside(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    cust = read(s, d, "customer").select("c_custkey")
    return joins.with_newest(cust, o, ["c_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey"])


def existence_flag(s: SparkSession, d: str) -> DataFrame:
    big = read(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.with_flag(read(s, d, "customer").select("c_custkey", "c_mktsegment"), big, ["c_custkey"], "has_big").groupBy("c_mktsegment", "has_big").agg(F.count("*").alias("n"))


def in_sale(s: SparkSession, d: str) -> DataFrame:
    sales = s.createDataFrame([("1996-06-20", "1996-07-05"), ("1997-12-20", "1998-01-05"), ("1998-01-01", "1998-01-10")], "start string, end string")
    sales = sales.select(F.col("start").cast("date"), F.col("end").cast("date"))
    o = read(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    return joins.in_intervals(o, sales, "day", "start", "end", "sale").groupBy("sale").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"))


def field_updates(s: SparkSession, d: str) -> DataFrame:
    """Operations of a write of two fields: their keys, summed up for each pair of values, are all rows once."""
    each = versions.field_updates(read(s, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    keys = each.select("o_orderstatus", "o_orderpriority", F.explode("keys").alias("key"))
    return keys.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.count_distinct("key").alias("operation_keys"))


def clean_text(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.sha2(c.clean_text("text"), 256).alias("clean"))


def plain_pages(s: SparkSession, d: str) -> DataFrame:
    text, cut = c.plain_notes("html")
    return read(s, d, "pages").select("page_id", F.sha2(text, 256).alias("text"), cut.alias("cut"))


def json_payload(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    return e.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def stated_numbers(s: SparkSession, d: str) -> DataFrame:
    v = read(s, d, "documents").select("doc_id", F.explode(c.stated_numbers("text")).alias("v"))
    return v.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("v.value").alias("largest"), F.sum("v.decimals").cast("long").alias("decimals"))


def quality_report(s: SparkSession, d: str) -> DataFrame:
    """Violations of each rule over the tables."""
    l, o, docs, e = (read(s, d, t) for t in ("lineitem", "orders", "documents", "events"))
    cust = read(s, d, "customer")
    return checks.report(
        {
            "not_null": checks.nulls(docs, "text"),
            "unique": checks.repeated(e, ["event_id"]),
            "unique_pair": checks.repeated(l, ["l_orderkey", "l_linenumber"]),
            "references": checks.orphans(o, cust, {"o_custkey": "c_custkey"}),
            "accepted": checks.unaccepted(o, "o_orderstatus", ["F", "O"]),
            "in_unit": checks.outside_unit(l, "l_discount"),
            "within": checks.more_than(l, "l_discount", "l_tax"),
        }
    )


def totals_reconcile(s: SparkSession, d: str) -> DataFrame:
    r = reviews(s, d)
    daily = r.where("run_id < 7").groupBy("entity", "version").agg(F.count("*").alias("n"))
    parts = r.groupBy("entity", "version", c.bucket_of_minutes("minutes").alias("b")).agg(F.count("*").alias("n"))
    return checks.unreconciled(daily, parts, ["entity", "version"], ["n"]).select("entity", "version")


def reconcile_counts(s: SparkSession, d: str) -> DataFrame:
    target, mirror = _copies(s, d)
    return versions.reconciled(target, mirror, ["o_orderstatus"])


def strays(s: SparkSession, d: str) -> DataFrame:
    target, mirror = _copies(s, d)
    return versions.strays_and_lacking(mirror, target, ["o_orderkey"])


def outranked_scores(s: SparkSession, d: str) -> DataFrame:
    r = reviews(s, d).withColumn("model", F.when(F.col("part") % 2 == 0, "a").otherwise("b"))
    return versions.outranked(r, ["review_id"], "model", "run_id", "a").groupBy("entity").agg(F.count("*").alias("n"))


def recent_per_entity(s: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey"))
    return read(s, d, "customer").withColumn("rank", rank).where("rank <= 5").select("c_nationkey", "rank", "c_custkey")


QUERIES = {f.__name__: f for f in (
    latest_version, seen_runs, latest_score_long, announcement_classes, playtime_bucket, length_eligibility, hash_holdout, date_dimension,
    daily_sentiment, bucket_sentiment, daily_label_share, event_window, comparison_counts, index_membership, sync_plan, sync_applied,
    upsert_result, changed_days, incremental_equals_full, as_of_event, newest_beside, existence_flag, in_sale, field_updates, clean_text,
    plain_pages, json_payload, stated_numbers, quality_report, totals_reconcile, reconcile_counts, strays, outranked_scores, recent_per_entity,
)}

_BUCKET = "CASE WHEN minutes IS NULL THEN NULL WHEN minutes < 120 THEN 'lt_2h' WHEN minutes < 600 THEN '2h_10h' WHEN minutes < 3000 THEN '10h_50h' WHEN minutes < 12000 THEN '50h_200h' ELSE '200h_plus' END"
_COPIES = """
o AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS version FROM orders),
t AS (SELECT *, o_orderstatus || 'a' AS fp FROM o WHERE o_orderkey % 7 <> 0),
m AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN version - 1 ELSE version END AS version,
  o_orderstatus || CASE WHEN o_orderkey % 13 = 0 THEN 'b' ELSE 'a' END AS fp FROM o WHERE o_orderkey % 5 <> 0)"""
_WORDS = "CASE WHEN length(trim(replace(replace(text, chr(13), ' '), chr(10), ' '))) = 0 THEN 0 ELSE length(trim(replace(replace(text, chr(13), ' '), chr(10), ' '))) - length(replace(trim(replace(replace(text, chr(13), ' '), chr(10), ' ')), ' ', '')) + 1 END"

SQL = {
    "latest_version": f"WITH {REVIEWS_SQL} SELECT review_id, version, run_id, positive, minutes FROM latest",
    "seen_runs": f"WITH {REVIEWS_SQL} SELECT l.review_id, l.version, s.a AS first_run, s.b AS last_run FROM latest l JOIN (SELECT review_id, min(run_id) a, max(run_id) b FROM reviews GROUP BY 1) s ON l.review_id = s.review_id",
    "latest_score_long": """WITH top AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
      SELECT l_orderkey, 'discount' AS code, l_discount AS p, l_discount >= 0.05::DOUBLE AS label FROM top UNION ALL SELECT l_orderkey, 'tax', l_tax, l_tax >= 0.05::DOUBLE FROM top""",
    "announcement_classes": rf"""WITH o AS (SELECT {list(OPENERS)!r} AS k), t AS (
        SELECT 'document' AS kind, doc_id AS id, concat_ws(' ', k[CAST(doc_id % len(k) AS INT) + 1], regexp_extract(text, '^[^\n]*')) AS title, CASE WHEN source <> 'src0' THEN 'official' END AS feed FROM documents, o
        UNION ALL SELECT 'page', page_id, concat_ws(' ', k[CAST(page_id % len(k) AS INT) + 1], regexp_extract(html, '<title>([^<\n]*)', 1)), CASE WHEN page_id % 9 = 0 THEN 'press' ELSE 'official' END FROM pages, o
      ), b AS (SELECT *, lower(title) AS l, coalesce(feed, '') = 'official' AS official, regexp_extract_all(regexp_replace(title, '(\d[a-z]?\d*)\s*(?i:million|thousand|billion)\b', '\1%', 'g'),
        '((^|[:(\[]\s*|[-–—]\s*|\b(?i:version|ver\.?|v|update|patch)\s*)[vV]?\d+(\.\d+)+([a-z]\d+|[a-jln-wyz])?|\b\d+(\.\d+){{2,}}([a-z]\d+|[a-jln-wyz])?|\b\d+\.\d+([a-z]\d+|[a-jln-wyz]))([^\w%]|$)') AS builds FROM t
      ), v AS (SELECT *, len(list_filter(builds, lambda x: regexp_matches(regexp_extract(x, '\b[vV]?\d+\.\d+(\.\d+)?([a-z]\d+)?\b'), '^[vV]?0*[1-9]\d*\.0+(\.0+)?([a-z]\d+)?$'))) > 0 AS major FROM b
      ), r AS (SELECT kind, id, CASE WHEN NOT official THEN 'not_official' WHEN regexp_matches(l, '\bbeta\b|\bexperimental\b|\bstress test|\bplaytest|\bpublic test|\btest server|\btest branch') THEN 'test_build' WHEN regexp_matches(l, '\bhot-?fix') THEN 'hotfix_keyword'
        WHEN regexp_matches(l, '\b(coming|upcoming|incoming|preview|showcase|maintenance|releasing|plans|roadmap)\b|\bannounc|\bdelay|\bpostpone|\bdev diary|\bdeveloper diary|\blivestream|\ban update (on|regarding|about)\b|\b(available|launches|arrives)\s+(on\s+)?(monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december)\b') THEN 'announcement'
        WHEN id % 10 = 4 AND regexp_matches(l, '^river\b') THEN 'studio_release_title' WHEN major OR regexp_matches(l, '\bmajor update\b|\bremaster|\bupdate\b.*\b(out now|is live|now live|available now)\b') THEN 'major_update_signal'
        WHEN id % 8 = 3 OR len(builds) > 0 OR regexp_matches(l, '\bpatch\b') THEN 'patch_signal' WHEN regexp_matches(l, '\b(sale|awards?|vote|trailer|bundle)\b|\bsave \d+%|\d+% off|\bdiscount|\bmerch|\bwishlist|\bpre-?order|copies sold') THEN 'marketing_keyword'
        WHEN regexp_matches(l, '\b(anniversary|festival|event|expedition|tournament)\b|\bcelebrat') THEN 'event_keyword' ELSE 'no_rule' END AS rule FROM v)
      SELECT kind, id, rule, rule = 'no_rule' AS ambiguous, CASE rule WHEN 'hotfix_keyword' THEN 'hotfix' WHEN 'studio_release_title' THEN 'major_update' WHEN 'major_update_signal' THEN 'major_update' WHEN 'patch_signal' THEN 'patch' WHEN 'marketing_keyword' THEN 'marketing' WHEN 'event_keyword' THEN 'event' ELSE 'other' END AS type FROM r""",
    "playtime_bucket": f"WITH {REVIEWS_SQL} SELECT {_BUCKET} AS bucket, count(*) AS n FROM reviews GROUP BY 1",
    "length_eligibility": f"SELECT lang, count(*) FILTER (CASE WHEN lang = 'de' THEN length(text) >= 400 ELSE {_WORDS} >= 60 END) AS eligible, sum({_WORDS})::BIGINT AS words FROM documents GROUP BY lang",
    "hash_holdout": "SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) < '33' AS held_out FROM documents",
    "date_dimension": "SELECT CAST(d AS DATE) AS day, CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, CAST(week(d) AS INT) AS iso_week, CAST(isodow(d) AS INT) AS day_of_week, CAST(month(d) AS INT) AS month, CAST(year(d) AS INT) AS year FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders)",
    "daily_sentiment": f"""WITH {REVIEWS_SQL}, c AS (SELECT entity, version AS day, count(*) AS n, count(*) FILTER (positive) AS x, count(*) FILTER (minutes < 600) AS new FROM latest GROUP BY 1, 2),
      ends AS (SELECT entity, min(day) a, max(day) b FROM c GROUP BY 1), spine AS (SELECT entity, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ends),
      f AS (SELECT s.entity, s.day, coalesce(n, 0) AS n, coalesce(x, 0) AS x, coalesce(new, 0) AS new, 1.6449::DOUBLE AS z FROM spine s LEFT JOIN c ON s.entity = c.entity AND s.day = c.day)
      SELECT entity, day, n, x, CASE WHEN n > 0 THEN round(x / n, 6) END AS share, {WILSON_SQL}, CASE WHEN n > 0 THEN round(new / n, 6) END AS new_share FROM f""",
    "bucket_sentiment": f"WITH {REVIEWS_SQL} SELECT entity, {_BUCKET} AS bucket, count(*) AS n, count(*) FILTER (positive) AS x, quantile_cont(minutes, 0.5)::DOUBLE AS median FROM reviews GROUP BY 1, 2",
    "daily_label_share": """WITH long AS (SELECT doc_id, 'quality' AS code, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels),
      f AS (SELECT lang, code, count(*) AS scored, count(*) FILTER (v = 1) AS mentions FROM documents d JOIN long l ON d.doc_id = l.doc_id GROUP BY 1, 2),
      s AS (SELECT lang, code FROM (SELECT DISTINCT lang FROM documents) a, (VALUES ('quality'), ('toxic'), ('absent')) b(code))
      SELECT s.lang, s.code, coalesce(scored, 0) AS scored, coalesce(mentions, 0) AS mentions, CASE WHEN scored > 0 THEN round(mentions / scored, 6) END AS share FROM s LEFT JOIN f ON s.lang = f.lang AND s.code = f.code""",
    "event_window": """WITH a AS (SELECT o_orderkey AS event, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS start FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)
      SELECT event, count(*) FILTER (CAST(o.o_orderdate AS DATE) < start) AS n_pre, count(*) FILTER (CAST(o.o_orderdate AS DATE) >= start) AS n_post, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) FILTER (CAST(o.o_orderdate AS DATE) >= start) AS DOUBLE) AS post_total
      FROM a JOIN orders o ON o.o_orderstatus = a.status AND CAST(o.o_orderdate AS DATE) BETWEEN start - 14 AND start + 13 GROUP BY event""",
    "comparison_counts": """WITH o AS (SELECT o_orderstatus AS entity, CAST(o_orderdate AS DATE) AS day FROM orders), st AS (SELECT entity, day, count(*) AS n FROM o WHERE year(day) >= 1997 GROUP BY 1, 2)
      SELECT * FROM st UNION ALL SELECT DISTINCT entity, day, -1 FROM o WHERE year(day) <= 1998 AND NOT EXISTS (SELECT 1 FROM st WHERE st.entity = o.entity AND st.day = o.day)""",
    "index_membership": """WITH o AS (SELECT o_orderkey, o_orderstatus AS entity, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders),
      a AS (SELECT o_orderstatus AS entity, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000 AND CAST(o_orderdate AS DATE) < DATE '1996-01-01'),
      r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC, o_orderkey DESC) AS recency_rank, EXISTS (SELECT 1 FROM a WHERE a.entity = o.entity AND o.day BETWEEN a.day - 10 AND a.day + 10) AS near FROM o)
      SELECT o_orderkey, CAST(recency_rank AS INT) AS recency_rank, near, sha256(entity || '|' || CAST(day AS VARCHAR) || '|' || o_orderpriority) AS fingerprint FROM r WHERE recency_rank <= 500 OR near""",
    "sync_plan": f"""WITH {_COPIES} SELECT coalesce(t.o_orderkey, m.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'delete' WHEN m.o_orderkey IS NULL OR t.version <> m.version THEN 'upsert' ELSE 'update' END AS action
      FROM t FULL JOIN m ON t.o_orderkey = m.o_orderkey WHERE t.o_orderkey IS NULL OR m.o_orderkey IS NULL OR t.version <> m.version OR t.fp <> m.fp""",
    "sync_applied": f"WITH {_COPIES} SELECT * FROM t",
    "upsert_result": f"WITH {_COPIES} SELECT coalesce(m.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(t.version, m.version) AS version, coalesce(m.fp, t.fp) AS fp FROM m FULL JOIN t ON t.o_orderkey = m.o_orderkey",
    "changed_days": f"""WITH {REVIEWS_SQL} SELECT entity, version AS day FROM reviews WHERE run_id > 5 UNION SELECT entity, CAST(unnest(generate_series(m - 3, m, INTERVAL 1 DAY)) AS DATE) FROM (SELECT entity, max(version) AS m FROM reviews GROUP BY 1) UNION SELECT entity, version FROM reviews WHERE minutes > 2940""",
    "incremental_equals_full": f"WITH {REVIEWS_SQL} SELECT entity, version AS day, count(*) AS n, count(*) FILTER (positive) AS x FROM reviews GROUP BY 1, 2",
    "as_of_event": """WITH b AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
      SELECT e.event_id, round(b.value, 6) AS last_value FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.ts""",
    "newest_beside": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON c_custkey = o_custkey",
    "existence_flag": "SELECT c_mktsegment, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS has_big, count(*) AS n FROM customer GROUP BY 1, 2",
    "in_sale": """SELECT (d BETWEEN DATE '1996-06-20' AND DATE '1996-07-05' OR d BETWEEN DATE '1997-12-20' AND DATE '1998-01-10') AS sale, count(*) AS n, CAST(sum(CAST(p AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice AS p FROM orders) GROUP BY 1""",
    "field_updates": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderkey) AS first, count(*) AS operation_keys FROM orders GROUP BY 1, 2",
    "json_payload": "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "quality_report": """SELECT 'not_null' AS name, (SELECT count(*) FROM documents WHERE text IS NULL) AS violations
      UNION ALL SELECT 'unique', (SELECT count(*) FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1))
      UNION ALL SELECT 'unique_pair', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
      UNION ALL SELECT 'references', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
      UNION ALL SELECT 'accepted', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
      UNION ALL SELECT 'in_unit', (SELECT count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 1)
      UNION ALL SELECT 'within', (SELECT count(*) FROM lineitem WHERE l_discount > l_tax)""",
    "totals_reconcile": f"WITH {REVIEWS_SQL} SELECT entity, version FROM reviews GROUP BY 1, 2 HAVING count(*) FILTER (run_id < 7) > 0 AND count(*) FILTER (run_id < 7) <> count(*)",
    "reconcile_counts": f"WITH {_COPIES} SELECT t.o_orderstatus, n_target, n_mirror, abs(n_target - n_mirror) AS difference FROM (SELECT o_orderstatus, count(*) n_target FROM t GROUP BY 1) t JOIN (SELECT o_orderstatus, count(*) n_mirror FROM m GROUP BY 1) m ON t.o_orderstatus = m.o_orderstatus",
    "strays": f"WITH {_COPIES} SELECT o_orderkey, 'stray' AS side FROM m WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t) UNION ALL SELECT o_orderkey, 'lacking' FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM m)",
    "outranked_scores": f"WITH {REVIEWS_SQL} SELECT entity, count(*) AS n FROM reviews r WHERE part % 2 = 0 AND run_id < (SELECT max(run_id) FROM reviews o WHERE o.review_id = r.review_id AND o.part % 2 <> 0) GROUP BY 1",
    "recent_per_entity": "SELECT c_nationkey, CAST(rank AS INT) AS rank, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5",
}
