"""Queries that land pages made of the test tables and read them back through the paged source."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import paged
from .tables import read


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors see: under spark.checkpoint.dir, or a temporary one of a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}"
    return f"{named.rstrip('/')}/brightloom-{label}-{uuid.uuid4().hex}"


PAGE = 6
START, END = "2024-01-04 00:00:00", "2024-01-25 12:00:00"


#: Events of a folder, about; a folder has whole users.
FOLDER_EVENTS = 20_000


def _events(s: SparkSession, d: str) -> DataFrame:
    """Events newest first, numbered within their user, and dealt to the folders their pages are to land in."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    newest = Window.partitionBy("part", "user_id").orderBy(F.col("at").desc(), F.col("event_id").desc())
    e = read(s, d, "events")
    parts = max(s.sparkContext.defaultParallelism, -(-e.count() // FOLDER_EVENTS))
    e = e.select("user_id", "event_id", at.alias("at"), "event_type", F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int").alias("part"))
    return e.repartition(parts, "part").withColumn("n", F.row_number().over(newest) - 1)  # all that follows is by part and user


def _landed(pages: DataFrame, s: SparkSession) -> str:
    """pages (part, entity, request, cursor, items) as JSON lines in a folder for each part."""
    path = shared_folder(s, "pages")
    pages.select("part", F.to_json(F.struct("entity", "request", "cursor", "items")).alias("value")).write.partitionBy("part").text(path)
    return path


def _cursor_pages(s: SparkSession, d: str) -> str:
    """Pages of PAGE events that repeat the last one of the page before; the cursors of every fifth user lead back at
    the third page, and every seventh one's break off behind the second."""
    e = _events(s, d)
    both = F.explode(F.when((F.col("n") % PAGE == 0) & (F.col("n") > 0), F.array(F.floor(F.col("n") / PAGE), F.floor(F.col("n") / PAGE) - 1)).otherwise(F.array(F.floor(F.col("n") / PAGE))))
    item = F.struct(F.when(F.col("event_id") % 31 != 0, F.col("event_id")).alias("id"), "at", F.col("event_type").alias("kind"))
    pages = e.select("part", "user_id", "n", item.alias("item"), both.alias("page")).groupBy("part", "user_id", "page").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("i"))
    last = F.max("page").over(Window.partitionBy("part", "user_id"))
    here, empty = F.struct("page", F.col("i.item").alias("items")), F.struct((F.col("page") + 1).alias("page"), F.slice("i.item", 1, 0).alias("items"))
    pages = pages.withColumn("last", last).select("part", "user_id", F.inline(F.when(F.col("page") == F.col("last"), F.array(here, empty)).otherwise(F.array(here))))

    def cursor(k: Column) -> Column:
        return F.when(k == 0, paged.FIRST).otherwise(F.concat(F.lit("c"), k.cast("string")))

    k, u = F.col("page"), F.col("user_id")
    following = F.when((u % 5 == 0) & (k == 2), "c1").when((u % 7 == 0) & (k == 1), F.lit(None)).otherwise(cursor(k + 1))
    return _landed(pages.select("part", u.cast("string").alias("entity"), cursor(k).alias("request"), following.alias("cursor"), "items"), s)


def _seconds(time: str) -> Column:
    return F.unix_seconds(F.lit(time).cast("timestamp"))


def _walked(s: SparkSession, path: str, **options: object) -> DataFrame:
    paged.register(s)
    reader = s.read.format("paged").option("path", path).option("folders", 1)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def _window(s: SparkSession) -> dict[str, int]:
    start, end = s.range(1).select(_seconds(START), _seconds(END)).first()
    return {"start": start, "end": end}


def cursor_walks(s: SparkSession, d: str) -> DataFrame:
    """Pages of each user's walk and why it ends."""
    out = _walked(s, _cursor_pages(s, d), rows="pages", **_window(s))
    return out.withColumn("entity", F.col("entity").cast("long"))


def cursor_items(s: SparkSession, d: str) -> DataFrame:
    """Events that the walks keep."""
    out = _walked(s, _cursor_pages(s, d), **_window(s))
    return out.select(F.col("entity").cast("long").alias("entity"), "page", F.col("id").cast("long").alias("id"), "at", F.get_json_object("body", "$.kind").alias("kind"))


def history_walks(s: SparkSession, d: str) -> DataFrame:
    """Pages back in time from each user's newest event: a page has the PAGE newest events up to its start, that time's included."""
    e = _events(s, d)
    newest = read(s, d, "events").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0]
    if newest is None:
        newest = 0
    # the rows of a page are the PAGE events from the first at or before its start on, in the user's order
    order = Window.partitionBy("part", "user_id").orderBy(F.col("n"))
    items = F.collect_list(F.struct(F.col("event_id").alias("id"), "at")).over(order.rowsBetween(0, PAGE - 1))
    first = e.withColumns({"items": items, "_later": F.lag("at").over(order)}).where("_later is null or _later <> at")
    asked = F.explode(F.when(F.col("n") == 0, F.array_distinct(F.array(F.col("at"), F.lit(newest)))).otherwise(F.array("at")))
    pages = first.select("part", F.col("user_id").cast("string").alias("entity"), asked.alias("asked"), "items")
    path = _landed(pages.select("part", "entity", F.col("asked").cast("string").alias("request"), F.lit(None).cast("string").alias("cursor"), "items"), s)
    until = s.range(1).select(_seconds(START)).first()[0]
    out = _walked(s, path, rows="pages", walk="history", start=newest, until=until)
    return out.groupBy(F.col("entity").cast("long").alias("entity")).agg(F.count("*").alias("pages"), F.sum("kept").alias("kept"), F.sum("repeated").alias("repeated"), F.max("stop").alias("stop"))


QUERIES = {f.__name__: f for f in (cursor_walks, cursor_items, history_walks)}

_WALK = f"""e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS n FROM events),
  b AS (SELECT CAST(epoch(TIMESTAMP '{START}') AS BIGINT) AS lo, CAST(epoch(TIMESTAMP '{END}') AS BIGINT) AS hi),
  r AS (SELECT *, n // {PAGE} AS page, false AS again FROM e UNION ALL SELECT *, n // {PAGE} - 1, true FROM e WHERE n % {PAGE} = 0 AND n > 0),
  i AS (SELECT *, event_id % 31 = 0 AS bad, sec >= lo AND sec <= hi AS inside FROM r, b),
  f AS (SELECT *, page = min(page) OVER (PARTITION BY event_id) AS first FROM i),
  p AS (SELECT user_id, page, count(*) AS items, count(*) FILTER (NOT bad AND inside AND first) AS kept, count(*) FILTER (NOT bad AND inside AND NOT first) AS repeated, count(*) FILTER (bad) AS invalid,
    bool_or(NOT bad AND sec < lo) AS passed, max(page) OVER (PARTITION BY user_id) AS last FROM f GROUP BY user_id, page),
  q AS (SELECT user_id, page, items, kept, repeated, invalid, passed, last FROM p UNION ALL SELECT user_id, last + 1, 0, 0, 0, 0, false, last FROM p WHERE page = last),
  s AS (SELECT *, CASE WHEN items = 0 THEN 'empty' WHEN passed THEN 'window_passed' WHEN user_id % 5 = 0 AND page = 2 OR user_id % 7 = 0 AND page = 1 THEN 'cursor_repeat' END AS stop FROM q),
  w AS (SELECT *, min(CASE WHEN stop IS NOT NULL THEN page END) OVER (PARTITION BY user_id) AS ends FROM s)"""

SQL = {
    "cursor_walks": f"""WITH {_WALK} SELECT user_id AS entity, page::INT AS page, CASE WHEN page = 0 THEN '*' ELSE 'c' || page END AS request,
      CASE WHEN user_id % 5 = 0 AND page = 2 THEN 'c1' WHEN user_id % 7 = 0 AND page = 1 THEN NULL ELSE 'c' || (page + 1) END AS cursor, items::INT AS items, kept::INT AS kept, repeated::INT AS repeated, invalid::INT AS invalid, stop FROM w WHERE page <= ends""",
    "cursor_items": f"WITH {_WALK} SELECT f.user_id AS entity, f.page::INT AS page, event_id AS id, sec AS \"at\", event_type AS kind FROM f JOIN w ON f.user_id = w.user_id AND f.page = w.page WHERE w.page <= ends AND NOT bad AND inside AND first",
    "history_walks": f"""WITH RECURSIVE {_WALK.split(",\n  r AS")[0]}, u AS (SELECT user_id, max(n) AS last FROM e GROUP BY 1), top AS (SELECT max(sec) AS newest FROM e),
      walk(user_id, page, asked, begun, stop) AS (
        SELECT user_id, 0, newest, 0, NULL::VARCHAR FROM u, top
        UNION ALL SELECT k.user_id, page + 1, k.oldest, (SELECT min(n) FROM e WHERE e.user_id = k.user_id AND e.sec <= k.oldest), NULL FROM (
          SELECT walk.user_id, page, asked, begun, (SELECT min(sec) FROM e WHERE e.user_id = walk.user_id AND n BETWEEN begun AND begun + {PAGE - 1}) AS oldest FROM walk) k, b
        WHERE k.oldest // 86400 >= lo // 86400 AND k.oldest < asked),
      h AS (SELECT walk.user_id, page, asked, begun, (SELECT min(sec) FROM e WHERE e.user_id = walk.user_id AND n BETWEEN begun AND begun + {PAGE - 1}) AS oldest FROM walk),
      g AS (SELECT h.user_id, count(*) AS pages, arg_max(CASE WHEN oldest // 86400 < lo // 86400 THEN 'reached' WHEN oldest >= asked THEN 'no_older' END, page) AS stop FROM h, b GROUP BY 1),
      m AS (SELECT h.user_id, count(*) AS met, count(DISTINCT e.event_id) AS kept FROM h JOIN e ON e.user_id = h.user_id AND n BETWEEN begun AND begun + {PAGE - 1} GROUP BY 1)
      SELECT g.user_id AS entity, pages, kept, met - kept AS repeated, stop FROM g JOIN m ON g.user_id = m.user_id""",
}
