"""Landed JSON and CSV as typed rows: declared schemas, bad records counted and skipped, personal fields never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, first_date

#: Only these fields of an author are ever read.
AUTHOR = "num_games_owned int, num_reviews int, playtime_forever int, playtime_last_two_weeks int, playtime_at_review int"
REVIEW = f"recommendationid string, author struct<{AUTHOR.replace(' int', ': int')}>, language string, review string, timestamp_created long, timestamp_updated long, voted_up boolean, votes_up int, votes_funny int, weighted_vote_score double, comment_count int, received_for_free boolean, written_during_early_access boolean"


def _nested(fields: str) -> str:
    """name type, ... as name: type, ... for a struct; commas inside struct<> stay."""
    out, depth, part = [], 0, ""
    for ch in fields + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += ch
    return ", ".join(out)


PAGE = f"success int, cursor string, reviews array<struct<{_nested(REVIEW)}>>"


def review_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each review of landed pages; those without id or times are left out."""
    pages = spark.read.schema(PAGE).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    rows = pages.select(F.inline("reviews"))
    flat = rows.select("*", "author.*").drop("author")
    return flat.where("recommendationid is not null and timestamp_created is not null and timestamp_updated is not null")


def within(rows: DataFrame, start: str, end: str, at: str = "timestamp_created") -> DataFrame:
    """Rows of a window of naive UTC times, its start included."""
    seconds = [F.unix_seconds(F.lit(t).cast("timestamp")) for t in (start, end)]
    return rows.where((F.col(at) >= seconds[0]) & (F.col(at) < seconds[1]))


def schema_drift(pages: DataFrame, json: str, known: list[str], nested: str, known_nested: list[str]) -> DataFrame:
    """Unknown field paths in the items of a JSON array, with counts."""
    item = pages.select(F.explode(F.from_json(json, "array<string>")).alias("i"))
    top = F.array_except(F.json_object_keys("i"), F.array(*map(F.lit, known)))
    inner = F.array_except(F.json_object_keys(F.get_json_object("i", f"$.{nested}")), F.array(*map(F.lit, known_nested)))
    named = F.transform(inner, lambda x: F.concat(F.lit(f"{nested}."), x))
    paths = F.concat(F.coalesce(top, F.array().cast("array<string>")), F.coalesce(named, F.array().cast("array<string>")))
    return item.select(F.explode(paths).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def prices(rows: DataFrame, json: str, day: Column | str) -> DataFrame:
    """A snapshot for each entity of a price map: failed ones marked, free ones without a price."""
    kind = "map<string, struct<success: boolean, data: struct<price_overview: struct<currency: string, initial: int, final: int, discount_percent: int>>>>"
    each = rows.select(col(day).alias("day"), F.explode(F.from_json(json, kind)).alias("entity", "p"))
    return each.select("entity", "day", F.coalesce("p.success", F.lit(False)).alias("ok"), "p.data.price_overview.*")


def day_counts(rows: DataFrame, json: str) -> DataFrame:
    kind = "struct<query_summary: struct<total_positive: long, total_negative: long>>"
    return rows.withColumn("_s", F.from_json(json, kind)).select(*rows.columns, F.col("_s.query_summary.total_positive").alias("positive"), F.col("_s.query_summary.total_negative").alias("negative"))


def release_days(rows: DataFrame, text: str, coming: str) -> DataFrame:
    """The release day by the first date format that fits; none while it is to come."""
    return rows.withColumn("release_day", F.when(~F.col(coming), first_date(text)))


def seeds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def history_problems(counts: DataFrame, entities: DataFrame, last_day: str) -> DataFrame:
    """Everything wrong with per-entity daily counts: days missing, given twice, outside the span, or negative."""
    days = entities.select("entity", F.explode(F.sequence("first_day", F.lit(last_day).cast("date"))).alias("day"))
    given = counts.groupBy("entity", "day").agg(F.count("*").alias("n"), F.min(F.least("positive", "negative")).alias("least"))
    both = days.withColumn("wanted", F.lit(True)).join(given, ["entity", "day"], "full_outer")
    problem = (
        F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "outside").when(F.col("n") > 1, "twice").when(F.col("least") < 0, "negative")
    )
    return both.withColumn("problem", problem).where("problem is not null").select("entity", "day", "problem")


def purged(pages: DataFrame, at: str, now: str, days: int = 30) -> DataFrame:
    return pages.where(F.col(at) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def coverage_windows(state: DataFrame, now: str, reread_days: int = 3) -> DataFrame:
    """For each entity: what is read again up to now, and what is left back to its floor."""
    n = F.lit(now).cast("timestamp")
    forward = F.coalesce(F.col("covered_to") - F.expr(f"INTERVAL {reread_days} DAYS"), F.col("floor"))
    back = (F.col("covered_from").isNotNull()) & (F.col("covered_from") > F.col("floor"))
    return state.select(
        "entity", F.greatest(forward, F.col("floor")).alias("forward_from"), n.alias("forward_to"),
        F.when(back, F.col("floor")).alias("backward_from"), F.when(back, F.col("covered_from")).alias("backward_to"),
    )


def window_done(seen: Column | str, announced: Column | str, share: float = 0.99) -> Column:
    """Whether as many rows came as were announced, but for a hundredth."""
    return col(seen) >= share * col(announced)


def catch_up(spine: DataFrame, held: DataFrame, per_run: int = 4) -> DataFrame:
    """The oldest missing days of each entity, a few for a run."""
    from pyspark.sql import Window

    gap = spine.join(held.select("entity", "day").distinct(), ["entity", "day"], "left_anti")
    return gap.withColumn("_n", F.row_number().over(Window.partitionBy("entity").orderBy("day"))).where(F.col("_n") <= per_run).drop("_n")


def recomputed_coverage(rows: DataFrame, entity: str, at: str) -> DataFrame:
    """How far back each entity's rows reach."""
    return rows.groupBy(entity).agg(F.min(at).alias("covered_from"), F.max(at).alias("covered_to"))
