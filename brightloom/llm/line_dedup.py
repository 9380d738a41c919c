"""Operator 2: repeated lines, exact or within one edit, by a deletion-neighbourhood join. No Python in its plans.

Occurrences of a line are ordered by (doc_id, hash of the text, line number); the earliest stays. A line also goes,
with all its occurrences, if one that first occurs earlier is within the edit bound: both then share a variant.
- A substitution leaves the same variant when the same position is deleted in both.
- A deletion makes the shorter line itself a variant of the longer.
So each line sends its variants, hashed, with the position deleted, and itself. For each variant and position the
earliest line is kept, and each other one compared with it alone, however many share the variant; what is found is
verified by edit distance on the texts.

Only lines that can have a neighbour send variants: two lines within one edit share their first or their last half,
so lines whose halves, as hashed keys, occur in no other line are left out before.

The edit bound is one edit, for two lines whose similarity, 1 less the share of characters edited of the longer one, is
then 0.8 or more: that is for a longer line of `near_chars` = 5 characters. A line one short of that can only be the
shorter of two, so it sends itself alone.

Defined cases: null and empty texts stay as they are; blank lines are never dropped; of rows repeated with the same doc_id and text each
keeps the same lines; null doc_ids come first in the order; an empty table gives no rows. Line hashes have 96 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, small_side, written

#: One edit in so many characters leaves a similarity of 0.8.
NEAR_CHARS = 5


def _name(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("x"), F.hash(line).alias("y"))


def _half_keys(line: Column) -> Column:
    """Keys of the halves of a line, as the shorter (or equal) and as the longer one of a pair."""
    size = F.char_length(line)

    def halves(shorter: Column) -> list[Column]:
        first = F.floor(shorter / 2).cast("int")
        return [
            F.xxhash64(shorter, F.lit(1), F.substr(line, F.lit(1), first)),
            F.xxhash64(shorter, F.lit(2), F.right(line, shorter - first)),
        ]

    return F.array(*halves(size), *halves(size - 1))


def _occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, line number and line of every line that is not blank."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return rows.where(F.trim("line") != "")


def dropped_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, th, no and kind (exact or near) of each line occurrence that goes."""
    each = _occurrences(docs).select("doc_id", "th", "no", "line", _name(F.col("line")).alias("name"))
    first = F.struct("doc_id", "th", "no")
    near = F.char_length("line") >= near_chars - 1
    keyed = each.select("name", first.alias("at"), F.when(near, _half_keys(F.col("line"))).alias("halves"))
    lines = written(keyed.groupBy("name").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.first("halves").alias("halves")), "lines")

    halves = lines.where("halves is not null").select("name", "at", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a < b").select("half")
    shared = written(shared, "halves")
    able = halves.join(small_side(shared), "half", "left_semi").select("at", "name").distinct()
    able = written(able.select("at.*", "name"), "able")
    spots = able.select(F.col("doc_id").alias("_d"), F.col("th").alias("_th"), F.col("no").alias("_no"), "name")
    rows = _occurrences(docs).where(near)
    same = rows["doc_id"].eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_th")) & (F.col("no") == F.col("_no"))
    texts = rows.join(small_side(spots), same)
    texts = written(texts.select("name", first.alias("at"), "line").dropDuplicates(["name"]), "able-texts")

    near_lines = written(_near(texts, near_chars), "near").select("name")
    again = each.select("doc_id", "th", "no", "name")
    again = again.join(small_side(near_lines.withColumn("is_near", F.lit(True))), "name", "left")
    repeated = written(lines.where("n > 1").select("name", F.col("at").alias("first")), "repeated")
    again = again.join(small_side(repeated), "name", "left").where("is_near or first is not null")
    kind = F.when(F.coalesce(F.col("first") != first, F.lit(False)), "exact").when(F.col("is_near"), "near")
    return again.select("doc_id", "th", "no", kind.alias("kind")).where("kind is not null")


def _near(texts: DataFrame, near_chars: int) -> DataFrame:
    """name of each line that has an earlier one within one edit."""
    size = F.char_length("line")
    cuts = F.when(size >= near_chars, size).otherwise(0)
    parts = F.transform(
        F.sequence(F.lit(0), cuts),
        # position 0 deletes nothing: the line itself
        lambda i: F.xxhash64(F.concat(F.substr("line", F.lit(1), i - F.when(i > 0, 1).otherwise(0)), F.substr("line", i + 1, size))),
    )
    sent = texts.select("name", "at", F.posexplode(parts).alias("cut", "variant"))
    # a deletion inside a run of equal characters gives one variant at several positions, as it should
    alike, whole = Window.partitionBy("variant", "cut"), Window.partitionBy("variant")
    itself, longer = F.struct("at", "name"), F.col("cut") > 0
    seen = sent.select(
        "name",
        "at",
        F.min(F.when(longer, itself)).over(alike).alias("substituted"),
        F.when(longer, F.min(F.when(~longer, itself)).over(whole)).alias("shorter"),
        F.when(~longer, F.min(F.when(longer, itself)).over(whole)).alias("longer"),
    )
    earlier = seen.select("name", "at", F.explode(F.array("substituted", "shorter", "longer")).alias("by"))
    pairs = earlier.where("by is not null and by.at < at").select("name", F.col("by.name").alias("by")).distinct()
    pairs = written(pairs, "line-pairs")
    lines = texts.select("name", "line")
    theirs = lines.select(F.col("name").alias("by"), F.col("line").alias("other"))
    checked = pairs.join(lines, "name").join(theirs, "by")
    return checked.where(F.levenshtein("line", "other", 1) >= 0).select("name").distinct()


def gone_numbers(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, th, and the numbers of the lines that go from such a document, exact and near: four bytes a line."""
    kinds = [F.collect_set(F.when(F.col("kind") == kind, F.col("no"))).alias(kind) for kind in ("exact", "near")]
    return dropped_lines(docs, near_chars).groupBy("doc_id", "th").agg(*kinds)


def dedup_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """row (a struct of all columns of docs, with lines dropped from text), n_lines, n_exact and n_near."""
    gone = written(gone_numbers(docs, near_chars), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("hash"))
    on = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("th"))
    both = rows.join(small_side(gone), on, "left")
    lines = F.split("row.text", "\n")
    numbers = F.concat("exact", "near")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(numbers, i)), "\n")

    def count(kind: str) -> Column:
        return F.when(F.col(kind).isNull(), 0).otherwise(F.size(kind)).cast("long")

    return both.select(
        F.col("row").withField("text", F.when(F.col("th").isNull(), F.col("row.text")).otherwise(kept)).alias("row"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        count("exact").alias("n_exact"),
        count("near").alias("n_near"),
    )


def without_repeated_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with the same columns and fewer lines."""
    return dedup_lines(docs, near_chars).select("row.*")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "row.text", "n_lines", "n_exact", "n_near")


#: Lines as code points; variants as text, so nothing is hashed.
OP2_SQL = f"""
WITH each AS (
  SELECT doc_id, t.no - 1 AS no, lines[t.no] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) d, unnest(range(1, len(lines) + 1)) AS t(no)
  WHERE trim(lines[t.no], ' ') <> ''
), firsts AS (
  SELECT line, min((doc_id, no)) AS spot FROM each GROUP BY line
), sent AS (
  SELECT line, spot, t.cut, CASE WHEN t.cut = 0 THEN line ELSE left(line, t.cut - 1) || substr(line, t.cut + 1) END AS variant
  FROM firsts, unnest(range(0, CASE WHEN length(line) >= {NEAR_CHARS} THEN length(line) ELSE 0 END + 1)) AS t(cut)
  WHERE length(line) >= {NEAR_CHARS} - 1
), seen AS (
  SELECT line, spot,
    CASE WHEN cut > 0 THEN min(CASE WHEN cut > 0 THEN spot END) OVER (PARTITION BY variant, cut) END AS s,
    CASE WHEN cut > 0 THEN min(CASE WHEN cut = 0 THEN spot END) OVER (PARTITION BY variant)
         ELSE min(CASE WHEN cut > 0 THEN spot END) OVER (PARTITION BY variant) END AS d
  FROM sent
), near AS (
  SELECT DISTINCT line FROM seen WHERE s < spot OR d < spot
), judged AS (
  SELECT e.doc_id, e.no, e.line,
    CASE WHEN (e.doc_id, e.no) <> f.spot THEN 'exact' WHEN n.line IS NOT NULL THEN 'near' END AS kind
  FROM each e JOIN firsts f ON e.line = f.line LEFT JOIN near n ON e.line = n.line
), gone AS (
  SELECT doc_id, list(no) AS nos, count(*) FILTER (kind = 'exact') AS n_exact, count(*) FILTER (kind = 'near') AS n_near
  FROM judged WHERE kind IS NOT NULL GROUP BY doc_id
)
SELECT d.doc_id,
  CASE WHEN g.nos IS NULL THEN d.text
       ELSE coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.nos, i - 1)), chr(10)), '') END AS text,
  len(string_split(d.text, chr(10)))::BIGINT AS n_lines,
  coalesce(g.n_exact, 0)::BIGINT AS n_exact,
  coalesce(g.n_near, 0)::BIGINT AS n_near
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""
