"""The test tables under the names the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as versioned rows: review, version, run, outcome, minutes, entity."""
    l = read(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("review_id"),
        F.col("l_shipdate").cast("date").alias("version"),
        F.col("l_linenumber").alias("run_id"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_returnflag") != "R").alias("positive"),
        F.col("l_returnflag").alias("entity"),
        (F.col("l_quantity") * 60).cast("int").alias("minutes"),
    )


def latest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.versions import latest

    order = [F.col(c).desc() for c in ("version", "run_id", "part", "supplier", "price")]
    return latest(reviews(spark, sf_dir), ["review_id"], order)


#: The same rows for DuckDB.
REVIEWS_SQL = """
reviews AS (
  SELECT l_orderkey AS review_id, CAST(l_shipdate AS DATE) AS version, l_linenumber AS run_id, l_partkey AS part,
    l_suppkey AS supplier, l_extendedprice AS price, l_returnflag <> 'R' AS positive, l_returnflag AS entity,
    CAST(l_quantity * 60 AS INT) AS minutes
  FROM lineitem
), latest AS (
  SELECT * FROM reviews
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY version DESC, run_id DESC, part DESC, supplier DESC, price DESC) = 1
)"""

WILSON_SQL = """CASE WHEN n > 0 THEN round(greatest(0.0, (x / n + z * z / (2 * n) - z * sqrt(x / n * (1 - x / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) END AS lo,
  CASE WHEN n > 0 THEN round(least(1.0, (x / n + z * z / (2 * n) + z * sqrt(x / n * (1 - x / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) END AS hi"""


def guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as truth, with a probability that depends on the id alone, and the document's language."""
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents")
    p = (F.pmod(F.col("doc_id") * 37, F.lit(101)) + 50 * F.col("quality")) / 151
    both = labels.join(docs.select("doc_id", "lang"), "doc_id")
    return both.select("doc_id", "lang", (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 1).alias("toxic"), p.alias("p"), (p >= 0.5).alias("predicted"))


GUESS_SQL = """
guess AS (
  SELECT l.doc_id, d.lang, quality = 1 AS truth, toxic = 1 AS toxic,
    ((l.doc_id * 37) % 101 + 50 * quality) / 151.0 AS p, ((l.doc_id * 37) % 101 + 50 * quality) / 151.0 >= 0.5 AS predicted
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""
