"""Nested documents for publication: sorted, rounded, and only of allowed fields, so equal data gives equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(rows: DataFrame, digits: int = 4) -> DataFrame:
    """Double columns to a number of places."""
    return rows.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in rows.dtypes])


def documents(entities: DataFrame, parts: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """One JSON text for each entity, with its rows of each part in the order of a column."""
    out = entities
    for name, (rows, order) in parts.items():
        fields = [c for c in sorted(rows.columns) if c != key]
        cells = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("row"))))
        out = out.join(rounded(rows).groupBy(key).agg(F.transform(cells, lambda x: x["row"]).alias(name)), key, "left")
    body = F.to_json(F.struct(*sorted(out.columns)))
    return out.select(key, body.alias("document"), F.sha2(body, 256).alias("sha256"))


def allowed(rows: DataFrame, names: set[str]) -> DataFrame:
    """rows, unless a field isn't on the list."""
    strange = set(rows.columns) - names
    if strange:
        raise ValueError(f"fields that may not be published: {sorted(strange)}")
    return rows


def aligned(rows: DataFrame, keys: list[str], code: str, value: str, order: list[str]) -> DataFrame:
    """Values of each key as an array in the given order of codes, 0 where absent."""
    held = F.map_from_entries(F.collect_list(F.struct(code, value)))
    cells = F.array(*[F.coalesce(F.try_element_at("_m", F.lit(c)), F.lit(0)) for c in order])
    return rows.groupBy(*keys).agg(held.alias("_m")).select(*keys, cells.alias("values"))


def durations(runs: DataFrame, stages: str) -> DataFrame:
    """Numeric stage times of a JSON object; anything else is left out, broken JSON is empty."""
    pairs = F.map_entries(F.coalesce(F.from_json(stages, "map<string, string>"), F.create_map().cast("map<string,string>")))
    numeric = F.filter(pairs, lambda e: e["value"].rlike(r"^-?\d+(\.\d+)?$"))
    return runs.withColumn("durations", F.map_from_entries(F.transform(numeric, lambda e: F.struct(e["key"], e["value"].cast("double")))))


def ranking_rows(runs: DataFrame) -> DataFrame:
    """system, variant, query, rank, item and score with six places, as the files of a run have them."""
    return runs.select("system", "variant", "query_id", "rank", "item_id", F.format_string("%.6f", "score").alias("score"))


def write_rankings(runs: DataFrame, path: str) -> None:
    """A folder of CSV for each system and variant."""
    ranking_rows(runs).repartition("system", "variant").sortWithinPartitions("query_id", "rank").write.partitionBy("system", "variant").option("header", True).csv(path)
