"""JSON values against a schema: every problem with its path, as one expression that Spark plans.

A schema is a dictionary of `type` (one of object, array, string, integer, number, boolean, null, or a list of them), and
where they apply `properties`, `required`, `additional` (whether unknown fields may be, false if not said), `items`,
`enum`, `least` and `most` (of a number, a text's length or an array's size). It is walked once, while the expression is
made; values are variants, so their own types decide, not their spelling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bound, col

KINDS = {
    "object": "OBJECT", "array": "ARRAY", "string": "STRING", "integer": "TINYINT|SMALLINT|INT|BIGINT|DECIMAL\\(\\d+, ?0\\)", "number": "TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE",
    "boolean": "BOOLEAN", "null": "VOID",
}
PROBLEM = "array<struct<path: string, problem: string>>"


def _one(condition: Column, path: Column, problem: Column | str) -> Column:
    said = F.lit(problem) if isinstance(problem, str) else problem
    return F.when(condition, F.array(F.struct(path.alias("path"), said.alias("problem"))).cast(PROBLEM)).otherwise(F.array().cast(PROBLEM))


def problems(value: Column, schema: dict, path: Column | str = "$") -> Column:
    """Problems of a variant (null: missing) as an array of path and problem, outer ones first. Each value, its kind and its
    path are made once, however many rules read them."""
    at = F.lit(path) if isinstance(path, str) else path
    return bound(F.struct(value.alias("value"), F.schema_of_variant(value).alias("kind"), at.alias("path")), lambda b: _problems(b["value"], b["kind"], schema, b["path"]))


def _problems(value: Column, kind: Column, schema: dict, at: Column) -> Column:
    kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
    fits = kind.rlike("^(?:" + "|".join(KINDS[k] for k in kinds) + ")")
    found = [_one(~fits, at, F.concat(F.lit("is "), F.lower(F.regexp_extract(kind, "^[A-Z]+", 0)), F.lit(f", not {' or '.join(kinds)}")))]
    if "enum" in schema:
        given = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))
        found.append(_one(fits & ~given.isin(*map(str, schema["enum"])), at, "is none of the values"))
    if "least" in schema or "most" in schema:
        size = F.when(kind.rlike("^ARRAY"), F.size(F.try_variant_get(value, "$", "array<variant>")).cast("double")).when(kind.rlike("^STRING"), F.length(F.try_variant_get(value, "$", "string")).cast("double")).otherwise(F.try_variant_get(value, "$", "double"))
        low = size < schema["least"] if "least" in schema else F.lit(False)
        high = size > schema["most"] if "most" in schema else F.lit(False)
        found.append(_one(F.coalesce(fits & (low | high), F.lit(False)), at, "is out of bounds"))
    if "object" in kinds:
        is_object = kind.rlike("^OBJECT")
        named = F.coalesce(F.when(is_object, F.json_object_keys(F.to_json(value))), F.array().cast("array<string>"))
        found.append(bound(named, lambda names: _fields(value, is_object, names, schema, at)))
    if "items" in schema:
        items = F.coalesce(F.when(kind.rlike("^ARRAY"), F.try_variant_get(value, "$", "array<variant>")), F.array().cast("array<variant>"))
        each = F.transform(items, lambda v, i: problems(v, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.flatten(each))
    return reduce(lambda a, b: F.concat(a, b), found)


def _fields(value: Column, is_object: Column, names: Column, schema: dict, at: Column) -> Column:
    """Problems of an object's fields, of those that are missing and of unknown ones."""
    own, found = schema.get("properties", {}), [F.array().cast(PROBLEM)]
    for name, inner in own.items():
        child, below = F.try_variant_get(value, f"$['{name}']", "variant"), F.concat(at, F.lit(f".{name}"))
        has = F.array_contains(names, name)
        deeper = F.when(is_object & has, problems(child, inner, below)).otherwise(F.array().cast(PROBLEM))
        found.append(deeper)
        if name in schema.get("required", ()):
            found.append(_one(is_object & ~has, below, "is missing"))
    if not schema.get("additional", False):
        strange = F.array_sort(F.array_except(names, F.array(*map(F.lit, own)).cast("array<string>")))
        found.append(F.transform(strange, lambda n: F.struct(F.concat(at, F.lit("."), n).alias("path"), F.lit("is unknown").alias("problem"))).cast(PROBLEM))
    return reduce(lambda a, b: F.concat(a, b), found)


def json_problems(text: Column | str, schema: dict) -> Column:
    """Problems of a JSON text; one that can't be read, or names a field twice, has that problem alone, a null none."""

    def told(b: Column) -> Column:
        broken = _one(b["text"].isNotNull(), F.lit("$"), "is no JSON or names a field twice")
        return F.when(b["value"].isNull(), broken).otherwise(problems(b["value"], schema))

    return bound(col(text), lambda t: bound(F.struct(t.alias("text"), F.try_parse_json(t).alias("value")), told))


def set_problems(rows: DataFrame, text: str, schema: dict, key: str, pinned: str | None = None, name: str = "id") -> DataFrame:
    """key, path and problem over a set of JSON texts: those of each, `id`s that are there more than once, and, under a null
    key, whether the set's hash is not the pinned one."""
    own = rows.select(key, F.explode(json_problems(text, schema)).alias("p")).select(key, "p.path", "p.problem")
    ids = rows.select(key, F.get_json_object(text, f"$.{name}").alias("_id")).where("_id is not null")
    again = ids.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    out = own.unionByName(ids.join(again, "_id").select(key, F.lit(f"$.{name}").alias("path"), F.lit("is there more than once").alias("problem")))
    if pinned is None:
        return out
    other = set_hash(rows, text).where(F.col("hash") != pinned)
    return out.unionByName(other.select(F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit("$").alias("path"), F.lit("is not the pinned set").alias("problem")))


def set_hash(rows: DataFrame, text: str) -> DataFrame:
    """One row: a hash of the texts that no order changes, of their number and the sums of the eight parts of their digests."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    parts = [F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"_{i}") for i in range(8)]
    sums = rows.agg(*parts, F.count("*").alias("_n"))
    return sums.select(F.sha2(F.concat_ws(":", "_n", *[F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("string") for i in range(8)]), 256).alias("hash"))
