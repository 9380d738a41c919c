"""JSON against a schema, sets of JSON, and the longest run of words."""

import random

from brightloom.functions import schemas
from brightloom.functions.text_udfs import longest_run

SCHEMA = {
    "type": "object",
    "required": ["id"],
    "properties": {
        "id": {"type": ["integer", "string"]},
        "kind": {"type": "string", "enum": ["a", "b"]},
        "share": {"type": "number", "least": 0, "most": 1},
        "list": {"type": "array", "most": 2, "items": {"type": "object", "additional": True, "properties": {"x": {"type": "boolean"}}}},
        "inner": {"type": "object", "required": ["y"], "properties": {"y": {"type": "null"}}},
    },
}


def found(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    return [[tuple(p) for p in r.p] for r in rows.select("k", schemas.json_problems("t", SCHEMA).alias("p")).orderBy("k").collect()]


def test_every_problem_has_its_path(spark):
    out = found(
        spark, '{"id": 1, "kind": "a", "share": 0.5, "list": [{"x": true, "z": 1}], "inner": {"y": null}}', '{"id": "s", "share": 1}', "[1]", '{"kind": "c", "share": 2, "list": [{"x": 1}, 3, {}], "inner": {"w": 1}, "v": 0}',
        '{"id": true, "kind": 5, "inner": null}', "{", '{"id": 1, "id": 2}', None, "", '"text"', '{"id": 1, "list": []}',
    )
    broken = [("$", "is no JSON or names a field twice")]
    assert out[0] == out[1] == out[7] == out[10] == []
    assert out[2] == [("$", "is array, not object")] and out[5] == out[6] == out[8] == broken and out[9] == [("$", "is string, not object")]
    assert sorted(out[3]) == sorted([
        ("$.id", "is missing"), ("$.kind", "is none of the values"), ("$.share", "is out of bounds"), ("$.list", "is out of bounds"), ("$.list[0].x", "is bigint, not boolean"), ("$.list[1]", "is bigint, not object"),
        ("$.inner.y", "is missing"), ("$.inner.w", "is unknown"), ("$.v", "is unknown"),
    ])
    assert sorted(out[4]) == [("$.id", "is boolean, not integer or string"), ("$.inner", "is void, not object"), ("$.kind", "is bigint, not string")]


def test_sets_with_repeats_and_a_pinned_hash(spark):
    rows = spark.createDataFrame([(1, '{"id": 1}'), (2, '{"id": 1}'), (3, '{"id": 2, "v": 1}')], "k int, t string")
    pinned = schemas.set_hash(rows, "t").first().hash
    assert schemas.set_hash(rows.orderBy("t").repartition(3), "t").first().hash == pinned != schemas.set_hash(rows.where("k < 3"), "t").first().hash
    out = sorted(tuple(r) for r in schemas.set_problems(rows, "t", SCHEMA, "k", pinned).collect())
    assert out == [(1, "$.id", "is there more than once"), (2, "$.id", "is there more than once"), (3, "$.v", "is unknown")]
    assert (None, "$", "is not the pinned set") in [tuple(r) for r in schemas.set_problems(rows, "t", SCHEMA, "k", "0" * 64).collect()]


def test_longest_run_equals_the_table_of_all_pairs():
    draw = random.Random(1)
    for _ in range(3000):
        x, y = (draw.choices("abc", k=draw.randint(0, 12)) for _ in range(2))
        best, last = 0, {}
        for w in x:
            now = {j: last.get(j - 1, 0) + 1 for j, v in enumerate(y) if v == w}
            best, last = max([best, *now.values()]), now
        assert longest_run(x, y) == best
    many = [str(i % 977) for i in range(200_000)]
    assert longest_run(many, many[5:]) == 199_995
