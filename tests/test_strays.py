"""Keys on one side only, without holding a side."""

from brightloom.operators import versions


def test_sides_are_counted_together(spark):
    held = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (4, "d")], "k long, t string")
    wanted = spark.createDataFrame([(2, "b"), (2, "b"), (3, None), (5, "e")], "k long, t string")
    out = versions.strays_and_lacking(held, wanted, ["k", "t"])
    assert sorted((r.k, r.side) for r in out.collect()) == [(1, "stray"), (3, "lacking"), (3, "stray"), (4, "stray"), (5, "lacking")]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
