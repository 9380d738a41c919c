"""Shuffle files of the near-copy stage go while it runs, not when the driver happens to collect its garbage."""

import time

from brightloom.llm import common, jaccard_join


def shuffled(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
    out = set()
    while files.hasNext():
        out.add(files.next().getName())
    return {f for f in out if f.startswith("shuffle_")}


def test_files_of_a_finished_shuffle_go(spark):
    before = shuffled(spark)
    table = common.written(spark.range(1000).repartition(7, "id"), "x")
    made = shuffled(spark) - before
    assert made
    common.released(spark)
    until = time.time() + 20
    while shuffled(spark) & made and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) & made
    assert table.count() == 1000


def test_keys_are_released_before_they_are_verified(spark, monkeypatch):
    told = []
    monkeypatch.setattr(jaccard_join, "released", lambda s: told.append("released"))
    real = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda *a: told.append("verified") or real(*a))
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "x y z")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(docs, 2, 80, 100).collect()} == {1: 1, 2: 1, 3: 3}
    assert told.index("released") < told.index("verified")
