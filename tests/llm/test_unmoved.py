"""What stays in place: sets with all their keys, and lines that go as numbers of four bytes."""

import pytest

from brightloom.llm import jaccard_join, line_dedup

WORDS = [f"w{i:03d}" for i in range(400)]


def _docs(spark, copies):
    texts = [" ".join(WORDS[40 * k : 40 * k + 60]) for k in range(4)]
    rows = [(n, texts[0]) for n in range(copies)] + [(100 + k, t) for k, t in enumerate(texts[1:])] + [(200, texts[0] + " more"), (201, texts[2].replace("w085", "other"))]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("copies", [3, jaccard_join.SMALL + 4])
def test_sets_are_not_shuffled_with_their_keys(spark, monkeypatch, copies):
    monkeypatch.setattr(jaccard_join, "small_side", lambda df, *_: df.hint("merge"))
    plans, sent = [], jaccard_join.sent_keys

    def kept(sets, canon):
        rows = sent(sets, canon)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(jaccard_join, "sent_keys", kept)
    out = {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(_docs(spark, copies)).collect()}
    want = dict.fromkeys([*range(copies), 200], 0) | {100: 100, 101: 101, 102: 102, 201: 101}
    assert out == want
    assert ("Exchange" in plans[0]) == (copies > jaccard_join.SMALL)


def test_lines_that_go_are_numbers(spark):
    docs = spark.createDataFrame([(1, "a first line here\nanother line there"), (2, "a first line here\nquite new words\nanother line thera")], "doc_id long, text string")
    gone = line_dedup.gone_numbers(docs)
    assert [(f.name, f.dataType.simpleString()) for f in gone.schema][2:] == [("exact", "array<int>"), ("near", "array<int>")]
    assert [(r.doc_id, r.exact, r.near) for r in gone.collect()] == [(2, [0], [2])]


def test_keys_are_not_written(spark, monkeypatch):
    columns, kept = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, label: columns.extend(df.columns) or kept(df, label))
    out = {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(_docs(spark, 3)).collect()}
    assert out == dict.fromkeys([0, 1, 2, 200], 0) | {100: 100, 101: 101, 102: 102, 201: 101}
    assert "sketch" in columns and "keys" not in columns
