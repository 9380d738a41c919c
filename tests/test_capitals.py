"""Capitals that are other words in lower case."""

from brightloom.plans import ledger


def test_a_question_shares_its_words_with_itself_in_capitals(spark, tmp_path):
    texts = [(1, "die straße ist lang und der weg ist weit"), (2, "kurz"), (3, "so der die straße ist lang und der weg ist weit")]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(tuple(r) for r in ledger.shared_runs(spark, str(tmp_path)).collect()) == [(1, True, False), (2, False, False)]
