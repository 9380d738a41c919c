"""Cuts of operator 7 come from all controls."""

from brightloom.llm import secret_scan
from brightloom.llm.spans import Cover


def test_all_strings_out_of_reach_are_controls(spark, monkeypatch):
    words = [f"ordinary{i:04d}word" for i in range(300)]
    text = "password " + "x " * 100 + " ".join(words)
    near, far = secret_scan.strings(text, Cover([]))
    assert near == [] and [text[a:b] for a, b in far] == words
    seen = []
    monkeypatch.setattr(secret_scan, "cuts_of", lambda counts, different: seen.append((sum(counts.values()), sum(different.values()))) or list(secret_scan.LEAST_NOVELTY))
    secret_scan.scan_documents(spark.createDataFrame([(1, text), (2, None), (3, text)], "doc_id long, text string")).collect()
    assert seen == [(600, 300)]


def test_equal_controls_do_not_make_enough():
    counts = {(0, b): 1000 for b in range(100, 150)}
    assert secret_scan.cuts_of(counts, {0: 300})[0] == secret_scan.LEAST_NOVELTY[0]
    assert secret_scan.cuts_of(counts, {0: 2000}) == secret_scan.cuts_of(counts) and secret_scan.cuts_of(counts)[0] == 1.5
