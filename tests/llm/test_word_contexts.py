"""Operator 1: every word is a context, however rare; draws don't depend on how texts are dealt."""

import zlib

import numpy as np

from brightloom.llm import pitman_yor


def test_rare_words_are_contexts(spark):
    n, held = 300, [i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [(i, f"first{i % n} second{i % n}") for i in range(4 * n)]
    told = [(held[k], f"first{k} second{k}") for k in range(n)] + [(held[n + k], f"first{k} second{(k + 7) % n}") for k in range(n)]
    out = {r.doc_id: r.score for r in pitman_yor.fit_and_score(spark.createDataFrame(texts + told, "doc_id long, text string")).collect()}
    assert all(out[held[k]] > out[held[n + k]] + 0.5 for k in range(n))


def test_scores_do_not_depend_on_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 30) % 500)) for i in range(400)] + [(1000, None), (1001, ""), (None, "w1 w2"), (7, "w1 w1")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")

    def scores(parts):
        return sorted((r.doc_id or -1, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in pitman_yor.fit_and_score(docs.repartition(parts)).collect())

    whole = scores(1)
    monkeypatch.setattr(pitman_yor, "PAIR_BYTES", 4000)
    monkeypatch.setattr(pitman_yor, "WORD_BYTES", 9000)
    assert scores(6) == whole and len(whole) == len(texts)


def test_keyed_draws_are_binomial():
    u = pitman_yor.uniform(np.arange(20_000, dtype=np.uint64), 3, 1)
    assert abs(u.mean() - 0.5) < 0.01 and not np.array_equal(u, pitman_yor.uniform(np.arange(20_000, dtype=np.uint64), 3, 2))
    for n, p in ((1, 0.3), (40, 0.02), (200, 0.6), (100_000, 0.05)):
        k = pitman_yor.binomial(np.full(len(u), n), np.full(len(u), p), u)
        assert abs(k.mean() - n * p) < 0.03 * np.sqrt(n * p * (1 - p)) + 1e-9 and abs(k.std() / np.sqrt(n * p * (1 - p)) - 1) < 0.05
        assert k.min() >= 0 and k.max() <= n
