"""The pipeline against a plain version of its stages on a small corpus."""

import math
import zlib

import numpy as np

import corpus_pipeline
from brightloom.llm import registry

GOOD = "the quiet river turned past {} old houses and {} gardens where people of {} sat and talked, then it went on to {}."
JUNK = "BUY!! {} $$$ ### NOW!! *** {} "
ITEM = "How many apples does the farmer keep when he sells twelve of the forty that he picked in the morning before the rain came down?"


def corpus():
    draw = np.random.default_rng(9)
    words = ["".join(draw.choice(list("abcdefghijklmnop"), 6)) for _ in range(4000)]

    def good(n):
        return " ".join(GOOD.format(*draw.choice(words, 4)) for _ in range(n))

    docs = {i: good(3 + i % 5) for i in range(120)}
    junk = {200 + i: " ".join(JUNK.format(*draw.choice(words, 2)) for _ in range(12)) for i in range(60)}
    line = "this line stands in many of the documents and is dropped after the first"
    docs[300] = f"{line}\n{good(4)}"
    docs[301] = f"{good(4)}\n{line}\n{good(2)}"
    docs[302] = f"{good(4)}\n{line.replace('many', 'meny')}\n{good(2)}"
    docs[310] = good(20)
    docs[311] = docs[310] + " one more"
    docs[320] = f"{good(5)} {ITEM} {good(5)}"
    return docs, junk, line


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    docs, junk, line = corpus()
    rows = [(i, t, "en", "src", len(t)) for i, t in (docs | junk).items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i in docs), 0) for i in docs | junk if i % 2 == 0 or i < 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = {i: t for i, t in docs.items() if i not in (311, 320)}
    for i in (301, 302):
        want[i] = "\n".join(x for x in want[i].split("\n") if x not in (line, line.replace("many", "meny")))

    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    ids = {i: encode(t, add_special_tokens=False).ids + [1] for i, t in want.items()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.length, r.ids_crc32) for r in out} == {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}
    assert len({r.sequence_id for r in out}) <= math.ceil(sum(map(len, ids.values())) / 4096) + 1


def test_stages_keep_the_columns(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], kinds)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (None, "x y", None, None, 3)], kinds)
    for docs, left in ((empty, 0), (odd, None)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == empty.columns
            if left is not None:
                assert out.count() == left


def test_each_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)
