"""Operators 11 and 12 against the plain library call, brute force and exact round trips."""

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import byte_bpe, fill_middle

EXTRA = "doc_id long, text string, ids array<int>, n long, form string, output string, n_tokens long"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000)) + "é" * 50_001
ODD = [(1, None), (2, ""), (3, " \t\n\n "), (4, "one"), (4, "one"), (None, "no id here"), (5, LONG), (6, "<|endoftext|> a <P> b"), (7, "\x1c a\x1c\x1c b \x1c")]


@pytest.fixture
def docs(spark):
    return lambda pairs: spark.createDataFrame([(i, t, [1], 2, "f", "o", 3) for i, t in pairs], EXTRA)


@lru_cache
def plain():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sampled(seed, n=3000):
    """Texts of tokens, marks and white space of all kinds, in odd orders."""
    draw = random.Random(seed)
    tokens = [plain().decode_single_token_bytes(i) for i in range(plain().n_vocab)]
    space = [c.encode() for c in " \t\n\x0b\x1c\x1f\x85\xa0   　​᠎"]
    for _ in range(n):
        parts = [draw.choice(draw.choice([tokens, space, [b" ", b"a", b"1", b"'s", b"-"]])) * draw.choice([1, 1, 2, 7]) for _ in range(draw.randint(0, 9))]
        yield b"".join(parts).decode(errors="ignore")


def test_ids_are_those_of_the_plain_library():
    bpe = byte_bpe.model(byte_bpe.rank_file())
    texts = [*sampled(1), LONG, "\n".join(sampled(2, 500)), " ".join(sampled(3, 500))]
    for text, ids in zip(texts, bpe.encode(texts)):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == plain().encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_every_code_point_splits_as_in_the_plain_library():
    bpe = byte_bpe.model(byte_bpe.rank_file())
    points = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    for form in ("a{}a", " {0}{0}1  {0}", "{0} ?{0}"):
        texts = [form.format(c) for c in points]
        for at in range(0, len(texts), 4096):
            some = texts[at : at + 4096]
            got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(some)]
            assert got == plain().encode_ordinary_batch(some, num_threads=1)


def test_offsets_equal_those_of_the_library():
    bpe = byte_bpe.model(byte_bpe.rank_file())
    for text in [*sampled(4, 800), "日本語🙂é x"]:
        ids = np.frombuffer(bpe.encode([text])[0], "<u4")
        starts, ends = bpe.offsets(text, ids)
        library = bpe.tokenizer.encode(text, add_special_tokens=False)
        assert list(zip(starts.tolist(), ends.tolist())) == library.offsets, repr(text)


def test_documents_are_encoded_and_decoded_whole(docs):
    df = docs(ODD)
    tokens = byte_bpe.encoded(df)
    back = sorted(((r.doc_id, r.n_tokens, bytes(r.bytes), r.text) for r in byte_bpe.decoded(tokens).collect()), key=str)
    want = sorted(((i, len(plain().encode_ordinary(t or "")), (t or "").encode(), t or "") for i, t in ODD), key=str)
    assert back == want
    got = sorted((tuple(r) for r in byte_bpe.digests(tokens).collect()), key=str)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    of = lambda t: np.array(plain().encode_ordinary(t), "<u4").tobytes()
    assert got == sorted(((i, len(of(t or "")) // 4, digest(of(t or "")), digest((t or "").encode())) for i, t in ODD), key=str)
    spans = {r.doc_id: r for r in byte_bpe.with_offsets(df).collect()}
    assert spans[4].starts == [0] and spans[4].ends == [3] and spans[1].ids == []
    assert byte_bpe.digests(byte_bpe.encoded(df.limit(0))).count() == 0


def test_split_characters_and_null_ids(spark):
    ids = plain().encode_ordinary("é🙂")
    split = plain().encode_ordinary("\U0001f9ff")
    assert len(split) > 1
    df = spark.createDataFrame([(1, ids), (2, split[:1]), (3, None), (4, split)], "doc_id long, ids array<int>")
    out = {r.doc_id: (r.n_tokens, r.text) for r in byte_bpe.decoded(df).collect()}
    assert out == {1: (len(ids), "é🙂"), 2: (1, "�"), 3: (0, ""), 4: (len(split), "\U0001f9ff")}
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decoded(spark.createDataFrame([(1, [999_999])], "doc_id long, ids array<int>")).collect()


UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def by_force(doc_id, text):
    """The contract read word by word."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    whole = hashlib.sha256(text.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, whole, whole
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), hashlib.sha256(out.encode()).hexdigest(), whole


def test_fill_in_middle_equals_brute_force(docs):
    draw = random.Random(5)
    marks = ["a", "bc", " ", "\t", "\r\n", "  ", "\x0b\x0c", "é", "🙂", "\xa0", "<", ">", "P>", "<P", "S", "M>", "\x1f"]
    rows = ODD + [(100 + i, "".join(draw.choices(marks, k=draw.randint(0, 12)))) for i in range(600)] + [(-3, "x y"), (8, "<<P>"), (9, "a<M>")]
    df = fill_middle.restored(fill_middle.transformed(docs(rows)))
    got = df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2("restored", 256))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((by_force(*r) for r in rows), key=str)
    assert {r.form for r in df.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_middle.transformed(docs([])).count() == 0


def test_sentinels_that_cuts_could_make_are_refused(docs):
    with pytest.raises(ValueError):
        fill_middle.transformed(docs([]), sentinels=("aa", "<S>", "<M>"))
    with pytest.raises(ValueError):
        fill_middle.transformed(docs([]), sentinels=("<S>", "<S>", "<M>"))
