"""Operator 11: byte-level byte-pair ids of texts by the tokenizers library, their offsets, and the way back.

The ranks of a public vocabulary become a model of the tokenizers library: every byte is written as one printable
character, tokens are strings of these, and each way to cut a token into two others is a merge with the token's rank.
The pattern that splits texts never joins characters over the last white space of a run and what stands before it, so
texts are cut there, and each distinct chunk of a batch of texts is encoded once; words of plain letters, and marks
behind them, are pieces of the public pattern already, so their bytes go to the merges at once. `with_offsets` maps bytes back to
characters; `decoded` reverses the byte table, and joins bytes before it makes characters of them, so a character that
is split over tokens is whole again.

Defined cases: a null text is encoded as an empty one, which has no ids; special tokens in a text are ordinary text;
null ids decode to nothing, unknown ids raise; bytes that are no UTF-8 (ids cut within a character) become U+FFFD in
`text`, and stay as they are in `bytes`; repeated rows and null doc_ids are kept; a text of any length is one row;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

#: White space of Unicode, which the pattern's \s stands for (Python's has four more).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters that any version of Unicode knows, and marks that end words and begin no contraction.
LETTERS, MARKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", ".,;:!?"
ONE_PIECE = re.compile(f" ?[{LETTERS}]+|[{MARKS}]+").fullmatch
CHUNK = re.compile(
    f" ?[{LETTERS}]+(?=[{MARKS}]*(?:[{SPACE}]|\\Z))|[{MARKS}]+(?=[{SPACE}]|\\Z)|[{SPACE}]?[^{SPACE}]+|[{SPACE}]+(?=[{SPACE}][^{SPACE}])|[{SPACE}]+"
)
#: Chunks that a worker keeps from batch to batch, and their longest; texts encoded at a time.
KEPT, KEPT_CHARS, TEXTS = 800_000, 64, 512


@lru_cache(1)
def byte_characters() -> list[str]:
    """A printable character for each byte: itself if Latin-1 shows it as a mark on paper, else the next from U+0100 on."""
    shown = [c.isprintable() and not c.isspace() for c in map(chr, range(256))]
    others = iter(range(256, 512))
    return [chr(b) if shown[b] else chr(next(others)) for b in range(256)]


def rank_file(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path


class ByteBPE:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks
        import public_tokenizers
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        shown = byte_characters()
        names = {token: "".join(map(shown.__getitem__, token)) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
            cuts = [c for c in cuts if c[0] in ranks and c[1] in ranks]
            cuts.sort(key=lambda c: max(map(ranks.__getitem__, c)))
            merges += [(names[a], names[b]) for a, b in cuts]
        model = models.BPE({names[t]: r for t, r in ranks.items()}, merges, ignore_merges=True)
        self.merger, self.tokenizer = Tokenizer(model), Tokenizer(model)
        split = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated")
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.shown = dict(enumerate(shown))
        back = {c: b for b, c in enumerate(shown)}
        self.token_bytes = {r: bytes(map(back.__getitem__, names[t])) for t, r in ranks.items()}
        self.lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for r, token in self.token_bytes.items():
            self.lengths[r] = len(token)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        chunks = [CHUNK.findall(t) for t in texts]
        met = set().union(*chunks)
        new = [c for c in met if c not in self.known]
        pieces = [c for c in new if ONE_PIECE(c)]
        shown = [c.encode().decode("latin-1").translate(self.shown) for c in pieces]
        others = [c for c in new if not ONE_PIECE(c)]
        for some, made in ((pieces, self.merger.encode_batch_fast(shown, add_special_tokens=False)), (others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False))):
            for chunk, one in zip(some, made):
                self.known[chunk] = np.array(one.ids, "<u4").tobytes()
        out = [b"".join(map(self.known.__getitem__, c)) for c in chunks]
        for chunk in new:
            if len(chunk) > KEPT_CHARS:
                del self.known[chunk]
        if len(self.known) > KEPT:
            self.known = {c: self.known[c] for c in met if len(c) <= KEPT_CHARS} if len(met) <= KEPT else {}
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; a split character belongs to all its tokens."""
        ends = np.cumsum(self.lengths[ids])
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80  # bytes that begin a character
        character = np.cumsum(lead) - 1
        return character[ends - self.lengths[ids]], character[ends - 1] + 1


@lru_cache(2)
def model(path: str) -> ByteBPE:
    """One for each file and worker, which keeps it from task to task."""
    return ByteBPE(path)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)]).astype(np.int32)))


def _by_slices(run: Callable[[pa.RecordBatch], list[pa.Array]], names: list[str]) -> Callable:
    """run over a few rows at a time; column 0 is handed on."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                yield pa.RecordBatch.from_arrays([some.column(0), *run(some)], names=["doc_id", *names])

    return of


def encoded(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and the ids of its text."""

    def run(some: pa.RecordBatch) -> list[pa.Array]:
        texts = [t or "" for t in some.column(1).to_pylist()]
        return [_lists([np.frombuffer(x, "<u4") for x in model(rank_file(ranks)).encode(texts)])]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_by_slices(run, ["ids"]), f"doc_id {kind}, ids array<int>")


def with_offsets(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids, and for each id its first character and the one after its last."""

    def run(some: pa.RecordBatch) -> list[pa.Array]:
        bpe = model(rank_file(ranks))
        texts = [t or "" for t in some.column(1).to_pylist()]
        ids = [np.frombuffer(x, "<u4") for x in bpe.encode(texts)]
        spans = [bpe.offsets(t, i) for t, i in zip(texts, ids)]
        return [_lists(ids), _lists([s for s, _ in spans]), _lists([e for _, e in spans])]

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["ids", "starts", "ends"]
    return docs.select("doc_id", "text").mapInArrow(_by_slices(run, names), f"doc_id {kind}, " + ", ".join(f"{n} array<int>" for n in names))


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The ids of each row; of a null, none."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] if ok else flat[:0] for a, b, ok in zip(at[:-1], at[1:], column.is_valid().to_pylist())]


def decoded(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, the bytes that its ids stand for, and their text."""

    def run(some: pa.RecordBatch) -> list[pa.Array]:
        ids = _rows(some.column(1))
        raw = [model(rank_file(ranks)).decode(i) for i in ids]
        return [pa.array([len(i) for i in ids], pa.int64()), pa.array(raw, pa.binary()), pa.array([r.decode(errors="replace") for r in raw], pa.string())]

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(_by_slices(run, ["n_tokens", "bytes", "text"]), f"doc_id {kind}, n_tokens long, bytes binary, text string")


def digests(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian, 32 bits) and of the bytes that they decode to."""

    def run(some: pa.RecordBatch) -> list[pa.Array]:
        ids = _rows(some.column(1))
        of_ids = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
        of_bytes = [hashlib.sha256(model(rank_file(ranks)).decode(i)).hexdigest() for i in ids]
        return [pa.array([len(i) for i in ids], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(_by_slices(run, ["n_tokens", "ids_sha256", "decoded_sha256"]), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encoded(read(spark, sf_dir, "documents")))
