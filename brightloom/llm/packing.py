"""Operator 4: best-fit packing of token pieces into sequences, improved by swaps between underfull bins.

Documents become ids of a public tokenizer and one end id; only those longer than a sequence are cut. Pieces are
dealt evenly to groups of bounded size, and each group is packed by itself: first best fit, longest piece first, then
local search. The search takes the emptiest bin and moves its pieces into the slack of others, swaps one of them for a
shorter one, or two of them for one shorter than both together. Each step moves tokens from a bin to a fuller one, so
the sum of squared fills grows, until the bin is empty. It goes through all bins that aren't full, and ends sooner only
if no group can do with fewer. Then the pieces of all underfull bins of all groups are dealt to groups of their own and
packed once more, so groups exchange pieces too; what that leaves is kept if it needs fewer sequences.

Ids are those of the tokenizer's plain call on the whole text. It never joins characters over white space, so the ids
of a text are those of its words, and words are encoded once for a batch, many at a time. Texts that hold the
tokenizer's own special tokens are encoded whole.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each for itself; equal lengths are
taken in the order of doc_id, piece and ids; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import string
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_id, written

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 8192
#: Words whose ids a task keeps from batch to batch, at most; beyond, those that the last batch has once go.
KEPT_WORDS = 600_000
#: Texts read at a time, and words encoded by one call.
TEXTS, CALL_WORDS = 500, 5_000
#: Bins with less room than this share of a sequence aren't packed again.
TIGHT = 1 / 128
#: Letters before this one are kept by normal form C, and Python lower-cases them as the tokenizer does.
LATIN_END = "\u0250"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES.replace("doc_id long", "doc_id string") + ", sequence_id long, offset long, room long"


@cache
def _tokenizers(path: str) -> tuple[Tokenizer, Tokenizer, Tokenizer, np.ndarray]:
    """The tokenizer, the same model without the rules that leave small ASCII and Latin letters and single spaces as they are,
    and which ids end a word. Loaded once for all tasks of a Python worker."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

    tokenizer = Tokenizer.from_file(path)
    ascii, latin = Tokenizer(tokenizer.model), Tokenizer(tokenizer.model)
    ascii.pre_tokenizer = WhitespaceSplit()
    latin.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return tokenizer, ascii, latin, ends


class Encoder:
    """Ids of texts as little-endian bytes."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.ascii, self.latin, self.ends = _tokenizers(str(path))
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str], tokenizer: Tokenizer | None = None) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Ids of words that end before `ends`, with a gap behind each."""
        raw, start = ids.tobytes(), 0
        for word, end in zip(words, ends.tolist()):
            self.known[word] = raw[4 * start : 4 * end]
            start = end + gap

    def _learn(self, words: list[str]) -> None:
        """Encodes words joined by a special token, which the tokenizer cuts out first, and cuts the ids at it."""
        mark, number = next(iter(self.special.items()))
        chunks = [words[at : at + CALL_WORDS] for at in range(0, len(words), CALL_WORDS)]
        for some, ids in zip(chunks, self._encode([mark.join(c) for c in chunks])):
            self._keep(some, ids, np.append(np.flatnonzero(ids == number), len(ids)), 1)

    def _learn_letters(self, words: list[str], tokenizer: Tokenizer | None = None) -> None:
        """Encodes words of letters joined by spaces: the last id of each ends a word, and no other one does."""
        chunks = [words[at : at + CALL_WORDS] for at in range(0, len(words), CALL_WORDS)]
        for some, ids in zip(chunks, self._encode([" ".join(c) for c in chunks], tokenizer)):
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                self._keep(some, ids, ends, 0)
            else:  # letters of which the tokenizer makes more
                self._learn(some)

    def _meet(self, new: list[str]) -> None:
        """Makes new words known. The tokenizer lower-cases, and letters never join with the ASCII punctuation behind them, so
        words of letters are encoded in lower case and without it. (A capital sigma has two small ones, and normal form C cuts
        some letters into a letter and a mark, which does join.)"""
        known = self.known
        plain: set[str] = set()
        latin: set[str] = set()
        letters: set[str] = set()
        rest: set[str] = set()
        made = []
        for word in new:
            stem = word.rstrip(string.punctuation)
            if not stem.isalpha():
                rest.add(word)
                continue
            low = stem.lower()
            if stem.isascii():
                of = plain
            elif "\u03a3" not in stem and len(low) == len(stem) and unicodedata.is_normalized("NFC", stem):
                of = latin if max(low) < LATIN_END else letters
            else:
                rest.add(word)
                continue
            if low not in known:
                of.add(low)
            if word != low:
                end = word[len(stem) :]
                made.append((word, low, end))
                if end not in known:
                    rest.add(end)
        self._learn_letters(list(plain), self.ascii)
        self._learn_letters(list(latin), self.latin)
        self._learn_letters(list(letters))
        self._learn(list(rest))
        for word, low, end in made:
            known[word] = known[low] + known[end]

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [any(s in t for s in self.special) for t in texts]
        rest = pa.array(["" if w else t for t, w in zip(texts, whole)], pa.large_string())
        parts = pc.split_pattern(pc.replace_substring(rest, "\n", " "), " ")
        coded = pc.dictionary_encode(parts.flatten())
        words, word = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self._meet([w for w in words if w not in self.known])
        raw = [self.known[w] for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        start, n = (np.cumsum(length) - length)[word], length[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(raw), "<u4")[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[parts.offsets.to_numpy()].tolist()
        out = [self._encode([t])[0].tobytes() if w else ids[a:b].tobytes() for t, w, a, b in zip(texts, whole, bounds, bounds[1:])]
        if len(self.known) > KEPT_WORDS:
            often = np.flatnonzero(np.bincount(word, minlength=len(words)) > 1).tolist()
            self.known = {words[k]: raw[k] for k in often}
        return out


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(tokenizer), END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for first in range(0, batch.num_rows, TEXTS):
                some = batch.slice(first, TEXTS)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(texts)):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = zip(*out) if out else ([] for _ in range(5))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set when a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                some &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            with_room[room - n].append(b)
            some |= 1 << (room - n)
    return bins


def emptied(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """The same pieces in fewer bins, if local search finds a way."""
    least = math.ceil(int(lengths.sum()) / capacity)
    where = np.empty(len(lengths), np.int64)
    for b, members in enumerate(bins):
        where[members] = b
    fill = np.bincount(where, weights=lengths, minlength=len(bins)).astype(np.int64)
    left = len(bins)
    for b in np.argsort(fill, kind="stable").tolist():
        if left <= least or fill[b] == capacity:
            break
        was, fill_was = where.copy(), fill.copy()
        while fill[b]:
            own = np.flatnonzero(where == b)
            room = capacity - fill
            room[b] = 0
            room[fill == 0] = 0
            # a move: the longest piece that fits somewhere, into the tightest room
            own = own[np.argsort(-lengths[own], kind="stable")]
            fits = own[lengths[own] <= room.max()]
            if len(fits):
                x = int(fits[0])
                c = int(np.where(room >= lengths[x], room, capacity + 1).argmin())
                where[x] = c
                fill[c] += lengths[x]
                fill[b] -= lengths[x]
                continue
            # swaps among bins with room: one for one, then two for one
            others = np.flatnonzero((room[where] > 0) & (where != b))
            slack, theirs = room[where[others]], lengths[others]
            best, swap = 0, None
            sums = [(int(lengths[x]), (int(x),)) for x in own]
            sums += [(int(lengths[x] + lengths[y]), (int(x), int(y))) for k, x in enumerate(own) for y in own[k + 1 :]]
            for total, given in dict(reversed(sums)).items():
                gain = total - theirs
                gain[(gain <= 0) | (gain > slack)] = 0
                if len(gain) and gain.max() > best:
                    at = int(gain.argmax())
                    best, swap = int(gain[at]), (given, int(others[at]))
            if swap is None:
                break
            given, taken = swap
            c = int(where[taken])
            where[list(given)] = c
            where[taken] = b
            fill[c] += best
            fill[b] -= best
        if fill[b]:
            where, fill = was, fill_was
        else:
            left -= 1
    out: dict[int, list[int]] = {}
    for i, b in enumerate(where.tolist()):
        out.setdefault(b, []).append(i)
    return list(out.values())


def _packed(pieces: DataFrame, capacity: int, group_pieces: int, level: int) -> DataFrame:
    """pieces with sequence_id, offset and what their sequence has left; each group by itself."""
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
        lengths = group["length"].to_numpy(np.int64)
        bins = emptied(lengths, best_fit(lengths, capacity), capacity)
        sequence, offset, room = (np.empty(len(group), np.int64) for _ in range(3))
        for b, members in enumerate(bins):
            sequence[members] = (int(group["_group"].iloc[0]) << 24) + (b << 1) + level
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
            room[members] = capacity - lengths[members].sum()
        return group.drop(columns=["_group"]).assign(sequence_id=sequence, offset=offset, room=room)

    deal = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups))
    dealt = pieces.withColumn("_group", deal).withColumn("doc_id", text_id("doc_id"))
    placed = dealt.groupBy("_group").applyInPandas(one, PLACED)
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (as from pieces_of) with sequence_id and offset. They should be a written table, for they are counted."""
    first = written(_packed(pieces, capacity, group_pieces, 0), "placed")
    loose = first.where(F.col("room") > capacity * TIGHT)
    second = written(_packed(loose.select(*pieces.columns), capacity, group_pieces, 1), "placed-again")
    before, after = (x.agg(F.count_distinct("sequence_id")).first()[0] for x in (loose, second))
    out = first if after >= before else first.where(F.col("room") <= capacity * TIGHT).unionByName(second)
    return out.drop("room")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(pieces_of(docs, tokenizer, capacity), "pieces"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
