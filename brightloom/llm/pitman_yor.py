"""Operator 1: a hierarchical Pitman-Yor language model whose seating is sampled by Gibbs sweeps.

Restaurants: one for each word as a context, however rare, and one for the starts of texts, all with one parent, whose
base is uniform over the training words and one unknown slot. A customer is a word after its context in a training
text. Sweeps are rounds over the cluster: each seats the customers of every pair of words anew given all tables of the
round before, then the parent's, whose customers are the tables below. A round's seating is drawn DRAWS times and
averaged. Customers sit down one by one up to a point, then in blocks that grow by a twentieth. A text's score is the sum
of the log10 of the predictive probabilities of its words and its end.

Texts don't travel. A task makes chunks of about CHUNK tokens: numbers of its own for words, and the different pairs. A
pair's count in a chunk goes to the bucket of the pair's hash, where those of all chunks meet; the sum comes back to each
chunk in the order sent, and one chunk is told that the pair is its own, to draw its tables. Words' counts and tables are
summed in buckets of words likewise, and tables of pairs go through the pairs' buckets once, after the last round; so a
chunk knows all that a probability is made of. Buckets are of hashes and hold a row of each chunk, so a frequent word or
pair is one number of each. Draws depend on the pair and the round alone, however texts are dealt.

Defined cases: a null or empty text has its end as only token; a null doc_id is in training; repeated rows each count
in training and are each scored; without training texts every count is 0 and the probabilities are those of the base;
an empty table gives no rows; other columns of the input are ignored. Words are compared as hashes of 64 bits, pairs of 56.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold_of, discard, read, released, written
from .shingles import mixed

FOLDS = 10
CONTEXTS = 62
WIDTH = CONTEXTS + 2  # contexts of `sampled`
SWEEPS, BURN_IN = 10, 4  # of `sampled`
ROUNDS, DRAWS = 2, 3
DISCOUNT, STRENGTH = 0.8, 20.0  # of context restaurants
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 20.0
ONE_BY_ONE = 32
#: Bits of a pair's hash, most of what is sent.
PAIR_BITS = 56
#: Tokens of a chunk, and bytes of texts for each bucket of pairs and of words.
CHUNK, PAIR_BYTES, WORD_BYTES = 1_500_000, 8 << 20, 48 << 20
#: Numbers of the start and the end of a text among the words of a chunk.
START, END = 0, 1
#: Kinds of rows: a chunk's texts, counts of its pairs, where a bucket has them, tables of pairs, totals for the driver, and
#: from WORDS on the words of each round.
TEXTS, PAIRS, PLACES, DRAWN, TOTALS, WORDS = range(6)
SENT = "chunk long, kind int, bucket int, data binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, hpy double"
_P = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and crc_fold_of(doc_id, FOLDS) == 0


def uniform(keys: np.ndarray, *of: int) -> np.ndarray:
    """A number from 0 to 1 for each key, another one for each `of`."""
    salt = np.zeros(1, np.uint64)
    for x in of:
        salt = mixed((salt + np.uint64(x + 1)) * _P)
    return (mixed(keys ^ salt) >> np.uint64(11)) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Where u lies in the binomial distribution; the normal one where its first terms vanish."""
    start = n * np.log1p(-p)
    k, below = np.zeros(len(n)), u.copy()
    flat = start < -600
    if flat.any():
        mean, sd = n[flat] * p[flat], np.sqrt(n[flat] * p[flat] * (1 - p[flat]))
        v = np.clip(u[flat], 1e-12, 1 - 1e-12)
        k[flat] = np.clip(np.rint(mean + sd * np.log(v / (1 - v)) * math.sqrt(3) / math.pi), 0, n[flat])
    left = np.flatnonzero(~flat)
    term = np.exp(start[left])
    while len(left):
        below[left] -= term
        go = (below[left] > 0) & (k[left] < n[left])
        left, term = left[go], term[go]
        term = term * (n[left] - k[left]) / (k[left] + 1) * p[left] / (1 - p[left])
        k[left] += 1
    return k


def tables(customers: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator | None, keys: np.ndarray | None = None, of: tuple[int, ...] = ()) -> np.ndarray:
    """Tables after seating that many customers who eat one dish; mass is the weight of a new table. Draws are rng's, or
    else depend on keys and `of` alone."""
    t = (customers > 0).astype(np.float64)
    left = np.flatnonzero(customers > 1)
    seated = 1
    while len(left):
        if seated < ONE_BY_ONE:
            p = mass[left] / (seated - discount * t[left] + mass[left])
            t[left] += (rng.random(len(left)) if keys is None else uniform(keys[left], *of, seated)) < p
            seated += 1
        else:
            step = max(1, seated // 20)
            p = mass[left] / (seated - discount * t[left] + mass[left])
            block = np.minimum(step, customers[left] - seated).astype(np.int64)
            t[left] += rng.binomial(block, p) if keys is None else binomial(block, p, uniform(keys[left], *of, seated))
            seated += step
        left = left[customers[left] > seated]
    return t


@dataclass(frozen=True)
class Totals:
    """What restaurants have beside the words of a task: customers (exact) and tables (as far as known)."""

    customers: np.ndarray  # by context
    other_tables: np.ndarray  # by context, of words dealt elsewhere in another way
    parts: float  # tasks like this one
    other_root: float
    words: float


def sampled(cell_word: np.ndarray, cell_context: np.ndarray, count: np.ndarray, n_words: int, ask_cell: np.ndarray, ask_word: np.ndarray, ask_context: np.ndarray, totals: Totals, seed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of WIDTH contexts on one machine, which the seating is tested on: averaged predictive probabilities of the asked (cell or -1, word, context), and the tables of the last sweep:
    by context, and of the parent."""
    rng = np.random.default_rng(seed)
    base = 1.0 / (totals.words + 1)
    t = np.minimum(count, 1).astype(float)
    total = np.zeros(len(ask_word))
    root_tables = 0.0
    below = np.bincount(cell_word, t, n_words)
    t0 = np.minimum(below, 1)
    for sweep in range(SWEEPS):
        by_context = totals.other_tables + totals.parts * np.bincount(cell_context, t, WIDTH)
        root_tables = totals.other_root + totals.parts * t0.sum()
        root_customers = by_context.sum()
        spare = ROOT_STRENGTH + ROOT_DISCOUNT * root_tables
        parent = (below - ROOT_DISCOUNT * t0 + spare * base) / (ROOT_STRENGTH + root_customers)
        t = tables(count, (STRENGTH + DISCOUNT * by_context)[cell_context] * parent[cell_word], DISCOUNT, rng)
        below = np.bincount(cell_word, t, n_words)
        t0 = tables(below, np.full(n_words, spare * base), ROOT_DISCOUNT, rng)
        if sweep >= BURN_IN:
            by_context = totals.other_tables + totals.parts * np.bincount(cell_context, t, WIDTH)
            root_tables = totals.other_root + totals.parts * t0.sum()
            spare = ROOT_STRENGTH + ROOT_DISCOUNT * root_tables
            parent = (below - ROOT_DISCOUNT * t0 + spare * base) / (ROOT_STRENGTH + by_context.sum())
            own = np.where(ask_cell >= 0, (count - DISCOUNT * t)[ask_cell], 0.0) if len(count) else np.zeros(len(ask_word))
            new = (STRENGTH + DISCOUNT * by_context)[ask_context] * parent[ask_word]
            total += (own + new) / (STRENGTH + totals.customers)[ask_context]
    return total / (SWEEPS - BURN_IN), np.bincount(cell_context, t, WIDTH), float(t0.sum())


class _Words(dict):
    """Numbers of the words of a chunk, and their hashes in that order."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []
        for word in (b" ", b""):  # no words: START and END
            self[word]

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        found = self[word] = len(self)
        return found


@dataclass
class Chunk:
    """Rows of some tokens in all, each different text once."""

    ids: list[int | None] = field(default_factory=list)
    text_of: list[int] = field(default_factory=list)
    training: list[int] = field(default_factory=list)  # rows of each text in training
    sizes: list[int] = field(default_factory=list)
    tokens: list[np.ndarray] = field(default_factory=list)
    seen: dict[str | None, int] = field(default_factory=dict)
    words: _Words = field(default_factory=_Words)
    length: int = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        at = self.seen.setdefault(text, len(self.sizes))
        if at == len(self.sizes):
            words = (text or "").encode().lower().split()
            out = np.full(len(words) + 1, END, np.int32)
            out[:-1] = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
            self.tokens.append(out)
            self.sizes.append(len(out))
            self.training.append(0)
            self.length += len(out)
        self.ids.append(doc_id)
        self.text_of.append(at)
        self.training[at] += not held_out(doc_id)

    def state(self) -> State:
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        return State(ids, np.array([i is None for i in self.ids]), np.array(self.text_of, np.int32), np.array(self.training, np.int32), np.array(self.sizes, np.int32), np.concatenate(self.tokens), np.array(self.words.hashes, np.uint64))


@dataclass(frozen=True)
class State:
    """A chunk as it is kept. Pairs are in the order of their hashes, words in that of theirs where they are sent."""

    ids: np.ndarray
    null: np.ndarray
    text_of: np.ndarray
    training: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    hashes: np.ndarray  # of words

    def columns(self) -> list[np.ndarray]:
        return [self.ids, self.null, self.text_of, self.training, self.sizes, self.tokens, self.hashes]

    def before(self) -> np.ndarray:
        """The context of each token."""
        out = np.roll(self.tokens, 1)
        out[np.cumsum(self.sizes) - self.sizes] = START
        return out

    def pairs(self, places: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context, word and hash of the different pairs, and the place among them of each token's (if places)."""
        n = len(self.hashes)
        code = self.before().astype(np.int64)
        code *= n
        code += self.tokens
        at, bits = None, len(code).bit_length()
        if not places:
            code = np.sort(code)
            code = code[np.append(True, code[1:] != code[:-1])]
        elif (n * n).bit_length() + bits < 64:  # a code and its place are one number
            code <<= bits
            code |= np.arange(len(code))
            code.sort()
            where = code & ((1 << bits) - 1)
            code >>= bits
            new = np.append(True, code[1:] != code[:-1])
            at = np.empty(len(code), np.int32)
            at[where] = np.cumsum(new, dtype=np.int32) - 1
            code = code[new]
        else:
            code, at = np.unique(code, return_inverse=True)
        context, word = (v.astype(np.int32) for v in np.divmod(code, n))
        h = mixed(self.hashes[context] * _P + self.hashes[word]) >> np.uint64(64 - PAIR_BITS)
        order = np.argsort(h)
        if at is not None:
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            at = place[at]
        return context[order], word[order], h[order], at


def packed(*columns: np.ndarray) -> bytes:
    """Columns byte by byte, as high ones are mostly equal."""
    raw = [(c.dtype.str, len(c), np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes()) for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(raw, 5))


def unpacked(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n))
    return out


def dealt(chunk: int, kind: int, hashes: np.ndarray, bits: int, buckets: int, *columns: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Rows for the buckets of ascending hashes of so many bits."""
    bucket = ((hashes >> np.uint64(bits - 24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else bucket
    ends = np.append(starts[1:], len(bucket))
    return [(chunk, kind, int(bucket[a]), packed(*(c[a:b] for c in columns))) for a, b in zip(starts, ends)]


def _frame(rows: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "data"])


def _of(group: pd.DataFrame, kind: int) -> list[np.ndarray]:
    """Columns of the rows of a kind, in the order of buckets."""
    parts = group[group["kind"] == kind].sort_values("bucket")["data"]
    return [np.concatenate(c) for c in zip(*map(unpacked, parts))]


def _back(group: pd.DataFrame, kind: int, sizes: list[int], *columns: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Rows for the chunks whose rows a bucket has, in the order that each sent."""
    ends = np.cumsum(sizes)
    return [(chunk, kind, bucket, packed(*(c[b - n : b] for c in columns))) for chunk, bucket, n, b in zip(group["chunk"], group["bucket"], sizes, ends)]


def summed_pairs(group: pd.DataFrame) -> pd.DataFrame:
    """The counts of a bucket's pairs over all chunks, and whether a chunk is the pair's own; and each chunk's places among
    the bucket's pairs, whether it is its own, and whether it is there more than once."""
    sent = [unpacked(d) for d in group["data"]]
    hashes, counts = (np.concatenate(c) for c in zip(*sent))
    _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
    own = np.zeros(len(hashes), bool)
    own[first] = True
    counts = np.bincount(at, counts).astype(np.int64)[at]
    sizes = [len(v[0]) for v in sent]
    return _frame([*_back(group, PAIRS, sizes, counts, own), *_back(group, PLACES, sizes, at.astype(np.int32), own, counts > 1)])


def told_tables(group: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, the tables of its pairs that occur more than once, which their own chunks have drawn."""
    places = group[group["kind"] == PLACES]
    drawn = {chunk: unpacked(data)[0] for chunk, data in zip(*(group.loc[group["kind"] == DRAWN, c] for c in ("chunk", "data")))}
    sent = [unpacked(d) for d in places["data"]]
    t = np.full(max(int(at.max()) for at, _, _ in sent) + 1, DRAWS, np.int32)
    for chunk, (at, own, many) in zip(places["chunk"], sent):
        if chunk in drawn:
            t[at[own & many]] = drawn[chunk]
    return _frame([(chunk, DRAWN, bucket, packed(t[at[many]])) for chunk, bucket, (at, _, many) in zip(places["chunk"], places["bucket"], sent)])


@dataclass(frozen=True)
class Root:
    """The parent of all restaurants, and counts of the training texts."""

    tokens: int = 0
    words: int = 0
    customers: float = 0.0
    tables: float = 0.0

    @property
    def spare(self) -> float:
        return (ROOT_STRENGTH + ROOT_DISCOUNT * self.tables) / (self.words + 1)

    def p(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - ROOT_DISCOUNT * tables + self.spare) / (ROOT_STRENGTH + self.customers)


def summed_words(kind: int, root: Root | None, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Counts of a bucket's words, tables in their restaurants (summed over draws), tables that serve them in all, and those of the parent. At
    first, without a root, each word has one table there. Buckets of drawn pairs may come along."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if group["kind"].iloc[0] != kind:
            return told_tables(group)
        sent = [unpacked(d) for d in group["data"]]
        hashes, *columns = (np.concatenate(c) for c in zip(*sent))
        keys, at = np.unique(hashes, return_inverse=True)
        count, inside, serving = (np.bincount(at, c) for c in columns)
        served = np.rint(serving / DRAWS)
        top = np.minimum(served, 1) if root is None else tables(served, np.full(len(keys), root.spare), ROOT_DISCOUNT, None, keys, (seed, kind))
        rows = _back(group, kind, [len(s[0]) for s in sent], *(c.astype(np.int64)[at] for c in (count, inside, served, top)))
        totals = packed(np.array([count.sum(), (count > 0).sum(), served.sum(), top.sum()]))
        return _frame([*rows, (-1, TOTALS, int(group["bucket"].iloc[0]), totals)])

    return run


class Known:
    """What a chunk knows of its words after a round, by their numbers."""

    def __init__(self, group: pd.DataFrame, kind: int, state: State, root: Root) -> None:
        order = np.argsort(state.hashes)
        columns = []
        for c in _of(group, kind):
            own = np.empty(len(c), c.dtype)
            own[order] = c
            columns.append(own)
        self.count, inside, served, top = columns
        self.p = root.p(served, top)
        self.weight = STRENGTH + DISCOUNT * inside / DRAWS  # of a new table
        customers = self.count.astype(float)
        customers[START] = self.count[END]  # as many starts as ends
        self.size = STRENGTH + customers


def seats(context: np.ndarray, word: np.ndarray, h: np.ndarray, count: np.ndarray, known: Known, of: tuple[int, ...]) -> np.ndarray:
    """Tables of pairs, summed over draws."""
    t = np.minimum(count, 1) * DRAWS
    many = np.flatnonzero(count > 1)
    mass = known.weight[context[many]] * known.p[word[many]]
    t[many] = sum(tables(count[many], mass, DISCOUNT, None, h[many], (*of, k)) for k in range(DRAWS))
    return t


def fit_and_score(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pair_buckets, word_buckets = (max(1, math.ceil(size / b)) for b in (PAIR_BYTES, WORD_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk, and the counts of its pairs in training."""
        number = TaskContext.get().partitionId() << 32

        def rows(chunk: Chunk) -> Iterator[pa.RecordBatch]:
            state = chunk.state()
            _, _, h, at = state.pairs()
            counts = np.bincount(at, np.repeat(state.training, state.sizes), len(h)).astype(np.int64)
            for some in ([(number, TEXTS, 0, packed(*state.columns()))], dealt(number, PAIRS, h, PAIR_BITS, pair_buckets, h, counts)):
                cols = [pa.array(list(v), k) for v, k in zip(zip(*some), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SENT.split(", ")])

        chunk = Chunk()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunk.add(doc_id, text)
                if chunk.length >= CHUNK:
                    yield from rows(chunk)
                    chunk, number = Chunk(), number + 1
        if chunk.ids:
            yield from rows(chunk)

    sent = written(docs.mapInArrow(send, SENT), "chunks", by="kind")
    texts = sent.where(F.col("kind") == TEXTS)
    met = written(sent.where(F.col("kind") == PAIRS).groupBy("bucket").applyInPandas(summed_pairs, SENT), "pairs", by="kind")
    known = texts.unionByName(met.where(F.col("kind") == PAIRS))
    discard(sent, part=f"kind={PAIRS}")
    released(docs.sparkSession)

    def seated(n: int, root: Root | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
        """Counts of a chunk's words, and the tables of its own pairs by context and by word: one each at first, then drawn."""

        def run(group: pd.DataFrame) -> pd.DataFrame:
            state = State(*_of(group, TEXTS))
            context, word, h, _ = state.pairs(places=False)
            count, own = _of(group, PAIRS)
            context, word, h, count = (v[own] for v in (context, word, h, count))
            t = np.minimum(count, 1) * DRAWS if root is None else seats(context, word, h, count, Known(group, WORDS + n - 1, state, root), (seed, n))
            order, size = np.argsort(state.hashes), len(state.hashes)
            columns = np.bincount(state.tokens, np.repeat(state.training, state.sizes), size).astype(np.int64), np.bincount(context, t, size).astype(np.int64), np.bincount(word, t, size).astype(np.int64)
            chunk, many = int(group["chunk"].iloc[0]), count > 1
            drawn = dealt(chunk, DRAWN, h[many], PAIR_BITS, pair_buckets, t[many].astype(np.int32)) if n == ROUNDS else []
            return _frame([*drawn, *dealt(chunk, WORDS + n, state.hashes[order], 64, word_buckets, *(c[order] for c in (state.hashes, *columns)))])

        return run

    roots: list[Root] = []
    words: DataFrame | None = None
    for n in range(ROUNDS + 1):
        root, before = roots[-1] if roots else None, words
        counts = (known if before is None else known.unionByName(before.where("chunk >= 0"))).groupBy("chunk").applyInPandas(seated(n, root), SENT)
        if n == ROUNDS:  # the tables of pairs go to all chunks that have them
            counts = counts.unionByName(met.where(F.col("kind") == PLACES))
        places = F.col("kind").isin(PLACES, DRAWN)
        words = written(counts.groupBy("bucket", places.alias("_p")).applyInPandas(summed_words(WORDS + n, root, seed), SENT), "words")
        totals = [unpacked(bytes(r["data"]))[0] for r in words.where("chunk < 0").select("data").collect()]
        tokens, kinds, customers, tops = np.sum(totals, axis=0) if totals else np.zeros(4)
        roots.append(Root(int(tokens), int(kinds), float(customers), float(tops)))
        if before is not None:
            discard(before)
        released(docs.sparkSession)

    root = roots[-1]

    def scored(group: pd.DataFrame) -> pd.DataFrame:
        state = State(*_of(group, TEXTS))
        context, word, _, at = state.pairs()
        count, _ = _of(group, PAIRS)
        t, now = np.minimum(count, 1).astype(np.int32) * DRAWS, Known(group, WORDS + ROUNDS, state, root)
        if (count > 1).any():
            t[count > 1] = _of(group, DRAWN)[0]
        p = np.log10((count - DISCOUNT / DRAWS * t + now.weight[context] * now.p[word]) / now.size[context])[at]
        starts = np.cumsum(state.sizes) - state.sizes
        known, base, hpy = (np.add.reduceat(v, starts) for v in ((now.count > 0)[state.tokens].astype(np.int64), np.log10(now.count + 0.1)[state.tokens], p))
        ids = pd.Series(state.ids).astype("Int64").mask(state.null)
        held = [held_out(None if no else int(i)) for i, no in zip(state.ids, state.null)]
        return pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": state.sizes[state.text_of].astype(np.int64), "n_known": known[state.text_of], "base": base[state.text_of], "hpy": hpy[state.text_of]})

    own = known.unionByName(words.where("chunk >= 0")).groupBy("chunk").applyInPandas(scored, SCORED)
    denominator = math.log10(root.tokens + 0.1 * (root.words + 1))
    return own.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(root.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * denominator).alias("base_score"),
        F.col("hpy").alias("score"),
    )


def perplexity(scores: DataFrame, held: bool = True) -> DataFrame:
    """Perplexities of the model and of the base over the (not) held out texts, for each token."""

    def of(column: str) -> Column:
        return F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens"))

    return scores.where(F.col("held_out") == held).agg(of("score").alias("model"), of("base_score").alias("base"))


def op1_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_score(read(spark, sf_dir, "documents"))
