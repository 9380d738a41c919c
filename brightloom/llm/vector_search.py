"""Operator 9: nearest neighbours by score-aware anisotropic quantisation, four-bit tables and exact reranking.

The nearest of a query q by Euclidean distance has the largest <q, x> - |x|^2 / 2. The second term is kept exactly; x
is quantised for the first. What matters for large inner products is the error along x, so the loss of a codebook
weighs the residual's part parallel to x by ETA, as in anisotropic vector quantisation. Codes are chosen by coordinate
descent over subspaces and centres by the weighted least squares of that loss. Each subspace has 16 centres: a code has
four bits, two to a byte.

Codebooks are fitted on a bounded sample (SAMPLE vectors, those with the smallest hashes of their id); every vector is
indexed. Queries go in blocks of bounded size against all index rows: sums of table entries pick CANDIDATES of each
chunk, and their exact distances on the original vectors, in double precision, decide. So do those of every other row
whose table score, with the error that quantisation can make, reaches the k-th best: the result is that of brute force.

All sums are in double precision, on vectors scaled by a power of two, which is exact, so that the largest component is
near one: squares of large components don't overflow, and distances are scaled back.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of each length
are searched among themselves, as others have no distance to them; a query is no candidate of its own, nor is another
row with its vec_id; repeated rows are candidates each for itself; with fewer candidates all are returned; ties
go to the smaller vec_id; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read, written

SAMPLE = 20_000
CENTRES = 16
SUBSPACE = 2
THRESHOLD = 0.2
ROUNDS = 8
CANDIDATES = 100
CHUNK = 8192
QUERY_BLOCK = 2048
FOUND = "query_id long, vec_id long, score double"
TINY = np.finfo(np.float64).tiny


@dataclass(frozen=True)
class Codebooks:
    centres: np.ndarray  # subspaces x 16 x width
    eta: float

    def split(self, x: np.ndarray) -> np.ndarray:
        spaces, _, width = self.centres.shape
        return np.pad(x, ((0, 0), (0, spaces * width - x.shape[1]))).reshape(len(x), spaces, width)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """A code for each row and subspace, by coordinate descent on the anisotropic loss."""
        parts = self.split(x)
        along = parts / np.maximum(np.linalg.norm(x, axis=1), TINY)[:, None, None]
        chosen = np.empty(parts.shape[:2], np.int64)
        for m in range(parts.shape[1]):
            chosen[:, m] = ((parts[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1)
        for _ in range(sweeps):
            residual = parts - self.centres[np.arange(parts.shape[1]), chosen]
            parallel = np.einsum("nmw,nmw->nm", along, residual)
            total = parallel.sum(1)
            for m in range(parts.shape[1]):
                gap = parts[:, m, None] - self.centres[m]
                p = np.einsum("nw,nkw->nk", along[:, m], gap)
                rest = total - parallel[:, m]
                loss = (gap**2).sum(2) + (self.eta - 1) * (rest[:, None] + p) ** 2
                chosen[:, m] = loss.argmin(1)
                parallel[:, m] = p[np.arange(len(p)), chosen[:, m]]
                total = rest + parallel[:, m]
        return chosen

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all centres: queries x subspaces x 16."""
        return np.einsum("qmw,mkw->qmk", self.split(queries), self.centres)


def fitted(sample: np.ndarray, seed: int = 9) -> Codebooks:
    n, dim = sample.shape
    spaces = math.ceil(dim / SUBSPACE)
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    draw = np.random.default_rng(seed)
    book = Codebooks(np.zeros((spaces, CENTRES, SUBSPACE)), eta)
    parts = book.split(sample)
    centres = np.stack([parts[draw.integers(0, n, CENTRES), m] for m in range(spaces)])
    for _ in range(6):  # plain k-means to start with
        for m in range(spaces):
            near = ((parts[:, m, None] - centres[m]) ** 2).sum(2).argmin(1)
            count = np.bincount(near, minlength=CENTRES)
            sums = np.stack([np.bincount(near, parts[:, m, w], CENTRES) for w in range(SUBSPACE)], 1)
            centres[m] = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres[m])
    along = parts / np.maximum(np.linalg.norm(sample, axis=1), TINY)[:, None, None]
    for _ in range(ROUNDS):
        book = Codebooks(centres, eta)
        codes = book.codes(sample, 1)
        centres = centres.copy()
        for m in range(spaces):
            residual = parts - centres[np.arange(spaces), codes]
            rest = np.einsum("nmw,nmw->n", along, residual) - np.einsum("nw,nw->n", along[:, m], residual[:, m])
            u, x = along[:, m], parts[:, m]
            goal = x + (eta - 1) * u * (rest + np.einsum("nw,nw->n", u, x))[:, None]
            for k in range(CENTRES):
                own = codes[:, m] == k
                if own.any():
                    bend = own.sum() * np.eye(SUBSPACE) + (eta - 1) * u[own].T @ u[own]
                    centres[m, k] = np.linalg.solve(bend, goal[own].sum(0))
    return Codebooks(centres, eta)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte."""
    even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
    return even[:, 0::2] | (even[:, 1::2] << 4)


def unpacked(raw: np.ndarray, spaces: int) -> np.ndarray:
    both = np.stack([raw & 15, raw >> 4], axis=2).reshape(len(raw), -1)
    return both[:, :spaces]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))


def _matrix(col: pd.Series, power: int) -> np.ndarray:
    return np.ldexp(np.vstack(col.to_numpy()).astype(np.float64), -power)


def indexed(rows: DataFrame, book: Codebooks, power: int = 0) -> DataFrame:
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                raw = packed(book.codes(_matrix(b["embedding"], power)))
                yield b.assign(codes=[r.tobytes() for r in raw])

    return rows.mapInPandas(encode, f"vec_id long, embedding {dict(rows.dtypes)['embedding']}, codes binary")


def _scan(index: DataFrame, book: Codebooks, power: int, ids: np.ndarray, queries: np.ndarray, k: int, candidates: int) -> DataFrame:
    """The k nearest of each (scaled) query of a block, as a written table: first in each partition of the index, then of all."""
    held = index.sparkSession.sparkContext.broadcast((book, ids, queries))

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for b in batches:
            kept.append(b)
            if sum(map(len, kept)) >= CHUNK:
                yield pd.concat(kept)
                kept = []
        if kept:
            yield pd.concat(kept)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, ids, queries = held.value
        tables = book.tables(queries)
        spaces = tables.shape[1]
        best_s = np.full((len(ids), k), np.inf)
        best_v = np.full((len(ids), k), np.iinfo(np.int64).max)
        for chunk in chunks(batches):
            if not len(chunk):
                continue
            names, x = chunk["vec_id"].to_numpy(np.int64), _matrix(chunk["embedding"], power)
            codes = unpacked(np.frombuffer(b"".join(chunk["codes"]), np.uint8).reshape(len(chunk), -1), spaces)
            norms = np.linalg.norm(x, axis=1)
            half = 0.5 * (x**2).sum(1)
            gap = np.linalg.norm((book.split(x) - book.centres[np.arange(spaces), codes]).reshape(len(x), -1), axis=1)
            most = min(len(chunk), candidates + 1)
            for at in range(0, len(ids), 128):
                part = slice(at, at + 128)
                score = np.repeat(-half[None], len(ids[part]), axis=0)
                for m in range(spaces):
                    score += tables[part, m][:, codes[:, m]]
                near = np.argpartition(-score, most - 1, axis=1)[:, :most]
                exact = np.sqrt(((x[near] - queries[part, None]) ** 2).sum(2))
                exact[names[near] == ids[part, None]] = np.inf
                s = np.hstack([best_s[part], exact])
                v = np.hstack([best_v[part], names[near]])
                order = np.lexsort((v, s), axis=1)[:, :k]
                best_s[part], best_v[part] = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)
                if most == len(chunk):
                    continue
                size = np.linalg.norm(queries[part], axis=1)[:, None]
                least = 0.5 * (size**2 - best_s[part, -1:] ** 2)
                loose = 1e-11 * (size * (norms + gap) + 0.5 * norms**2 + 0.5 * size**2)  # rounding of the sums
                may = score + size * gap + loose >= least
                may &= queries[part] @ x.T - 0.5 * norms**2 + loose >= least
                np.put_along_axis(may, near, False, 1)
                for i in np.flatnonzero(may.any(1)).tolist():
                    rows = np.flatnonzero(may[i] & (names != ids[at + i]))
                    s = np.append(best_s[at + i], np.sqrt(((x[rows] - queries[at + i]) ** 2).sum(1)))
                    v = np.append(best_v[at + i], names[rows])
                    order = np.lexsort((v, s))[:k]
                    best_s[at + i], best_v[at + i] = s[order], v[order]
        q, r = np.nonzero(np.isfinite(best_s))
        yield pd.DataFrame({"query_id": ids[q], "vec_id": best_v[q, r], "score": np.ldexp(best_s[q, r], power)})

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    found = index.mapInPandas(scan, FOUND).withColumn("rank", rank).where(F.col("rank") <= k)
    out = written(found.select("query_id", "rank", "vec_id", "score"), "nearest")
    held.unpersist()
    return out


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    most = F.max(F.array_max(F.transform("embedding", lambda v: F.abs(v).cast("double"))))
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(most.alias("most")).orderBy("size").collect()  # a row for each length
    parts = []
    for size, largest in sizes:
        same, power = rows.where(F.size("embedding") == size), math.frexp(largest)[1]
        sample = same.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
        book = fitted(np.ldexp(np.array([r[0] for r in sample], np.float64), -power))
        index = written(indexed(same, book, power), "index")
        asked = index.where(F.col("vec_id") % every == 0).select("vec_id", "embedding").dropDuplicates(["vec_id"])
        blocks = math.ceil(asked.count() / QUERY_BLOCK)
        for b in range(blocks):
            block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()  # QUERY_BLOCK rows or so
            if block:
                ids, queries = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)
                parts.append(_scan(index, book, power, ids, np.ldexp(queries, -power), k, candidates))
        discard(index)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts) if parts else empty


def op9_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
