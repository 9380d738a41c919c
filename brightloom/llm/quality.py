"""Operator 8: a quality score from random Fourier features, ridge regression and isotonic calibration.

Statistics of a text are standardised, mapped to cosines of random projections (an approximation of a Gaussian
kernel), and joined by the statistics themselves and a constant. Each partition of the labelled rows sums its part of
the normal equations; the sums, of a size that depends on the number of features alone, are added up by row of the
matrix and solved. A share of the labelled rows is left out of that fit and calibrates it: counts and label sums by
fine score bins, made monotone by pooling adjacent violators.

Defined cases: a null text counts as empty, and empty texts are scored like any other; labels that are null or have no
document are ignored, several labels of one document count as their mean; a null doc_id has no label and is not held
out; repeated rows are each scored; with no usable label, or only one kind, every score is the mean label (0.5 without
any); an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, read, written

COSINES = 192
WIDTH = 4.0
RIDGE = 1.0
SEED = 8
#: Standardised statistics are cut at so many deviations.
REACH = 4.0
CALIBRATION_PART = 4
BINS = 1024
LOW, HIGH = -0.5, 1.5

_BYTES = np.arange(256)
_CLASSES = np.stack(
    [
        np.isin(_BYTES, np.frombuffer(chars, np.uint8))
        for chars in (
            bytes(range(65, 91)),
            bytes(range(97, 123)),
            b"0123456789",
            b".,;:?'\"-()",
            b"!",
            b"|",
            b"#$%&*@^~_=+<>/\\{}[]`",
            b"\n",
            b" ",
            bytes(range(128, 256)),
        )
    ]
).astype(np.float64)
STATISTICS = 8 + len(_CLASSES)


def text_statistics(texts: list[str | None]) -> np.ndarray:
    """A row for each text. Label, language, source and id have no part in it."""
    pack, out = zstandard.ZstdCompressor(level=1), np.zeros((len(texts), STATISTICS))
    for row, text in zip(out, texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = text.split()
        n = max(1, len(words))
        lines = text.split("\n")
        row[: len(_CLASSES)] = _CLASSES @ counts / len(raw)
        row[len(_CLASSES) :] = (
            np.log1p(len(raw)),
            np.log1p(len(words)),
            min(len(text) / n, 40.0),
            len(set(words)) / n**0.85,
            sum(map(str.__eq__, words, words[1:])) / n,
            len(pack.compress(raw)) / (len(raw) + 40),
            np.log1p(len(words) / len(lines)),
            len(set(lines)) / len(lines),
        )
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -REACH, REACH)
        draw = np.random.default_rng(SEED)
        spread = draw.normal(size=(STATISTICS, COSINES)) / WIDTH
        waves = np.cos(x @ spread + draw.uniform(0, 2 * np.pi, COSINES)) * np.sqrt(2 / COSINES)
        return np.hstack([waves, x / REACH, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.steps[1][0])
        return np.interp(self.raw(stats), *self.steps)


def pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: means of x and y in each pool, x ascending."""
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _matrix(col: pd.Series) -> np.ndarray:
    return np.vstack(col.to_numpy()) if len(col) else np.zeros((0, STATISTICS))


def statistics_of(docs: DataFrame) -> DataFrame:
    """doc_id and stats for each document."""

    @F.pandas_udf("array<double>")
    def stats(text: pd.Series) -> pd.Series:
        return pd.Series(list(text_statistics(text.tolist())))

    return docs.select("doc_id", stats("text").alias("stats"))


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Learns labels.quality from rows of stats (a written table) that are not held out."""
    spark = stats.sparkSession
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    rows = stats.join(known, "doc_id").where(crc_fold(F.col("doc_id"), 3) != 1)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_PART)) == 0
    rows = written(rows.select("stats", "label", part.alias("calibrates")), "labelled")
    each = [F.struct(F.avg(s).alias("m"), F.stddev_pop(s).alias("s")) for s in (F.col("stats")[i] for i in range(STATISTICS))]
    seen = rows.agg(F.array(*each).alias("each"), F.avg("label").alias("label"), F.min("label").alias("least"), F.max("label").alias("most")).first()
    if seen.label is None or seen.least == seen.most:
        level = 0.5 if seen.label is None else float(seen.label)
        return QualityModel(np.zeros(STATISTICS), np.ones(STATISTICS), None, (np.zeros(1), np.array([level])))
    mean = np.array([e.m for e in seen.each])
    scale = np.array([e.s for e in seen.each])
    scale[scale < 1e-9] = 1.0
    start = QualityModel(mean, scale, None, (np.zeros(1), np.zeros(1)))
    width = COSINES + STATISTICS + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + 1))
        for b in batches:
            z = start.features(_matrix(b["stats"]))
            total += z.T @ np.hstack([z, b["label"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    def added(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.vstack(group["row"].to_numpy()), axis=0)]})

    fitted = rows.where(~F.col("calibrates")).mapInPandas(sums, "i int, row array<double>")
    found = fitted.groupBy("i").applyInPandas(added, "i int, row array<double>").collect()
    normal = np.zeros((width, width + 1))
    for r in found:
        normal[r.i] = r.row
    weights = np.linalg.solve(normal[:, :width] + RIDGE * np.eye(width), normal[:, width])
    model = QualityModel(mean, scale, weights, (np.zeros(1), np.zeros(1)))

    @F.pandas_udf("double")
    def raw(s: pd.Series) -> pd.Series:
        return pd.Series(model.raw(_matrix(s)))

    scored = rows.where("calibrates").select(raw("stats").alias("raw"), "label")
    place = F.floor((F.least(F.greatest("raw", F.lit(LOW)), F.lit(HIGH)) - LOW) / (HIGH - LOW) * BINS).cast("int")
    bins = scored.groupBy(place.alias("bin")).agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count("*").alias("w"))
    curve = sorted((r.x, r.y, r.w) for r in bins.collect())  # BINS + 1 rows at most
    steps = pooled(*map(np.array, zip(*curve))) if curve else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return QualityModel(mean, scale, weights, steps)


def score_column(model: QualityModel, stats: str) -> Column:
    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(s)))

    return score(stats)


def text_score_column(model: QualityModel, text: str) -> Column:
    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(text_statistics(t.tolist())))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    stats = written(statistics_of(docs), "statistics")
    model = fit(stats, labels)
    scored = stats.select(
        "doc_id",
        F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        score_column(model, "stats").alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    model = fit(written(statistics_of(docs), "statistics"), labels)
    return docs.where(text_score_column(model, "text") >= 0.5)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
