"""Quality scores (operator 4): random Fourier features, ridge, isotonic calibration.

Statistics of each whole text (lengths, kinds of characters, repetition) are
standardised and mapped to random Fourier features, whose inner products
approximate a Gaussian kernel.  Each partition of the labelled rows adds up its
part of the normal equations per fold; the sums give a ridge fit, and fits that
leave one fold out give the scores on which an isotonic curve is calibrated.

The fit uses at most ``MOST_FIT_ROWS`` labelled rows (beyond that a sample by
hash of doc_id), which bounds the broadcast of labels, the partial sums and the
driver's work; every document is scored, from its whole text.  Only the text is
an input of a score.

Defined cases: a null text is scored as an empty one; a null label is no label;
without labels every score is 0.5, with labels of one kind their mean; a row
without doc_id is scored and not held out; repeated rows are scored each; texts of
any length are read whole; equal statistics give equal scores; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release, table

MOST_FIT_ROWS = 200_000
#: Random features, folds, strength of the ridge (per row), and places of the calibration's grid.
FEATURES, FOLDS, RIDGE, BINS = 320, 4, 1e-4, 2000
#: Of the standardised statistics, beyond which they are cut off; and the kernel's exp(-GAMMA d^2).
REACH, GAMMA = 4.0, 0.02
ACCEPT = 0.7
SEED = 11
PARTS = 8

GLUED = re.compile(r"[,;:!?][^\W\d_]")
STATISTICS = 22


def statistics(text: str) -> list[float]:
    """What a score is made from: STATISTICS numbers about a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    if not data or not (words := text.split()):
        return [0.0] * STATISTICS
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n = len(data), len(words)
    upper, lower, digits = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    stops, bars, bangs = int(count[46] + count[44]), int(count[124]), int(count[33] + count[63])
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    share = count[count > 0] / size
    distinct = len(set(words))
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = text.split("\n")
    again = sum(map(eq, words, words[1:]))
    every_other = sum(map(eq, words, words[2:]))
    most_even = zlib.compress(data, 1)
    return [
        math.log1p(size),
        math.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        math.log1p(float(lengths.max())),
        float((lengths <= 3).mean()),
        float((lengths >= 10).mean()),
        upper / max(1, upper + lower),
        math.sqrt(digits / size),
        math.sqrt(bars / n),
        math.sqrt(bangs / n),
        math.sqrt(max(0, marks - stops - bars - bangs) / n),
        stops / n,
        math.sqrt(len(GLUED.findall(text)) / n),
        math.log1p(len(lines)) - math.log1p(n),
        1 - len(set(lines)) / len(lines),
        math.log1p(distinct) / math.log1p(n),
        math.sqrt(again / n),
        math.sqrt(every_other / n),
        float(-(share * np.log2(share)).sum()),
        len(most_even) / size,
        int(count[128:].sum()) / size,
    ]


def features_of(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) if isinstance(t, str) else [0.0] * STATISTICS for t in texts], dtype=np.float64).reshape(-1, STATISTICS)


@dataclass
class Model:
    """Maps statistics to scores; small, and shipped with the scoring function."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    at: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    to: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return fourier(stats, self.mean, self.scale) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.to[0])
        # rounded, as a matrix product's last bits depend on the rows it is made with
        return np.round(np.clip(np.interp(self.raw(stats), self.at, self.to), 0.0, 1.0), 12)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    draw = np.random.default_rng(SEED)
    w = draw.normal(size=(STATISTICS, FEATURES)) * math.sqrt(2 * GAMMA)
    b = draw.uniform(0, 2 * math.pi, FEATURES)
    z = np.clip((stats - mean) / scale, -REACH, REACH)
    return np.hstack([np.cos(z @ w + b) * math.sqrt(2 / FEATURES), np.ones((len(stats), 1))])


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted places: the middles of the pools and their means."""
    pools: list[list[float]] = []  # sum of y, weight, sum of x
    for xi, ti, wi in zip(x, total, weight, strict=True):
        pools.append([ti, wi, xi * wi])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_FIT_ROWS) -> Model:
    """Learns from the labels (doc_id, quality) of documents (doc_id, text) that are not held out."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    n = known.count()
    if n > most_rows:
        known = known.filter(F.pmod(F.xxhash64("l_id"), F.lit(1 << 20)) < int(most_rows / n * (1 << 20)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_id"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"fold": b["fold"], "y": b["y"], "f": list(features_of(b["text"]))})
        release()

    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(FOLDS)).cast("int").alias("fold")
    train = scratch.put(rows.select(fold, "y", "text").mapInPandas(measure, "fold int, y double, f array<double>"))
    train = train.coalesce(PARTS)
    part = lambda i: F.col("f")[i]
    moments = train.agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.array(*(F.avg(part(i)) for i in range(STATISTICS))).alias("m"), F.array(*(F.stddev_pop(part(i)) for i in range(STATISTICS))).alias("s")).first()
    if not moments["n"]:
        scratch.keep()
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), None)
    base = float(moments["y"])
    mean, scale = np.array(moments["m"]), np.array(moments["s"])
    scale[scale < 1e-9] = 1.0
    if base in (0.0, 1.0):
        scratch.keep()
        return Model(mean, scale, None, to=np.array([base]))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
        for b in batches:
            phi = fourier(np.stack(b["f"].to_numpy()), mean, scale) if len(b) else np.zeros((0, FEATURES + 1))
            y, folds = b["y"].to_numpy(), b["fold"].to_numpy()
            for k in range(FOLDS):
                p = phi[folds == k]
                part[k, :, :-1] += p.T @ p
                part[k, :, -1] += p.T @ y[folds == k]
        for k in range(FOLDS):
            yield pd.DataFrame({"fold": k, "i": range(FEATURES + 1), "v": list(part[k])})

    parts = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
    for r in train.mapInPandas(sums, "fold int, i int, v array<double>").toLocalIterator():
        parts[r["fold"], r["i"]] += np.array(r["v"])
    every = parts.sum(0)

    def solve(total: np.ndarray) -> np.ndarray:
        rows_in = total[-1, -2]  # the constant's square
        penalty = np.eye(FEATURES + 1) * RIDGE * max(rows_in, 1.0)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    model = Model(mean, scale, solve(every))
    without = [solve(every - parts[k]) for k in range(FOLDS)]

    def left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                stats = np.stack(b["f"].to_numpy())
                raw = np.choose(b["fold"].to_numpy(), [model.raw(stats, w) for w in without])
                yield pd.DataFrame({"bin": np.floor(np.clip(raw + 0.5, 0, 2) * (BINS / 2)).astype(int), "y": b["y"]})

    curve = train.mapInPandas(left_out, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    x = (np.array([r["bin"] for r in curve]) + 0.5) / (BINS / 2) - 0.5
    model.at, model.to = isotonic(x, np.array([r["y"] for r in curve]), np.array([float(r["n"]) for r in curve]))
    scratch.keep()
    return model


def scorer(model: Model) -> Callable[[Column], Column]:
    """A column function: text -> score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = pd.Series(model.score(features_of(texts)))
        release()
        return out

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (doc_id, text)."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(model)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
