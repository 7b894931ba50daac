"""What the two vector operators share: usable vectors, bounded samples, k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part.

    Out: null vec_ids; vectors that are null, empty, zero, or hold a null or
    non-finite component, or whose length is not the most frequent one (ties: the
    smaller).
    """
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", -F.col("d"))).alias("m")).first()["m"]
    if common is None:
        return rows
    return rows.filter(F.size("v") == -common[1])


def sample(rows: DataFrame, most: int, salt: int = 0) -> np.ndarray:
    """At most about ``most`` of the vectors, chosen by hash of vec_id, in order of vec_id."""
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 24)) < int(most / n * (1 << 24)))
    found = rows.select("vec_id", "v").orderBy("vec_id").toPandas()
    return np.array(found["v"].tolist(), dtype=np.float64) if len(found) else np.empty((0, 0))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Lloyd's centres; fewer than k where there are fewer different rows."""
    x = np.unique(x, axis=0)
    draw = np.random.default_rng(seed)
    if len(x) <= k:
        return x
    centres = x[draw.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = np.concatenate([nearest(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[draw.integers(0, len(x), k)])
    return centres
