"""Approximate nearest neighbours (operator 5): inverted file, product-quantised residuals, exact reranking.

Coarse centroids and residual codebooks are fitted on a bounded sample; every row
is assigned to its nearest centroid's list and its residual is coded.  A query
probes the lists nearest to it; within a list an asymmetric distance table (query
residual against codebooks) ranks the codes, and the best are reranked by exact
distance on the original vectors; then so is every row that its code's own error
does not rule out, so nothing among the best of a probed list is lost.  (For that a
list's task holds its vectors beside the codes: where codes rule little out, as of
vectors that lie evenly, naming the survivors and fetching them would cost more.)
How many lists are probed is found from an audit: the true neighbours of a bounded
sample of queries, by brute force.  The same queries' results audit the whole search
afterwards, from codes to ranks, those of crowded lists (hot) apart from the others;
where either falls short, more lists are probed.

Long lists are cut into blocks, many queries into chunks, and each (list, block,
chunk) is searched on its own; what leaves it is the ten best per query, so a list
that holds a third of all rows spreads over many tasks.

Defined cases: vectors that don't take part (see vectors.usable) are neither
queries nor candidates; equal vectors keep their rows, ties go to the smaller
vec_id; a vec_id with several vectors asks with the smallest; with fewer candidates
than asked for, all that were found are returned; an empty table gives an empty
result.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .vectors import k_means, nearest, sample, usable

LOG = logging.getLogger(__name__)

#: Bounds: rows in the fitting sample (so many for each list, if that is more), lists, audited queries.
MOST_SAMPLE, SAMPLE_A_LIST, MOST_LISTS, MOST_AUDIT = 20_000, 20, 4096, 64
SUBSPACES, CODES = 16, 256
BLOCK_ROWS, CHUNK_QUERIES = 4096, 1024
#: Codes per list that are reranked at first; share of audited neighbours whose lists are probed.
RERANK, RECALL = 48, 0.985
#: Least recall, of hot queries and of others, that is accepted; a list of so many times the mean rows is crowded.
ACCEPTED, CROWDED = 0.9, 3


@dataclass
class Quantiser:
    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, n_lists: int) -> Quantiser:
        centres = k_means(x, n_lists)
        residual = x - centres[nearest(x, centres).argmin(1)]
        d = x.shape[1]
        cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int).tolist()
        books = [k_means(residual[:, a:b], CODES, rounds=6) for a, b in zip(cuts, cuts[1:], strict=False)]
        return cls(centres, books, cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each row, and the codes of its residual."""
        lists = nearest(x, self.centres).argmin(1)
        residual = x - self.centres[lists]
        codes = [nearest(residual[:, a:b], book).argmin(1) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]
        return lists, np.stack(codes, 1).astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What codes of residuals stand for."""
        return self.centres[lists] + np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], 1)

    def tables(self, q: np.ndarray, which: int) -> np.ndarray:
        """Asymmetric distances of one query's residual in a list: subspace x code."""
        r = q - self.centres[which]
        out = np.full((len(self.books), CODES), np.inf)
        for s, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
            out[s, : len(book)] = ((book - r[a:b]) ** 2).sum(1)
        return out


def lists_for(n_rows: int) -> int:
    """Half the square root: a list then holds some times as many rows as are reranked at first."""
    return int(min(MOST_LISTS, max(1, math.sqrt(n_rows) / 2)))


def equal_rows(x: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal rows."""
    _, at, same = np.unique(hashes, return_index=True, return_inverse=True)
    if (x == x[at[same]]).all():
        return same
    return np.unique(x, axis=0, return_inverse=True)[1].reshape(-1)  # different rows share a hash


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """Exact: the k nearest rows of each query but itself; nearest first, ties to smaller ids."""
    for query, v in zip(query_ids.tolist(), q, strict=True):
        d = np.sqrt(((x - v) ** 2).sum(1))
        if len(d) > 4 * k:
            near = np.flatnonzero(d <= np.partition(d, k)[k])
        else:
            near = np.arange(len(d))
        near = near[ids[near] != query]
        for i in near[np.lexsort((ids[near], d[near]))][:k].tolist():
            yield query, int(ids[i]), float(d[i])


def build_index(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """vec_id, v, h (hash of v), list, codes of every row (vec_id, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                lists, codes = quantiser.encode(matrix(b["v"]))
                yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "h": b["h"], "list": lists, "codes": [c.tobytes() for c in codes]})

    return rows.select("vec_id", "v", F.xxhash64("v").alias("h")).mapInPandas(run, "vec_id long, v array<double>, h long, list int, codes binary")


def exact_neighbours(rows: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """Brute force for a bounded set of queries (vec_id, v): query_id, vec_id, score, list of the rows (with list)."""
    ids, q = queries["vec_id"].to_numpy(), matrix(queries["v"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at = dict(zip(b["vec_id"], b["list"], strict=True))
                found = list(best(ids, q, b["vec_id"].to_numpy(), matrix(b["v"]), k))
                yield pd.DataFrame([(*f, at[f[1]]) for f in found], columns=["query_id", "vec_id", "score", "list"])

    return first(rows.select("vec_id", "v", "list").mapInPandas(run, "query_id long, vec_id long, score double, list int"), k)


def first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_index(index: DataFrame, queries: DataFrame, quantiser: Quantiser, probes: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: queries (vec_id, v) against an index."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = np.argsort(nearest(matrix(b["v"]), quantiser.centres), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": b["vec_id"], "v": b["v"], "lists": list(near.astype(np.int32))})

    asked = queries.mapInPandas(probe, "query_id long, v array<double>, lists array<int>").select("query_id", "v", F.explode("lists").alias("list"))
    # both are counts per list, of which there are at most MOST_LISTS
    size = index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    load = asked.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("chunks"))
    plan = F.broadcast(size.join(load, "list"))
    place = lambda column, n, salt: F.pmod(F.xxhash64(column, F.lit(salt)), F.col(n)).cast("int")
    data = index.join(plan, "list").withColumn("block", place("vec_id", "blocks", 1)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asks = asked.join(plan, "list").withColumn("chunk", place("query_id", "chunks", 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def run(key: tuple, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(rows) or not len(wanted):
            return pd.DataFrame(columns=columns)
        rows = rows.sort_values("vec_id", kind="stable")
        ids, x = rows["vec_id"].to_numpy(), matrix(rows["v"])
        # equal vectors stand for one another: of each, the first k + 1 rows can be among the k best
        same = equal_rows(x, rows["h"].to_numpy())
        order = np.argsort(same, kind="stable")
        ahead = np.empty(len(x), int)
        ahead[order] = np.arange(len(x)) - np.searchsorted(same[order], same[order])
        firsts = np.flatnonzero(ahead == 0)
        members = np.flatnonzero(ahead <= k)
        codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)[firsts]
        which, subspaces = int(key[0]), np.arange(codes.shape[1])
        # a row is this far from what its code stands for, so its distance is within that of its code's
        error = np.sqrt(((x[firsts] - quantiser.decode(np.full(len(firsts), which), codes)) ** 2).sum(1)) + 1e-9
        out: list[tuple[int, int, float]] = []
        for query, v in zip(wanted["query_id"].to_numpy(), matrix(wanted["v"]), strict=True):
            rough = quantiser.tables(v, which)[subspaces, codes].sum(1)
            n = min(RERANK, len(rough))
            ranked = np.argpartition(rough, n - 1)[:n]
            exact = np.sqrt(((x[firsts[ranked]] - v) ** 2).sum(1))
            # of different vectors k + 1, as one may be the query itself; with fewer, none is ruled out
            most = np.partition(exact, k)[k] + 1e-9 if n > k else np.inf
            chosen = firsts[np.sqrt(rough) - error <= most]
            chosen = members[np.isin(same[members], same[chosen])]
            out.extend(best(np.array([query]), v[None, :], ids[chosen], x[chosen], k))
        return pd.DataFrame(out, columns=columns)

    keys = ["list", "block", "chunk"]
    found = data.select(*keys, "vec_id", "v", "h", "codes").groupBy(*keys).cogroup(asks.select(*keys, "query_id", "v").groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    return first(found, k).select("query_id", "rank", "vec_id", "score")


def recall(found: pd.DataFrame, truth: pd.DataFrame, hot: dict[int, bool]) -> dict[bool, float]:
    """Of hot queries and of others (where there are any): the share of true neighbours (query_id, score) that are found, or as near ones."""
    got = {q: np.sort(g.to_numpy()) for q, g in found.groupby("query_id")["score"]}
    shares: dict[bool, list[float]] = {}
    for q, g in truth.groupby("query_id")["score"]:
        n = int((got.get(q, np.empty(0)) <= g.max() + 1e-9).sum())
        shares.setdefault(hot[q], []).append(min(n, len(g)) / len(g))
    return {kind: float(np.mean(s)) for kind, s in shares.items()}


def search(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for vectors whose vec_id is divisible by ``every``, the k nearest found of all others."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "ann")
    rows = usable(embeddings)
    n_lists = lists_for(rows.count())
    fitted = sample(rows, max(MOST_SAMPLE, SAMPLE_A_LIST * n_lists))
    if not len(fitted):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantiser = Quantiser.fit(fitted, n_lists)
    index = scratch.put(build_index(rows, quantiser))
    chosen = index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "list")).alias("q")).select("vec_id", "q.v", "q.list")
    queries = chosen.select("vec_id", "v")
    # rows per list, of which there are at most MOST_LISTS
    sizes = index.groupBy("list").count().toPandas()
    crowded = sizes["list"][sizes["count"] > CROWDED * sizes["count"].mean()].tolist()
    asked = chosen.select("vec_id", "v", F.col("list").isin(crowded).alias("hot"))
    drawn = [asked.filter(F.col("hot") == hot).orderBy(F.xxhash64("vec_id"), "vec_id").limit(MOST_AUDIT).toPandas() for hot in (False, True)]
    audited = pd.concat([d for d in drawn if len(d)] or drawn[:1], ignore_index=True)
    if not len(audited):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    truth = exact_neighbours(index, audited, k).select("query_id", "list", "score").toPandas()
    order = np.argsort(np.argsort(nearest(matrix(audited["v"]), quantiser.centres), axis=1, kind="stable"), axis=1)
    row = {q: i for i, q in enumerate(audited["vec_id"])}
    hot = dict(zip(audited["vec_id"], audited["hot"], strict=True))
    probes = 1
    for kind in set(hot.values()):
        needed = np.sort([order[row[q], at] + 1 for q, at in zip(truth["query_id"], truth["list"], strict=True) if hot[q] == kind])
        if len(needed):
            probes = max(probes, int(needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)))]))
    names = spark.createDataFrame(audited[["vec_id"]]).select(F.col("vec_id").alias("query_id"))
    while True:
        found = scratch.put(search_index(index, queries, quantiser, probes, k))
        measured = recall(found.join(F.broadcast(names), "query_id").select("query_id", "score").toPandas(), truth, hot)
        for kind, share in sorted(measured.items()):
            LOG.info("recall of %s queries, %d lists probed: %.4f", "hot" if kind else "other", probes, share)
        if probes >= len(quantiser.centres) or all(share >= ACCEPTED for share in measured.values()):
            scratch.keep(found)
            return found
        scratch.drop(found)
        probes *= 2


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_nearest_neighbours": op5_nearest_neighbours}
SQL: dict[str, str] = {}
