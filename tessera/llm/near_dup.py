"""MinHash near-dedup with DartMinHash signatures (operator 9).

Documents are weighted sets of five-word shingles: a shingle weighs as often as it
occurs (``weighted=False``: 1).  A signature throws
darts: every element has a hashed Poisson process of darts over its weight and a
rank; darts that fall within the element's weight count, and each coordinate of
the signature keeps the dart of lowest rank that hits it.  Two documents agree in
a coordinate with the probability of their (weighted) Jaccard similarity.  Ranks
are looked at only up to a bound at which the document is sure to fill its
coordinates, so the work is that of reading it plus a constant.

Links are found without listing the pairs of a group:

1. Documents with equal sets fall together first.
2. Signatures are cut into bands; documents that share a band share a bucket.
3. Each bucket has a leader, the member that shares the most buckets with others;
   every member is verified against the leaders of its buckets.
4. Two documents that are alike share a bucket, hence a leader.  So what may have
   been missed are pairs within the group of one leader that lie in different
   components; those groups that hold such pairs are compared exactly, in blocks
   of bounded size, and only edges that join components come out.

Similarities are verified on the whole sets of 64-bit shingle hashes.

Defined cases: documents without words have no shingles and link with nothing;
fewer than five words make one shingle; rows that share a doc_id are one
document; rows without doc_id are classes of their own (class null, kept); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, joinable, release, spread_join, table
from .components import connected

WORDS, SIMILAR = 5, 0.8
#: 0.8^5 = 0.33 per band: two documents at the threshold share none of 25 with probability 0.00005.
BANDS, ROWS = 25, 5
#: Members of a leader's group that a task compares with each other at most; groups too
#: small for SPLITS such blocks a side are cut into smaller ones, of at least these sizes.
BLOCK_LEFT, BLOCK_RIGHT = 1024, 3072
SMALL_LEFT, SMALL_RIGHT, SPLITS = 256, 512, 8
#: Members that a task compares with their leader at most, about.
GROUP_ROWS = 256
#: Shingles looked at together when a block is compared.
COLUMNS = 2048

U = np.uint64
PRIME = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(PRIME), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of PRIME and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[U(1)], np.full(m - 1, PRIME)]), dtype=U)
                self.down = np.cumprod(np.concatenate([[U(1)], np.full(m - 1, INVERSE)]), dtype=U)
        return self.up, self.down


POWERS = Powers()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The 64-bit hashes of a text's runs of so many words, in order, with repeats."""
    data = np.frombuffer(" ".join(text.split()).encode("utf-8", "surrogatepass"), np.uint8) if text else np.empty(0, np.uint8)
    if not len(data):
        return np.empty(0, U)
    up, down = POWERS.to(len(data) + 1)
    before = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U, out=before[1:])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    elif len(starts) <= words:
        starts, ends = starts[:1], ends[-1:]
    return mix((before[ends] - before[starts]) * down[starts] + (ends - starts).astype(U))


def layers(keys: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float, float]]:
    """Elements by layers of their weights, [0, 1), [1, 2), [2, 4), ...: cell keys, weights, where the layer begins, its width."""
    low, width, n = 0.0, 1.0, 0
    while True:
        inside = weights > low
        if not inside.any():
            return
        yield mix(keys[inside] + U(n + 1) * PRIME), weights[inside], low, width
        low, n = low + width, n + 1
        width = low


def arrivals(cells: np.ndarray, rate: float, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The darts of cells with ranks below a bound: their cells' places, ranks, and hashes."""
    step = U(0xD1B54A32D192ED03)
    gap = lambda h: -np.log(((h >> U(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate
    expected = rate * bound
    # as many as nearly all cells need at once, the others go on one by one
    m = int(expected + 4.5 * math.sqrt(expected)) + 1
    h = mix(cells[:, None] + np.arange(1, m + 1, dtype=U)[None, :] * step)
    ranks = np.cumsum(gap(h), axis=1)
    early = ranks < bound
    at = np.nonzero(early)[0]
    if not early[:, -1].any():
        return at, ranks[early], h[early]
    places, found, hashes = [at], [ranks[early]], [h[early]]
    at = np.flatnonzero(early[:, -1])
    rank, i = ranks[at, -1], m + 1
    while len(at):
        h = mix(cells[at] + U(i) * step)
        rank = rank + gap(h)
        on = rank < bound
        at, rank, h = at[on], rank[on], h[on]
        places.append(at)
        found.append(rank)
        hashes.append(h)
        i += 1
    return np.concatenate(places), np.concatenate(found), np.concatenate(hashes)


def signature(keys: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k dart hashes of a non-empty weighted set."""
    bound = k * (math.log(k) + 4) / float(weights.sum())
    while True:
        all_ranks, all_hashes = [], []
        for cells, w, low, width in layers(keys, weights):
            at, ranks, hashes = arrivals(cells, width, bound)
            # a dart counts if it falls within its element's weight
            where = low + (mix(hashes ^ U(0x5851F42D4C957F2D)) >> U(11)).astype(np.float64) * 2.0**-53 * width
            hit = where < w[at]
            all_ranks.append(ranks[hit])
            all_hashes.append(hashes[hit])
        ranks, hashes = np.concatenate(all_ranks), np.concatenate(all_hashes)
        coordinate = (mix(hashes ^ U(0x2545F4914F6CDD1D)) % U(k)).astype(np.int64)
        first = np.full(k, np.inf)
        np.minimum.at(first, coordinate, ranks)
        if np.isfinite(first).all():
            out, wins = np.zeros(k, U), ranks == first[coordinate]
            out[coordinate[wins]] = hashes[wins]
            return out
        bound *= 2


def banded(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band."""
    coefficients = mix(np.arange(1, rows + 1, dtype=U))
    return mix((mix(sig).reshape(bands, rows) * coefficients).sum(axis=1, dtype=U) + np.arange(bands, dtype=U) * PRIME)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def sign(docs: DataFrame, words: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """doc_id, s1 and s2 (hash of the document's set), n (its shingles), bands, of documents with a doc_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for b in batches:
                out = []
                for text in b["text"]:
                    keys, counts = np.unique(shingles(text, words), return_counts=True)
                    if not len(keys):
                        out.append((0, 0, 0, []))
                        continue
                    weights = counts.astype(float) if weighted else np.ones(len(keys))
                    whole = keys.tobytes() + (counts.astype("<i8").tobytes() if weighted else b"")
                    s1, s2 = np.frombuffer(hashlib.blake2b(whole, digest_size=16).digest(), "<i8")
                    out.append((int(s1), int(s2), len(keys), signed(banded(signature(keys, weights, bands * rows), bands, rows))))
                cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
                yield pd.DataFrame({"doc_id": b["doc_id"], "s1": cols[0], "s2": cols[1], "n": cols[2], "bands": cols[3]})
                del b, out, cols
                release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInPandas(run, "doc_id long, s1 long, s2 long, n long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, weighted: bool) -> DataFrame:
    """rep, s (sorted hashes; with counts, repeats are told apart) of the wanted documents (rep)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for b in batches:
                out = []
                for text in b["text"]:
                    h = np.sort(shingles(text, words))
                    if weighted and len(h):  # the i-th repeat of a shingle is an element of its own
                        first = np.concatenate([[True], h[1:] != h[:-1]])
                        place = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
                        h = np.sort(np.where(place > 0, mix(h + place.astype(U) * PRIME), h))
                    out.append(signed(np.unique(h)))
                yield pd.DataFrame({"rep": b["rep"], "s": out})
                del b, out
                release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(joinable(wanted), F.col("doc_id") == F.col("rep")).select("rep", "text")
    return rows.mapInPandas(run, "rep long, s array<long>")


def alike(common, left, right, similar: float):
    """Whether sets of these sizes with so much in common are similar; for columns and arrays."""
    return common >= (left + right) * (similar / (1 + similar)) - 1e-9


def compare_block(left: pd.DataFrame, right: pd.DataFrame, similar: float) -> list[tuple[int, int]]:
    """Edges (u, v) between similar members of different components; for each left member one per component."""
    ls, rs = [np.asarray(s) for s in left["s"]], [np.asarray(s) for s in right["s"]]
    nl, nr = np.array(list(map(len, ls))), np.array(list(map(len, rs)))
    every = np.concatenate(ls + rs)
    owner = np.repeat(np.arange(len(ls) + len(rs)), np.concatenate([nl, nr]))
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    names, column = np.unique(column, return_inverse=True)
    common = np.zeros((len(ls), len(rs)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for first in range(0, len(names), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        c, o = column[a:b] - first, owner[a:b]
        width = min(COLUMNS, len(names) - first)
        m = np.zeros((len(ls) + len(rs), width), np.float32)
        m[o, c] = 1
        common += m[: len(ls)] @ m[len(ls) :].T
    cl, cr = left["component"].to_numpy(), right["component"].to_numpy()
    near = alike(common.astype(np.float64), nl[:, None], nr[None, :], similar) & (cl[:, None] != cr[None, :])
    i, j = np.nonzero(near)
    seen, out = set(), []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if (a, cr[b]) not in seen:
            seen.add((a, cr[b]))
            out.append((int(left["rep"].iloc[a]), int(right["rep"].iloc[b])))
    return out


def compare_groups(members: DataFrame, similar: float) -> DataFrame:
    """Edges within the groups of members (leader, i, j, side, rep, component, s): left against right of each (leader, i, j)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        edges: list[tuple[int, int]] = []

        def done() -> None:
            if held:
                block = pd.concat(held)
                left, right = block[block["side"] == 0], block[block["side"] == 1]
                if len(left) and len(right):
                    edges.extend(compare_block(left, right, similar))
                held.clear()

        for b in batches:
            for k, part in b.groupby(["leader", "i", "j"], sort=False):
                if k != key:
                    done()
                    key = k
                held.append(part)
            if edges:
                yield pd.DataFrame(edges, columns=["u", "v"])
                edges = []
        done()
        if edges:
            yield pd.DataFrame(edges, columns=["u", "v"])
        release()

    return members.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), kept (it is that one), one row per row of documents (doc_id, text).

    Similarity is sum of least weights by sum of greatest; ``weighted=False``: of the sets.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    signs = scratch.put(sign(docs, words, bands, rows, weighted))
    reps = scratch.put(signs.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")))
    # buckets with several documents
    banded_rows = reps.select("rep", F.explode("bands").alias("band"))
    sizes = scratch.put(banded_rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select(F.col("band").alias("k"), F.col("size").alias("n")))
    by_size = sizes.select(F.col("k").alias("b"), F.col("n").alias("size"))
    shared = scratch.put(spread_join(banded_rows, by_size, ("band", "b"), sizes, ["rep"]).select("rep", "band", "size"))
    known = scratch.put(shared.groupBy("rep").agg(F.sum("size").alias("renown")))
    ranked = shared.join(known.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).select("rep", "band", F.struct(F.col("renown"), (-F.col("rep")).alias("r")).alias("rank"))
    leaders = ranked.groupBy("band").agg((-F.max("rank")["r"]).alias("leader")).withColumnRenamed("band", "b")
    pairs = scratch.put(spread_join(shared, leaders, ("band", "b"), sizes, ["rep"]).filter("rep != leader").select("rep", "leader").distinct())
    followers = scratch.put(pairs.groupBy(F.col("leader").alias("k")).agg(F.count("*").alias("n")))
    sets = scratch.put(sets_of(docs, known.select("rep"), words, weighted).dropDuplicates(["rep", "s"]))
    mine, theirs = sets.select(F.col("rep").alias("m"), F.col("s").alias("s")), sets.select(F.col("rep").alias("t"), F.col("s").alias("ls"))
    # a leader's set meets its members' in as many tasks as they need
    compared = spread_join(pairs.join(mine, F.col("rep") == F.col("m")), theirs, ("leader", "t"), followers, ["rep"], GROUP_ROWS)
    common = F.size(F.array_intersect("s", "ls"))
    compared = scratch.put(compared.select("rep", "leader", alike(common, F.size("s"), F.size("ls"), similar).alias("linked")))
    star = compared.filter("linked").select(F.col("rep").alias("u"), F.col("leader").alias("v"))
    first = scratch.put(connected(star, scratch))
    # groups of a leader in which a member lies outside its component
    at = first.select(F.col("node").alias("n_node"), F.col("component").alias("n_component"))
    group = compared.select("rep", "leader").distinct().join(at, F.col("rep") == F.col("n_node"), "left").select("rep", "leader", F.coalesce("n_component", "rep").alias("component"))
    group = scratch.put(group.join(at, F.col("leader") == F.col("n_node"), "left").select("rep", "leader", "component", (F.col("component") != F.coalesce("n_component", "leader")).alias("apart")))
    counts = group.groupBy("leader").agg(F.count("*").alias("members"), F.count_if("apart").alias("apart_n")).filter("apart_n > 0 and members > 1")
    blocks = lambda n, small, most: F.least(F.ceil(F.col(n) / small), F.greatest(F.lit(SPLITS), F.ceil(F.col(n) / most))).cast("int")
    counts = counts.select(F.col("leader").alias("g"), blocks("apart_n", SMALL_LEFT, BLOCK_LEFT).alias("n_left"), blocks("members", SMALL_RIGHT, BLOCK_RIGHT).alias("n_right"))
    open_groups = group.join(counts, F.col("leader") == F.col("g"))
    place = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    row = lambda side: ("leader", "i", "j", F.lit(side).alias("side"), "rep", "component")
    left = open_groups.filter("apart").withColumn("i", place("n_left", 1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_right") - 1))).select(*row(0))
    right = open_groups.withColumn("j", place("n_right", 2)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1))).select(*row(1))
    members = left.unionByName(right).join(mine, F.col("rep") == F.col("m")).select("leader", "i", "j", "side", "rep", "component", "s")
    rest = scratch.put(compare_groups(members, similar))
    classes = scratch.put(connected(star.unionByName(rest), scratch)) if not rest.isEmpty() else first
    scratch.keep(signs, reps, classes)
    copies = scratch.put(signs.filter("n > 0").groupBy(F.col("s1").alias("k")).agg(F.count("*").alias("n")))
    of_rep = reps.select(F.col("s1").alias("r1"), F.col("s2").alias("r2"), "rep").join(classes.select("node", "component"), F.col("rep") == F.col("node"), "left")
    of_rep = of_rep.select("r1", "r2", F.coalesce("component", "rep").alias("class_id"))
    said = spread_join(signs.filter("n > 0").select("doc_id", "s1", "s2"), of_rep, ("s1", "r1"), copies, ["doc_id"]).filter(F.col("s2") == F.col("r2")).select("doc_id", "class_id")
    out = said.unionByName(signs.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id")))
    missing = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(missing).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_dedup": op9_near_dedup}
SQL = {
    "op9_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
o AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
g AS (SELECT doc_id, g, count(*) AS w FROM o GROUP BY 1, 2),
n AS (SELECT doc_id, sum(w) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.w, b.w)) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.doc_id),
c AS (SELECT doc_id, min(m) AS m FROM r GROUP BY 1)
SELECT e.doc_id, c.m AS class_id, e.doc_id IS NOT DISTINCT FROM c.m AS kept FROM documents e LEFT JOIN c ON c.doc_id = e.doc_id
"""
}
