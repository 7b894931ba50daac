"""Vector codes: product codebooks of integers, whose nearest entries are found by annular norm pruning.

A codebook's entries are sorted by norm.  By the triangle inequality an entry can be
no nearer to a part than their norms differ, so with a best distance so far only
entries whose norm lies in the annulus of that width round the part's own norm (found
by binary search, both ends included) can be as near; these alone are evaluated,
outwards from the part's norm, and the annulus narrows with every nearer entry met.
All sums and distances are exact integers.

The codebooks (at most ENTRIES entries a part) pass through the driver; vectors and
codes do not.  A round is one narrow pass that sums per task, and one shuffle of those sums.

Defined cases.  Out: vectors that are null or empty, hold a null or non-finite component
or one beyond FARTHEST, or whose length isn't the table's most frequent one (ties: the
smaller).  Zero vectors, null labels, null and repeated vec_ids stay, every row for itself;
first entries go by vec_id (nulls last), then by components.  A length that 4 does not
divide gives the first parts one component more.  An error beyond a long is null, and
so is the sum of its label.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, joinable, spread_join, table

LOG = logging.getLogger(__name__)

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components of a larger magnitude count as non-finite: their floors fit a long.
FARTHEST = 2.0**52
#: Entries met on either side of a part's norm before the annulus is narrowed again.
STEP = 24
#: Parts that are compared at a time.
CHUNK = 1024
LONG = 2**63 - 1


def widths(d: int, parts: int = PARTS) -> list[slice]:
    """The consecutive parts of d components."""
    ends = np.cumsum([0, *(d // parts + (p < d % parts) for p in range(parts))])
    return [slice(int(a), int(b)) for a, b in zip(ends, ends[1:])]


class Annuli:
    """A codebook sorted by norm, and the search in it."""

    def __init__(self, book: np.ndarray):
        square = (book * book).sum(1)
        self.order = np.lexsort((np.arange(len(book)), square))
        self.book, self.norms = book[self.order], np.sqrt(square[self.order].astype(np.float64))
        self.met = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (of the unsorted book; ties: the lower) and squared distance of the entry nearest to each row."""
        found = [self._chunk(x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _chunk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, last = len(x), len(self.norms) - 1
        own = np.sqrt((x * x).sum(1).astype(np.float64))
        right = np.clip(np.searchsorted(self.norms, own), 0, last)
        left = np.maximum(right - 1, 0)
        low = np.where(own - self.norms[left] <= self.norms[right] - own, left, right)
        high = low + 1  # what is met so far: low to high - 1
        at = self.order[low]
        best = self._distances(x, np.arange(n), low)
        active = np.arange(n)
        while len(active):
            # inclusive, with room for the roots' rounding
            reach = np.sqrt(best[active].astype(np.float64))
            reach += 1e-9 * (1 + own[active] + reach)
            start = np.minimum(np.searchsorted(self.norms, own[active] - reach, "left"), low[active])
            end = np.maximum(np.searchsorted(self.norms, own[active] + reach, "right"), high[active])
            open_ = (start < low[active]) | (end > high[active])
            active, start, end = active[open_], start[open_], end[open_]
            if not len(active):
                break
            down, up = np.maximum(start, low[active] - STEP), np.minimum(end, high[active] + STEP)
            span = np.arange(2 * STEP)
            entry = np.where(span < STEP, low[active][:, None] - 1 - span, high[active][:, None] + span - STEP)
            row, column = np.nonzero((entry >= down[:, None]) & (entry < up[:, None]))
            entry = entry[row, column]
            low[active], high[active] = down, up
            d = self._distances(x, active[row], entry)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(d, first)
            index = np.where(d == np.repeat(least, np.diff(np.r_[first, len(row)])), self.order[entry], len(self.norms))
            index = np.minimum.reduceat(index, first)
            who = active[row[first]]
            better = (least < best[who]) | ((least == best[who]) & (index < at[who]))
            best[who[better]], at[who[better]] = least[better], index[better]
        return at, best

    def _distances(self, x: np.ndarray, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        self.met += len(rows)
        gap = x[rows] - self.book[entries]
        return (gap * gap).sum(1)


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, x (array<long>, floors of SCALE times the components) of the vectors that take part, but for their length."""
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < FARTHEST))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    return rows.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Codes and squared distances of each part, and how many entries were evaluated."""
    codes, errors, met = [], [], 0
    for part, book in zip(widths(x.shape[1], len(books)), books, strict=True):
        search = Annuli(book)
        code, error = search.nearest(x[:, part])
        codes.append(code)
        errors.append(error)
        met += search.met
    return codes, errors, met


def totals(rows: DataFrame, books: list[np.ndarray], kind: type) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many parts each entry is nearest to, and their sums: per task first, then over all."""
    shapes = [book.shape for book in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(books), len(books[0])), np.int64)
        sums = [np.zeros(s, kind) for s in shapes]
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen, x = True, matrix(batch.column("x"), kind)
            for p, (part, code) in enumerate(zip(widths(x.shape[1], len(books)), assigned(x, books)[0], strict=True)):
                order = np.argsort(code, kind="stable")
                entries, first = np.unique(code[order], return_index=True)
                counts[p] += np.bincount(code, minlength=len(books[p]))
                if part.stop > part.start:
                    sums[p][entries] += np.add.reduceat(x[order, part], first, axis=0)
        if seen:
            flat = [*counts.ravel().tolist(), *(v for s in sums for v in s.ravel().tolist())]
            some = [(i, str(v)) for i, v in enumerate(flat) if v]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([v for _, v in some], pa.string())], ["slot", "total"])

    parts = rows.select("x").mapInArrow(run, "slot int, total string")
    # one row for each component of the codebooks
    summed = parts.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    n = len(books) * len(books[0])
    flat = np.zeros(n + sum(a * b for a, b in shapes), object)
    for slot, total in summed:
        flat[slot] = int(total)
    out, at = [], n
    for a, b in shapes:
        out.append(flat[at : at + a * b].reshape(a, b))
        at += a * b
    return flat[:n].reshape(len(books), -1), out


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (array<int>), error long of every vector that takes part; and the codebooks."""
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession, "codes")
    rows = scratch.put(integers(embeddings))
    # counts by length: as many rows as there are lengths
    found = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("far")).orderBy(F.desc("n"), "d").first()
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code array<int>, error long"
    if found is None:
        return spark.createDataFrame([], schema), []
    rows = rows.filter(F.size("x") == found["d"])
    kind = np.int64 if 4 * found["far"] ** 2 * found["d"] < 2**62 else object
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    seeds = np.array([r["x"] for r in head], dtype=kind)
    books = [seeds[:, part] for part in widths(found["d"], parts)]
    for n in range(rounds):
        counts, sums = totals(rows, books, kind)
        # // is the floor for negative sums as well
        books = [np.where(c[:, None] > 0, s // np.maximum(c, 1)[:, None], b).astype(kind) for c, s, b in zip(counts, sums, books, strict=True)]
        LOG.info("round %d: %d entries in use", n + 1, int((counts > 0).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors, _ = assigned(matrix(batch.column("x"), kind), books)
            whole = [v if v <= LONG else None for v in np.sum(errors, axis=0).tolist()]
            code = pa.array(np.stack(codes, axis=1).astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array(whole, pa.int64())], ["vec_id", "label", "code", "error"])

    out = scratch.put(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "x").mapInArrow(run, schema))
    scratch.keep(out)
    return out, books


def digest(books: list[np.ndarray]) -> str:
    """Of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` (a written table) with label_error, the sum of the errors of all rows of its label; a label may hold most rows."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long")
    sums = coded.groupBy(key.alias("k")).agg(total.alias("label_error"), F.count("*").alias("n"))
    keyed = coded.withColumn("_key", key)
    if bounded(sums):
        return keyed.join(joinable(sums.drop("n")), F.col("_key") == F.col("k")).drop("_key", "k")
    return spread_join(keyed, sums.select(F.col("k").alias("_of"), "label_error"), ("_key", "_of"), sums.select("k", "n"), ["vec_id"]).drop("_key", "_of")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    code = F.concat(*(F.lpad(F.lower(F.hex(F.element_at("code", p + 1))), 2, "0") for p in range(PARTS)))
    return with_label_error(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds unrolled; every part against every entry, ties to the lower index."""
    cut = "x[p * w + 1 : p * w + w]"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"pieces AS MATERIALIZED (SELECT vec_id, label, p, {cut} AS v FROM (SELECT *, len(x) // 4 AS w FROM kept), range(4) AS r(p))",
        "book0 AS MATERIALIZED (SELECT p, i, v AS e FROM pieces JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM kept ORDER BY vec_id LIMIT 256) USING (vec_id))",
    ]
    for n in range(ROUNDS + 1):
        steps.append(
            f"near{n} AS MATERIALIZED (SELECT vec_id, label, p, v, min(struct_pack(d := d, i := i)) AS best FROM (SELECT vec_id, label, a.p, v, i, "
            f"list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM pieces a JOIN book{n} b ON a.p = b.p) GROUP BY ALL)"
        )
        if n < ROUNDS:
            steps.append(
                f"means{n} AS MATERIALIZED (SELECT p, i, list(m ORDER BY k) AS e FROM (SELECT p, best.i AS i, k, CAST(floor(sum(v[k]) / count(*)::DOUBLE) AS BIGINT) AS m FROM near{n}, range(1, 257) AS r(k) "
                f"WHERE k <= len(v) GROUP BY ALL) GROUP BY ALL)"
            )
            steps.append(f"book{n + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(m.e, b.e) AS e FROM book{n} b LEFT JOIN means{n} m ON b.p = m.p AND b.i = m.i)")
    steps.append(f"coded AS (SELECT vec_id, label, string_agg(lpad(lower(hex(best.i)), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id, label)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"


QUERIES = {"op12_vector_codes": op12_vector_codes}
SQL = {"op12_vector_codes": _sql()}
