"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts anywhere else go.

Every window of ``length`` bytes has a key, a hash of its least gram, so equal windows
have equal keys wherever they lie (``suffixes.segments``).  Runs of neighbouring windows
of one key are segments; segments under keys that occur once cannot repeat and are never
sorted.  Different segments of a key meet in one task, with how often each occurs, and
deep-shallow sorting (``suffixes.deep_shallow``) orders the suffixes that begin at their
windows: neighbours in that order that are equal repeat, as does every window of a
segment that occurs more than once.  A key with more than MOST_SEGMENTS different
segments (a passage that very many documents share in different places) is not gathered:
its windows go by 128-bit hashes, counted before they are shuffled.

Texts are shuffled once, by row, into a bucketed table with as many buckets as there are
shuffle partitions; after that only segments, ranges and the first copies of repeated
segments move.  Equality of segments is that of a 64-bit hash within a 64-bit key.

Defined cases: a null text is empty; a text shorter than ``length`` keeps all its bytes;
rows are told apart as rows, so equal rows and equal or null doc_ids are documents of
their own (and repeat each other); touching removed runs are one span; an empty table
gives no rows.  A removed part may begin or end within a character.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release, table
from .suffixes import GRAM, blocks, deep_shallow, segments

LENGTH = 200
#: Different segments of a key that one task sorts at most.
MOST_SEGMENTS = 1024
#: Windows that are sorted at a time, about.
SORTED = 150_000
#: Bytes of texts that a task holds at a time, about, but for one longer text.
HELD = 4 << 20

SEGMENT = "uid long, start long, windows int, key long, segment long, inner boolean"


class Rows:
    """The texts as bytes with a number of their own, in a table bucketed by it; ``drop`` deletes it."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.spark, self.name = docs.sparkSession, f"tessera_texts_{uuid.uuid4().hex[:12]}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
        rows = rows.withColumn("uid", F.monotonically_increasing_id())
        self.path = f"{scratch.root}/texts"
        rows.repartition(n, "uid").write.bucketBy(n, "uid").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """uid and body of rows, about HELD bytes at a time."""
    uids, bodies, size = [], [], 0
    for batch in batches:
        for uid, body in zip(batch.column("uid").to_pylist(), batch.column("body"), strict=True):
            uids.append(uid)
            bodies.append(body.as_py())
            size += len(bodies[-1])
            if size >= HELD:
                yield uids, bodies
                uids, bodies, size = [], [], 0
    if uids:
        yield uids, bodies


def cut(rows: DataFrame, length: int) -> DataFrame:
    """All segments of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, bodies in held(batches):
            number = np.array(uids, np.int64)
            for text, ends, who, offset in blocks(bodies, length):
                start, n, key, inner = segments(text, ends, length)
                if not len(start):
                    continue
                view = memoryview(text)
                named = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)], np.uint64)
                at = np.searchsorted(ends, start, "right")
                local = start - np.r_[0, ends][at] + offset[at]
                columns = [number[who[at]], local, n.astype(np.int32), key.view(np.int64), named.view(np.int64), inner]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "start", "windows", "key", "segment", "inner"])
        release()

    return rows.select("uid", "body").filter(F.length("body") >= length).mapInArrow(run, SEGMENT)


def pieces(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """uid, start, key, copies, piece: the bytes of the wanted segments, cut where their texts lie."""
    per_text = wanted.groupBy("uid").agg(F.collect_list(F.struct("start", "windows", "key", "copies")).alias("cuts"))
    taken = F.transform("cuts", lambda c: F.struct(c["start"].alias("start"), c["key"].alias("key"), c["copies"].alias("copies"), F.substring("body", (c["start"] + 1).cast("int"), c["windows"] + (length - 1)).alias("piece")))
    return rows.join(per_text, "uid").select("uid", F.explode(taken).alias("c")).select("uid", "c.*")


def repeated_by_order(cuts: DataFrame, length: int) -> DataFrame:
    """uid, start, stop: windows of segments that occur once, but equal another window of their key."""

    def ranges(keys: np.ndarray, uids: np.ndarray, starts: np.ndarray, copies: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in texts])
        n = np.array([len(t) - length + 1 for t in texts])
        which = np.repeat(np.arange(len(texts)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.r_[0, ends[:-1]][which] + within
        group = np.cumsum(np.r_[0, keys[1:] != keys[:-1]])[which]
        order, equal = deep_shallow(np.frombuffer(b"".join(texts), np.uint8), at, group, length)
        again = np.zeros(len(order), bool)
        again[order] = equal | np.r_[equal[1:], False]
        again &= copies[which] == 1  # of other segments all windows repeat anyway
        edge = np.r_[True, which[1:] != which[:-1]]
        first = np.flatnonzero(again & (edge | ~np.r_[False, again[:-1]]))
        last = np.flatnonzero(again & (np.r_[edge[1:], True] | ~np.r_[again[1:], False]))
        seg = which[first]
        found = [uids[seg], starts[seg] + within[first], starts[seg] + within[last] + 1]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["uid", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size = 0
        for batch in batches:
            parts += zip(*(batch.column(c).to_pylist() for c in ("key", "uid", "start", "copies", "piece")), strict=True)
            size = sum(len(p[4]) for p in parts)
            if size < SORTED + length * len(parts) or parts[0][0] == parts[-1][0]:
                continue
            # whole keys only: the last may go on
            cut_at, whole = 0, 0
            for i in range(1, len(parts)):
                whole += len(parts[i - 1][4]) - length + 1
                if parts[i][0] != parts[i - 1][0] and (whole >= SORTED or parts[i][0] == parts[-1][0]):
                    yield ranges(*columns(parts[cut_at:i]))
                    cut_at, whole = i, 0
                    if parts[i][0] == parts[-1][0]:
                        break
            parts = parts[cut_at:]
        if parts:
            cut_at, whole = 0, 0
            for i in range(1, len(parts)):
                whole += len(parts[i - 1][4]) - length + 1
                if parts[i][0] != parts[i - 1][0] and whole >= SORTED:
                    yield ranges(*columns(parts[cut_at:i]))
                    cut_at, whole = i, 0
            yield ranges(*columns(parts[cut_at:]))
        release()

    def columns(rows: list[tuple]) -> tuple:
        keys, uids, starts, copies, texts = zip(*rows, strict=True)
        return np.array(keys, np.int64), np.array(uids, np.int64), np.array(starts, np.int64), np.array(copies, np.int64), list(texts)

    together = cuts.select("key", "uid", "start", "copies", "piece").repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(run, "uid long, start long, stop long")


def repeated_by_hash(cuts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """The same for keys with very many segments: each window by a 128-bit hash of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, start, copies, piece in zip(*(batch.column(c).to_pylist() for c in ("uid", "start", "copies", "piece")), strict=True):
                view, n = memoryview(piece), len(piece) - length + 1
                names = [xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n)]
                halves = np.frombuffer(b"".join(names), np.int64).reshape(n, 2)
                columns = [np.full(n, uid), np.arange(start, start + n), np.full(n, copies), halves[:, 0], halves[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "start", "copies", "a", "b"])

    windows = scratch.put(cuts.select("uid", "start", "copies", "piece").mapInArrow(run, "uid long, start long, copies long, a long, b long"))
    again = windows.groupBy("a", "b").agg(F.sum("copies").alias("n")).filter("n > 1").select("a", "b")
    return windows.filter("copies = 1").join(again, ["a", "b"], "left_semi").select("uid", "start", (F.col("start") + 1).alias("stop"))


def removals(rows: DataFrame, scratch: Scratch, length: int, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """uid, start, stop: runs of windows that repeat, of all texts."""
    found = scratch.put(cut(rows, length))
    often = found.groupBy("key").agg(F.sum(F.when(F.col("inner"), 2).otherwise(1)).alias("n")).filter("n > 1").select("key")
    again = scratch.put(found.join(often, "key", "left_semi").select(*found.columns))
    scratch.drop(found)
    # of equal segments one, with how many there are
    one = F.min(F.struct("uid", "start", "windows"))
    distinct = scratch.put(again.groupBy("key", "segment").agg(F.count("*").alias("copies"), one.alias("at"), F.max("inner").alias("inner")).select("key", "segment", "copies", "inner", "at.*"))
    keys = scratch.put(distinct.groupBy("key").agg(F.count("*").alias("n"), F.max("inner").alias("in_itself")).filter("n > 1 or in_itself"))
    wanted = lambda some: distinct.join(keys.filter(some), "key", "left_semi")
    out = [again.join(distinct.filter("copies > 1").select("key", "segment"), ["key", "segment"], "left_semi").select("uid", "start", (F.col("start") + F.col("windows")).alias("stop"))]
    out.append(repeated_by_order(pieces(rows, wanted(F.col("n") <= most_segments), length), length))
    if not keys.filter(F.col("n") > most_segments).isEmpty():
        out.append(repeated_by_hash(pieces(rows, wanted(F.col("n") > most_segments), length), length, scratch))
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return first


def spans(starts: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that windows beginning at [start, stop) cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], stops[order] + length - 1
    reach = np.maximum.accumulate(ends)
    first = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[first], reach[np.r_[first[1:] - 1, len(starts) - 1]]


def deduplicated(docs: DataFrame, length: int = LENGTH, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (array of start, stop), kept (binary): one row per document, written."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = Rows(docs, scratch)
    runs = scratch.put(removals(rows.table, scratch, length, most_segments))
    per_text = runs.groupBy("uid").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, body, starts, stops in zip(*(batch.column(c) for c in ("doc_id", "body", "starts", "stops")), strict=True):
                body = body.as_py()
                a, b = spans(np.array(starts.as_py(), np.int64), np.array(stops.as_py(), np.int64), length)
                kept = b"".join(body[i:j] for i, j in zip(np.r_[0, b].tolist(), np.r_[a, len(body)].tolist(), strict=True))
                out.append((doc_id.as_py(), len(body), len(body) - len(kept), [{"start": i, "stop": j} for i, j in zip(a.tolist(), b.tolist(), strict=True)], kept))
                if len(out) == 256:
                    yield made(out)
                    out = []
            if out:
                yield made(out)
        release()

    def made(out: list[tuple]) -> pa.RecordBatch:
        ids, n, gone, removed, kept = zip(*out, strict=True)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, n, gone, removed, kept), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    joined = rows.table.join(per_text, "uid", "left")
    schema = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,stop:long>>, kept binary"
    changed = joined.filter("starts is not null").select("doc_id", "body", "starts", "stops").mapInArrow(run, schema)
    whole = rows.table.join(per_text, "uid", "left_anti").select("doc_id", F.length("body").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:long,stop:long>>").alias("removed"), F.col("body").alias("kept"))
    out = scratch.put(changed.unionByName(whole))
    rows.drop()
    scratch.keep(out)
    return out


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of every text, grouped by its bytes.
_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, u, octet_length(b)::BIGINT AS n, hex(b) AS x FROM (SELECT doc_id, row_number() OVER () AS u, encode(coalesce(text, '')) AS b FROM documents)),
c AS MATERIALIZED (SELECT u, n, k, substr(x, 2 * k + 1, {2 * (128 + LENGTH)}) AS y FROM d, range(0, greatest(n - {LENGTH - 1}, 0), 128) AS r(k)),
w AS MATERIALIZED (SELECT u, k + j AS p, md5_number(substr(y, 2 * j + 1, {2 * LENGTH})) AS m FROM c, range(0, 128) AS r(j) WHERE k + j <= n - {LENGTH}),
often AS MATERIALIZED (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
again AS (SELECT u, p FROM w WHERE m IN (SELECT m FROM often)),
runs AS MATERIALIZED (SELECT u, min(p) AS a, max(p) + {LENGTH} AS z FROM (SELECT u, p, sum(new) OVER (PARTITION BY u ORDER BY p) AS g FROM
  (SELECT u, p, CASE WHEN p <= lag(p) OVER (PARTITION BY u ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS new FROM again)) GROUP BY u, g),
gaps AS (SELECT u, z AS a, coalesce(lead(a) OVER (PARTITION BY u ORDER BY a, z), 1000000000000) AS z FROM (SELECT u, 0 AS a, 0 AS z FROM d UNION ALL SELECT u, a, z FROM runs)),
kept AS (SELECT g.u, string_agg(substr(x, 2 * g.a + 1, 2 * (least(g.z, n) - g.a)), '' ORDER BY g.a) AS h FROM gaps g JOIN d ON g.u = d.u GROUP BY g.u),
counts AS (SELECT u, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY u)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (u) LEFT JOIN counts USING (u)"""

QUERIES = {"op11_suffix_dedup": op11_suffix_dedup}
SQL = {"op11_suffix_dedup": _SQL}
