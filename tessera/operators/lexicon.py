"""A persisted inverted index for lexical search: Porter stems, BM25, snippets.

An index is four tables in a folder that all executors share: postings (term, id, tf,
dl), what each term weighs at most in a block of ids, what it weighs at most anywhere
and in how many rows it is, all three in folders by hash of the term and sorted by it;
and one row of totals.  A search reads the folders of its terms only, and in them the
row groups that hold the terms; texts are read for snippets alone.  Indexes are kept by what they were made from
(files, their sizes and times), so a changed table gets a new one.
"""

from __future__ import annotations

import hashlib
import logging
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stem
from ..sources.store import cleaned, file_system, shared_folder

LOG = logging.getLogger(__name__)
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Folders of an index; postings that a file of one folder has at most, about.
BUCKETS, FILE_ROWS = 64, 4_000_000
#: Ids that share an upper bound of what a term weighs in them.
BLOCK = 128
#: Terms that are named to the reader of a table; of more, the folders alone are.
MOST_NAMED = 2000
#: Words in a snippet.
SNIPPET = 32
#: Columns of the tables in folders, and the mark of this layout.
TABLES = {"postings": "term string, id long, tf int, dl int", "blocks": "term string, block long, most double", "terms": "term string, df long, most double"}
LAYOUT = 2


def weight(tf: Column, dl: Column, avg_dl: Column) -> Column:
    """What a term that is in a row so often adds to its score, but for the term's rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def rarity(n: Column, df: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, LEAST_IDF).otherwise(idf)


def bucket(term: Column) -> Column:
    return (F.crc32(F.encode(term, "UTF-8")) % BUCKETS).cast("int")


def words(columns: Sequence[str]) -> Column:
    """The words of several columns: runs of letters and digits in lower case, without marks."""
    return F.concat(*(F.coalesce(F.filter(F.split(stem.folded(F.col(c)), r"[^\p{L}\p{N}\p{Co}]+"), lambda w: F.length(w) > 0), F.array().cast("array<string>")) for c in columns))


def postings(rows: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """term, id, tf, dl: one row for each stem of each row."""
    read = rows.select(F.col(key).cast("long").alias("id"), words(columns).alias("words"))
    counted = read.select("id", F.size("words").alias("dl"), F.explode(stem.counted(F.col("words"))).alias("t"))
    return counted.select("t.term", "id", "t.tf", "dl")


def query_terms(query: Sequence[str]) -> list[str]:
    """Distinct stems of the words of a query."""
    said = "".join(c for c in unicodedata.normalize("NFD", " ".join(query).lower()) if not unicodedata.combining(c))
    return list(dict.fromkeys(stem.stem(w) for w in re.findall(r"[^\W_]+", said)))


@dataclass(frozen=True)
class Index:
    """An index that was written to ``path``."""

    spark: SparkSession
    path: str

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """The postings of stems: only their folders are read."""
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        return self.table("postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms))).drop("bucket")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[name]}, bucket int").parquet(f"{self.path}/{name}")

    def of(self, name: str, asked: DataFrame) -> DataFrame:
        """The rows of a table for the terms of a (written) table ``asked``: only their folders are read, and few terms are named to the reader."""
        buckets = [r[0] for r in asked.select(bucket(F.col("term"))).distinct().collect()]  # at most BUCKETS
        terms = asked.select("term").distinct()
        named = [r[0] for r in terms.limit(MOST_NAMED + 1).collect()]
        found = self.table(name).filter(F.col("bucket").isin(buckets)).drop("bucket")
        return found.filter(F.col("term").isin(named)) if len(named) <= MOST_NAMED else found.join(terms, "term", "left_semi")

    def totals(self) -> DataFrame:
        """One row: n (rows indexed), avg_dl."""
        return self.spark.read.schema("n long, avg_dl double").parquet(f"{self.path}/totals")

    def scores(self, query: Sequence[str]) -> DataFrame:
        """id, bm25 of the rows that hold any of the query's words."""
        terms = query_terms(query)
        if not terms:
            return self.spark.createDataFrame([], "id long, bm25 double")
        hits = self.postings(terms)
        df = hits.groupBy(F.col("term").alias("d_term")).agg(F.count("*").alias("df"))  # one row for each of the query's terms
        rated = hits.join(F.broadcast(df), F.col("term") == F.col("d_term")).join(F.broadcast(self.totals()))
        part = rarity(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
        # rounded, as a sum's last bits depend on its order, and equal rows are to be equal
        return rated.select("id", part.alias("part")).groupBy("id").agg(F.round(F.sum("part"), 10).alias("bm25"))


def build(rows: DataFrame, columns: Sequence[str], path: str, key: str = "id") -> Index:
    """Writes the index of ``rows``; the totals last, as they mark it whole."""
    spark = rows.sparkSession
    size = rows.select(*(F.coalesce(F.length(c), F.lit(0)).alias(f"c{i}") for i, c in enumerate(columns))).agg(F.count("*"), *(F.sum(f"c{i}") for i in range(len(columns)))).first()
    # a bucket whose terms have many postings is dealt over files by id; a word has about six characters
    spread = max(1, -(-sum(filter(None, size[1:])) // (6 * BUCKETS * FILE_ROWS)))
    laid = postings(rows, columns, key).withColumn("bucket", bucket(F.col("term")))
    laid = laid.repartition("bucket", F.pmod("id", F.lit(spread))).sortWithinPartitions("bucket", "term", "id")
    with cleaned(spark):
        laid.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    tokens = spark.read.schema("tf int").parquet(f"{path}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    index, avg_dl = Index(spark, path), tokens / max(1, size[0])
    most = F.max(weight(F.col("tf"), F.col("dl"), F.lit(avg_dl))).alias("most")
    by = {"blocks": F.floor(F.col("id") / BLOCK).alias("block")}
    for name, counts in (("blocks", ()), ("terms", (F.count("*").alias("df"),))):
        rolled = index.table("postings").groupBy("bucket", "term", *([by[name]] if name in by else ())).agg(most, *counts)
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        with cleaned(spark):
            rolled.select(*columns, "bucket").repartition("bucket").sortWithinPartitions("bucket", *columns).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{name}")
    spark.createDataFrame([(size[0], avg_dl)], "n long, avg_dl double").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    return index


# --- Where indexes are kept ----------------------------------------------------


def stamp(spark: SparkSession, paths: Sequence[str]) -> str:
    """What tells the present state of files and folders apart from others: names, sizes, times."""
    said = []
    for path in paths:
        fs, where = file_system(spark, path)
        status = fs.getFileStatus(where)
        listed = fs.listStatus(where) if status.isDirectory() else [status]
        said += sorted(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}" for s in listed)
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:24]


def kept(spark: SparkSession, name: str, sources: Sequence[str], rows: Callable[[], DataFrame], columns: Sequence[str], key: str = "id") -> Index:
    """The index of ``rows`` (made from the files ``sources``): an earlier one if nothing changed, else a new one."""
    path = f"{shared_folder(spark)}/lexicon/{name}-{stamp(spark, [*sources])}-{BUCKETS}-{LAYOUT}"
    fs, done = file_system(spark, f"{path}/totals/_SUCCESS")
    if not fs.exists(done):
        LOG.info("indexing %s into %s", name, path)
        build(rows(), columns, path, key)
    return Index(spark, path)


# --- Results -------------------------------------------------------------------


def search(index: Index, rows: DataFrame, query: Sequence[str], limit: int = 50, key: str = "id") -> DataFrame:
    """key, bm25 of the best of ``rows`` (those of a status, a session, a kind): statistics are those of all rows indexed."""
    own = rows.select(F.col(key).alias("_row"))
    hits = index.scores(query).join(own, F.col("id") == F.col("_row"))
    return hits.select(F.col("id").alias(key), "bm25").orderBy(F.desc("bm25"), key).limit(limit)


def best_window(size: int, hits: list[tuple[int, int]], sentences: list[int], most: int) -> int:
    """Where the ``most`` words that a snippet shows begin, of ``size`` words; hits: place and term of the words that match.

    Each hit opens a window, and so does the sentence it lies in.  In a window the first
    hit of a term counts 1000, each other one 1; a sentence counts 100 more, the first
    of the text 120.  The first of the best windows wins; one that a hit opens is moved
    so that its hits lie in the middle.
    """
    places = [p for p, _ in hits]

    def worth(start: int) -> tuple[int, int]:
        inside = hits[bisect_left(places, start) : bisect_left(places, start + most)]
        if not inside:
            return 0, start
        terms = len({t for _, t in inside})
        middle = inside[0][0] - (most - (inside[-1][0] + 1 - inside[0][0])) // 2
        return 1000 * terms + len(inside) - terms, max(0, min(middle, size - most))

    best, begin = 0, 0
    for place, _ in hits:
        score, middle = worth(place)
        if score > best:
            best, begin = score, middle
        if size > most and (at := bisect_right(sentences, place) - 1) >= 0 and sentences[at] < place:
            score = worth(sentences[at])[0] + (100 if sentences[at] else 120)
            if score > best:
                best, begin = score, sentences[at]
    return begin


def snippet(content: Column, query: Sequence[str], most: int = SNIPPET) -> Column:
    """Up to ``most`` words of the best window (best_window), matches in <mark>, cuts shown as three dots.

    A sentence begins with the text, and after a full stop or colon and white space.
    Meant for the texts of the best hits, not of all rows.
    """
    terms = {t: i for i, t in enumerate(query_terms(query))}

    @F.pandas_udf("string")
    def cut(texts):
        known: dict[str, int | None] = {}

        def term(word: str) -> int | None:
            if word not in known:
                known[word] = terms.get(next(iter(query_terms([word])), None))
            return known[word]

        def one(t):
            if t is None:
                return None
            found = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t)]
            said = [term(t[a:b]) for a, b in found]
            hits = [(i, s) for i, s in enumerate(said) if s is not None]
            opens = {m.end() for m in re.finditer(r"[.:][ \t\n\r]+", t)} | {0}
            begins = [i for i, (a, _) in enumerate(found) if a in opens]
            first = best_window(len(found), hits, begins, most)
            last = min(len(found), first + most)
            out, at = [], 0 if first == 0 else found[first][0]
            for (a, b), is_hit in zip(found[first:last], said[first:last], strict=True):
                out.append(t[at:a] + (f"<mark>{t[a:b]}</mark>" if is_hit is not None else t[a:b]))
                at = b
            return ("" if first == 0 else "...") + "".join(out) + (t[at:] if last == len(found) else "...")

        return texts.map(one)

    return cut(content)
