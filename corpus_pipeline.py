"""The corpus pipeline: quality, near-dedup, privacy, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, joinable, table
from tessera.llm.near_dup import near_duplicates
from tessera.llm.packing import default_tokenizer, pack
from tessera.llm.pii import pseudonymise, session_key
from tessera.llm.quality import ACCEPT, fit, scorer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    score = scorer(fit(docs, table(spark, sf_dir, "labels")))
    return docs.select(*COLUMNS).filter(score(F.col("text")) >= ACCEPT)


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with key: doc_id, but for rows whose doc_id names several texts: those are told apart by text, below 0."""
    text = F.xxhash64("text")
    torn = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).filter("a <> b")
    torn = joinable(scratch.put(torn.select(F.col("doc_id").alias("torn"))))
    own = -1 - F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**62))
    return docs.join(torn, F.col("doc_id") == F.col("torn"), "left").withColumn("key", F.when(F.col("torn").isNull(), F.col("doc_id")).otherwise(own)).drop("torn")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates.

    Rows that repeat a doc_id with its text are one document, of which the least row
    stays; different texts under one doc_id are documents of their own.  Rows without
    doc_id stay.
    """
    scratch = Scratch(spark, "pipeline")
    docs = keyed(docs.select(*COLUMNS), scratch)
    classes = near_duplicates(docs.select(F.col("key").alias("doc_id"), "text"))
    gone = scratch.put(classes.filter("not kept").select(F.col("doc_id").alias("gone")).distinct())
    kept = docs.join(joinable(gone), F.col("key") == F.col("gone"), "left_anti")
    # only where there are repeated rows does one go
    again = scratch.put(docs.filter("key is not null").groupBy("key").count().filter("count > 1").select(F.col("key").alias("again")))
    once = kept.join(joinable(again), F.col("key") == F.col("again"), "left_anti")
    twice = kept.join(joinable(again), F.col("key") == F.col("again"), "left_semi")
    least = twice.groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return once.select(*COLUMNS).unionByName(least)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    out = pseudonymise(docs.select(*COLUMNS), session_key(spark))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents."""
    return pack(docs, default_tokenizer())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("privacy", privacy), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what each keeps is written and read again."""
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.put(docs)
            scratch.keep(docs)  # what the stage read is not read again
    return docs


#: The classifier, near-dedup and tokenizing are beyond SQL.
ORACLE_SQL = None
