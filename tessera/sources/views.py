"""Adapters: the test tables as memories, outcomes, events, usage, turns and vectors.

Every adapter is a narrow projection, so filters and column pruning reach the
parquet scan.  *_SQL are the same views for DuckDB, as bodies of a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon
from ..schema import CONFIDENCES, OBJECT_TYPES, REVIEWS

#: The present, for everything that decays or ages.
NOW = "2024-02-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def days_ago(days: Column) -> Column:
    return F.make_dt_interval(days=days)


def nth(names: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (position + 1).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_memories(read(spark, sf_dir, "documents"))


def as_memories(documents: DataFrame) -> DataFrame:
    """Knowledge records: type, status, review, ages and reference counts by arithmetic on doc_id."""
    i = F.col("doc_id")
    ago = lambda n: now() - days_ago((i % n).cast("int"))
    return documents.select(
        i.alias("id"),
        F.col("text").alias("content"),
        nth(OBJECT_TYPES, i % 7).alias("object_type"),
        F.when(i % 10 < 7, "active").when(i % 10 == 7, "stale").when(i % 10 == 8, "superseded").otherwise("retired").alias("status"),
        nth(REVIEWS, i % 3).alias("review_status"),
        nth(CONFIDENCES, i % 4).alias("confidence"),
        F.col("source").alias("scope_path"),
        ago(120).alias("created_at"),
        F.when(i % 5 != 0, ago(45)).alias("last_accessed"),
        F.when(i % 4 != 0, ago(20)).alias("last_verified_at"),
        (F.col("n_chars") % 30).alias("access_count"),
        (i % 3).alias("n_refs"),
        (i % 2).alias("n_evidence"),
        (1 - (i % 10) / F.lit(20.0)).alias("strength"),
    )


MEMORIES_SQL = f"""memories AS (SELECT doc_id AS id, text AS content,
  (['decision','preference','convention','known_fix','constraint','failed_attempt','environment'])[doc_id % 7 + 1] AS object_type,
  CASE WHEN doc_id % 10 < 7 THEN 'active' WHEN doc_id % 10 = 7 THEN 'stale' WHEN doc_id % 10 = 8 THEN 'superseded' ELSE 'retired' END AS status,
  (['pending','approved','rejected'])[doc_id % 3 + 1] AS review_status,
  (['certain','high','medium','low'])[doc_id % 4 + 1] AS confidence,
  source AS scope_path,
  TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 120 AS INTEGER)) AS created_at,
  CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 45 AS INTEGER)) END AS last_accessed,
  CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 20 AS INTEGER)) END AS last_verified_at,
  n_chars % 30 AS access_count, doc_id % 3 AS n_refs, doc_id % 2 AS n_evidence,
  1 - (doc_id % 10) / 20.0::DOUBLE AS strength FROM documents)"""


def memory_index(spark: SparkSession, sf_dir: str) -> lexicon.Index:
    """The lexical index of memories, made when the table is new or was changed."""
    return lexicon.kept(spark, "memories", [f"{sf_dir}/documents.parquet"], lambda: memories(spark, sf_dir).select("id", "content", "scope_path"), ("content", "scope_path"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_outcomes(read(spark, sf_dir, "labels"))


def as_outcomes(labels: DataFrame) -> DataFrame:
    """Feedback on memories: toxic or of low quality is unhelpful, else helpful."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return labels.select(F.col("doc_id").alias("memory_id"), F.when(bad, "unhelpful").otherwise("helpful").alias("outcome"))


OUTCOMES_SQL = "outcomes AS (SELECT doc_id AS memory_id, CASE WHEN toxic = 1 OR quality = 0 THEN 'unhelpful' ELSE 'helpful' END AS outcome FROM labels)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events: the session is the user, the type and exit code follow the event type."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("session_id"),
        "ts",
        F.when(kind == "error", "error").when(kind == "view", "tool_output").when(kind == "click", "tool_call").when(kind == "purchase", "user_prompt").otherwise("turn").alias("event_type"),
        F.when(kind == "error", 1).when(kind == "view", 0).cast("int").alias("exit_code"),
        F.col("value"),
    )


LOG_SQL = """log AS (SELECT event_id, user_id AS session_id, ts,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'tool_output' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'user_prompt' ELSE 'turn' END AS event_type,
  CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 0 END AS exit_code, value FROM events)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: one for each event."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("operation"),
        nth(("gpt-4", "claude-3-haiku", "unlisted"), F.col("user_id") % 3).alias("model"),
        F.floor("value").cast("long").alias("input_tokens"),
        F.floor(F.col("value") / 2).cast("long").alias("output_tokens"),
        "ts",
        "event_id",
    )


USAGE_SQL = """usage AS (SELECT user_id AS session_id, event_type AS operation, (['gpt-4','claude-3-haiku','unlisted'])[user_id % 3 + 1] AS model,
  CAST(floor(value) AS BIGINT) AS input_tokens, CAST(floor(value / 2) AS BIGINT) AS output_tokens, ts, event_id FROM events),
priced AS (SELECT *, CASE model WHEN 'gpt-4' THEN input_tokens / 1000.0::DOUBLE * 0.03::DOUBLE + output_tokens / 1000.0::DOUBLE * 0.06::DOUBLE
  WHEN 'claude-3-haiku' THEN input_tokens / 1000.0::DOUBLE * 0.00025::DOUBLE + output_tokens / 1000.0::DOUBLE * 0.00125::DOUBLE
  ELSE input_tokens / 1000.0::DOUBLE * 0.001::DOUBLE + output_tokens / 1000.0::DOUBLE * 0.002::DOUBLE END AS cost FROM usage)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_turns(read(spark, sf_dir, "conversations"))


def as_turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events of a log, with an id of their own."""
    return turns(spark, sf_dir).withColumn("id", F.col("session_id") * 100_000 + F.col("pos"))


def event_index(spark: SparkSession, sf_dir: str) -> lexicon.Index:
    return lexicon.kept(spark, "events", [f"{sf_dir}/conversations.parquet"], lambda: said(spark, sf_dir).select("id", "content", "role"), ("content", "role"))


SAID_SQL = "said_events AS (SELECT conv_id * 100000 + turn AS id, conv_id AS session_id, role, text AS content FROM conversations)"
TURNS_SQL = "turns AS (SELECT conv_id AS session_id, turn AS pos, role, text AS content FROM conversations)"
