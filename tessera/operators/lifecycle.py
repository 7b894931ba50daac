"""The store as an append-only change log: every mutation is a row, the current state is the latest of each id.

A change holds id, version (orders the changes of an id), op and the columns it
sets; null means unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What an operation sets.
EFFECTS = {
    "stale": {"status": "stale"},
    "retire": {"status": "retired"},
    "approve": {"review_status": "approved"},
    "reject": {"review_status": "rejected", "status": "retired"},
    "supersede": {"status": "superseded"},
    "verify": {"status": "active"},
}
DEFAULTS = {"status": "active", "review_status": "pending", "confidence": "medium", "strength": 1.0, "outcome_score": 0.5}


def created(rows: DataFrame, now: Column) -> DataFrame:
    """New memories with defaults; verified now if they come with references."""
    out = rows
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    refs = F.size("code_refs") > 0 if "code_refs" in rows.columns else F.lit(False)
    return out.withColumn("created_at", now).withColumn("last_verified_at", F.when(refs, now)).withColumn("op", F.lit("create"))


def applied(changes: DataFrame) -> DataFrame:
    """Changes with what their operation sets filled in."""
    out = changes
    for column in ("status", "review_status"):
        value = F.col(column)
        for op, effect in EFFECTS.items():
            if column in effect:
                value = F.when(F.col("op") == op, effect[column]).otherwise(value)
        out = out.withColumn(column, value)
    for column in ("strength", "outcome_score"):
        if column in changes.columns:
            out = out.withColumn(column, F.when(F.col(column).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(column)))))
    return out


def current(changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The state after all changes: for each id the last value set in every column; deleted ids are gone.

    One grouped aggregation with partial sums; no history is gathered.
    """
    done = applied(changes)
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("version", F.col(c).alias("v")))).alias(f"_{c}") for c in columns]
    state = done.groupBy("id").agg(F.max_by("op", "version").alias("_op"), F.max("version").alias("version"), *last)
    return state.filter("_op <> 'delete'").select("id", "version", *(F.col(f"_{c}.v").alias(c) for c in columns))


def accessed(memories: DataFrame, accesses: DataFrame, boost: float = 0.15) -> DataFrame:
    """Memories with counters and strength brought up to date by access events (id, accessed_at)."""
    rolled = accesses.groupBy(F.col("id").alias("a_id")).agg(F.count("*").alias("n"), F.max("accessed_at").alias("at"))
    joined = memories.join(rolled, F.col("id") == F.col("a_id"), "left")
    n = F.coalesce("n", F.lit(0))
    return (
        joined.withColumn("access_count", F.col("access_count") + n)
        .withColumn("last_accessed", F.greatest("last_accessed", "at"))
        .withColumn("strength", F.least(F.lit(1.0), F.col("strength") + n * boost))
        .drop("a_id", "n", "at")
    )


def sessions(changes: DataFrame) -> DataFrame:
    """session_id, started_at, ended_at, summary, task of session changes (op: start, end, edit)."""
    at = lambda op: F.when(F.col("op") == op, F.col("ts"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    return changes.groupBy("session_id").agg(F.min(at("start")).alias("started_at"), F.max(at("end")).alias("ended_at"), last("summary").alias("summary"), last("task").alias("task"))


def current_session(all_sessions: DataFrame, nth: int = 1, open_only: bool = False) -> DataFrame:
    """The nth latest session; with open_only, of those that have not ended."""
    kept = all_sessions.filter("ended_at is null") if open_only else all_sessions
    newest = kept.orderBy(F.desc("started_at"), "session_id").limit(nth)
    return newest.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("started_at"), "session_id"))).filter(F.col("_n") == nth).drop("_n")


def split_blobs(events: DataFrame, most_tokens: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Events with hash and token estimate, and blobs (blob_id, content, size): large contents are kept apart."""
    from ..functions import text

    content = F.col("content")
    sized = events.withColumn("content_hash", text.content_hash(content)).withColumn("token_count", text.estimate_tokens(content))
    large = F.col("token_count") > most_tokens
    blobs = sized.filter(large).select(F.col("content_hash").alias("blob_id"), "content", F.octet_length("content").alias("size")).dropDuplicates(["blob_id"])
    return sized.withColumn("blob_id", F.when(large, F.col("content_hash"))).withColumn("content", F.when(~large, content)), blobs


def with_content(events: DataFrame, blobs: DataFrame) -> DataFrame:
    """Events with their whole contents again."""
    found = blobs.select(F.col("blob_id").alias("b_id"), F.col("content").alias("b_content"))
    joined = events.join(found, F.col("blob_id") == F.col("b_id"), "left")
    return joined.withColumn("content", F.coalesce("content", "b_content")).drop("b_id", "b_content")
