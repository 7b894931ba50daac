"""Structured Streaming: event ingest, gap sessions, and checkpoints by count and by trigger.

Event times drive everything; late events are dropped after a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schema as S
from ..functions import text

WATERMARK = "10 minutes"
#: Folders that the log of curated events is cut into by session.
LOG_BUCKETS = 64


def read_events(spark: SparkSession, path: str, schema: T.StructType = S.EVENT, files_per_trigger: int = 50) -> DataFrame:
    """A stream of event files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingested(events: DataFrame) -> DataFrame:
    """Events cleaned, classified and hashed: what an event log row holds; works on streams and tables."""
    content = text.sanitized(F.coalesce("content", F.lit("")))
    kind = F.coalesce("event_type", text.event_type(content, F.col("tool_name"), F.col("exit_code")))
    out = events.withColumn("event_type", kind).withColumn("content", content)
    return out.withColumn("content_hash", text.content_hash(F.col("content"))).withColumn("token_count", text.estimate_tokens(F.col("content")))


def deduplicated(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Each content once per session within the watermark's delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "content_hash"])


def gap_sessions(events: DataFrame, gap: str = "60 seconds", delay: str = WATERMARK) -> DataFrame:
    """session_id, start, end, n, errors of runs of events without a gap."""
    grouped = events.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.count_if(F.col("exit_code") != 0).alias("errors")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors")


CHECKPOINT = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("checkpoint", T.IntegerType()), T.StructField("event_id", T.LongType()), T.StructField("trigger", T.StringType())])


class Checkpoints(StatefulProcessor):
    """A checkpoint at every n-th event of a session; sooner on a burst of tool outputs or a word of completion, from ``least`` events on.

    State of a session: its counters and the times of its last tool outputs (at
    most ``burst`` of them), so it stays small however long the session is; with ``ttl``
    (milliseconds) it goes when nothing came for so long, for streams that never end.
    """

    ttl: int | None = None

    every, least, burst, seconds, triggers = 10, 5, 10, 120, False
    done = r"(?i)tests?\s+(?:are\s+)?(?:passing|passed|pass)|\b(?:done|finished|complete|ready)\b|successfully\s+(?:built|compiled|deployed)"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", "since int, total int, tools array<double>", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        since, total, tools = self.state.get() if self.state.exists() else (0, 0, [])
        tools, out = list(tools), []
        said = batch["content"].fillna("").str.contains(self.done, regex=True)
        for event_id, ts, kind, finished in zip(batch["event_id"], batch["ts"], batch["event_type"], said, strict=True):
            since += 1
            at = ts.timestamp()
            if kind == "tool_output":
                tools = [t for t in [*tools, at][-self.burst :] if t >= at - self.seconds]
            why = None
            if since >= self.every:
                why = "count"
            elif self.triggers and since >= self.least:
                why = "tool_burst" if len(tools) >= self.burst else "task_complete" if finished else None
            if why:
                total, since, tools = total + 1, 0, []
                out.append((key[0], total, int(event_id), why))
        self.state.update((since, total, tools))
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in CHECKPOINT])

    def close(self) -> None:
        pass


def checkpoints(events: DataFrame, triggers: bool = False, ttl: int | None = None) -> DataFrame:
    """session_id, checkpoint, event_id, trigger as they come due; needs the RocksDB state store."""
    processor = Checkpoints()
    processor.triggers, processor.ttl = triggers, ttl
    return events.groupBy("session_id").transformWithStateInPandas(processor, CHECKPOINT, outputMode="Append", timeMode="ProcessingTime" if ttl else "None")


DISCLOSURE = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("trigger", T.StringType()), T.StructField("confidence", T.DoubleType())])


class Disclosures(StatefulProcessor):
    """When a session needs context: an error burst (counted since the last disclosure), else a change of topic.

    State of a session: its error count and last topic (``ttl``: see Checkpoints).
    """

    ttl: int | None = None

    burst = 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("disclosure", "errors int, topic string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        errors, topic = self.state.get() if self.state.exists() else (0, None)
        out = []
        for event_id, kind, name in zip(batch["event_id"], batch["event_type"], batch["topic"], strict=True):
            errors += kind == "error"
            shifted = isinstance(name, str) and topic is not None and name != topic
            topic = name if isinstance(name, str) else topic
            if errors >= self.burst:
                out.append((key[0], int(event_id), "error_burst", min(1.0, errors / 5)))
                errors = 0
            elif shifted:
                out.append((key[0], int(event_id), "topic_shift", 0.7))
        self.state.update((errors, topic))
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in DISCLOSURE])

    def close(self) -> None:
        pass


def disclosures(events: DataFrame, ttl: int | None = None) -> DataFrame:
    """session_id, event_id, trigger, confidence of a stream of events (session_id, event_id, ts, event_type, topic)."""
    processor = Disclosures()
    processor.ttl = ttl
    return events.groupBy("session_id").transformWithStateInPandas(processor, DISCLOSURE, outputMode="Append", timeMode="ProcessingTime" if ttl else "None")


def curate_batches(events: DataFrame, path: str, checkpoint: str):
    """Curates a stream: what a session told in earlier micro-batches counts with what it tells in this one.

    Each micro-batch's events go to a log, cut by session; the sessions that it touches
    are curated as a whole, from the log's folders that hold them.  Replayed batches
    overwrite themselves.  ``curated_so_far`` reads the result.
    """
    from ..operators import curate

    bucket = F.pmod(F.xxhash64("session_id"), F.lit(LOG_BUCKETS)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", bucket)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/log/batch={batch_id}")
        own = spark.read.option("basePath", f"{path}/log").parquet(f"{path}/log/batch={batch_id}")
        touched = own.select("session_id").distinct()
        buckets = [r[0] for r in own.select("bucket").distinct().collect()]  # at most LOG_BUCKETS
        log = spark.read.schema(own.schema).parquet(f"{path}/log").filter((F.col("batch") <= batch_id) & F.col("bucket").isin(buckets))
        whole = log.join(touched, "session_id", "left_semi").drop("batch", "bucket")
        found = curate.curated(whole)
        found.write.mode("overwrite").parquet(f"{path}/candidates/batch={batch_id}")
        touched.write.mode("overwrite").parquet(f"{path}/touched/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def curated_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The candidates of all sessions, each as of the last micro-batch that touched it, merged."""
    from ..operators import curate

    last = spark.read.parquet(f"{path}/touched").groupBy("session_id").agg(F.max("batch").alias("batch"))
    return curate.merged(spark.read.parquet(f"{path}/candidates").join(last, ["session_id", "batch"], "left_semi").drop("batch"))
