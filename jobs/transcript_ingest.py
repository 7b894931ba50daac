"""Incremental ingest of conversation transcripts into an event log.

New files of a folder of turns (conv_id, turn, role, text) are taken by a file stream with
a checkpoint; a run takes what has come since the last one and ends.  Turns are sanitised,
classified, hashed and measured; long contents go to a blob table, once each; turns that
were delivered before (same conversation, turn, role and text) are left out.

Below the output folder, all as Parquet, a folder for each micro-batch (a replayed one
overwrites itself):

  events/batch=N/event_type=T   session_id, pos, role, content (null for blobs), blob_id, content_hash, token_count, redacted
  blobs/batch=N                 blob_id, content, size
  activity/batch=N              session_id, event_type, events, tokens, redactions

``log``, ``blobs`` and ``activity`` read them back; activity adds up what the batches
hold, so no run reads earlier events again.  Turns seen are state of the stream, which
grows with them (a RocksDB state store keeps it on disk; the session chooses).

Nulls: a null text is empty; null ids and roles are kept as they are.

  python jobs/transcript_ingest.py --input FOLDER --output FOLDER --checkpoint FOLDER [--config FILE]
"""

from __future__ import annotations

import logging
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from pyspark.sql import DataFrame, Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import arguments, checked, session, stored  # noqa: E402
from tessera.functions import text  # noqa: E402
from tessera.operators import lifecycle  # noqa: E402
from tessera.sources import views  # noqa: E402

LOG = logging.getLogger("transcript_ingest")
DEFAULTS = {"format": "parquet", "files_per_batch": 1000, "blob_tokens": 1000}
TURNS = "conv_id long, turn long, role string, text string"
EVENTS = "session_id long, pos long, role string, content string, blob_id string, content_hash string, token_count long, redacted boolean, batch long, event_type string"
BLOBS = "blob_id string, content string, size int, batch long"
ACTIVITY = "session_id long, event_type string, events long, tokens long, redactions long, batch long"
KEY = ("session_id", "pos", "role", "raw_hash")


def as_events(turns: DataFrame) -> DataFrame:
    """Turns (session_id, pos, role, content) as events: what users say is a prompt, the rest is told by its text."""
    raw = F.coalesce("content", F.lit(""))
    clean = text.sanitized(raw)
    rows = turns.withColumn("raw_hash", F.sha2(raw, 256)).withColumn("redacted", clean != raw).withColumn("content", clean)
    return rows.withColumn("event_type", F.when(F.col("role") == "user", "user_prompt").otherwise(text.event_type(F.col("content"))))


def write_batch(events: DataFrame, batch_id: int, output: str, blob_tokens: int) -> None:
    """One micro-batch: its events, the blobs that no earlier batch has, and its share of the activity."""
    spark = events.sparkSession
    earlier = stored(spark, f"{output}/blobs", BLOBS).filter(F.col("batch") < batch_id).select("blob_id")
    sized, large = lifecycle.split_blobs(events.drop("raw_hash"), blob_tokens)
    told, counts = Observation(), Observation()
    columns = [c.split()[0] for c in EVENTS.split(", ")][:8]
    rows = sized.select(*columns, "event_type").observe(told, F.count("*").alias("n"), F.count_if(F.col("blob_id").isNotNull()).alias("blobs"))
    rows.write.mode("overwrite").partitionBy("event_type").parquet(f"{output}/events/batch={batch_id}")
    new = large.join(earlier, "blob_id", "left_anti").select("blob_id", "content", "size").observe(counts, F.count("*").alias("n"))
    new.write.mode("overwrite").parquet(f"{output}/blobs/batch={batch_id}")
    # from the batch's own file, as a stream's batch would be made again
    own = spark.read.schema(", ".join(c for c in EVENTS.split(", ") if not c.startswith("batch "))).parquet(f"{output}/events/batch={batch_id}")
    share = own.groupBy("session_id", "event_type").agg(F.count("*").alias("events"), F.sum("token_count").alias("tokens"), F.count_if("redacted").alias("redactions"))
    share.write.mode("overwrite").parquet(f"{output}/activity/batch={batch_id}")
    LOG.info("batch %d: wrote %d events (%d with blobs) and %d new blobs to %s", batch_id, told.get["n"], told.get["blobs"], counts.get["n"], output)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict | None = None) -> int:
    """Ingests what is new below ``source`` and ends; the number of turns read."""
    chosen = checked(settings or {}, DEFAULTS)
    files = spark.readStream.format(chosen["format"]).schema(TURNS).option("maxFilesPerTrigger", chosen["files_per_batch"]).option("recursiveFileLookup", True)
    events = as_events(views.as_turns(files.load(source))).dropDuplicates(KEY)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, output, chosen["blob_tokens"])

    query = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    LOG.info("read %d new turns from %s", read, source)
    return read


def log(spark: SparkSession, output: str) -> DataFrame:
    """All events."""
    return stored(spark, f"{output}/events", EVENTS).drop("batch")


def blobs(spark: SparkSession, output: str) -> DataFrame:
    """All long contents."""
    return stored(spark, f"{output}/blobs", BLOBS).drop("batch")


def activity(spark: SparkSession, output: str) -> DataFrame:
    """session_id, event_type, events, tokens, redactions over all batches."""
    return stored(spark, f"{output}/activity", ACTIVITY).groupBy("session_id", "event_type").agg(*(F.sum(c).alias(c) for c in ("events", "tokens", "redactions")))


def main() -> None:
    named, settings = arguments(__doc__.split("\n\n")[0], __file__, ("input", "folder of turns"), ("output", "folder of the log"), ("checkpoint", "folder of the stream's progress"))
    spark = session("transcript_ingest")
    try:
        run(spark, named.input, named.output, named.checkpoint, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
