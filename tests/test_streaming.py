"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import sessions
from tessera.sources import views
from tessera.streaming import ingest

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('events')}/e"
    log = views.log(spark, TINY).select("event_id", "session_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.lit("text").alias("content"), F.lit(None).cast("string").alias("tool_name"), "exit_code")
    log.orderBy("ts").coalesce(1).write.parquet(path)
    return path


def run(df, spark, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name)


def test_checkpoints_equal_batch(spark, event_files, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = run(ingest.checkpoints(ingest.read_events(spark, event_files)), spark, "due", tmp_path)
    want = sessions.checkpoints(spark.read.parquet(event_files))
    rows = lambda df: sorted((r.session_id, r.checkpoint, r.event_id) for r in df.collect())
    assert rows(got) == rows(want) and rows(got)


def test_gap_sessions_equal_batch(spark, event_files, tmp_path):
    got = run(ingest.gap_sessions(ingest.read_events(spark, event_files), "30 minutes"), spark, "gaps", tmp_path, "complete")
    batch = sessions.episode_summary(sessions.episodes(spark.read.parquet(event_files), 1800))
    assert sorted((r.session_id, r.n) for r in got.collect()) == sorted((r.session_id, r.n) for r in batch.collect())


def test_ingest_stream(spark, event_files, tmp_path):
    stream = ingest.deduplicated(ingest.ingested(ingest.read_events(spark, event_files)))
    got = run(stream, spark, "ingested", tmp_path)
    assert got.count() == spark.read.parquet(event_files).select("session_id").distinct().count()  # one text each
    assert got.filter("token_count = 1 and length(content_hash) = 16").count() == got.count()


def test_disclosures(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, i, 100 + i, "error" if i in (1, 3, 4) else "turn", "a" if i < 3 else "b" if i == 6 else None) for i in range(8)]
    events = spark.createDataFrame(rows, "session_id long, event_id long, at long, event_type string, topic string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    events.write.parquet(f"{tmp_path}/e")
    stream = ingest.disclosures(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"))
    got = run(stream, spark, "disclosed", tmp_path).collect()
    assert [(r.event_id, r.trigger, r.confidence) for r in sorted(got)] == [(4, "error_burst", 0.6), (6, "topic_shift", 0.7)]


def test_curated_batches(spark, tmp_path):
    """Told over several micro-batches: an error, later its fix and success; a phrase that repeats."""
    from tessera.operators import curate

    rows = [
        (1, 1, 0, "tool_output", "Error: cannot find module x\n", "bash", 1), (2, 2, 1, "turn", "We are using pytest for tests.", None, None),
        (1, 3, 20, "turn", "Fixed by installing the missing package.", None, None), (2, 4, 21, "turn", "We are using pytest for tests.", None, None),
        (1, 5, 60, "tool_output", "ok", "bash", 0), (2, 6, 61, "turn", "We are using pytest for tests.", None, None), (3, 7, 70, "user_prompt", "Never use any casts in this code base.", None, None),
    ]
    schema = "session_id long, event_id long, at long, event_type string, content string, tool_name string, exit_code int"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1)
    for i, part in enumerate(("event_id <= 2", "event_id in (3, 4)", "event_id > 4")):
        events.filter(part).write.parquet(f"{tmp_path}/e/part{i}")
    files = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/e")
    query = ingest.curate_batches(files, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(300)
    found = ingest.curated_so_far(spark, f"{tmp_path}/out")
    key = lambda df: sorted((r.session_id, r.object_type, r.content, r.confidence) for r in df.collect())
    assert key(found) == key(curate.merged(curate.curated(events)))
    assert {r[1] for r in key(found)} == {"known_fix", "convention", "constraint"}
