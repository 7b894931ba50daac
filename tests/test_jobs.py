"""The jobs: against SQL, over growing input, run again, by their command lines."""

import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import memory_audit, queries, transcript_ingest
from jobs.common import checked

TINY = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(rows):
    return sorted(repr(tuple(round(v, 5) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, TINY)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(tuple(r[c] for c in want.columns) for r in got.collect()) == plain(want.fetchall())


# --- transcripts ------------------------------------------------------------------

LONG = "word " * 1500
FIRST = [(1, 0, "user", "Fix the build"), (1, 1, "assistant", "Error: no such file"), (1, 2, "assistant", LONG), (2, 0, "user", None), (2, 1, None, "Bearer abc.def-123 is the key")]
SECOND = [(1, 1, "assistant", "Error: no such file"), (1, 1, "assistant", "12 tests passed"), (3, 0, "user", LONG), (2, 0, "user", None), (None, 7, "system", "ok"), (3, 1, "assistant", LONG + "!")]


def turns(spark, rows):
    return spark.createDataFrame(rows, transcript_ingest.TURNS)


def contents(spark, out):
    log = transcript_ingest.log(spark, out)
    return sorted(map(repr, log.select(*sorted(log.columns)).collect())), sorted(map(repr, transcript_ingest.blobs(spark, out).collect()))


def test_transcripts_over_growing_input(spark, tmp_path):
    source, out, progress = (f"file://{tmp_path}/{n}" for n in ("in", "out", "progress"))
    turns(spark, FIRST + FIRST[:2]).coalesce(1).write.parquet(f"{source}/one")
    assert transcript_ingest.run(spark, source, out, progress) == 7
    first = contents(spark, out)
    assert len(first[0]) == 5 and len(first[1]) == 1
    assert transcript_ingest.run(spark, source, out, progress) == 0
    assert contents(spark, out) == first  # nothing new
    turns(spark, SECOND).coalesce(1).write.parquet(f"{source}/two")
    assert transcript_ingest.run(spark, source, out, progress) == 6  # new files alone are read
    both = contents(spark, out)
    assert set(first[0]) < set(both[0]) and len(both[0]) == 9 and len(both[1]) == 2  # delivered again: left out
    # all at once says the same
    transcript_ingest.run(spark, source, f"{out}-whole", f"{progress}-whole")
    assert contents(spark, f"{out}-whole") == both
    kinds = {(r["session_id"], r["pos"], r["content_hash"][:4]): (r["event_type"], r["redacted"], r["blob_id"] is not None) for r in transcript_ingest.log(spark, out).collect()}
    assert sorted(kinds.values()) == sorted([("user_prompt", False, False), ("error", False, False), ("turn", False, True), ("user_prompt", False, False), ("turn", True, False), ("test_summary", False, False), ("user_prompt", False, True), ("turn", False, False), ("turn", False, True)])
    done = {(r["session_id"], r["event_type"]): (r["events"], r["redactions"]) for r in transcript_ingest.activity(spark, out).collect()}
    assert done == {(1, "user_prompt"): (1, 0), (1, "error"): (1, 0), (1, "turn"): (1, 0), (1, "test_summary"): (1, 0), (2, "user_prompt"): (1, 0), (2, "turn"): (1, 1), (3, "user_prompt"): (1, 0), (3, "turn"): (1, 0), (None, "turn"): (1, 0)}


def test_a_replayed_batch_overwrites_itself(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    events = transcript_ingest.as_events(turns(spark, FIRST).selectExpr("conv_id session_id", "turn pos", "role", "text content"))
    transcript_ingest.write_batch(events, 0, out, 1000)
    once = contents(spark, out)
    transcript_ingest.write_batch(events, 0, out, 1000)
    assert contents(spark, out) == once and len(once[1]) == 1


@pytest.mark.parametrize("kind", ["json", "csv", "orc"])
def test_other_formats(spark, tmp_path, kind):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    turns(spark, FIRST[:2]).coalesce(1).write.format(kind).save(source)
    assert transcript_ingest.run(spark, source, out, f"file://{tmp_path}/progress", {"format": kind, "files_per_batch": 1}) == 2
    assert transcript_ingest.log(spark, out).filter("event_type = 'error'").count() == 1


def test_empty_input(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    turns(spark, []).write.parquet(source)
    assert transcript_ingest.run(spark, source, out, f"file://{tmp_path}/progress") == 0
    assert transcript_ingest.log(spark, out).count() == transcript_ingest.blobs(spark, out).count() == transcript_ingest.activity(spark, out).count() == 0


# --- audit ------------------------------------------------------------------------


def test_audit_of_some_scopes_replaces_their_partitions_alone(spark, tmp_path):
    here, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text", "source", "n_chars")
    docs.write.parquet(here)
    labels = f"{TINY}/labels.parquet"
    n = memory_audit.run(spark, here, labels, out)
    whole = memory_audit.results(spark, out).collect()
    assert n == len(whole) == docs.count()
    names = sorted({r["scope"] for r in whole})
    changed = docs.withColumn("text", F.when(F.col("source") == names[0], F.concat(F.lit("Let me check "), "doc_id")).otherwise(F.lit("gone")))
    changed.write.mode("overwrite").parquet(here)
    memory_audit.run(spark, here, labels, out, {"scopes": [names[0]]})
    part = memory_audit.results(spark, out).collect()
    other = lambda rows: sorted(repr(r) for r in rows if r["scope"] != names[0])
    assert other(part) == other(whole)
    assert "discard" in (acts := {r["action"] for r in part if r["scope"] == names[0]}) and acts <= {"leave", "discard"}
    sums = memory_audit.summary(spark, out).groupBy("scope").agg(F.sum("n").alias("n")).collect()
    assert {r["scope"]: r["n"] for r in sums} == {s: sum(r["scope"] == s for r in part) for s in names}
    # and a run over all scopes leaves none that is gone
    docs.filter(F.col("source") != names[0]).write.mode("overwrite").parquet(here)
    memory_audit.run(spark, here, labels, out)
    assert names[0] not in {r["scope"] for r in memory_audit.results(spark, out).collect()}


def test_audit_keeps_null_texts_and_scopes(spark, tmp_path):
    here, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    spark.createDataFrame([(0, None, None, None), (1, "", "2020", 0), (10, "same", "2020", 4), (20, "Same ", "a=b/c", 5)], "doc_id long, text string, source string, n_chars long").write.parquet(here)
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{here}-labels")
    memory_audit.run(spark, here, f"{here}-labels", out)
    rows = {r["id"]: (r["scope"], r["action"], r["into"], r["tokens"]) for r in memory_audit.results(spark, out).collect()}
    assert rows[0][0] is None and rows[0][3] == 0 and rows[1][0] == "2020" and rows[20][:3] == ("a=b/c", "merge", 10)


def test_settings_are_checked():
    assert checked({"format": "orc"}, transcript_ingest.DEFAULTS)["blob_tokens"] == 1000
    for wrong in ({"formt": "orc"}, {"format": "delta"}):
        with pytest.raises(ValueError):
            checked(wrong, transcript_ingest.DEFAULTS)


def test_command_lines(tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"blob_tokens": 5}))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    call = lambda job, *more: subprocess.run([sys.executable, f"{ROOT}/jobs/{job}.py", *more], env=env, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    done = call("transcript_ingest", "--input", f"{TINY}/conversations.parquet", "--output", f"{tmp_path}/o1", "--checkpoint", f"{tmp_path}/c1", "--config", str(config))
    assert done.returncode == 0 and "new turns" in done.stderr and "new blobs" in done.stderr, done.stderr[-2000:]
    done = call("memory_audit", "--memories", f"{TINY}/documents.parquet", "--feedback", f"{TINY}/labels.parquet", "--output", f"{tmp_path}/o2")
    assert done.returncode == 0 and "wrote 200 rows" in done.stderr, done.stderr[-2000:]
