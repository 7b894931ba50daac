"""Buffers over tables and streams against each other and against folds."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import buffers as B
from tessera.streaming import buffers as SB

SCHEMA = "session_id long, event_id long, at double, event_type string, content string, tool_name string, exit_code int, path string"


def made(draw, sessions=12, length=60):
    rows, at, e = [], {s: 1000.0 * s for s in range(sessions)}, 0
    for _ in range(sessions * length):
        s = draw.randrange(sessions)
        at[s] += draw.choice([1, 5, 20, 40, 400])
        tool = draw.random() < 0.5
        said = draw.choice(["working", "hm", "All tests passed", "We should use one pattern", "pattern and architecture", None] + ["working"] * 14)
        rows.append((s, e, at[s], "tool_output" if tool else "turn", said, draw.choice(["bash", "pytest"]) if tool else None, draw.choice([0, 0, 1]) if tool else None, draw.choice([None, f"f{e // 200}"])))
        e += 1
    return sorted(rows, key=lambda r: (r[2], r[1]))


@pytest.fixture(scope="module")
def events(spark):
    rows = made(random.Random(5))
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("at")).drop("at")


def key(df):
    return sorted(tuple(r) for r in df.collect())


def fold_checkpoints(rows, burst, within, least):
    """The whole buffer kept, every rule asked anew."""
    out, held, number = [], {}, {}
    import re

    for s, e, at, kind, said, tool, code, path in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        buffer = held.setdefault(s, [])
        done = bool(said and re.search("tests? (are )?(passing|passed|pass)|done|finished|complete|ready", said, re.I)) or (kind == "tool_output" and code == 0 and bool(re.search("test|spec", tool or "")))
        buffer.append((e, at, kind, done, path))
        early, late = {b[4] for b in buffer[:-5] if b[4]}, {b[4] for b in buffer[-5:] if b[4]}
        if sum(b[2] == "tool_output" and b[1] >= at - within for b in buffer) >= burst:
            why = "tool_burst"
        elif any(b[3] for b in buffer[-5:]):
            why = "task_complete"
        elif len(buffer) >= 10 and early and late and not early & late:
            why = "topic_shift"
        else:
            continue
        if len(buffer) >= least:
            number[s] = number.get(s, 0) + 1
            out.append((s, number[s], buffer[0][0], e, len(buffer), why))
            held[s] = []
    return sorted(out), sorted((s, number.get(s, 0) + 1, b[0][0], b[-1][0], len(b), "end") for s, b in held.items() if b)


def test_checkpoints_against_a_fold(events):
    rows, df = events
    want, rest = fold_checkpoints(rows, 4, 120, 5)
    assert key(B.checkpoints(df.repartition(5), burst=4)) == want
    assert {w[5] for w in want} == {"tool_burst", "task_complete", "topic_shift"}
    assert key(B.checkpoints(df, flush=True, burst=4)) == sorted(want + rest)


def test_rolling_dedupe_is_bounded_by_count(spark):
    """3,000 keys, each again after 400 and after 1,200 others: by count the first is a repeat, the second is not."""
    order = [k for i in range(0, 3000, 400) for k in (*range(i, min(i + 400, 3000)), *range(i, min(i + 400, 3000)), *range(max(0, i - 1200), max(0, i - 800)))]
    rows = [(1, n, float(n), f"k{k}") for n, k in enumerate(order)] + [(2, 10**6, 1.0, "k0"), (2, 10**6 + 1, 2.0, None)]
    df = spark.createDataFrame(rows, "session_id long, event_id long, at double, key string").withColumn("ts", F.timestamp_seconds("at"))
    seen, kept = {}, []
    for n, k in enumerate(order):
        if k not in seen:
            seen[k] = 1
            kept.append(n)
            if len(seen) > 1000:
                seen = dict.fromkeys(list(seen)[-500:], 1)
    assert key(B.rolling(df)) == sorted([(1, n) for n in kept] + [(2, 10**6)])
    assert len(kept) > 3000  # within any time that spans the session, only 3,000 would stay


def stream(spark, df, tmp_path, files):
    """The events in so many files, one for each micro-batch."""
    rows = df.count()
    numbered = df.withColumn("part", F.floor((F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts", "event_id")) - 1) * files / rows))
    for i in range(files):
        numbered.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def finished(df, spark, name, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(600)
    return spark.table(name)


def test_a_stream_that_ends_amid_sessions(spark, events, tmp_path):
    """Several micro-batches: what it emitted, by triggers and by timers, and what its state still holds is the table's answer."""
    df = events[1]
    got = finished(SB.analyses(stream(spark, df, tmp_path, 4), delay="0 seconds", idle=300), spark, "analysed", tmp_path)
    rest = SB.left(spark, f"{tmp_path}/cp", lambda: B.Analyses(idle=300))
    want = key(B.analyses(df, idle=300))
    told = key(got) + key(rest)
    assert {r[5] for r in want} == {"idle", "old", "moment", "end"}
    # a timer can call the last buffer of a session idle that the table calls its end
    last = {(r[0], r[1]) for r in want if r[5] == "end"}
    assert sorted((*r[:5], "end") if (r[0], r[1]) in last else r for r in told) == want
    assert any(r[5] == "idle" for r in key(got))


def test_other_machines_over_a_stream(spark, events, tmp_path):
    df = events[1]
    source = stream(spark, df, tmp_path / "a", 3)
    got = finished(SB.checkpoints(source, burst=4), spark, "checked", tmp_path / "a")
    rest = SB.left(spark, f"{tmp_path}/a/cp", lambda: B.Checkpoints(burst=4))
    assert sorted(key(got) + key(rest)) == key(B.checkpoints(df, flush=True, burst=4))
    keyed = df.select("session_id", "event_id", "ts", F.concat(F.lit("k"), F.col("event_id") % 37).alias("key"))
    got = finished(SB.rolling(stream(spark, keyed, tmp_path / "b", 3), most=20, keep=10), spark, "rolled", tmp_path / "b")
    assert key(got) == key(B.rolling(keyed, most=20, keep=10))


def test_no_events(spark, events):
    none = events[1].limit(0)
    assert key(B.checkpoints(none, flush=True)) == key(B.analyses(none)) == []
