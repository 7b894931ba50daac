"""State from a snapshot and what came since, against the state of the whole log."""

import random
import re

from pyspark.sql import functions as F

from tessera.operators import compaction as K
from tessera.operators import lifecycle

SCHEMA = "id long, version long, op string, status string, review_status string, value double, at long"
COLUMNS = ["status", "review_status", "value", "at"]


def log(spark, seed, first, n):
    draw = random.Random(seed)
    rows = [(draw.randrange(40), v, draw.choice(["create", "update", "stale", "retire", "approve", "reject", "verify", "delete", "supersede"]), None, None, draw.choice([None, draw.random()]), draw.choice([None, v])) for v in range(first, first + n)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.select("id", "version", *COLUMNS).collect()))


def test_state_over_snapshots(spark, tmp_path):
    path, parts = f"file://{tmp_path}/s", [log(spark, i, 300 * i, 300) for i in range(3)]
    schema = parts[0].schema
    assert K.newest(spark, path) is None
    whole = None
    for i, part in enumerate(parts):
        K.append(part, path, block=100)
        whole = part if whole is None else whole.unionByName(part)
        want = rows(lifecycle.current(whole, COLUMNS))
        assert rows(K.state(spark, path, schema, COLUMNS, block=100)) == want
        if i < 2:
            assert K.compact(spark, path, schema, COLUMNS, block=100) == 300 * i + 299
            assert rows(K.state(spark, path, schema, COLUMNS, block=100)) == want
            # compacting again changes nothing, and neither do changes that come twice
            assert K.compact(spark, path, schema, COLUMNS, block=100) == 300 * i + 299
            K.append(part, path, block=100)
            assert rows(K.state(spark, path, schema, COLUMNS, block=100)) == want


def test_a_state_reads_later_blocks_alone(spark, tmp_path):
    path, part = f"file://{tmp_path}/s", log(spark, 7, 0, 500)
    K.append(part, path, block=100)
    K.compact(spark, path, part.schema, COLUMNS, block=100)
    K.append(log(spark, 8, 500, 50), path, block=100)
    out = K.state(spark, path, part.schema, COLUMNS, block=100)
    read = K.since(spark, path, part.schema, K.newest(spark, path), block=100).select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("block=5" in r["f"] for r in read)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block[^\]]*>= 4", plan) and re.search(r"PushedFilters: \[[^\]]*GreaterThan\(version,499\)", plan)
    assert any("snapshot/upto=499" in f for f in out.inputFiles())


def test_old_resolved_conflicts_are_cleared(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    changes = spark.createDataFrame([(1, 1, "create", "resolved", None, None, 10), (2, 2, "create", "resolved", None, None, 90), (3, 3, "create", "pending", None, None, 10)], SCHEMA)
    K.append(changes, path)
    K.compact(spark, path, changes.schema, COLUMNS)
    old = (F.col("status") == "resolved") & (F.col("at") < 60)
    for _ in range(2):
        K.compact(spark, path, changes.schema, COLUMNS, clear=old)
        assert [r[0] for r in rows(K.state(spark, path, changes.schema, COLUMNS))] == [2, 3]


def test_no_changes(spark, tmp_path):
    path, none = f"file://{tmp_path}/s", spark.createDataFrame([], SCHEMA)
    none.write.parquet(f"{path}/changes/block=0")
    assert K.compact(spark, path, none.schema, COLUMNS) is None
