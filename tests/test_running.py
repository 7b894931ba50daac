"""Running totals over ranges against a fold, and how evenly they are dealt."""

import random

from pyspark.sql import functions as F

from tessera.operators import running as T

SCHEMA = "k string, at long, id long, v long"


def test_against_a_fold_with_a_hot_key(spark):
    draw = random.Random(2)
    rows = [("hot" if draw.random() < 0.8 else draw.choice(["a", "b", None]), draw.randrange(400), i, draw.choice([None, 1, 5, 10**12])) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r["id"]: r["s"] for r in T.running(df, "k", ("at", "id"), {"s": F.col("v")}, range_rows=300).collect()}
    sums, want = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = sums.get(k, 0)
        sums[k] = want[i] + (v or 0)
    assert got == want


def test_a_hot_key_fills_many_ranges_evenly(spark, monkeypatch):
    kept = []
    put = T.Rounds.put
    monkeypatch.setattr(T.Rounds, "put", lambda self, df: kept.append(put(self, df)) or kept[-1])
    df = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"), "id", F.lit(1).alias("v"))
    out = T.running(df, "k", ("at", "id"), {"s": F.col("v")}, range_rows=4000)
    assert out.agg(F.max("s")).first()[0] == 39_999
    sizes = sorted(r["count"] for r in kept[0].groupBy("_range").count().collect())
    assert len(sizes) == 10 and sizes[-1] <= 3 * sizes[5]
    # the rows' own windows are by range; those by key hold a row a range
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in plan


def test_no_rows(spark):
    assert T.running(spark.createDataFrame([], SCHEMA), "k", ("at", "id"), {"s": F.col("v")}).count() == 0


def test_gate(spark):
    calls = [(1, 0, 900, 600, 0.5), (1, 1, 100, 100, 0.4), (2, 2, 10, 10, 0.3), (1, 3, 10, 10, 0.1), (2, 4, 1, 1, 0.1), (2, 90_000, 1, 1, 0.1)]
    df = spark.createDataFrame(calls, "session_id long, at long, input_tokens long, output_tokens long, cost double").select("*", F.col("at").alias("event_id"), F.timestamp_seconds("at").alias("ts"))
    got = {r["event_id"]: (r["tokens"], r["spent"], r["reason"], r["allowed"]) for r in T.budget_gate(df, 2600, 1.2).collect()}
    assert got == {0: (0, 0, None, True), 1: (1500, 500_000_000, None, True), 2: (0, 900_000_000, None, True), 3: (1700, 1_200_000_000, "session_tokens", False), 4: (20, 1_300_000_000, "day_cost", False), 90_000: (22, 0, None, True)}
