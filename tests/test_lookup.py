"""What a lookup by prefix reads, and prefixes at once against one by one."""

import re

from pyspark.sql import functions as F

from tessera.operators import lookup


def test_a_prefix_opens_few_files(spark, tmp_path):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").alias("value"))
    table = lookup.clustered(rows, "key", f"file://{tmp_path}/t", 16)
    found = lookup.by_prefix(table, "key", "a7")
    assert sorted(r["value"] for r in found.collect()) == sorted(r["value"] for r in rows.filter("key LIKE 'a7%'").collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(key,a7\), LessThan\(key,a8\)", plan)
    ranges = [(r["a"], r["z"]) for r in table.groupBy(F.input_file_name().alias("f")).agg(F.min("key").alias("a"), F.max("key").alias("z")).collect()]
    assert len(ranges) == 16 and sum(a < "a8" and z >= "a7" for a, z in ranges) <= 2
    assert lookup.by_prefix(table, "key", "").count() == 5000 and lookup.after("a9") == "a:"


def test_many_prefixes(spark):
    table = spark.createDataFrame([("abc1",), ("abd2",), ("b",), ("b",), (None,)], "key string")
    asked = spark.createDataFrame([("ab",), ("abd",), ("b",), ("zz",), ("abc",), ("abd",)], "prefix string")
    got = {r["prefix"]: (r["n"], r["id"]) for r in lookup.resolved(table, "key", asked, (1, 2, 3)).collect()}
    assert got["ab"] == (2, None) and got["abd"] == (1, "abd2") and got["zz"] == (0, None) and got["abc"] == (1, "abc1")
