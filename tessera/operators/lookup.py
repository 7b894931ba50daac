"""Lookups by id and by the beginning of an id: a layout clustered by id, ranges pushed to its reader, and many prefixes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clustered(rows: DataFrame, key: str, path: str, files: int) -> DataFrame:
    """Writes rows in ranges of a string key, sorted, so that a range of keys is in few files and few row groups of them; reads them back."""
    rows.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def after(prefix: str) -> str:
    """The least string above all that begin with a (non-empty) prefix."""
    return prefix[:-1] + chr(ord(prefix[-1]) + 1)


def by_prefix(table: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key begins with ``prefix``; a range, which the reader prunes by. All rows for an empty one."""
    return table if not prefix else table.filter((F.col(key) >= prefix) & (F.col(key) < after(prefix)))


def resolved(table: DataFrame, key: str, prefixes: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """prefix, n, id of prefixes (prefix; of the given lengths): how many keys begin so, and the key if there is just one.

    Each length is one join on equal beginnings, and keys are counted before they meet
    the prefixes, so a prefix that very many keys share is one row.
    """
    asked = prefixes.select("prefix").distinct()
    keys = table.select(F.explode(F.array(*(F.substring(key, 1, n) for n in lengths))).alias("prefix"), key)
    counts = keys.groupBy("prefix").agg(F.count("*").alias("n"), F.min(key).alias("id"))
    joined = asked.join(counts, "prefix", "left")
    return joined.select("prefix", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n") == 1, F.col("id")).alias("id"))
