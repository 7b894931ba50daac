"""The change log with snapshots: the state after all changes from the newest snapshot and the changes since.

Below a folder: changes/block=B (versions of BLOCK each), snapshot/upto=V (of each id the
last value set in every column up to version V, and by which version) and marks, a row
for each snapshot once it is whole.  A state reads one snapshot and the blocks of later
versions only.  Compacting again gives the same snapshot; changes delivered twice count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lifecycle import applied

#: Versions of a folder of changes.
BLOCK = 100_000


def append(changes: DataFrame, path: str, block: int = BLOCK) -> None:
    """Adds changes (id, version, op and the columns they set) to the log."""
    changes.withColumn("block", F.floor(F.col("version") / block)).write.mode("append").partitionBy("block").parquet(f"{path}/changes")


def newest(spark: SparkSession, path: str) -> int | None:
    """The version up to which the newest whole snapshot goes; None: there is none."""
    try:
        return spark.read.schema("upto long").parquet(f"{path}/marks").agg(F.max("upto")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def since(spark: SparkSession, path: str, schema: T.StructType, upto: int | None, block: int = BLOCK) -> DataFrame:
    """Changes after a version: the folders of earlier blocks are not read."""
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField("block", T.LongType())])).parquet(f"{path}/changes")
    return (found if upto is None else found.filter((F.col("block") >= upto // block) & (F.col("version") > upto))).drop("block")


def partial(changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Changes as what ``merged`` adds up: of every column the value set, with the version that set it."""
    done = applied(changes)
    return done.select("id", "version", "op", *(F.when(F.col(c).isNotNull(), F.struct("version", F.col(c).alias("v"))).alias(c) for c in columns))


def merged(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    return parts.groupBy("id").agg(F.max("version").alias("version"), F.max_by("op", "version").alias("op"), *(F.max(c).alias(c) for c in columns))


def parts_of(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str], block: int) -> DataFrame:
    """The newest snapshot and the changes since, one row for each id."""
    upto = newest(spark, path)
    later = partial(since(spark, path, schema, upto, block), columns)
    if upto is None:
        return merged(later, columns)
    kept = spark.read.schema(later.schema).parquet(f"{path}/snapshot/upto={upto}")
    return merged(kept.unionByName(later), columns)


def visible(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """id, version and columns of the ids that were not deleted last."""
    return parts.filter("op <> 'delete'").select("id", "version", *(F.col(f"{c}.v").alias(c) for c in columns))


def state(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """What lifecycle.current says of the whole log.  schema: of the changes."""
    return visible(parts_of(spark, path, schema, columns, block), columns)


def compact(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str], clear: Column | None = None, block: int = BLOCK) -> int | None:
    """Writes a snapshot of all changes so far; the version it goes up to (None: there are no changes).

    clear: a condition on id, version and columns; ids that meet it (resolved conflicts
    that are old enough) leave the snapshot for good.  Deleted ids stay as such, since a
    later change may bring them back with what they had.
    """
    parts = parts_of(spark, path, schema, columns, block)
    upto = max((v for v in (since(spark, path, schema, newest(spark, path), block).agg(F.max("version")).first()[0], newest(spark, path)) if v is not None), default=None)
    if upto is None:
        return None
    if clear is not None:
        gone = visible(parts, columns).filter(clear).select(F.col("id").alias("_gone"))
        parts = parts.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    if upto == newest(spark, path) and clear is None:
        return upto  # nothing has come since
    if upto == newest(spark, path):
        # what it replaces cannot be read while it is overwritten
        aside = f"{path}/aside/upto={upto}"
        parts.write.mode("overwrite").parquet(aside)
        parts = spark.read.schema(parts.schema).parquet(aside)
    parts.write.mode("overwrite").parquet(f"{path}/snapshot/upto={upto}")
    spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").parquet(f"{path}/marks")
    return upto
