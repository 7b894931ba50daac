"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """tessera.index.dir, else spark.checkpoint.dir; in local mode, where both may be unset, a folder that goes with the process."""
    named = spark.conf.get("tessera.index.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("tessera.index.dir or spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not hasattr(shared_folder, "own"):
            shared_folder.own = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, shared_folder.own, ignore_errors=True)
        named = f"file://{shared_folder.own}"
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


#: With this, what a query shuffled leaves the disks when it ends, not when the driver happens to collect garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Queries that begin within leave no shuffle files behind; for writes of tables that are read again."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


class Rounds:
    """Tables of an iteration: each round's is written, read again, and takes the place of the one before; ``drop`` deletes those that no later plan reads."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/rounds-{what}-{uuid.uuid4().hex[:12]}", 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/t{self.n}"
        self.n += 1
        with cleaned(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            fs, where = file_system(self.spark, df._tessera_path)
            fs.delete(where, True)
