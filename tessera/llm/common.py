"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most this many rows.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir``; in local mode, where it may be unset, one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="tessera-", dir=os.environ.get("TMPDIR"))
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no recomputation.

    ``put`` writes and rereads a DataFrame; ``drop`` deletes a table that no
    later plan reads, ``keep`` all but those named.  Tables a result still depends
    on are left to the owner of the folder.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/tessera-{what}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.live: dict[str, DataFrame] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/t{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        self.live[path] = out
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            if self.live.pop(df._tessera_path, None) is None:
                continue
            path = jvm.org.apache.hadoop.fs.Path(df._tessera_path)
            conf = self.spark._jsc.hadoopConfiguration()
            path.getFileSystem(conf).delete(path, True)

    def keep(self, *frames: DataFrame) -> None:
        named = {df._tessera_path for df in frames}
        self.drop(*(df for path, df in list(self.live.items()) if path not in named))


@functools.cache
def trim():
    """The C library's way to give free memory back; does nothing where it has none."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def release() -> None:
    """Gives back what a Python worker no longer uses: idle workers are kept, and count among an executor's memory."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim()(0)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (written) table has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def joinable(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` marked for broadcast if its counted size allows, else as it is."""
    return F.broadcast(small) if bounded(small, rows) else small


#: Rows of one key that a task of a join gets at most, about.
KEY_ROWS = 2048


def spread_join(left: DataFrame, right: DataFrame, on: tuple[str, str], sizes: DataFrame, spread: list[str], rows: int = KEY_ROWS) -> DataFrame:
    """Inner join in which a key with many rows on the left is dealt over several tasks.

    ``on``: the key's column on either side; ``sizes`` (a written table: k, n): how many
    rows a key has on the left, at least of keys with more than ``rows``; ``spread``:
    columns that tell the left's rows apart.  The right's rows of such keys are repeated
    once for each ``rows`` rows of the left; nothing is dropped.
    """
    hot = sizes.filter(F.col("n") > rows).select(F.col("k").alias("_k"), F.ceil(F.col("n") / rows).cast("int").alias("_salts"))
    if hot.isEmpty():
        return left.join(right, F.col(on[0]) == F.col(on[1]))
    hot = joinable(hot)
    salts = F.coalesce("_salts", F.lit(1))
    l = left.join(hot, F.col(on[0]) == F.col("_k"), "left").withColumn("_l", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_k", "_salts")
    r = right.join(hot, F.col(on[1]) == F.col("_k"), "left").withColumn("_r", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_k", "_salts")
    return l.join(r, (F.col(on[0]) == F.col(on[1])) & (F.col("_l") == F.col("_r"))).drop("_l", "_r")
