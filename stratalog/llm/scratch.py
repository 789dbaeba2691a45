"""Intermediate tables in the folder that all executors share, and Python over Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that may be broadcast: a million longs are about 8 MB, 16 to 40 MB as a hash table.
BROADCAST_IDS = 1_000_000
#: Session settings that bound what a Python worker and its executor hold at once, made only where they are unset.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


class Scratch:
    """Tables written once and reread, which cuts the lineage and outlives lost executors.

    `save` returns the reread table, `drop` removes one that no later step reads; what
    is left goes with `close`, or when the process ends.
    """

    #: Those that have not been closed.
    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        Scratch.opened.append(self)
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        if self not in Scratch.opened:
            return
        Scratch.opened.remove(self)
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session ended first: nothing to delete through
            pass


def in_arrow(df: DataFrame, run: Callable, schema, kind: str = "mapInArrow") -> DataFrame:
    """`df` through `run`, a function of an iterator of batches, in Python workers that hand freed memory back when a partition ends."""
    given = df.sparkSession.conf.getAll
    for k, v in BATCHES.items():
        if k not in given:
            df.sparkSession.conf.set(k, v)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return getattr(df, kind)(tidy, schema)


def col(name: str) -> Column:
    """A top-level column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def sized(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """`df` marked for broadcast if it was counted to have at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def rows_in(left: DataFrame, ids: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """`left` semi or anti joined with the ids of one column or several; broadcast only under a counted bound."""
    keys = [key] if isinstance(key, str) else key
    return left.join(sized(ids.select(*keys).distinct()), keys, how)
