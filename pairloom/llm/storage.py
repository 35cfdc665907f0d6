"""Reading the input tables and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set on the context. Without one, a temporary folder in
    local mode only, where one machine runs all (tests); on a cluster that is an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        found = context._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-"))
            found = context._jsc.sc().getCheckpointDir()
        base = found.get()
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_folders: list[tuple[SparkSession, str]] = []


def _clear() -> None:
    """At the driver's end its scratch folders go, if the session still runs: results that are read lazily
    need them until then."""
    for spark, base in _folders:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended first
                remove(spark, base)


atexit.register(_clear)


class Scratch:
    """Written tables of one run under the shared folder, which are removed at the driver's end.

    ``keep`` writes a table and reads it back, so that what follows neither recomputes it nor
    depends on shuffle files of an executor that may be lost. ``drop`` removes a table that no
    later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _folders.append((spark, self.base))
        self.count = 0
        self.kept: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> str:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.write(df, name)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def forget(self, *frames: DataFrame) -> None:
        """Remove tables that ``keep`` has returned and that nothing reads from here on."""
        gone = [path for out, path in self.kept if any(out is x for x in frames)]
        self.kept = [x for x in self.kept if x[1] not in gone]
        self.drop(*gone)

    def settle(self) -> None:
        """Let go of shuffle files that no later step reads: their plans are garbage once no event in the
        listeners' queues holds them, and Python's references have reached the JVM by a second round."""
        for _ in range(2):
            gc.collect()
            with contextlib.suppress(Py4JError):  # a slow queue is not waited for
                self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(2000)
            self.spark.sparkContext._jvm.System.gc()

    def drop(self, *paths: str) -> None:
        for path in paths:
            remove(self.spark, path)
