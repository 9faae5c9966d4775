"""Tables in the shared folder that plans compute once."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written in the scope that is open, and in those around it.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open scopes", default=())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The application's folder within the shared one that the cluster names in spark.checkpoint.dir. Only
    where it names none, and driver and executors are one process, a folder of our own is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="mnemora-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Spark knows them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, found = _hadoop(spark, path)
    system.deleteOnExit(found)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no plan needs any more."""
    for path in paths:
        system, found = _hadoop(spark, path)
        system.delete(found, True)


class Scope:
    def keep(self, df: DataFrame) -> DataFrame:
        """The rows as a table that outlives the scope; it belongs to the scope around it, if any."""
        inner = _OPEN.get()
        token = _OPEN.set(inner[:-1])
        try:
            return written(df)
        finally:
            _OPEN.reset(token)


@contextmanager
def scope(spark: SparkSession):
    """Tables that are written inside go when the block ends; what is still needed goes through keep()."""
    paths: list[str] = []
    token = _OPEN.set((*_OPEN.get(), paths))
    try:
        yield Scope()
    finally:
        _OPEN.reset(token)
        remove(spark, *paths)


def written_to(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, read again, and its path. They are computed once, and outlive
    the executors that computed them. Plans over the table assume no partitioning, so that a join exchanges
    both its sides and adaptive execution can split the hot partitions of either."""
    path = scratch_path(df.sparkSession)
    if scopes := _OPEN.get():
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """written_to without the path: the table stays until its scope or the application ends."""
    return written_to(df)[0]
