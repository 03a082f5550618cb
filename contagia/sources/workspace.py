"""Durable intermediate results.

Results that are reused many times, or that grow from step to step of a loop,
are written to the shared checkpoint folder and read back. That cuts lineage,
survives the loss of any executor, and gives the planner the true size of the
table, so that it broadcasts the table only when it is really small.

A shuffle is of no use once the table it led to is written. Spark keeps its
files until the driver collects garbage, which a long run of writes seldom
makes it do, so a step that writes or collects deletes them as it ends.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where the setting is missing, a temporary folder is used for a local
    master only; on a cluster a machine-local folder would be wrong.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="contagia-")
    return _LOCAL_ROOT[app]


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes, and frames declared and collected, in here delete their shuffle files when they end.

    A lost file of a stage that is needed again is computed again, as after the loss of an executor.
    """
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)


class Workspace:
    """A fresh folder below the checkpoint root for one run."""

    def __init__(self, spark: SparkSession, label: str = "run") -> None:
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def child(self, name: str) -> str:
        return f"{self.path}/{name}"

    def sub(self, name: str) -> Workspace:
        """A folder below this one, for one step of a loop."""
        below = Workspace.__new__(Workspace)
        below.spark, below.path = self.spark, self.child(name)
        return below

    def fresh(self, name: str) -> Workspace:
        """A folder of its own below this one, so one workspace serves any number of builds."""
        return self.sub(f"{name}-{uuid.uuid4().hex[:12]}")

    def durable(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` once and return a frame that reads the written copy."""
        target = self.child(name)
        with freed_shuffles(self.spark):
            df.write.mode("error").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def clear(self) -> None:
        """Delete the folder with all steps in it; only for runs whose result was written elsewhere."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
