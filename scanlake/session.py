"""Session helpers: local sessions for tests, and cutting the lineage of iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A small local session for tests and the bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scanlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only when unset in local mode.

    Elsewhere a folder of one machine would lose what the others write, so an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scanlake-checkpoint-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written once in the shared checkpoint folder, without its lineage.

    A written table survives lost executors, is read back column by column with filters pushed
    down, and tells the optimizer its size.
    """
    spark = df.sparkSession
    path = scratch_table(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of an iterative job, one folder a round below one path, which are read together at the end.

    So the plan of the result doesn't grow with the rounds.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.written = spark, scratch_table(spark, name), 0

    def add(self, df: DataFrame) -> DataFrame:
        """``df``, written as the next round and read back."""
        path = f"{self.path}/round={self.written}"
        df.write.parquet(path)
        self.written, self.schema = self.written + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        """The rows of all rounds."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/round={r}" for r in range(self.written)])


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder for a table written in rounds."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per Spark application.

    Functions that run in Python workers are found by name there, whatever folder a worker starts in.
    """
    if _SHIPPED.get("application") == spark.sparkContext.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="scanlake-package-"), "scanlake.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED["application"] = spark.sparkContext.applicationId


_SHIPPED: dict[str, str] = {}
