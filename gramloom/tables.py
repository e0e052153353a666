"""Reading the tables of a folder, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediate tables.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder of this machine is taken.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gramloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """The same rows from the shared folder: later stages survive the loss of an executor."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def numbered(frame: DataFrame, *keys: str | Column, name: str = "rank") -> DataFrame:
    """Adds ``rank``: 1, 2, ... in the order of the keys (distinct, or the order of equal rows is open). Ranges of keys are numbered apart; no task holds all."""
    rows = cut(frame.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    starts = rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return rows.join(F.broadcast(starts), "__part").withColumn(name, (F.col("start") + own).cast("bigint")).drop("__part", "start")


class Scratch:
    """A folder in the shared one for tables that are written and read again, compressed and without any of their plan; it is removed when its work is done.

    For loops that rewrite a state many times: plans of checkpoints keep what is known about their columns, which then grows with every round.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def stored(self, frame: DataFrame) -> DataFrame:
        """The same rows from a table of their own."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def remove(self) -> None:
        """Removes the folder; frames read from it are gone."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def once(frame: DataFrame, key: str) -> DataFrame:
    """Rows delivered twice count once: one row for each key; rows with a null key all stay.

    Delivered-twice rows agree in everything but the time of arrival, so any of them will do.
    """
    return frame.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(frame.where(F.col(key).isNull()))
