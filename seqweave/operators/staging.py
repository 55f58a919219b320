"""Stage outputs: tables in the folder that driver and executors share. They cut the lineage, so that plans stay small
where a relation is used several times, and a lost executor costs no more than its own tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder of our own in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='seqweave-')}")
        known = sc._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def new_folder(spark: SparkSession, name: str = "stage") -> str:
    """The path of a new folder below the shared one."""
    _MADE.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def staged(df: DataFrame) -> DataFrame:
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Fewer rows than these are one task's work wherever they lie.
FEW_ROWS = 20_000


def spread(rows: DataFrame, *keys: str, few: int = FEW_ROWS) -> DataFrame:
    """rows dealt out anew by the keys where few tasks would read most of them.

    A split of a file gives rows only where a row group begins, so a large file of few groups is a few tasks' work however
    many splits it has. The rows a partition are counted first, which reads no column.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    sizes = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    if not sizes["n"] or sizes["n"] <= few or sizes["most"] * cores <= 2 * sizes["n"]:
        return rows
    return rows.repartition(4 * cores, *keys)


def measured(rows: DataFrame, most: int) -> DataFrame:
    """rows for one side of a join: sent to all tasks if they are `most` at most, else merged. They are counted, as the
    planner would judge them by the length of a compressed file."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("merge")


def clear(spark: SparkSession) -> None:
    """Deletes the stage outputs that this process has made. For when results are written: frames that were made from
    them can't be read after it."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
