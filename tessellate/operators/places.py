"""Places in a global order without gathering all rows in one task, and rows dealt out by a key."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id holds the task's number above this bit and the row's number below it.
TASK_BIT = 33
#: Rows of a task that by_key aims at.
ROWS_A_TASK = 300_000


def shared_checkpoints(spark: SparkSession) -> None:
    """Makes checkpoints possible: in the folder the cluster names; a local master may use its own disk."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def by_key(df: DataFrame, n_rows: int, *key: str) -> DataFrame:
    """df dealt by a key to as many tasks as its rows fill, so that a task's memory doesn't grow with the input.

    Spark's own sizes go by compressed bytes, which hold far more rows than a task's sorts and maps should."""
    return df.repartition(-(-n_rows // ROWS_A_TASK) or 1, *key)


def global_places(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with each row's 1-based place (long) in a total order: rows are numbered inside range-sorted partitions, then offset.

    One shuffle; only a count of each partition meets in one task. The numbered rows are checkpointed, since a
    second run could draw other range borders."""
    shared_checkpoints(df.sparkSession)
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = sorted_rows.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", TASK_BIT)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    row = F.col("_at").bitwiseAND((1 << TASK_BIT) - 1) + 1
    return numbered.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + row).drop("_part", "_at", "_before")
