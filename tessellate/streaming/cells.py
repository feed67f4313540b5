"""A log of read cells that runs append to and resume from.

A batch of a stream is one folder of JSON lines, named by the batch: the batch that a stopped run left half
written, or wrote but did not commit, is written again under its own name, so no entry is lost or doubled. A cell
that another batch holds is not read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("doc", "page", "row", "col")
SCHEMA = "doc string, page int, row int, col int, text string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, row, col, text, batch): the last entry of each cell. Torn lines and entries without a place are passed over; a null text is an entry."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], f"{SCHEMA}, batch long")
    lines = spark.read.option("basePath", path).schema("value string, batch long").text(path)
    rows = lines.select("batch", F.from_json("value", SCHEMA).alias("r")).select("r.*", "batch").dropna(subset=[*KEYS])
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct("text", "batch"), "batch").alias("e")).select(*KEYS, "e.text", "e.batch")


def wanted(cells: DataFrame, path: str) -> DataFrame:
    """The cells that the log doesn't hold yet."""
    return cells.join(read_log(cells.sparkSession, path).select(*KEYS), list(KEYS), "left_anti")


def appender(path: str, read: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: reads a batch's cells that no other batch holds (read adds `text`) and logs them under the batch's number."""

    def append(cells: DataFrame, batch: int) -> None:
        logged = read_log(cells.sparkSession, path).where(F.col("batch") != batch)
        fresh = cells.dropDuplicates(list(KEYS)).join(logged.select(*KEYS), list(KEYS), "left_anti")
        # null texts are written too: a figure is an entry, and isn't read again
        read(fresh).select(*KEYS, "text").write.mode("overwrite").option("ignoreNullFields", False).json(f"{path.rstrip('/')}/batch={batch}")

    return append
