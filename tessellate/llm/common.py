"""Helpers shared by the training-data operators: shared scratch space and Arrow plumbing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir (which all executors share).

    Only a local session, whose executors share the machine, may leave that setting out; a temporary folder is taken."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.environ.get("TESSELLATE_SCRATCH") or tempfile.mkdtemp(prefix="spark-")
        if "://" not in base:
            base = "file://" + os.path.abspath(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables in one new shared folder: writing one cuts lineage and survives lost executors.

    A table is deleted by drop() after its last reader, or when another one is written under its name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, shared_dir(spark, name), {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove(self.spark, self.paths.pop(name))

    def keep_only(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in a shared folder of its own and read it back."""
    return Scratch(df.sparkSession, name).write(df, name)


def open_output(uri: str):
    """A writable binary stream on any file system pyarrow knows (file, hdfs, s3, ...)."""
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(uri)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    return filesystem.open_output_stream(path, compression=None)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times inside body."""
    return F.transform(F.array(value), body)[0]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def smallest(rows: DataFrame, label: str, counts: dict, each: int) -> DataFrame:
    """The `each` rows (doc_id, label) of each label whose doc_id has the smallest hash.

    A draw of about four times as many comes first, so that the ranking sees a bounded number of rows."""
    dice = F.col("hash") / F.lit(2.0**64) + 0.5
    take = F.lit(False)
    for name, n in counts.items():
        take |= (F.col(label) == name) & (dice < F.lit(min(1.0, (4.0 * each + 100) / n)))
    ranked = Window.partitionBy(label).orderBy("hash", "doc_id")
    drawn = rows.select("doc_id", label, F.xxhash64("doc_id", F.lit(23)).alias("hash")).where(take)
    return drawn.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= each).select("doc_id", label)
