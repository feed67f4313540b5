"""Trees of files as rows: paths, sizes and times, without their contents."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.places import shared_checkpoints

#: What stands before a path: a scheme and a host.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of every file below root whose name fits the pattern; path is relative to root.

    The content column isn't selected, so no file is opened. Spark passes over names that begin with _ or a dot, and
    folders without files are not seen: walk() sees both. An empty tree gives no rows."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    top = re.sub(SCHEME, "", root).rstrip("/") + "/"
    path = F.regexp_replace("path", SCHEME, "")
    return listed.select(F.substring(path, F.lit(len(top) + 1), F.length(path)).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified, unreadable) of all files and folders below root, a share that every executor has mounted.

    A folder's path ends with / and has no size. Tasks list the folders of one level, the next job theirs, so the
    driver holds a count a level. Links aren't followed; a folder that can't be listed is told, not skipped silently."""
    shared_checkpoints(spark)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column("path").to_pylist():
                rows = []
                try:
                    with os.scandir(os.path.join(root, folder)) as entries:
                        for e in entries:
                            at, below = e.stat(follow_symlinks=False), e.is_dir(follow_symlinks=False)
                            rows.append((folder + e.name + "/" * below, None if below else at.st_size, datetime.fromtimestamp(at.st_mtime, UTC), False))
                except OSError:
                    rows.append((folder, None, None, True))
                kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], ["path", "size", "modified", "unreadable"])

    folders, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = folders.repartition("path").mapInArrow(listed, "path string, size long, modified timestamp, unreadable boolean").checkpoint()
        levels.append(found)
        folders = found.where("path LIKE '%/' AND NOT unreadable").select("path")
        if folders.isEmpty():
            break
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out
