"""Listed files as project candidates and archive folders as projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .derivations import is_excluded, project_code

#: Beginnings of folder names that mark a project; the first of an archive's name.
MARKERS = ("_tor", "proposal")
ARCHIVE = "_Project "


def candidates(files: DataFrame, collections: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (path 'collection/client/.../name') of the collections {folder: kind} to projects, unmatched files and codes
    with excluded files only.

    projects: code, client (of its first path), one sorted list of paths a kind. A folder's code goes before the name's.
    Files outside the collections, directly in one, or other than PDFs don't count."""
    seg = F.split("path", "/")
    kind = F.create_map(*[F.lit(x) for pair in collections.items() for x in pair])[seg[0]]
    pdfs = files.where((F.size(seg) >= 3) & F.lower("path").endswith(".pdf")).select("path", kind.alias("kind"), seg[1].alias("client")).where("kind IS NOT NULL")
    # the collection and client are no names of a project
    below = F.concat(F.lit("///"), F.array_join(F.slice(F.split("path", "/"), F.lit(3), F.size(F.split("path", "/"))), "/"))
    known = pdfs.withColumn("code", project_code(below)).withColumn("out", is_excluded(F.col("path")))
    lists = [F.sort_array(F.collect_list(F.when(~F.col("out") & (F.col("kind") == k), F.col("path")))).alias(k) for k in dict.fromkeys(collections.values())]
    by_code = known.where("code IS NOT NULL").groupBy("code").agg(F.bool_and("out").alias("_none"), F.min_by("client", F.when(~F.col("out"), F.col("path"))).alias("client"), *lists, F.sort_array(F.collect_list(F.when(F.col("out"), F.col("path")))).alias("excluded"))
    return by_code.where("NOT _none").drop("_none", "excluded"), known.where("code IS NULL").select("path"), by_code.where("_none").select("code", "excluded")


def archive_projects(files: DataFrame) -> DataFrame:
    """files or walked entries (path '_Project .../client/folder/...') to (archive, client, project, layout, year_hint).

    A folder named as a year holds projects; another is one if a folder in it is marked; else it is 'skipped'."""
    seg = F.split("path", "/")
    year = F.expr("try_cast(regexp_extract(folder, '^([0-9]{4})$', 1) AS int)")
    inner = F.when(F.size(seg) >= 5, seg[3])
    rows = files.where(F.startswith(seg[0], F.lit(ARCHIVE)) & (F.size(seg) >= 4)).select(seg[0].alias("archive"), seg[1].alias("client"), seg[2].alias("folder"), inner.alias("inner"))
    rows = rows.withColumn("year", year).where("year IS NULL OR inner IS NOT NULL")
    marked = F.lower("inner").rlike("^(" + "|".join(MARKERS) + ")")
    project = F.when(F.col("year").isNotNull(), F.col("inner")).otherwise(F.col("folder"))
    seen = rows.groupBy("archive", "client", "year", project.alias("project")).agg(F.coalesce(F.max(marked), F.lit(False)).alias("marked"))
    hint = F.expr("try_cast(regexp_extract(archive, '([0-9]{4})', 1) AS int)")
    layout = F.when(F.col("year").isNotNull(), "year/project").when(F.col("marked"), "project").otherwise("skipped")
    return seen.select("archive", "client", "project", layout.alias("layout"), F.when(layout != "skipped", F.coalesce("year", hint)).alias("year_hint"))
