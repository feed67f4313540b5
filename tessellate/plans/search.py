"""Faceted search over the catalog tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contains_ci(col: Column, needle: str) -> Column:
    """Literal case-insensitive substring: % and _ are ordinary characters."""
    return F.contains(F.lower(col), F.lit(needle.lower()))


def conjunction(preds: list[Column]) -> Column:
    return reduce(and_, preds, F.lit(True))


def faceted_search(parts: DataFrame, q: str | None = None, columns: tuple[str, ...] = ("p_name", "p_brand", "p_type"), size: tuple[int | None, int | None] = (None, None), price: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    preds = []
    if q and q.strip():
        preds.append(reduce(lambda a, b: a | b, [contains_ci(F.col(c), q.strip()) for c in columns]))
    for name, (low, high) in (("p_size", size), ("p_retailprice", price)):
        if low is not None:
            preds.append(F.col(name) >= low)
        if high is not None:
            preds.append(F.col(name) <= high)
    return parts.where(conjunction(preds))


def f1_faceted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = faceted_search(table(spark, sf_dir, "part"), "RING", size=(10, 40))
    return rows.select("p_partkey", "p_name", "p_brand", "p_size").orderBy(F.desc_nulls_last("p_size"), "p_partkey")


QUERIES = {"f1_faceted_search": f1_faceted_search}
SQL = {
    "f1_faceted_search": """SELECT p_partkey, p_name, p_brand, p_size FROM part
WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')) AND p_size BETWEEN 10 AND 40"""
}
