"""Facets that each leave out their own filter, in one pass over the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import contains_ci, table


def facet_counts(rows: DataFrame, filters: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """facet, value, n: for each value of a facet how many rows hold it once every filter but the facet's own is applied.

    filters: name -> condition (null counts as failed); values: name -> the facet's value, or array of values, of a row.
    A row's failed filters are a bit mask, computed once; it counts for facet k if no bit but k's own is set. Values
    that no row holds under the filters stay with n = 0; null values are a value of their own, texts otherwise; a
    row's repeated values count once, a null list has none; `all` (value null) counts the rows that pass every filter. A facet without a
    filter of its name obeys all filters."""
    bits = {name: 1 << i for i, name in enumerate(filters)}
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(cond, 0).otherwise(bits[name]) for name, cond in filters.items()], F.lit(0))

    def held(name: str) -> Column:
        one = values[name]
        many = F.array_distinct(F.coalesce(one, F.array())) if name in lists else F.array(one)
        return F.transform(many, lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value"), F.lit(bits.get(name, 0)).alias("own")))

    types = rows.select(*[v.alias(n) for n, v in values.items()]).schema
    lists = {f.name for f in types if f.dataType.typeName() == "array"}
    every = F.array(F.struct(F.lit("all").alias("facet"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("own")))
    marked = rows.select(mask.alias("mask"), F.inline(F.concat(every, *[held(n) for n in values])))
    # the mask is combined with the value before the shuffle: a group a facet's value, however many rows
    return marked.groupBy("facet", "value").agg(F.count_if(F.col("mask").bitwiseAND(F.bitwise_not("own")) == 0).alias("n"))


def a25_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands, types, sizes, price levels and words of parts, each counted under all filters but its own."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    filters = {
        "text": reduce(or_, [contains_ci(F.col(c), "ring") for c in ("p_name", "p_brand", "p_type")]),
        "size": F.col("p_size").between(10, 40),
        "price": F.col("p_retailprice") >= 950,
        "brand": F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#11", "Brand#12", "Brand#20"),
        "type": F.when(F.col("p_partkey") % 9 != 0, F.col("p_type").isin("ECONOMY", "PROMO", "LARGE")),
    }
    values = {"size": F.floor(F.col("p_size") / 10), "price": F.floor(F.col("p_retailprice") / 100), "brand": F.col("p_brand"), "type": F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")), "word": words}
    return facet_counts(p, filters, values)


def _oracle() -> str:
    filters = {
        "text": "contains(lower(p_name || '|' || p_brand || '|' || p_type), 'ring')",
        "size": "p_size BETWEEN 10 AND 40",
        "price": "p_retailprice >= 950",
        "brand": "p_brand IN ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#12', 'Brand#20')",
        "type": "p_partkey % 9 <> 0 AND p_type IN ('ECONOMY', 'PROMO', 'LARGE')",
    }
    values = {"size": "floor(p_size / 10)::BIGINT::VARCHAR", "price": "floor(p_retailprice / 100)::BIGINT::VARCHAR", "brand": "p_brand", "type": "CASE WHEN p_partkey % 9 <> 0 THEN p_type END", "word": "unnest(list_distinct(string_split(p_name, ' ')))", "all": "NULL"}
    parts = []
    for facet, value in values.items():
        others = " AND ".join(f"({c})" for n, c in filters.items() if n != facet)
        parts.append(f"SELECT '{facet}' AS facet, v AS value, count(*) FILTER (ok) AS n FROM (SELECT {value} AS v, {others} AS ok FROM part) GROUP BY v")
    return " UNION ALL ".join(parts)


QUERIES = {"a25_facets": a25_facets}
SQL = {"a25_facets": _oracle()}
