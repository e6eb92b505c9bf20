"""Experiment tables: rows are maps of names to strings, values are numbers where they read as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(line: Column) -> Column:
    """key=value pairs between tabs as a map; only a pair's first = divides it, of equal keys the last counts."""
    pair = lambda p: F.split(p, "=", 2)
    entries = F.filter(F.split(line, "\t"), lambda p: p.contains("="))
    keys = F.transform(entries, lambda p: pair(p)[0])
    fresh = F.filter(entries, lambda p, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), pair(p)[0]) == 0)
    return F.map_from_entries(F.transform(fresh, lambda p: F.struct(pair(p)[0], pair(p)[1])))


def unparse(m: Column) -> Column:
    """The map as key=value pairs between tabs, keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\t")


def matching(m: Column, key: str) -> Column:
    """The name in m that ends with key: the exact one, else the first in order; null if none."""
    found = F.array_sort(F.filter(F.map_keys(m), lambda k: k.endswith(key)))
    return F.when(F.array_contains(F.map_keys(m), key), F.lit(key)).otherwise(F.get(found, 0))


def _holds(key: str, value: str):
    return lambda e: e["key"].endswith(key) & (e["value"] == value)


def filter_rows(df: DataFrame, m: str, wanted: dict[str, str]) -> DataFrame:
    """Rows that for every wanted (key, value) have a name that ends with key and holds just that value."""
    for k, v in wanted.items():
        df = df.where(F.exists(F.map_entries(m), _holds(k, v)))
    return df


def extract(df: DataFrame, m: str, keys: list[str]) -> DataFrame:
    """The named columns by matching(); rows that lack one go."""
    out = df
    for k in keys:
        out = out.withColumn(k, F.try_element_at(F.col(m), matching(F.col(m), k)))
    return out.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys)


def aggregate(df: DataFrame, m: str, keys: list[str]) -> DataFrame:
    """(keys, name, mean, most, least, first): rows grouped by the keys' values, every other name that is a number aggregated; for strings the first in order."""
    rows = df.select(*(F.try_element_at(F.col(m), F.lit(k)).alias(k) for k in keys), F.explode(F.map_entries(m)).alias("e"))
    rows = rows.select(*keys, F.col("e.key").alias("name"), F.col("e.value").alias("value")).where(~F.col("name").isin(keys))
    number = F.expr("try_cast(value AS DOUBLE)")
    return rows.groupBy(*keys, "name").agg(F.avg(number).alias("mean"), F.max(number).alias("most"), F.min(number).alias("least"), F.min(F.when(number.isNull(), F.col("value"))).alias("first"))


def sort_key(m: Column, key: str) -> tuple[Column, Column]:
    """Numbers before strings, each in its order."""
    value = F.try_element_at(m, F.lit(key))
    return value.try_cast("double").asc_nulls_last(), value.asc_nulls_last()
