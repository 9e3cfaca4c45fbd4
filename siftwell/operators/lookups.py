"""Reading rows of an index's tables by key, by keys, by names, and in lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(rows: DataFrame, **key) -> DataFrame:
    """Rows with these values in all named columns (None: null). The comparison reaches the scan as a filter."""
    test = F.lit(True)
    for column, value in key.items():
        test = test & (F.col(column).isNull() if value is None else F.col(column) == value)
    return rows.filter(test)


def by_keys(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key is among those of a table."""
    return rows.join(keys.select(*on).distinct(), list(on), "left_semi").select(*rows.columns)


def exists(rows: DataFrame, **key) -> DataFrame:
    """One row, found: whether any row has the key; at most one is read."""
    return by_key(rows, **key).limit(1).agg((F.count("*") > 0).alias("found"))


def active(files: DataFrame, *columns: str) -> DataFrame:
    """Files without a tombstone."""
    return files.filter("deleted_at IS NULL").select(*(columns or files.columns))


def listed(rows: DataFrame, where: Column | None, order: list[Column], most: int) -> DataFrame:
    """The first rows that pass, in a total order."""
    return (rows if where is None else rows.filter(where)).orderBy(*order).limit(most)


def by_names(entities: DataFrame, names: list[str], most: int = 25, distinct_names: int = 20) -> DataFrame:
    """Entities with one of the first distinct names, in the order of the names, then by path and line; `most` of a name
    and in all."""
    wanted = list(dict.fromkeys(names))[:distinct_names]
    if not wanted:
        return entities.limit(0)
    named = F.create_map(*(F.lit(x) for k, n in enumerate(wanted) for x in (n, k)))
    n = F.row_number().over(Window.partitionBy("name").orderBy("path", "start_line"))
    some = entities.filter(F.col("name").isin(*wanted)).withColumn("__n", n).filter(F.col("__n") <= most)
    return some.orderBy(F.element_at(named, F.col("name")), "__n").limit(most).drop("__n")
