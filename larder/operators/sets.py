"""Key sets: unions, differences, equality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_codes(name: str, *columns: tuple[DataFrame, str]) -> DataFrame:
    """Distinct values of several columns under one name, in one shuffle that sends each value once per partition."""
    parts = [df.select(F.col(c).alias(name)) for df, c in columns]
    return reduce(DataFrame.union, parts).distinct()


def _sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each key once, and whether each side has it: one union, one shuffle, repeats collapse before it."""
    marked = [df.select(key, F.lit(k == 0).alias("_left"), F.lit(k == 1).alias("_right")) for k, df in enumerate((left, right))]
    return marked[0].union(marked[1]).groupBy(key).agg(F.bool_or("_left").alias("_left"), F.bool_or("_right").alias("_right"))


def key_differences(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Distinct keys found on one side only, with the side that has them. A NULL key is on the sides that have one."""
    alone = _sides(left, right, key).where("NOT (_left AND _right)")
    return alone.select(key, F.when(F.col("_left"), names[0]).otherwise(names[1]).alias("only_in"))


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys each side has alone, and whether there are none."""
    counts = _sides(left, right, key).agg(
        F.count_if(~F.col("_right")).alias("left_only"), F.count_if(~F.col("_left")).alias("right_only")
    )
    return counts.withColumn("same", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def only_in_first(first: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first table whose key none of the others has."""
    return reduce(lambda df, other: df.join(other.select(key).distinct(), key, "left_anti"), others, first)
