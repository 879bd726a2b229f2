"""Joins to keep when keys are NULL or hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys match each other; the result has the left keys once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def lookup(facts: DataFrame, dimension: DataFrame, fact_key: str, dimension_key: str, spread_by: str) -> DataFrame:
    """Left join to a dimension, whose key column is dropped.

    Whether the dimension is broadcast is left to its size in bytes when the query runs. In a shuffled
    join, rows without a key, which match nothing, would all go to one task; a second join key made
    from `spread_by` sends them everywhere.
    """
    spread = F.when(F.col(fact_key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(1000))).otherwise(0)
    salted = dimension.withColumnRenamed(dimension_key, "_lookup_key").withColumn("_lookup_spread", F.lit(0).cast("long"))
    matches = (F.col(fact_key) == F.col("_lookup_key")) & (spread == F.col("_lookup_spread"))
    return facts.join(salted, matches, "left").drop("_lookup_key", "_lookup_spread")


def salted_join(facts: DataFrame, dimension: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Inner join of a fact table with a smaller one.

    Rows of the smaller side are repeated once per salt, and every fact row joins one of the copies, so
    a hot key is shared by that many tasks.
    """
    copies = dimension.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [key, "_salt"]).drop("_salt")
