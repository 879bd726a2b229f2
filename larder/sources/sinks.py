"""Writing marts, reports and worked examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, cluster_by: list[str] | None = None, spread_by: str | None = None) -> DataFrame:
    """Replace a Parquet table and return it as read back.

    Files hold ranges of `cluster_by`, and rows are sorted by it inside each: a filter on those columns
    opens few files and skips most of them. `spread_by` divides a frequent value among several files.
    """
    laid_out = df
    if cluster_by:
        spread = [F.xxhash64(spread_by)] if spread_by else []
        laid_out = df.repartitionByRange(*cluster_by, *spread).sortWithinPartitions(*cluster_by)
    laid_out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; NULL is an empty field."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_serving_copy(tables: dict[str, DataFrame], folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The few tables a serving process needs, each as its own Parquet table."""
    return {name: write_table(tables[name], f"{folder}/{name}") for name in names}


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """Attach column comments as field metadata; Parquet and catalog tables keep them."""
    return df.select(
        *[F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(c) for c in df.columns]
    )


def synthetic_rows(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Rows for timing exports: id, name, two random numbers, a text that is NULL in 30 % of rows."""
    number = F.col("id") + 1
    return spark.range(rows).select(
        number.alias("id"),
        F.concat(F.lit("name_"), number.cast("string")).alias("name"),
        F.rand(seed).alias("random_float"),
        F.round(F.rand(seed + 1) * 1000).cast("int").alias("random_int"),
        F.when(F.rand(seed + 2) <= 0.7, F.concat(F.lit("value_"), number.cast("string"))).alias("nullable_field"),
    )
