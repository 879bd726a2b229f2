"""Running values over ordered rows.

A window with PARTITION BY gives each key to one task. Here rows are first cut into
slices by range partitioning on (key, order), so that a key with a third of all rows
spreads over a third of the tasks; slice totals, one row per slice and key, are then
carried forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.joins import null_safe_join
from larder.runtime import materialize

SLICE = "_slice"
EARLIER = (Window.unboundedPreceding, -1)
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def sliced(df: DataFrame, keys: list[str], order: list[Column], slices: int | None = None) -> DataFrame:
    """df with a slice number: equal or rising along the order within each key.

    `order` has to tell all rows of a key apart; rows that tie on it share a slice.
    The numbering depends on sampled bounds, so it is written out once.
    """
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *[F.col(k).asc() for k in keys], *order)
    return materialize(ranged.withColumn(SLICE, F.spark_partition_id()))


def running_segments(
    df: DataFrame, keys: list[str], order: list[Column], level: str, slices: int | None = None
) -> DataFrame:
    """Add start_value and end_value: the running total of `level` before and after each row."""
    cut = sliced(df, keys, order, slices)
    totals = cut.groupBy(*keys, SLICE).agg(F.sum(level).alias("_total"))
    before = totals.withColumn(
        "_before", F.sum("_total").over(Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(*EARLIER))
    ).drop("_total")
    local = F.sum(level).over(Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(*UP_TO_HERE))
    end = F.coalesce("_before", F.lit(0)) + F.coalesce("_local", F.lit(0))
    return (
        null_safe_join(cut, before, [*keys, SLICE], "inner")
        .withColumn("_local", local)
        .withColumn("end_value", end)
        .withColumn("start_value", F.col("end_value") - F.coalesce(level, F.lit(0)))
        .drop("_before", "_local", SLICE)
    )


def fill_down(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, slices: int | None = None
) -> DataFrame:
    """Add `name`: the latest non-NULL `value` at or before each row (section headers onto detail rows)."""
    cut = sliced(df, keys, [F.col(c) for c in order], slices)
    latest = F.last(value, ignorenulls=True)
    local = latest.over(Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(*UP_TO_HERE))
    filled = cut.withColumn(name, local)
    ends = (
        cut.where(F.col(value).isNotNull())
        .groupBy(*keys, SLICE)
        .agg(F.max_by(value, F.struct(*order)).alias("_end"))
    )
    every = null_safe_join(cut.select(*keys, SLICE).distinct(), ends, [*keys, SLICE], "left")
    carried = every.withColumn(
        "_carried",
        F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(*EARLIER)),
    ).drop("_end")
    return (
        null_safe_join(filled, carried, [*keys, SLICE], "inner")
        .withColumn(name, F.coalesce(name, "_carried"))
        .drop("_carried", SLICE)
    )


def numbered(df: DataFrame, order: list[Column], name: str = "row_num", slices: int | None = None) -> DataFrame:
    """Number all rows from 1 in the given order, without sorting them in one task."""
    cut = sliced(df, [], order, slices)
    sizes = cut.groupBy(SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select(
        SLICE, F.coalesce(F.sum("_rows").over(Window.orderBy(SLICE).rowsBetween(*EARLIER)), F.lit(0)).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy(SLICE).orderBy(*order))
    return cut.join(before, SLICE).withColumn(name, F.col("_before") + local).drop("_before", SLICE)


def in_file_order(df: DataFrame, name: str = "row_num") -> DataFrame:
    """Number rows from 1 as they lie in their files, files in order of their paths, however many splits they are read in.

    df comes straight from files: it still has their hidden column _metadata. Inside a split rows follow each other, so
    a split's first row number, a sum over the splits before it, is all that its rows need. Nothing is sorted but splits.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    # Running ids depend on how a scan packs its splits; written once, they are the same for both readers.
    placed = materialize(df.select("*", *split, F.monotonically_increasing_id().alias("_at")))
    splits = placed.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(Window.orderBy("_file", "_start").rowsBetween(*EARLIER))
    offsets = splits.select("_file", "_start", (F.coalesce(before, F.lit(0)) + 1 - F.col("_first")).alias("_offset"))
    numbered_rows = placed.join(offsets, ["_file", "_start"])
    return numbered_rows.withColumn(name, F.col("_at") + F.col("_offset")).drop("_file", "_start", "_at", "_offset")


def best_per_group(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group in ascending order; every task keeps one row per group before the shuffle."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", first).where("_rank = 1").drop("_rank")
