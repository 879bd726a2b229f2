"""Grouped statistics that stay whole when one group holds most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.numeric import two_decimals
from larder.operators.joins import null_safe_join
from larder.runtime import Scratch

# percentile_approx guarantees a rank error of at most rows / ACCURACY. The bracket leaves
# three times that on either side of the middle, so it always contains the median, and of a
# key with a billion different values about 800,000 are ordered by one task.
ACCURACY = 10_000
BRACKET = (0.5 - 3 / ACCURACY, 0.5 + 3 / ACCURACY)


def value_counts(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows per key, most frequent first; NULL counts as a key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"))


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median", count: str = "count") -> DataFrame:
    """Interpolated median and number of values per key, for groups of any size.

    A sketch first brackets the median. Values outside the bracket are then counted
    as two lumps before the shuffle; only distinct values near the middle are
    ordered, never a whole group in one task.
    """
    scratch = Scratch(df.sparkSession)
    # Written once: the bracket and the histogram both read these few columns, not what they were joined from.
    rows = scratch.table(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value")))
    bracket = rows.groupBy(*keys).agg(
        F.percentile_approx("_value", list(BRACKET), ACCURACY).alias("_bracket"),
        F.count(F.lit(1)).alias(count),
    )
    lumped = (
        F.when(F.col("_value") < F.col("_bracket")[0], float("-inf"))
        .when(F.col("_value") > F.col("_bracket")[1], float("inf"))
        .otherwise(F.col("_value"))
    )
    histogram = (
        null_safe_join(rows, bracket, keys, "inner")
        .groupBy(*keys, count, lumped.alias("_value"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    upto = F.sum("_rows").over(
        Window.partitionBy(*keys).orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = histogram.withColumn("_upto", upto)
    low, high = F.floor((F.col(count) + 1) / 2), F.floor(F.col(count) / 2) + 1
    middles = ranked.groupBy(*keys, count).agg(
        F.min(F.when(F.col("_upto") >= low, F.col("_value"))).alias("_low"),
        F.min(F.when(F.col("_upto") >= high, F.col("_value"))).alias("_high"),
    )
    result = scratch.table(middles.select(*keys, (F.col("_low") / 2 + F.col("_high") / 2).alias(name), count))
    scratch.close(result)
    return result


def pivot_long(df: DataFrame, keys: list[str], label: str, labels: list[str], values: dict[str, str]) -> DataFrame:
    """Long to wide: `<label>_<name>` for each label and each name -> column of `values`.

    Where a (key, label) pair repeats, the row with the smallest values wins, all its
    values together. Only the listed labels become columns; keys without any stay, as NULLs.
    """
    cell = F.min(F.struct(*[F.col(column).alias(name) for name, column in values.items()]))
    wide = df.groupBy(*keys).pivot(label, labels).agg(cell)
    return wide.select(*keys, *[F.col(f"`{x}`.{name}").alias(f"{x}_{name}") for x in labels for name in values])


def strip_suffix(df: DataFrame, suffix: str = "_value") -> DataFrame:
    return df.withColumnsRenamed({c: c.removesuffix(suffix) for c in df.columns if c.endswith(suffix)})


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Minimum, maximum and mean of each numeric column, one row per column, in a single pass."""
    numeric = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    totals = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.avg(c).alias("mean"),
            ).alias(f"_{i}")
            for i, c in enumerate(numeric)
        ]
    )
    return totals.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(numeric))])))


def column_catalog(mart: DataFrame, leave_out: str) -> DataFrame:
    """Comment, range and mean of the floating-point columns whose name does not match `leave_out`."""
    floats = [f for f in mart.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))]
    described = mart.sparkSession.createDataFrame(
        [(f.name, f.metadata.get("comment")) for f in floats], "column_name string, comment string"
    )
    profile = column_profile(mart, [f.name for f in floats])
    return (
        described.join(profile, "column_name")
        .where(~F.col("column_name").rlike(f"^(?:{leave_out})$"))
        .select("column_name", "comment", "min", "max", two_decimals(F.col("mean")).alias("mean"))
    )


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and cells of each table."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(len(df.columns)).alias("n_cols"),
            (F.col("n_rows") * len(df.columns)).alias("n_cells"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.union, counted)


def venn_regions(key_sets: dict[str, DataFrame], key: str) -> DataFrame:
    """How many keys lie in each combination of sets; each input needs the column `key`.

    One shuffle: repeats of a key collapse before it, sets meet after it.
    """
    names = list(key_sets)
    flagged = reduce(
        DataFrame.union,
        [
            df.select(key, *[F.lit(int(n == name)).alias(n) for n in names])
            for name, df in key_sets.items()
        ],
    )
    membership = flagged.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(n).alias(n) for n in names])
    return membership.groupBy(*names).agg(F.count(F.lit(1)).alias("keys"))


def venn_bitmaps(id_sets: dict[str, DataFrame], key: str) -> DataFrame:
    """venn_regions for keys that are whole numbers from 0 up: membership as bitmaps, one per set and bucket of keys.

    A task folds its keys into bitmaps of 32,768 bits before anything moves, so keys never meet one by one: a bucket's
    bitmaps do, and a region is an AND of them (or of their complements) and a count of bits.
    """
    names = list(id_sets)

    def folded(name: str) -> DataFrame:
        known = id_sets[name].where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"))
        bits = F.bitmap_construct_agg(F.bitmap_bit_position("_key"))
        return known.groupBy(F.bitmap_bucket_number("_key").alias("_bucket")).agg(bits.alias("_bits")).withColumn("_set", F.lit(name))

    buckets = reduce(DataFrame.union, [folded(n) for n in names]).groupBy("_bucket").pivot("_set", names).agg(F.first("_bits"))
    regions = _Regions(names)
    counted = buckets.mapInArrow(regions, "region int, keys long").groupBy("region").agg(F.sum("keys").alias("keys"))
    member = [F.shiftright("region", i).bitwiseAND(F.lit(1)).alias(n) for i, n in enumerate(names)]
    return counted.where("keys > 0").select(*member, "keys")


class _Regions:
    """Of each bucket's bitmaps, the number of keys in every combination of sets, the empty one left out."""

    def __init__(self, names: list[str]):
        self.names = names

    def __call__(self, batches):
        import numpy as np
        import pyarrow as pa

        size = 1 << len(self.names)
        total = np.zeros(size, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                # Each key's region number, a bit per set; then how often each number occurs.
                number = 0
                for i, name in enumerate(self.names):
                    blob = batch.column(name)[row].as_py()
                    if blob is not None:
                        number = number + (np.unpackbits(np.frombuffer(blob, np.uint8)).astype(np.int64) << i)
                total += np.bincount(number, minlength=size)
        found = np.flatnonzero(total[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["region", "keys"])


def grouped_structs(df: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Sorted list of structs per key; a list is as long as its group (attribute lists, nutrient groups)."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
