"""Stored marts that are refreshed, not rebuilt: only key buckets whose inputs changed are computed and written anew.

A mart's folder holds its rows, partitioned by a bucket of the key that ties its inputs together, and beside them
the digests of the inputs that these rows were made of, by bucket. A refresh compares digests, computes the mart over
the inputs of unequal buckets alone, and overwrites these partitions; files of the others keep their names.

Digests are written last. A refresh that was cut off leaves the old ones, so the next one does its buckets again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.plans.marts import food_offers, food_table, price_mart
from larder.plans.nutrition import Nutrient
from larder.plans.vocabulary import NUTRIENT_IDS, PRICE_COLUMNS

BUCKETS = 64
BUCKET = "key_bucket"
WHOLE = -1  # the bucket of inputs that every row depends on


def bucket_of(key: str | Column, buckets: int) -> Column:
    """The bucket of a key; NULL has one like any other value."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(column.cast("string")), F.lit(buckets)).cast("int")


def digests(df: DataFrame, name: str, key: str | None, buckets: int) -> DataFrame:
    """(input, bucket, rows, digest) of a table: a sum over row hashes, so that no order of rows changes it.

    Without a key the whole table is one bucket. Each task adds up its own rows before any moves.
    """
    bucket = bucket_of(key, buckets) if key else F.lit(WHOLE)
    row = F.xxhash64(*[F.to_json(c) if _has_map(df, c) else F.col(f"`{c}`") for c in sorted(df.columns)])
    hashed = df.select(bucket.alias("bucket"), row.alias("row"))
    # Sums of 16 bits each, the highest with the sign: longs that no table overflows, where decimals would cost an object a row.
    sixteen = {k: F.shiftright("row", k) if k == 48 else F.shiftright("row", k).bitwiseAND(F.lit(0xFFFF)) for k in range(0, 64, 16)}
    summed = hashed.groupBy("bucket").agg(F.count("*").alias("rows"), *[F.sum(part).alias(f"_{k}") for k, part in sixteen.items()])
    digest = sum(F.col(f"_{k}").cast("decimal(20,0)") * F.lit(1 << k).cast("decimal(15,0)") for k in sixteen)
    return summed.select(F.lit(name).alias("input"), "bucket", "rows", digest.cast("decimal(38,0)").alias("digest"))


def _has_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()  # maps have no hash


def changed(before: DataFrame, after: DataFrame) -> list[int]:
    """Buckets in which an input differs, WHOLE among them; no more than there are buckets."""
    old = before.select("input", "bucket", F.struct("rows", "digest").alias("old"))
    new = after.select("input", "bucket", F.struct("rows", "digest").alias("new"))
    unequal = old.join(new, ["input", "bucket"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return sorted(r.bucket for r in unequal.select("bucket").distinct().collect())


@dataclass(frozen=True)
class Input:
    """What a stored table is made of: rows of a key make rows of the same key, those without one may touch any row."""

    rows: DataFrame
    key: str | None = None


@dataclass(frozen=True)
class Refresh:
    """The stored table as read back, and the buckets that were written anew."""

    table: DataFrame
    buckets: list[int]


class Store:
    """A folder with a table in key buckets, and the digests of what it was made of."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.rows, self.digests, self.following = f"{self.folder}/rows", f"{self.folder}/digests", f"{self.folder}/digests_next"

    def _at(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _has(self, path: str) -> bool:
        system, found = self._at(path)
        return system.exists(found)

    def _drop(self, path: str) -> None:
        system, found = self._at(path)
        system.delete(found, True)

    def read(self, schema) -> DataFrame:
        """The stored rows; schema is theirs, without the bucket."""
        stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(stored).parquet(self.rows).drop(BUCKET)

    def stale(self, inputs: dict[str, Input]) -> list[int]:
        """Buckets to be made anew. The digests of the inputs as they are now are written beside the old ones."""
        now = reduce(DataFrame.unionByName, [digests(i.rows, name, i.key, self.buckets) for name, i in inputs.items()])
        now.coalesce(1).write.mode("overwrite").parquet(self.following)
        everything = list(range(self.buckets))
        if not (self._has(self.digests) and self._has(self.rows)):
            return everything
        found = changed(self.spark.read.parquet(self.digests), self.spark.read.schema(now.schema).parquet(self.following))
        return everything if WHOLE in found else found

    def overwrite(self, rows: DataFrame, buckets: list[int]) -> None:
        """Replace the rows of these buckets by rows, which has a column BUCKET. One that is empty now loses its folder.

        A bucket is one file, and several where a hot key makes it much larger than others.
        """
        seen = Observation()
        dealt = rows.hint("rebalance", BUCKET).observe(seen, F.collect_set(BUCKET).alias("buckets"))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.rows)
        for bucket in set(buckets) - set(seen.get["buckets"] or []):
            self._drop(f"{self.rows}/{BUCKET}={bucket}")

    def commit(self) -> None:
        """The rows are those of the inputs of this round: their digests become the store's."""
        self._drop(self.digests)
        system, following = self._at(self.following)
        system.rename(following, self._at(self.digests)[1])


def refresh(store: Store, inputs: dict[str, Input], make: Callable[..., DataFrame], key: str) -> Refresh:
    """Bring a store up to date with its inputs.

    make gets the inputs by name, those with a key cut to the buckets that changed, and returns rows with `key`.
    Its rows of other buckets, which inputs without a key may give, are left out.
    """
    buckets = store.stale(inputs)
    every = len(buckets) == store.buckets

    def cut(rows: DataFrame, column: str) -> DataFrame:
        return rows if every else rows.where(bucket_of(column, store.buckets).isin(buckets))

    made = make(**{name: cut(i.rows, i.key) if i.key else i.rows for name, i in inputs.items()})
    if buckets:
        store.overwrite(cut(made, key).withColumn(BUCKET, bucket_of(key, store.buckets)), buckets)
        store.commit()
    return Refresh(store.read(made.schema), buckets)


def mirror(store: Store, table: DataFrame, key: str) -> Refresh:
    """A copy of a table, such as a serving copy: only buckets that changed since the last one are written."""
    return refresh(store, {"table": Input(table, key)}, lambda table: table, key)


def refresh_price_mart(
    store: Store,
    prices: DataFrame,
    products: DataFrame,
    nutrients: list[Nutrient],
    nutrient_ids: list[str] = NUTRIENT_IDS,
    price_columns: dict[str, str] = PRICE_COLUMNS,
    **others: DataFrame,
) -> Refresh:
    """The stored price mart, in buckets of the product code. others: the further tables of price_mart by name."""
    inputs = {"prices": Input(prices, "product_code"), "products": Input(products, "code")} | {n: Input(df) for n, df in others.items()}

    def make(**tables: DataFrame) -> DataFrame:
        return price_mart(**tables, nutrients=nutrients, nutrient_ids=nutrient_ids, price_columns=price_columns)

    return refresh(store, inputs, make, "code")


def refresh_food_mart(
    offers: Store,
    foods: Store,
    prices: DataFrame,
    products: DataFrame,
    rates: DataFrame,
    nutrients: list[Nutrient],
    nutrient_ids: list[str] = NUTRIENT_IDS,
    **others: DataFrame,
) -> Refresh:
    """The stored food mart, in buckets of the food code, from stored offers in buckets of the product code.

    A changed price touches its product's offers, and through them one food. others: the further tables of food_table.
    """
    sold = {"prices": Input(prices, "product_code"), "products": Input(products, "code"), "rates": Input(rates)}
    kept = refresh(offers, sold, food_offers, "code").table
    inputs = {"offers": Input(kept, "food_code")} | {n: Input(df) for n, df in others.items()}

    def make(**tables: DataFrame) -> DataFrame:
        return food_table(**tables, nutrients=nutrients, nutrient_ids=nutrient_ids)

    return refresh(foods, inputs, make, "ciqual_food_code")
