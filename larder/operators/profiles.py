"""Column profiles that grow with a table: a state for each file and column, kept beside the table and merged on read.

A state is what two of them can be added to: rows, values, sum, minimum and maximum. An update lists the table's
files, which reads none of them, scans those that have no state yet, and appends theirs. Files that were deleted or
replaced no longer match the listing, and their states no longer count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = "file string, length long, modified timestamp, column_name string, n_rows long, filled long, total double, least double, most double"


def _plain(path: Column) -> Column:
    """Sources differ in how many slashes follow a scheme."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]


def file_states(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One state per file and column of rows read from files, in one pass; tasks add up their own rows first."""
    meta = F.col("_metadata")
    named = rows.select(
        _plain(meta["file_path"]).alias("file"), meta["file_size"].alias("length"), meta["file_modification_time"].alias("modified"),
        *[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(columns)],
    )
    measures = [m for i in range(len(columns)) for m in (F.count(f"_{i}"), F.sum(f"_{i}"), F.min(f"_{i}"), F.max(f"_{i}"))]
    summed = named.groupBy("file", "length", "modified").agg(F.count(F.lit(1)).alias("n_rows"), *[m.alias(f"m{k}") for k, m in enumerate(measures)])
    states = [
        F.struct(
            F.lit(c).alias("column_name"), "n_rows", F.col(f"m{4 * i}").alias("filled"), F.col(f"m{4 * i + 1}").alias("total"),
            F.col(f"m{4 * i + 2}").alias("least"), F.col(f"m{4 * i + 3}").alias("most"),
        )
        for i, c in enumerate(columns)
    ]
    return summed.select("file", "length", "modified", F.inline(F.array(*states)))


def merged(states: DataFrame) -> DataFrame:
    """(column_name, n_rows, filled, min, max, mean) of the files whose states these are."""
    totals = states.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("filled").alias("filled"), F.min("least").alias("min"), F.max("most").alias("max"), F.sum("total").alias("total")
    )
    return totals.select("column_name", "n_rows", "filled", "min", "max", F.try_divide("total", "filled").alias("mean"))


class ProfiledTable:
    """A Parquet table at `path`, and its profile's states in `folder`."""

    def __init__(self, spark: SparkSession, path: str, folder: str, schema: T.StructType, columns: list[str] | None = None):
        self.spark, self.path, self.folder, self.schema = spark, path, folder.rstrip("/"), schema
        self.columns = columns or numeric_columns(schema)

    def files(self) -> DataFrame:
        """(file, length, modified) of the table's files as they are now; their content is not read."""
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(self.path)
        return listed.select(_plain(F.col("path")).alias("file"), "length", F.col("modificationTime").alias("modified"), F.col("path"))

    def _states(self) -> DataFrame:
        """All states that were ever written, once each, those of columns that are asked for."""
        known = self._written()
        return known.where(F.col("column_name").isin(self.columns)).dropDuplicates(["file", "length", "modified", "column_name"])

    def _written(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self.folder)

    def update(self) -> int:
        """Scan the files that some column has no state of; returns how many there were."""
        complete = self._states().groupBy("file", "length", "modified").agg(F.count("*").alias("columns")).where(F.col("columns") == len(self.columns))
        new = self.files().join(complete, ["file", "length", "modified"], "left_anti")
        paths = [r.path for r in new.select("path").collect()]  # names of new files only
        if paths:
            found = file_states(self.spark.read.schema(self.schema).parquet(*paths), self.columns)
            # A file without rows has a state too.
            every = new.select("file", "length", "modified", F.explode(F.array(*[F.lit(c) for c in self.columns])).alias("column_name"))
            found = every.join(found, ["file", "length", "modified", "column_name"], "left").fillna(0, ["n_rows", "filled"])
            found.coalesce(1).write.mode("append").parquet(self.folder)
        return len(paths)

    def profile(self) -> DataFrame:
        """The merged profile of the files that are there; one that update has not seen is an error."""
        current = self.files().select("file", "length", "modified")
        states = self._states().join(current, ["file", "length", "modified"], "left_semi")
        seen = states.select("file").distinct().count()
        if seen != current.count():
            raise ValueError(f"{current.count() - seen} files of {self.path} have no state yet: update first")
        return merged(states)
