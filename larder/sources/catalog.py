"""Tables in the session's catalog: stored in buckets of a key, with comments, so that joins on the key move nothing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.sinks import with_comments

HOT_KEYS = "larder.hot_keys"
HOT = 2  # mean buckets of rows that make a key hot


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hot_keys(df: DataFrame, key: str, buckets: int) -> list:
    """Keys that hold more rows than HOT buckets would on average; no more than buckets / HOT of them exist.

    A NULL key joins nothing, but its rows are kept: they count like any other.
    """
    counts = df.groupBy(F.col(key).alias("key")).count()
    least = df.agg((F.count("*") * HOT / buckets).alias("least"))
    return [r.key for r in counts.join(F.broadcast(least), F.col("count") > F.col("least")).select("key").collect()]


def _is_hot(key: Column, hot: list) -> Column:
    named = [k for k in hot if k is not None]
    found = key.isin(named) if named else F.lit(False)
    return F.coalesce(found, F.lit(any(k is None for k in hot)))


def save_bucketed(
    df: DataFrame, name: str, key: str, buckets: int, path: str | None = None, comment: str = "", comments: dict[str, str] | None = None
) -> DataFrame:
    """Replace a catalog table by df, in buckets of `key`, each sorted by it and written by one task.

    Rows of hot keys would make one bucket's task as large as many others together. They go to a second table,
    `<name>_hot`, which has no buckets; the first one's properties list these keys. path: where the files lie,
    else in the warehouse. comment is the table's, comments are its columns'.
    """
    spark = df.sparkSession
    hot = hot_keys(df, key, buckets)
    described = with_comments(df, comments or {})

    def written(rows: DataFrame, table: str, folder: str | None, bucketed: bool) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        writer = rows.write.format("parquet").mode("overwrite")
        writer = writer.bucketBy(buckets, key).sortBy(key) if bucketed else writer
        (writer.option("path", folder) if folder else writer).saveAsTable(table)
        if comment:
            spark.sql(f"COMMENT ON TABLE {table} IS {_text(comment)}")

    plain = described.where(~_is_hot(F.col(key), hot)) if hot else described
    written(plain.repartition(buckets, key), name, path, True)
    spark.sql(f"DROP TABLE IF EXISTS {name}_hot")
    if hot:
        written(described.where(_is_hot(F.col(key), hot)), f"{name}_hot", f"{path}_hot" if path else None, False)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({_text(HOT_KEYS)} = {_text(json.dumps(hot, default=str))})")
    return read_table(spark, name)


def properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def stored_hot_keys(spark: SparkSession, name: str) -> list:
    return json.loads(properties(spark, name).get(HOT_KEYS, "[]"))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """All rows of a table that save_bucketed wrote."""
    table = spark.table(name)
    return table.unionByName(spark.table(f"{name}_hot")) if stored_hot_keys(spark, name) else table


def join_bucketed(spark: SparkSession, left: str, right: str, key: str, how: str = "inner") -> DataFrame:
    """Two tables in the same buckets, joined on their key: inner, left or left_semi.

    Bucket meets bucket in place. Only rows of hot keys, of either table, are joined the usual way: there adaptive
    execution splits what is uneven, and of the other table only the buckets of these keys are read.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"no bucketed join of kind {how!r}")
    a, b = spark.table(left), spark.table(right)
    kind = a.schema[key].dataType
    hot = {json.dumps(k): k for k in stored_hot_keys(spark, left) + stored_hot_keys(spark, right)}
    if not hot:
        return a.join(b, key, how)
    is_hot = _is_hot(F.col(key), [None if k is None else F.lit(k).cast(kind) for k in hot.values()])
    usual = read_table(spark, left).where(is_hot).join(read_table(spark, right).where(is_hot), key, how)
    return a.where(~is_hot).join(b, key, how).unionByName(usual)


def table_comment(spark: SparkSession, name: str) -> str:
    return spark.catalog.getTable(name).description or ""


def column_comments(spark: SparkSession, name: str) -> DataFrame:
    """(column, type, comment) of a catalog table, as the catalog has them."""
    rows = [(c.name, c.dataType, c.description or "") for c in spark.catalog.listColumns(name)]
    return spark.createDataFrame(rows, "column string, type string, comment string")
