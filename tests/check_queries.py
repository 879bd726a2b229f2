"""Run registered queries beside their SQL: python tests/check_queries.py [folder] [name ...]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return "None" if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql):
    """None if both give the same column names and the same multiset of rows, else a short description."""
    ours = spark_df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: {sorted(set(names) ^ set(spark_df.columns))}"
    a, b = rows_of(spark_df.columns, ours), rows_of(names, theirs)
    if len(a) != len(b):
        return f"rows: {len(a)} here, {len(b)} in SQL"
    for x, y in zip(a, b, strict=True):
        if x != y:
            difference = [(n, p, q) for n, p, q in zip(sorted(names), x, y, strict=True) if p != q]
            return f"values differ: {difference[:4]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from larder.runtime import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark = local_session(cores="8", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            sql = entry.oracle_sql().get(name)
            outcome = compare(df, con, sql) if sql else f"{len(df.collect())} rows (no SQL)"
        except Exception as error:
            outcome = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(outcome and "no SQL" not in outcome)
        print(f"{name:28} {time.time() - start:6.2f}s  {outcome or 'same'}", flush=True)
    print(f"{len(wanted)} queries, {bad} differ")
