"""Row-level expectations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from larder.operators.joins import lookup


@dataclass(frozen=True)
class Rule:
    """A named condition that has to be true; NULL counts as broken."""

    name: str
    holds: Column


@dataclass(frozen=True)
class Reference:
    """A named foreign key: non-NULL values of `column` have to occur in `target`.`key`."""

    name: str
    column: str
    target: DataFrame
    key: str


def check_rules(df: DataFrame, rules: list[Rule], references: list[Reference] = ()) -> DataFrame:
    """The rows of df that break a rule, once per broken rule, with the rule's name.

    All conditions are evaluated in one pass; each foreign key adds one join
    against the distinct keys of its target.
    """
    broken = [F.when(F.coalesce(r.holds, F.lit(False)), None).otherwise(F.lit(r.name)) for r in rules]
    rows = df
    for i, ref in enumerate(references):
        known = ref.target.select(F.col(ref.key).alias(f"_key{i}")).distinct().withColumn(f"_known{i}", F.lit(True))
        rows = lookup(rows, known, ref.column, f"_key{i}", spread_by=df.columns[0])
        missing = F.col(ref.column).isNotNull() & F.col(f"_known{i}").isNull()
        broken.append(F.when(missing, F.lit(ref.name)))
    names = F.filter(F.array(*broken), lambda name: name.isNotNull())
    return rows.select(F.explode(names).alias("rule"), *[F.col(f"`{c}`") for c in df.columns])


class Counted:
    """Counts of broken rules, taken while the rows that are checked are written.

    `rows` are the given rows with the counts attached; whatever is derived from them may be written. The counts are
    there once that has been done, and cover every row that was read, also rows that the derived table leaves out.
    Each rule adds an aggregate to the pass, no scan. Rows are counted once for each time `rows` is evaluated, so it
    has to be used in one write only.
    """

    def __init__(self, df: DataFrame, rules: list[Rule]):
        self.spark, self.names = df.sparkSession, [r.name for r in rules]
        self.seen = Observation()
        broken = [F.count_if(~F.coalesce(r.holds, F.lit(False))).alias(f"_{i}") for i, r in enumerate(rules)]
        self.rows = df.observe(self.seen, F.count(F.lit(1)).alias("_rows"), *broken)

    def counts(self) -> DataFrame:
        """(rule, broken, n_rows), a row for each rule; waits for the write."""
        found = self.seen.get
        rows = [(name, int(found[f"_{i}"]), int(found["_rows"])) for i, name in enumerate(self.names)]
        return self.spark.createDataFrame(rows, "rule string, broken long, n_rows long")


def write_counted(df: DataFrame, rules: list[Rule], path: str, derive=None) -> tuple[DataFrame, DataFrame]:
    """Write derive(df), or df, as a Parquet table, and count in the same pass the rows of df that break each rule.

    Returns the table as read back, and the counts: (rule, broken, n_rows).
    """
    counted = Counted(df, rules)
    made = derive(counted.rows) if derive else counted.rows
    made.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path), counted.counts()


def required(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column).cast("string") != "")


def one_of(column: str, values: list) -> Column:
    return F.col(column).isin(values)


def empty_or(column: str, condition: Column) -> Column:
    return F.col(column).isNull() | condition


def all_or_none(*columns: str) -> Column:
    """Either every column has a value or none has."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return filled.isin(0, len(columns))
