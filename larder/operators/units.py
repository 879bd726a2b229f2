"""Unit conversion, off by default in the marts (labels in another unit are ignored there)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def convert_units(df: DataFrame, value: str, unit: str, target_unit: str, unit_conversion: DataFrame, name: str) -> DataFrame:
    """Add `name`: value expressed in the row's target unit, NULL if the two do not share a base unit.

    unit_conversion: (from_unit, to_unit, conversion_factor), one row per from_unit; to_unit is its base
    unit. A unit that the table lacks converts to itself only.
    """

    def side(key: str) -> DataFrame:
        return unit_conversion.select(
            F.col("from_unit").alias(f"_{key}"), F.col("to_unit").alias(f"_{key}_base"), F.col("conversion_factor").alias(f"_{key}_factor")
        )

    known = df.join(side("have"), F.col(unit) == F.col("_have"), "left").join(side("want"), F.col(target_unit) == F.col("_want"), "left")
    converted = F.col(value).cast("double") * F.col("_have_factor") / F.col("_want_factor")
    same = F.when(F.col(unit) == F.col(target_unit), F.col(value).cast("double"))
    result = same.when(F.col("_have_base") == F.col("_want_base"), converted)
    return known.withColumn(name, result).drop(*[f"_{k}{x}" for k in ("have", "want") for x in ("", "_base", "_factor")])
