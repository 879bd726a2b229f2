"""Daily nutrient targets: from published tables to slider bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import text as X
from larder.operators.ordered import fill_down
from larder.operators.quality import Rule, check_rules

# Fixed values: (nutrient or None for any, unit of target, unit of upper limit, factor for target,
# factor for upper limit, common unit), first match wins. Alpha-tocopherol equivalents are taken as 1.5 mg.
UNIT_RULES = [
    ("Vitamin A", "RE", "µg RE", 1.0, 1.0, "RE"),
    ("Vitamin E", "α-TE", "mg", 1.5, 1.0, "mg"),
    ("Copper", "µg", "mg", 0.001, 1.0, "mg"),
    (None, "µg", "mg", 1.0, 1000.0, "µg"),
]
# The upper limit of this nutrient covers supplements only and lies below its target.
NO_UPPER_LIMIT = ["Magnesium"]
# Targets published in g and wanted in mg.
GRAMS_TO_MILLIGRAMS = ["Potassium"]
# Section headers of the tables by age, and how rows under them are named.
AGE_SECTIONS = {"CHILDREN": "child", "FEMALES": "female", "MALES": "male"}


def recommendations(nutrient_map: DataFrame, macro: DataFrame, micro: DataFrame) -> DataFrame:
    """Targets per enabled nutrient; a macro target wins over a micro target, and the unit has to fit."""
    values = ("value_males", "value_females", "value_upper_intake", "unit")
    first = macro.select("id", *[F.col(c).alias(f"_a_{c}") for c in values])
    second = micro.select(F.col("nutrient").alias("nnr2023_id"), *[F.col(c).alias(f"_b_{c}") for c in values])
    joined = nutrient_map.where("disabled IS NULL").join(first, "id", "left").join(second, "nnr2023_id", "left")
    return (
        joined.where("_a_value_males IS NOT NULL OR _b_value_males IS NOT NULL")
        .select(
            "id", "name", "nutrient_type", "ciqual_unit", *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in values]
        )
        .where("unit = ciqual_unit")
        .drop("ciqual_unit")
    )


def slider_bounds(recs: DataFrame) -> DataFrame:
    """Range and preset of the input slider of each nutrient, from the male target."""
    lower, upper = F.col("value_males"), F.col("value_upper_intake")
    top = F.when(upper.isNull(), 4 * lower).otherwise(F.ceil(upper + lower).cast("double"))
    return recs.withColumn("_max", F.when(top == 0, 100.0).otherwise(top)).select(
        "id",
        "name",
        "unit",
        "nutrient_type",
        F.lit(0).alias("min"),
        F.col("_max").alias("max"),
        lower.alias("lower"),
        F.coalesce(upper, "_max").alias("upper"),
        F.lit(1).alias("active"),
    )


def target_rows(cells: DataFrame, label: str, females: str, males: str, comment: str) -> DataFrame:
    """'Vitamin D, µg' and its values to (nutrient, unit, RI_or_AI, value_males, value_females)."""
    parts = F.split(label, ", ")
    adequate = X.without_hard_spaces(F.coalesce(comment, F.lit(""))) == "AI in NNR2023"
    return cells.select(
        parts[0].alias("nutrient"),
        parts[1].alias("unit"),
        F.when(adequate, "AI").otherwise("RI").alias("RI_or_AI"),
        F.col(males).cast("double").alias("value_males"),
        F.col(females).cast("double").alias("value_females"),
    )


def upper_limit_rows(cells: DataFrame, label: str, unit_per_day: str, value: str) -> DataFrame:
    """'Zinc', 'mg/d', '25' to (nutrient, unit, value_upper_intake), without limits that cover supplements only."""
    return cells.where(~F.col(label).isin(NO_UPPER_LIMIT)).select(
        F.col(label).alias("nutrient"),
        F.split_part(unit_per_day, F.lit("/"), F.lit(1)).alias("unit"),
        F.col(value).cast("double").alias("value_upper_intake"),
    )


def recommendation_merge(targets: DataFrame, uppers: DataFrame) -> DataFrame:
    """Targets and upper limits by nutrient, in one unit per nutrient."""
    left = targets.withColumns({"_in": F.lit(True), "_unit_1": X.one_micro_sign(F.col("unit"))}).drop("unit")
    right = uppers.withColumn("_unit_2", X.one_micro_sign(F.col("unit"))).drop("unit")
    both = left.join(right, "nutrient", "full")
    matched = F.col("_unit_1").isNotNull() & F.col("_unit_2").isNotNull() & (F.col("_unit_1") != F.col("_unit_2"))
    value_factor = F.when(matched, _by_rule(3)).otherwise(1.0)
    upper_factor = F.when(matched, _by_rule(4)).otherwise(1.0)
    unit = F.when(matched, _by_rule(5)).otherwise(F.coalesce("_unit_1", "_unit_2"))
    in_grams = F.col("nutrient").isin(GRAMS_TO_MILLIGRAMS) & F.col("_in") & (unit == "g")
    to_milligrams = F.when(in_grams, 1000.0).otherwise(1.0)
    upper = F.col("value_upper_intake") * upper_factor
    return both.select(
        "nutrient",
        F.when(in_grams, "mg").otherwise(unit).alias("unit"),
        "RI_or_AI",
        (F.col("value_males") * value_factor * to_milligrams).alias("value_males"),
        (F.col("value_females") * value_factor * to_milligrams).alias("value_females"),
        F.when(F.col("_in"), F.bround(upper, 1)).otherwise(upper).alias("value_upper_intake"),
    )


def _by_rule(part: int) -> Column:
    chosen = F.lit(None)
    for rule in reversed(UNIT_RULES):
        nutrient, unit_1, unit_2 = rule[:3]
        applies = (F.col("_unit_1") == unit_1) & (F.col("_unit_2") == unit_2)
        if nutrient is not None:
            applies &= F.col("nutrient") == nutrient
        chosen = F.when(applies, F.lit(rule[part])).otherwise(chosen)
    return chosen


def merge_problems(merged: DataFrame) -> DataFrame:
    """Merged rows without a common unit, or with a target that is not below its upper limit."""
    upper = F.col("value_upper_intake")
    return check_rules(
        merged,
        [
            Rule("no common unit", F.col("unit").isNotNull()),
            Rule("target of males not below upper limit", F.coalesce(F.col("value_males") < upper, F.lit(True))),
            Rule("target of females not below upper limit", F.coalesce(F.col("value_females") < upper, F.lit(True))),
        ],
    )


def rows_by_age(tables: DataFrame, table: str = "table_no", row: str = "row_no", cells: str = "cells") -> DataFrame:
    """Detail rows of the tables by age group, each with its section and age as one label.

    Section headers are rows of a single cell; rows above the first header are of children.
    Row 0 of each table is its column header.
    """
    section = F.when(F.size(cells) == 1, F.col(cells)[0])
    filled = fill_down(tables.withColumn("_header", section), [table], [row], "_header", "_section")
    names = F.create_map(*[F.lit(x) for pair in AGE_SECTIONS.items() for x in pair])
    group = F.try_element_at(names, F.coalesce("_section", F.lit("CHILDREN")))
    detail = filled.where((F.size(cells) > 1) & (F.col(row) > 0))
    age = X.plain_age(F.col(cells)[0])
    return detail.select(
        table, row, F.concat(group, F.lit(" ("), age, F.lit(")")).alias("individual_type"), cells
    )
