"""Which nutrient value a product or food gets, and where it came from.

Order of preference: the product's own label (with a unit, and the unit wanted), the
first composition table, the second composition table, and at last 0, "assumed".

There is no products x nutrients grid to join and pivot. The composition tables
become one row per food holding an array with a position per nutrient; a product row
then needs one lookup of its food, and its label values are read from its own array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.text import join_text


@dataclass(frozen=True)
class Nutrient:
    """One row of the nutrient map: the same nutrient's codes and units in every source."""

    id: str
    off_id: str | None
    ciqual_const_code: int | None
    ciqual_unit: str | None
    calnut_const_code: int | None
    calnut_unit: str | None


def read_nutrients(nutrient_map: DataFrame) -> list[Nutrient]:
    """The nutrient map as plan-time configuration: it decides the columns of a mart."""
    columns = ["id", "off_id", "ciqual_const_code", "ciqual_unit", "calnut_const_code", "calnut_unit"]
    usable = nutrient_map.where("ciqual_const_code IS NOT NULL OR calnut_const_code IS NOT NULL")
    return sorted((Nutrient(*row) for row in usable.select(*columns).collect()), key=lambda n: n.id)


def food_facts(ciqual_compo: DataFrame, calnut_1: DataFrame, nutrients: list[Nutrient]) -> DataFrame:
    """(food_code, facts): facts[i] is the composition value of nutrients[i], NULL if neither table knows it.

    A fact is struct(value, unit, source, detail, combl). Both tables are reduced to
    one row per food and nutrient before foods are put together, so the array is
    as long as the nutrient list and no longer.
    """
    ciqual_codes = [n.ciqual_const_code for n in nutrients if n.ciqual_const_code is not None]
    calnut_codes = [n.calnut_const_code for n in nutrients if n.calnut_const_code is not None]
    first = ciqual_compo.where(F.col("mean").isNotNull() & F.col("const_code").isin(ciqual_codes)).select(
        F.col("alim_code").cast("long").alias("food_code"),
        F.concat(F.lit("q"), F.col("const_code").cast("string")).alias("slot"),
        F.struct(
            F.col("mean").cast("float").alias("mean"),
            join_text(F.col("code_confiance"), F.lit("_"), F.col("source_code").cast("string")).alias("detail"),
            F.lit(False).alias("combl"),
        ).alias("fact"),
    )
    second = calnut_1.where(F.col("mean").isNotNull() & F.col("CONST_CODE").isin(calnut_codes)).select(
        F.col("ALIM_CODE").cast("long").alias("food_code"),
        F.concat(F.lit("n"), F.col("CONST_CODE").cast("string")).alias("slot"),
        F.struct(
            F.col("mean").cast("float").alias("mean"),
            F.lit("").alias("detail"),
            F.coalesce("combl", F.lit(False)).alias("combl"),
        ).alias("fact"),
    )
    one_each = first.union(second).groupBy("food_code", "slot").agg(F.min("fact").alias("fact"))
    by_slot = one_each.groupBy("food_code").agg(F.map_from_entries(F.collect_list(F.struct("slot", "fact"))).alias("_f"))
    return by_slot.selectExpr("food_code", f"array({', '.join(_fact(n) for n in nutrients)}) AS facts")


def _text(value: str | None) -> str:
    """A SQL string literal. The per-nutrient expressions are written as SQL: one call each instead of dozens."""
    if value is None:
        return "CAST(NULL AS STRING)"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _fact(n: Nutrient) -> str:
    def known(slot: str, unit: str | None, source: str) -> str:
        fact = f"try_element_at(_f, '{slot}')"
        return (
            f"WHEN {fact} IS NOT NULL THEN named_struct('value', {fact}.mean, 'unit', {_text(unit)}, "
            f"'source', '{source}', 'detail', {fact}.detail, 'combl', {fact}.combl)"
        )

    first = known(f"q{n.ciqual_const_code}", n.ciqual_unit, "ciqual_")
    second = known(f"n{n.calnut_const_code}", n.calnut_unit, "calnut_")
    return f"CASE {first} {second} END"


Choice = dict[str, tuple[str, str, str]]


def product_values(
    nutrients: list[Nutrient],
    nutriments: str = "nutriments",
    facts: str = "facts",
    food_origin: str = "ciqual_food_code_origin",
) -> Choice:
    """nutrient id -> SQL for (value, unit, origin) of a row with label array, food facts and food-code origin.

    Where a label repeats a nutrient, its first entry counts.
    """

    def choose(i: int, n: Nutrient) -> tuple[str, str, str]:
        fact = f"get({facts}, {i})"
        label = f"get({nutriments}, CAST(array_position({nutriments}.name, {_text(n.off_id)}) AS INT) - 1)"
        usable = f"{label}.`100g` IS NOT NULL AND {label}.unit = {_text(n.ciqual_unit)}"
        text = f"concat_ws('', {fact}.source, {food_origin}, {fact}.detail, IF({fact}.combl, '_combl', ''))"
        return (
            f"CASE WHEN {usable} THEN {label}.`100g` ELSE coalesce({fact}.value, CAST(0 AS FLOAT)) END",
            f"CASE WHEN {usable} THEN {label}.unit ELSE coalesce({fact}.unit, {_text(n.ciqual_unit)}) END",
            f"CASE WHEN {usable} THEN 'product' WHEN {fact} IS NOT NULL THEN {text} ELSE 'assumed 0' END",
        )

    return {n.id: choose(i, n) for i, n in enumerate(nutrients)}


def food_values(nutrients: list[Nutrient], facts: str = "facts") -> Choice:
    """The same choice for a food itself: no label, and no food-code origin in the text."""

    def choose(i: int, n: Nutrient) -> tuple[str, str, str]:
        fact = f"get({facts}, {i})"
        text = f"concat_ws('', {fact}.source, {fact}.detail, IF({fact}.combl, 'combl', ''))"
        return (
            f"coalesce({fact}.value, CAST(0 AS FLOAT))",
            f"coalesce({fact}.unit, {_text(n.ciqual_unit)})",
            f"CASE WHEN {fact} IS NOT NULL THEN {text} ELSE 'assumed 0' END",
        )

    return {n.id: choose(i, n) for i, n in enumerate(nutrients)}


def as_columns(choice: Choice, ids: list[str]) -> list[str]:
    """Wide form: `<id>`, `<id>_unit`, `<id>_origin` for each id; NULL where the nutrient map lacks it."""
    unmapped = ("CAST(NULL AS FLOAT)", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)")
    return [
        f"{sql} AS {_name(nutrient + suffix)}"
        for nutrient in ids
        for sql, suffix in zip(choice.get(nutrient, unmapped), ("", "_unit", "_origin"), strict=True)
    ]


def as_rows(df: DataFrame, choice: Choice, keep: list[str]) -> DataFrame:
    """Long form: (keep..., nutrient_id, value, unit, origin), by exploding within each row."""
    cells = [
        f"named_struct('nutrient_id', {_text(n)}, 'value', {v}, 'unit', {u}, 'origin', {o})"
        for n, (v, u, o) in choice.items()
    ]
    return df.selectExpr(*[_name(k) for k in keep], f"inline(array({', '.join(cells)}))")


def nutrient_grid(entities: DataFrame, nutrients: list[Nutrient]) -> DataFrame:
    """Every entity row with every nutrient: an explode of constants within each row, not a join."""
    fields = ("off_id", "ciqual_const_code", "ciqual_unit", "calnut_const_code", "calnut_unit")
    types = ("string", "long", "string", "long", "string")
    rows = [
        F.struct(
            F.lit(n.id).alias("nutrient_id"),
            *[F.lit(getattr(n, f)).cast(t).alias(f) for f, t in zip(fields, types, strict=True)],
        )
        for n in nutrients
    ]
    return entities.select("*", F.inline(F.array(*rows)))
