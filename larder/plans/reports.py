"""What is shown about a product, a diet and its nutrients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.ordered import running_segments
from larder.plans.vocabulary import ENERGY_PER_GRAM


def product_facts(mart: DataFrame, offers: DataFrame, nutrient_map: DataFrame, ids: list[str]) -> DataFrame:
    """Nutrient rows of the offers whose price_id is asked for: type, name, unit, value and origin, from their wide rows.

    offers: (price_id), a short list. Where an id repeats, the row of the smallest product_code, then of
    the smallest location_id, stands for it.
    """
    cells = [
        F.struct(
            F.lit(n).alias("id"), F.col(n).cast("double").alias("value"), F.col(f"{n}_origin").alias("origin")
        )
        for n in ids
    ]
    asked = mart.join(offers.select("price_id").distinct(), "price_id", "left_semi")
    one = asked.groupBy("price_id").agg(F.min_by(F.array(*cells), F.struct("product_code", "location_id")).alias("cells"))
    long = one.select("price_id", F.inline("cells"))
    described = nutrient_map.select("id", "name", "nutrient_type", F.col("ciqual_unit").alias("unit"))
    return long.join(described, "id").select("price_id", "nutrient_type", "id", "name", F.round("value", 3).alias("value"), "unit", "origin")


def macro_summary(diet: DataFrame, keys: list[str], energy_per_gram: dict[str, float] = ENERGY_PER_GRAM) -> DataFrame:
    """Weight, energy and share of energy of each macronutrient, per key."""
    names = list(energy_per_gram)
    weights = diet.groupBy(*keys).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
    energy = {n: F.col(n) * kcal for n, kcal in energy_per_gram.items()}
    total = sum(energy.values(), F.lit(0.0))

    def row(n: str) -> Column:
        return F.struct(
            F.lit(n).alias("nutrient"),
            F.col(n).alias("weight_g"),
            energy[n].alias("energy_kcal"),
            (100 * F.try_divide(energy[n], total)).alias("percent"),
        )

    return weights.select(*keys, F.inline(F.array(*[row(n) for n in names])))


def total_price(diet: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    return diet.groupBy(*keys).agg(F.coalesce(F.sum(price), F.lit(0.0)).alias("total_price"))


def nutrient_segments(diet: DataFrame, keys: list[str], rank: str, nutrients: list[str]) -> DataFrame:
    """For stacked bars: each row's start and end on each nutrient's axis, last-ranked row first."""
    kept = [*keys, rank]
    cells = [F.struct(F.lit(n).alias("nutrient_id"), F.col(n).cast("double").alias("level")) for n in nutrients]
    long = diet.select(*kept, F.inline(F.array(*cells)))
    return running_segments(long, [*keys, "nutrient_id"], [F.desc(rank)], "level")
