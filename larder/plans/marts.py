"""The two wide tables: one row per price, one row per food."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.aggregates import exact_median
from larder.operators.joins import lookup
from larder.operators.pricing import priced_products, unit_price
from larder.operators.sets import union_codes
from larder.plans.nutrition import Nutrient, as_columns, food_facts, food_values, product_values
from larder.plans.vocabulary import (
    COLUMN_COMMENTS,
    IMPACT_COLUMNS,
    NUTRIENT_IDS,
    PRICE_COLUMNS,
    UNKNOWN_GROUP_COLOR,
)
from larder.sources.sinks import with_comments


BASIC_NUTRIENTS = ("energy_fibre_kcal", "carbohydrate", "fat", "protein")

FOOD_NAMES = {
    "alim_code": "ciqual_code",
    "alim_nom_eng": "ciqual_name",
    "alim_grp_code": "ciqual_group_code",
    "alim_ssgrp_code": "ciqual_subgroup_code",
    "alim_ssssgrp_code": "ciqual_subsubgroup_code",
}


def price_mart(
    prices: DataFrame,
    products: DataFrame,
    rates: DataFrame,
    ciqual_alim: DataFrame,
    ciqual_compo: DataFrame,
    calnut_1: DataFrame,
    agribalyse: DataFrame,
    colors: DataFrame,
    nutrients: list[Nutrient],
    nutrient_ids: list[str] = NUTRIENT_IDS,
    dedupe: bool = False,
    price_columns: dict[str, str] = PRICE_COLUMNS,
) -> DataFrame:
    """One row per price, with product, EUR per 100 g, nutrients with unit and origin, food and impact columns.

    Product codes repeat in the catalog. By default every catalog row of a code is
    joined to its prices; `dedupe` keeps one row per code instead. price_columns names the price
    table's columns that the mart has, and what they are called there; all of them have to exist.

    Products are cut down to priced ones first and brought together by code once; the
    price table is shuffled once, for a single join on the code whose hot codes
    adaptive execution may split. Food tables are looked up on the product side.
    """
    sold = prices.select(F.col("product_code").alias("code")).distinct()
    priced = products.join(sold, "code", "left_semi")
    named = priced.withColumn("product_name", F.try_element_at("product_name", F.lit(1))["text"])
    facts = food_facts(ciqual_compo, calnut_1, nutrients)

    label_keys = ["code", "ciqual_food_code"]
    tie_break = F.struct("product_name", "product_quantity", F.xxhash64("nutriments"))
    about = ["product_name", "product_quantity", "product_quantity_unit"]
    if dedupe:
        order = F.struct("ciqual_food_code", tie_break)
        row = F.min_by(F.struct("ciqual_food_code", "nutriments", "ciqual_food_code_origin", *about), order)
        labels = named.groupBy("code").agg(row.alias("_row")).select("code", "_row.*")
    else:
        row = F.min_by(F.struct("nutriments", "ciqual_food_code_origin"), tie_break)
        labels = named.groupBy(*label_keys).agg(row.alias("_row")).select(*label_keys, "_row.*")
    labelled = lookup(labels, facts, "ciqual_food_code", "food_code", "code")
    carried = about if dedupe else []
    profiles = labelled.selectExpr(*label_keys, *carried, *as_columns(product_values(nutrients), nutrient_ids))
    catalog = profiles if dedupe else profiles.join(named.select("code", *about), "code")
    catalog = catalog.where("product_quantity > 0 AND product_quantity < 30000")
    foods = _foods(ciqual_alim, agribalyse, colors)
    catalog = lookup(catalog, foods, "ciqual_food_code", "_food", "code")

    kept = price_columns
    offers = prices.where("price IS NOT NULL").select("product_code", *[F.col(o).alias(f"_{n}") for o, n in kept.items()])
    joined = offers.join(catalog, offers.product_code == catalog.code).join(
        rates.select(F.col("currency").alias("_currency"), "rate"), F.col("_product_currency") == F.col("_currency")
    )
    mart = joined.select(
        "product_code",
        *about,
        *FOOD_NAMES.values(),
        F.coalesce("color", F.lit(UNKNOWN_GROUP_COLOR)).alias("color"),
        *[F.col(f"_{n}").alias(n) for n in kept.values()],
        unit_price(joined, "_product_price", "product_quantity", "rate").alias("price"),
        *label_keys,
        *[c for n in nutrient_ids for c in (n, f"{n}_unit", f"{n}_origin")],
        *IMPACT_COLUMNS,
    )
    return with_comments(mart, COLUMN_COMMENTS)


def food_mart(
    prices: DataFrame,
    products: DataFrame,
    rates: DataFrame,
    ciqual_alim: DataFrame,
    ciqual_compo: DataFrame,
    calnut_0: DataFrame,
    calnut_1: DataFrame,
    agribalyse: DataFrame,
    colors: DataFrame,
    nutrients: list[Nutrient],
    nutrient_ids: list[str] = NUTRIENT_IDS,
) -> DataFrame:
    """One row per food known to any of three tables, with the median price over all its products."""
    offers = food_offers(prices, products, rates)
    return food_table(offers, ciqual_alim, ciqual_compo, calnut_0, calnut_1, agribalyse, colors, nutrients, nutrient_ids)


def food_offers(prices: DataFrame, products: DataFrame, rates: DataFrame) -> DataFrame:
    """(code, food_code, price): every price of a product with a food code, in EUR per 100 g."""
    sold = products.where("ciqual_food_code IS NOT NULL").where(F.col("product_quantity").between(1, 30000))
    sold = sold.select("code", F.col("ciqual_food_code").cast("long").alias("food_code"), "product_quantity")
    offers = priced_products(prices.where("price IS NOT NULL").select("product_code", "price", "currency"), sold, rates)
    return offers.select("code", "food_code", unit_price(offers, "price", "product_quantity", "rate").alias("price"))


def food_table(
    offers: DataFrame,
    ciqual_alim: DataFrame,
    ciqual_compo: DataFrame,
    calnut_0: DataFrame,
    calnut_1: DataFrame,
    agribalyse: DataFrame,
    colors: DataFrame,
    nutrients: list[Nutrient],
    nutrient_ids: list[str] = NUTRIENT_IDS,
) -> DataFrame:
    """The food mart from priced offers (food_code, price)."""
    codes = union_codes(
        "ciqual_food_code",
        (ciqual_alim.select(F.col("alim_code").cast("long")), "alim_code"),
        (calnut_0.select(F.col("ALIM_CODE").cast("long")), "ALIM_CODE"),
        (agribalyse.select(F.col("ciqual_food_code").cast("long")), "ciqual_food_code"),
    )
    facts = food_facts(ciqual_compo, calnut_1, nutrients)
    wide = codes.join(facts, codes.ciqual_food_code == facts.food_code, "left").selectExpr(
        "ciqual_food_code", *as_columns(food_values(nutrients), nutrient_ids)
    )
    per_food = offers.select(F.col("food_code").alias("_food_code"), "price")
    medians = exact_median(per_food, ["_food_code"], "price", "price", "price_count")
    foods = _foods(ciqual_alim, agribalyse, colors)
    joined = wide.join(medians, wide.ciqual_food_code == medians._food_code, "left").join(
        foods, wide.ciqual_food_code == foods._food, "left"
    )
    return joined.select(
        *FOOD_NAMES.values(),
        F.coalesce("color", F.lit(UNKNOWN_GROUP_COLOR)).alias("color"),
        "price",
        "price_count",
        *wide.columns,
        *IMPACT_COLUMNS,
    )


def _foods(ciqual_alim: DataFrame, agribalyse: DataFrame, colors: DataFrame) -> DataFrame:
    """Names, group color and impacts by food code, for codes that either table has."""
    colored = ciqual_alim.join(
        colors.select("alim_ssgrp_code", "color"), "alim_ssgrp_code", "left"
    ).select(F.col("alim_code").cast("long").alias("_food"), *[F.col(o).alias(n) for o, n in FOOD_NAMES.items()], "color")
    impacts = agribalyse.select(F.col("ciqual_food_code").cast("long").alias("_food"), *IMPACT_COLUMNS)
    return colored.join(impacts, "_food", "full")


def missing_food_code(mart: DataFrame, nutrients: tuple[str, ...] = BASIC_NUTRIENTS) -> DataFrame:
    """Distinct products without a food code, with a few of their nutrients."""
    shown = [c for n in nutrients for c in (n, f"{n}_origin")]
    return mart.where("ciqual_food_code IS NULL").select("product_code", "product_name", *shown).distinct()
