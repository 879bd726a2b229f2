"""From a folder of input files to the tables and files that users read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.aggregates import column_catalog
from larder.operators.pricing import location_catalog
from larder.plans.marts import food_mart, price_mart
from larder.plans.nutrition import read_nutrients
from larder.plans.recommendations import recommendations
from larder.sources import schemas as S
from larder.sources import tables as T
from larder.sources.sinks import write_csv, write_serving_copy, write_table

# Where each input lies in a data folder.
FILES = {
    "nutrient_map": "nutrient_map.csv",
    "recommendations_macro": "recommendations_macro.csv",
    "recommendations_nnr2023": "recommendations_nnr2023.csv",
    "unit_conversion": "unit_conversion.csv",
    "ssgrp_colors": "ssgrp_colors.csv",
    "ciqual_alim": "ciqual2020/alim.csv",
    "ciqual_compo": "ciqual2020/compo.csv",
    "ciqual_sources": "ciqual2020/sources.csv",
    "calnut_0": "calnut.0.csv",
    "calnut_1": "calnut.1.csv",
    "agribalyse": "agribalyse_synthese.csv",
    "euro_exchange_rates": "euro_exchange_rates/latest.csv",
    "prices": "prices.parquet",
    "products": "products.parquet",
}
SERVED = ("final_table_price", "recommendations", "nutrient_map")
# Columns without a place in the column descriptions.
UNDESCRIBED = "location_osm_l..|product_quantity"


def load(spark: SparkSession, folder: str, files: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All inputs as typed DataFrames; `files` names those that lie elsewhere than FILES says."""
    path = {name: f"{folder}/{file}" for name, file in (FILES | (files or {})).items()}
    return {
        "nutrient_map": T.nutrient_map(spark, path["nutrient_map"]),
        "recommendations_macro": T.recommendations_macro(spark, path["recommendations_macro"]),
        "recommendations_nnr2023": T.recommendations_nnr2023(spark, path["recommendations_nnr2023"]),
        "unit_conversion": T.unit_conversion(spark, path["unit_conversion"]),
        "ssgrp_colors": T.ssgrp_colors(spark, path["ssgrp_colors"]),
        "ciqual_alim": T.ciqual_alim(T.ciqual_rows(spark, path["ciqual_alim"], "ALIM", S.CIQUAL_ALIM)),
        "ciqual_compo": T.ciqual_compo(T.ciqual_rows(spark, path["ciqual_compo"], "COMPO", S.CIQUAL_COMPO)),
        "ciqual_sources": T.ciqual_sources(T.ciqual_rows(spark, path["ciqual_sources"], "SOURCES", S.CIQUAL_SOURCES)),
        "calnut_0": T.calnut_0(spark, path["calnut_0"]),
        "calnut_1": T.calnut_1(spark, path["calnut_1"]),
        "agribalyse": T.agribalyse(spark, path["agribalyse"]),
        "euro_exchange_rates": T.exchange_rates(spark, path["euro_exchange_rates"]),
        "prices": T.prices(spark, path["prices"]),
        "products": T.products(spark, path["products"]),
    }


def build(tables: dict[str, DataFrame], out: str, with_foods: bool = False) -> dict[str, DataFrame]:
    """Write the price mart, the recommendations and, if asked, the food mart; return all tables by name.

    The price mart's files hold ranges of locations, as shops are what readers filter by.
    """
    t = tables
    nutrients = read_nutrients(t["nutrient_map"])
    shared = (t["ciqual_alim"], t["ciqual_compo"])
    prices = price_mart(
        t["prices"], t["products"], t["euro_exchange_rates"], *shared, t["calnut_1"], t["agribalyse"], t["ssgrp_colors"], nutrients
    )
    made = {"final_table_price": write_table(prices, f"{out}/final_table_price", ["location_id"], "price_id")}
    targets = recommendations(t["nutrient_map"], t["recommendations_macro"], t["recommendations_nnr2023"])
    made["recommendations"] = write_table(targets, f"{out}/recommendations")
    if with_foods:
        foods = food_mart(
            t["prices"], t["products"], t["euro_exchange_rates"], *shared, t["calnut_0"], t["calnut_1"], t["agribalyse"],
            t["ssgrp_colors"], nutrients,
        )
        made["final_table_food"] = write_table(foods, f"{out}/final_table_food")
    return tables | made


def write_static(tables: dict[str, DataFrame], out: str) -> None:
    """The locations and the column descriptions, as CSV folders."""
    mart = tables["final_table_price"]
    write_csv(location_catalog(mart).orderBy("id", F.desc("count")), f"{out}/locations")
    write_csv(column_catalog(mart, UNDESCRIBED), f"{out}/column_description")


def write_serving(tables: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    return write_serving_copy(tables, out, SERVED)
