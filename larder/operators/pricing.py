"""Shelf prices in a common currency, and comparisons of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.numeric import ieee_divide, round_half_away


def unit_price(df: DataFrame, price: str, quantity: str, rate: str, per: float = 100) -> Column:
    """per * price / quantity / rate: EUR per 100 g, or per kg with per=1000.

    As in SQL engines with 32-bit floats, the first quotient is a float when the
    quantity is one and the price is not a double; the rate then makes it a double.
    """
    single = isinstance(df.schema[quantity].dataType, T.FloatType) and not isinstance(
        df.schema[price].dataType, T.DoubleType
    )
    scaled = F.lit(per) * F.col(price)
    if single:
        per_gram = ieee_divide(scaled.cast("float"), F.col(quantity)).cast("float")
    else:
        per_gram = ieee_divide(scaled, F.col(quantity))
    return ieee_divide(per_gram, F.col(rate))


def priced_products(
    prices: DataFrame, products: DataFrame, rates: DataFrame, code: str = "code", product_code: str = "product_code"
) -> DataFrame:
    """Price rows with their product and exchange rate; rows in unknown currencies drop out.

    `rates` has a row per currency: Spark broadcasts it while it is under its size
    threshold and shuffles otherwise.
    """
    return prices.join(products, F.col(product_code) == F.col(code)).join(rates, "currency")


def cheapest(df: DataFrame, keys: list[str], price: str, tag: str) -> DataFrame:
    """Lowest price per key and the smallest tag that has it; rows without a price are not candidates."""
    best = F.min(F.struct(F.col(price).alias("price"), F.col(tag).alias("id")))
    return df.where(F.col(price).isNotNull()).groupBy(*keys).agg(best.alias("best")).select(
        *keys, F.col("best.id").alias("id"), F.col("best.price").alias("price")
    )


def category_location_matrix(
    df: DataFrame, category: str, location: str, price: str, tag: str, locations: list
) -> DataFrame:
    """One row per category, one struct(id, price) of the cheapest offer per location.

    Prices are reduced to one row per (category, location) before they are shuffled,
    so a category that holds most rows costs no more than another.
    """
    offers = df.where(F.col(location).isin(locations) & F.col(category).isNotNull())
    best = cheapest(offers, [category, location], price, tag)
    cells = best.select(category, location, F.struct("id", "price").alias("offer"))
    return cells.groupBy(category).pivot(location, locations).agg(F.min("offer"))


def location_catalog(mart: DataFrame) -> DataFrame:
    """Locations with their coordinates, names and numbers of prices."""
    return mart.groupBy(
        F.col("location_id").alias("id"),
        F.col("location_osm_lat").alias("lat"),
        F.col("location_osm_lon").alias("lon"),
        F.col("location_osm_display_name").alias("name"),
    ).count()


def location_names(mart: DataFrame, locations: list) -> DataFrame:
    """A short name for each of the given locations, in the order given."""
    wanted = F.array(*[F.lit(x) for x in locations])
    names = mart.where(F.col("location_id").isin(locations)).groupBy("location_id").agg(
        F.min("location_osm_display_name").alias("name")
    )
    return names.select(
        F.array_position(wanted, F.col("location_id")).alias("position"),
        "location_id",
        F.substring_index("name", ", ", 1).alias("name"),
    ).orderBy("position")


def prices_at_locations(priced: DataFrame, locations: list, name_contains: str | None = None) -> DataFrame:
    """Offers at the given locations with EUR per kg, cheapest first; `priced` comes from priced_products."""
    name = F.try_element_at("product_name", F.lit(1))["text"]
    chosen = priced.where(F.col("location_id").isin(locations))
    if name_contains is not None:
        chosen = chosen.where(name.ilike(f"%{name_contains}%"))
    return chosen.select(
        F.col("code").alias("product_code"),
        F.col("id").alias("price_id"),
        "location_id",
        F.col("compared_to_category").alias("category"),
        F.split_part("location_osm_display_name", F.lit(","), F.lit(1)).alias("location_name"),
        name.alias("product_name"),
        F.col("price").alias("product_price"),
        "product_quantity",
        round_half_away(unit_price(priced, "price", "product_quantity", "rate", 1000), 2).alias("price_per_kg"),
        "date",
    ).orderBy("price_per_kg")


def mart_prices_at_locations(mart: DataFrame, locations: list) -> DataFrame:
    """The same comparison read from the price mart, with EUR per 100 g turned into EUR per kg."""
    return (
        mart.where(F.col("location_id").isin(locations))
        .select(
            "product_name",
            F.split_part("location_osm_display_name", F.lit(","), F.lit(1)).alias("location_name"),
            round_half_away(F.col("price") * 10, 2).alias("eur_price_per_kg"),
            "product_price",
            F.col("product_currency").alias("currency"),
            F.col("product_quantity").alias("product_quantity_g"),
            "product_code",
            "price_id",
            "location_id",
            "price_date",
        )
        .orderBy("eur_price_per_kg")
    )


def brush(
    locations: DataFrame,
    selected: DataFrame,
    x: Column,
    y: Column,
    rectangle: tuple[float, float, float, float],
    mode: str,
) -> DataFrame:
    """Ids selected after drawing a rectangle (x0, y0, x1, y1) on the map in mode select or deselect."""
    x0, y0, x1, y1 = rectangle
    inside = locations.where(x.between(x0, x1) & y.between(y0, y1)).select("id")
    if mode == "select":
        return selected.select("id").union(inside).distinct()
    if mode == "deselect":
        return selected.select("id").join(inside, "id", "left_anti").distinct()
    raise ValueError("mode is 'select' or 'deselect'")
