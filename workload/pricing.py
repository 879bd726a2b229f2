"""Unit prices, comparisons between shops, locations on a map."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import geo
from larder.functions.numeric import round_half_away
from larder.operators import aggregates as A
from larder.operators import pricing as P
from larder.operators.units import convert_units
from larder.sources.tables import rates_to_long
from workload import inputs as I
from workload.marts import PER_100_G, SELLABLE, build_price_mart

LOCATIONS = list(range(0, 12))
PLACES = ", ".join(map(str, LOCATIONS))


def _priced(spark, folder):
    return P.priced_products(I.prices(spark, folder), I.products(spark, folder), I.rates(spark, folder))


def unit_price(spark, folder):
    priced = _priced(spark, folder)
    per_100 = P.unit_price(priced, "price", "product_quantity", "rate")
    per_kg = round_half_away(P.unit_price(priced, "price", "product_quantity", "rate", 1000), 2)
    return priced.select("id", "product_code", "location_id", "currency", per_100.alias("per_100g"), per_kg.alias("per_kg"))


def prices_at_locations(spark, folder):
    return I.widened(P.prices_at_locations(_priced(spark, folder), LOCATIONS, "rIng"))


def mart_prices_at_locations(spark, folder):
    return I.widened(P.mart_prices_at_locations(build_price_mart(spark, folder), LOCATIONS))


def category_location_matrix(spark, folder):
    priced = _priced(spark, folder).where("product_quantity > 0")
    per_kg = round_half_away(P.unit_price(priced, "price", "product_quantity", "rate", 1000), 2)
    offers = priced.select("id", F.col("compared_to_category").alias("category"), "location_id", per_kg.alias("per_kg"))
    matrix = P.category_location_matrix(offers, "category", "location_id", "per_kg", "id", LOCATIONS)
    cells = [F.col(f"`{x}`.{part}").alias(f"at_{x}_{part}") for x in LOCATIONS for part in ("id", "price")]
    wide = matrix.select("category", *cells).orderBy("category")
    return I.widened(wide, *[f"at_{x}_id" for x in LOCATIONS])


def _matrix_sql() -> str:
    cells = ", ".join(
        f"CAST(min(id) FILTER (location_id = {x} AND rank = 1) AS DOUBLE) AS at_{x}_id, min(per_kg) FILTER (location_id = {x}) AS at_{x}_price"
        for x in LOCATIONS
    )
    return f"SELECT category, {cells} FROM ranked GROUP BY category ORDER BY category"


def location_catalog(spark, folder):
    return P.location_catalog(build_price_mart(spark, folder)).orderBy("id", F.desc("count"))


def location_names(spark, folder):
    return P.location_names(I.prices(spark, folder), [7, 3, 5, 0])


def currency_counts(spark, folder):
    return A.value_counts(_priced(spark, folder).where("price IS NOT NULL"), "currency")


def median_price(spark, folder):
    priced = _priced(spark, folder).where(F.col("product_quantity").between(1, 30000))
    per = priced.select("p_brand", P.unit_price(priced, "price", "product_quantity", "rate").alias("per_100g"))
    return A.exact_median(per, ["p_brand"], "per_100g", "median_price", "price_count")


def bbox_select(spark, folder):
    """Shops selected by drawing a rectangle and then deselected by a smaller one inside."""
    shops = I.prices(spark, folder).select(
        F.col("location_id").alias("id"), "location_osm_lon", "location_osm_lat"
    ).distinct()
    x, y = geo.mercator_x(F.col("location_osm_lon")), geo.mercator_y(F.col("location_osm_lat"))
    none = shops.where("id IS NULL").select("id")
    drawn = P.brush(shops, none, x, y, (0.0, -0.15, 0.25, 0.0), "select")
    return P.brush(shops, drawn, x, y, (0.05, -0.06, 0.12, -0.03), "deselect")


def mercator(spark, folder):
    shops = I.prices(spark, folder).select("location_id", "location_osm_lon", "location_osm_lat").distinct()
    projected = shops.select(
        "location_id",
        geo.mercator_x(F.col("location_osm_lon")).alias("x"),
        geo.mercator_y(F.col("location_osm_lat")).alias("y"),
    )
    return I.rounded(projected, 9, "x", "y")


def fx_unpivot(spark, folder):
    """Average order value by priority as a one-row wide table of text, turned back to rows."""
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = I.table(spark, folder, "orders").groupBy().pivot("o_orderpriority", names).agg(
        F.round(F.max("o_totalprice"), 2).cast("string")
    )
    dated = wide.select(F.lit("04 July 2025").alias("Date"), *[F.col(f"`{n}`").alias(f" {n} ") for n in names])
    return I.widened(rates_to_long(dated))


def unit_convert(spark, folder):
    """Amounts in units of nations, which convert to one another within a region (opt-in; the marts ignore other units)."""
    units = I.table(spark, folder, "nation").selectExpr(
        "concat('U', n_nationkey) AS from_unit", "concat('R', n_regionkey) AS to_unit", "1 + n_nationkey / 10 AS conversion_factor"
    )
    lines = I.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity AS amount",
        "concat('U', IF(l_linenumber != 4, l_suppkey % 27, NULL)) AS unit", "concat('U', l_partkey % 25) AS wanted",
    )
    return I.rounded(convert_units(lines, "amount", "unit", "wanted", units, "converted"), 6, "converted")


QUERIES = {
    "unit_price": unit_price,
    "prices_at_locations": prices_at_locations,
    "mart_prices_at_locations": mart_prices_at_locations,
    "category_location_matrix": category_location_matrix,
    "location_catalog": location_catalog,
    "location_names": location_names,
    "currency_counts": currency_counts,
    "median_price": median_price,
    "bbox_select": bbox_select,
    "mercator": mercator,
    "fx_unpivot": fx_unpivot,
    "unit_convert": unit_convert,
}

_PER_KG = "round(1000 * shelf / grams / per_euro, 2)"
_SHOPS = "SELECT DISTINCT location_id, location_osm_lon AS lon, location_osm_lat AS lat FROM prices"
_X, _Y = "radians(lon) / (2 * pi())", "-ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())"

SQL = {
    "unit_price": I.sql(
        ["offers"],
        f"SELECT offer AS id, part AS product_code, shop AS location_id, zone AS currency, {PER_100_G} AS per_100g, {_PER_KG} AS per_kg FROM offers",
    ),
    "prices_at_locations": I.sql(
        ["offers"],
        f"""SELECT part AS product_code, offer AS price_id, shop AS location_id, category, split_part(shop_name, ',', 1) AS location_name,
        product_name, shelf AS product_price, CAST(grams AS DOUBLE) AS product_quantity, {_PER_KG} AS price_per_kg, CAST(seen AS VARCHAR) AS date
        FROM offers WHERE shop IN ({PLACES}) AND lower(product_name) LIKE '%ring%' ORDER BY price_per_kg""",
    ),
    "mart_prices_at_locations": I.sql(
        ["offers"],
        f"""SELECT product_name, split_part(shop_name, ',', 1) AS location_name, round({PER_100_G} * 10, 2) AS eur_price_per_kg,
        shelf AS product_price, zone AS currency, CAST(grams AS DOUBLE) AS product_quantity_g, part AS product_code, offer AS price_id,
        shop AS location_id, CAST(seen AS VARCHAR) AS price_date
        FROM offers JOIN (SELECT code, count(DISTINCT coalesce(ciqual_food_code, -1)) AS profiles FROM products GROUP BY code) ON code = part,
          range(profiles) WHERE shop IN ({PLACES}) AND {SELLABLE}""",
    ),
    "category_location_matrix": I.sql(
        ["offers"],
        _matrix_sql(),
        ("shown", f"""SELECT offer AS id, category, shop AS location_id, {_PER_KG} AS per_kg FROM offers
          WHERE shop IN ({PLACES}) AND grams > 0 AND category IS NOT NULL AND shelf IS NOT NULL"""),
        ("ranked", "SELECT *, rank() OVER (PARTITION BY category, location_id ORDER BY per_kg) AS rank FROM shown"),
    ),
    "location_catalog": I.sql(
        ["offers"],
        f"""SELECT shop AS id, north AS lat, east AS lon, shop_name AS name, count(*) AS count FROM offers WHERE {SELLABLE} GROUP BY ALL""",
    ),
    "location_names": I.sql(
        ["prices"],
        """SELECT CAST(list_position([7, 3, 5, 0], location_id) AS BIGINT) AS position, location_id, split_part(any_value(location_osm_display_name), ', ', 1) AS name
        FROM prices GROUP BY location_id HAVING location_id IN (7, 3, 5, 0)""",
    ),
    "currency_counts": I.sql(["offers"], "SELECT zone AS currency, count(shelf) AS count FROM offers GROUP BY zone HAVING count(shelf) > 0"),
    "median_price": I.sql(
        ["offers"],
        f"""SELECT p_brand, quantile_cont({PER_100_G}, 0.5) AS median_price, count(shelf) AS price_count FROM offers
        WHERE grams >= 1 AND grams <= 30000 AND shelf IS NOT NULL GROUP BY p_brand""",
    ),
    "bbox_select": I.sql(
        ["prices"],
        """SELECT location_id AS id FROM placed WHERE x BETWEEN 0.0 AND 0.25 AND y BETWEEN -0.15 AND 0.0
        AND NOT (x BETWEEN 0.05 AND 0.12 AND y BETWEEN -0.06 AND -0.03)""",
        ("places", _SHOPS),
        ("placed", f"SELECT location_id, {_X} AS x, {_Y} AS y FROM places"),
    ),
    "mercator": I.sql(
        ["prices"], f"SELECT location_id, round({_X}, 9) AS x, round({_Y}, 9) AS y FROM places", ("places", _SHOPS)
    ),
    "fx_unpivot": """SELECT '2025-07-04' AS date, o_orderpriority AS currency, round(max(o_totalprice), 2) AS rate FROM orders GROUP BY 2
      UNION ALL SELECT '2025-07-04', 'EUR', 1.0""",
    "unit_convert": """WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS amount,
        CASE WHEN l_linenumber <> 4 THEN l_suppkey % 27 END AS have, l_partkey % 25 AS want FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, amount, 'U' || have AS unit, 'U' || want AS wanted,
        round(CASE WHEN have = want THEN amount WHEN a.n_regionkey = b.n_regionkey
          THEN amount * (1 + a.n_nationkey / 10) / (1 + b.n_nationkey / 10) END, 6) AS converted
      FROM u LEFT JOIN nation a ON a.n_nationkey = have LEFT JOIN nation b ON b.n_nationkey = want""",
}
