"""Food, product and price tables derived from the test tables, once as DataFrames and once as SQL.

A part is a product, a lineitem a shelf price, a supplier a shop, a nation a currency; the
events of a user are the composition of a food, and customers and suppliers describe foods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.plans.nutrition import Nutrient
from larder.plans.vocabulary import IMPACT_COLUMNS
from larder.sources.schemas import NUTRIMENTS
from larder.sources.tables import with_food_code

NUTRIENTS = [
    Nutrient("calcium", None, 4, "mg", 4, "mg"),
    Nutrient("energy_fibre_kcal", "energy-kcal", 1, "kcal", 1, "kcal"),
    Nutrient("fat", "fat", 2, "g", 2, "g"),
    Nutrient("iodine", "iodine", 5, "µg", 5, "mcg"),
    Nutrient("protein", "proteins", 3, "g", 3, "g"),
]
IDS = ["energy_fibre_kcal", "protein", "fat", "calcium", "iodine", "folates"]
CONST_CODES = {"view": 1, "click": 2, "purchase": 3, "signup": 4, "error": 5}


#: Columns of the price table that the test tables have something for.
PRICE_COLUMNS = [
    "id", "price", "currency", "location_id", "location_osm_id", "location_osm_display_name", "location_osm_lat", "location_osm_lon", "date",
]

_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once and pinned after that."""
    path = f"{folder}/{name}.parquet"
    if (folder, name) not in _schemas:
        _schemas[folder, name] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[folder, name]).parquet(path)


def prices(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS id", "CAST(l_partkey AS STRING) AS product_code",
        "CASE WHEN l_returnflag != 'R' THEN l_extendedprice END AS price", "l_suppkey",
        "CAST(l_shipdate AS DATE) AS date",
    )
    shops = table(spark, folder, "supplier")
    nations = table(spark, folder, "nation")
    placed = lines.join(shops, F.col("l_suppkey") == F.col("s_suppkey"))
    return placed.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "id", "product_code", "price", "date", "s_suppkey AS location_id", "n_name AS currency",
        "s_suppkey + 1000 AS location_osm_id",
        "concat_ws(', ', s_name, n_name, 'Main Street', 'Town') AS location_osm_display_name",
        "s_acctbal / 200 AS location_osm_lat", "s_acctbal / 100 + s_nationkey AS location_osm_lon",
    )


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """Nations without a rate (region 4) are unknown currencies."""
    known = table(spark, folder, "nation").where("n_regionkey < 4")
    return known.selectExpr("n_name AS currency", "1 + n_nationkey / 10 AS rate")


def products(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as catalog rows with label lists; Brand#7 is listed twice, once with another quantity."""

    def label(name: str, unit: str, amount: str) -> str:
        fields = {"name": f"'{name}'", "unit": unit, "value": amount, "100g": amount}
        fields |= dict.fromkeys(("serving", "prepared_100g", "prepared_value", "prepared_serving", "prepared_unit"), "NULL")
        return f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())})"

    entries = [
        label("energy-kcal", "'kcal'", "floor(p_retailprice / 4)"),
        label("proteins", "IF(p_size != 20, 'g', NULL)", "p_size / 2"),
        label("fat", "'g'", "IF(p_size != 30, p_size / 4, NULL)"),
        label("iodine", "'g'", "p_size / 8"),
        label("proteins", "'g'", "p_size * 2"),
    ]
    shaped = table(spark, folder, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS code",
        "array(named_struct('lang', 'main', 'text', p_name)) AS product_name",
        "CASE p_size WHEN 1 THEN 0 WHEN 2 THEN 40000 ELSE p_size * 40 END AS grams",
        "'g' AS product_quantity_unit",
        f"IF(p_type != 'SMALL', array({', '.join(entries)}), array()) AS nutriments",
        "p_type AS compared_to_category",
        "IF(p_type = 'LARGE', NULL, p_size) AS nova_group",
        "p_brand",
        """named_struct('ciqual_food_code', CAST(IF(p_type = 'STANDARD', p_partkey % 400, NULL) AS INT),
           'agribalyse_food_code', IF(p_type = 'ECONOMY', p_size, NULL),
           'agribalyse_proxy_food_code', IF(p_type IN ('PROMO', 'SMALL'), p_size * 2, NULL)) AS categories_properties""",
        "explode(IF(p_brand = 'Brand#7', array(1.0D, 0.5D), array(1.0D))) AS share",
    )
    typed = shaped.withColumns(
        {
            "product_quantity": F.expr("CAST(grams * share AS FLOAT)"),
            "nutriments": F.col("nutriments").cast(NUTRIMENTS),
        }
    )
    return with_food_code(typed).drop("share", "grams", "categories_properties")


def compositions(spark: SparkSession, folder: str) -> DataFrame:
    """Event values per user and type: (food, const_code, high, low, entries)."""
    code = F.create_map(*[F.lit(x) for pair in CONST_CODES.items() for x in pair])
    return table(spark, folder, "events").groupBy(
        F.col("user_id").alias("food"), F.try_element_at(code, F.col("event_type")).alias("const_code")
    ).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.count(F.lit(1)).alias("entries"))


def ciqual_compo(spark: SparkSession, folder: str) -> DataFrame:
    return compositions(spark, folder).selectExpr(
        "food AS alim_code", "const_code", "CASE WHEN entries > 12 THEN 'A' WHEN entries > 9 THEN 'B' END AS code_confiance",
        "entries AS source_code", "CAST(IF(high > 40, high, NULL) AS FLOAT) AS mean",
    )


def calnut_1(spark: SparkSession, folder: str) -> DataFrame:
    return compositions(spark, folder).selectExpr(
        "food AS ALIM_CODE", "const_code AS CONST_CODE", "entries > 10 AS combl", "CAST(IF(low < 3, low, NULL) AS FLOAT) AS mean"
    )


def ciqual_alim(spark: SparkSession, folder: str) -> DataFrame:
    group = "lpad(CAST(c_nationkey AS STRING), 2, '0')"
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS alim_code", "c_name AS alim_nom_eng", f"{group} AS alim_grp_code",
        f"concat({group}, '01') AS alim_ssgrp_code", "'000000' AS alim_ssssgrp_code",
    )


def colors(spark: SparkSession, folder: str) -> DataFrame:
    key = "lpad(CAST(n_nationkey AS STRING), 2, '0')"
    return table(spark, folder, "nation").where("n_nationkey < 20").selectExpr(
        f"concat('#0000', {key}) AS color", f"concat({key}, '01') AS alim_ssgrp_code"
    )


def agribalyse(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS ciqual_food_code", *[f"s_acctbal + {i} AS {c}" for i, c in enumerate(IMPACT_COLUMNS)]
    )


def nutrient_map(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as nutrients, for the queries on targets."""
    return table(spark, folder, "nation").selectExpr(
        "n_name AS id", "concat('Name of ', n_name) AS name", "IF(n_regionkey = 0, 'macro', 'mineral') AS nutrient_type",
        "IF(n_nationkey % 2 = 0, 'g', 'mg') AS ciqual_unit", "IF(n_regionkey = 3, 'true', NULL) AS disabled",
        "n_nationkey", "n_regionkey",
    )


_impacts = ", ".join(f"s_acctbal + {i} AS {c}" for i, c in enumerate(IMPACT_COLUMNS))

SQL = {
    "shops": """SELECT s_suppkey AS location_id, n_name AS currency, s_suppkey + 1000 AS location_osm_id,
        s_name || ', ' || n_name || ', Main Street, Town' AS location_osm_display_name,
        s_acctbal / 200 AS location_osm_lat, s_acctbal / 100 + s_nationkey AS location_osm_lon
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "prices": """SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey AS VARCHAR) AS product_code,
        CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price, CAST(l_shipdate AS DATE) AS date, shops.*
      FROM lineitem JOIN shops ON location_id = l_suppkey""",
    "rates": "SELECT n_name AS currency, 1 + n_nationkey / 10 AS rate FROM nation WHERE n_regionkey < 4",
    "products": """SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS product_name, p_brand, p_type AS compared_to_category,
        CAST(share * CASE p_size WHEN 1 THEN 0 WHEN 2 THEN 40000 ELSE p_size * 40 END AS FLOAT) AS product_quantity,
        'g' AS product_quantity_unit, CASE WHEN p_type <> 'LARGE' THEN p_size END AS nova_group, p_size, p_type, p_retailprice,
        CASE p_type WHEN 'STANDARD' THEN p_partkey % 400 WHEN 'ECONOMY' THEN p_size WHEN 'PROMO' THEN p_size * 2
          WHEN 'SMALL' THEN p_size * 2 END AS ciqual_food_code,
        CASE p_type WHEN 'STANDARD' THEN '' WHEN 'ECONOMY' THEN 'agribalyse_' WHEN 'PROMO' THEN 'agribalyse_proxy_'
          WHEN 'SMALL' THEN 'agribalyse_proxy_' ELSE 'unknown' END AS ciqual_food_code_origin
      FROM part, (VALUES (1.0), (0.5)) AS copies(share) WHERE share = 1 OR p_brand = 'Brand#7'""",
    "labels": """SELECT code, ciqual_food_code, 'energy-kcal' AS off_id, 'kcal' AS unit, CAST(floor(p_retailprice / 4) AS FLOAT) AS amount
        FROM products WHERE p_type <> 'SMALL'
      UNION ALL SELECT code, ciqual_food_code, 'proteins', CASE WHEN p_size <> 20 THEN 'g' END, CAST(p_size / 2 AS FLOAT)
        FROM products WHERE p_type <> 'SMALL'
      UNION ALL SELECT code, ciqual_food_code, 'fat', 'g', CASE WHEN p_size <> 30 THEN CAST(p_size / 4 AS FLOAT) END
        FROM products WHERE p_type <> 'SMALL'
      UNION ALL SELECT code, ciqual_food_code, 'iodine', 'g', CAST(p_size / 8 AS FLOAT) FROM products WHERE p_type <> 'SMALL'
      UNION ALL SELECT code, ciqual_food_code, 'proteins', 'g', CAST(p_size * 2 AS FLOAT) FROM products WHERE p_type <> 'SMALL'""",
    "compositions": """SELECT user_id AS food, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3
        WHEN 'signup' THEN 4 WHEN 'error' THEN 5 END AS const_code, max(value) AS high, min(value) AS low, count(*) AS entries
      FROM events GROUP BY ALL""",
    "ciqual_compo": """SELECT food AS alim_code, const_code, CASE WHEN entries > 12 THEN 'A' WHEN entries > 9 THEN 'B' END AS code_confiance,
        entries AS source_code, CASE WHEN high > 40 THEN CAST(high AS FLOAT) END AS mean FROM compositions""",
    "calnut_1": """SELECT food AS alim_code, const_code, entries > 10 AS combl, CASE WHEN low < 3 THEN CAST(low AS FLOAT) END AS mean
      FROM compositions""",
    "ciqual_alim": """SELECT c_custkey AS alim_code, c_name AS alim_nom_eng, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS alim_grp_code,
        lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '01' AS alim_ssgrp_code, '000000' AS alim_ssssgrp_code FROM customer""",
    "colors": """SELECT '#0000' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS color,
        lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '01' AS ssgrp FROM nation WHERE n_nationkey < 20""",
    "agribalyse": f"SELECT s_suppkey AS food, {_impacts} FROM supplier",
    "nutrients": """SELECT * FROM (VALUES ('calcium', NULL, 4, 'mg', 4, 'mg'), ('energy_fibre_kcal', 'energy-kcal', 1, 'kcal', 1, 'kcal'),
        ('fat', 'fat', 2, 'g', 2, 'g'), ('iodine', 'iodine', 5, 'µg', 5, 'mcg'), ('protein', 'proteins', 3, 'g', 3, 'g'))
        AS t(nutrient_id, off_id, qcode, qunit, ncode, nunit)""",
    # A shelf price with its product and what its currency is worth; one row per catalog row of the product.
    "offers": """SELECT prices.id AS offer, products.code AS part, currency AS zone, rate AS per_euro, prices.price AS shelf, date AS seen,
        location_id AS shop, location_osm_id AS shop_osm, location_osm_display_name AS shop_name, location_osm_lat AS north,
        location_osm_lon AS east, product_name, product_quantity AS grams, product_quantity_unit, p_brand, compared_to_category AS category,
        ciqual_food_code AS food
      FROM rates JOIN prices USING (currency) JOIN products ON products.code = product_code""",
    # What is known about a food besides its nutrients; customers describe it, suppliers give its impacts.
    "food_about": """SELECT foods.alim_code AS described, foods.alim_nom_eng, foods.alim_grp_code, foods.alim_ssgrp_code, foods.alim_ssssgrp_code,
        colors.color FROM ciqual_alim AS foods LEFT JOIN colors ON ssgrp = alim_ssgrp_code""",
    "nutrient_map": """SELECT n_name AS id, 'Name of ' || n_name AS name, CASE n_regionkey WHEN 0 THEN 'macro' ELSE 'mineral' END AS nutrient_type,
        CASE WHEN n_nationkey % 2 = 0 THEN 'g' ELSE 'mg' END AS ciqual_unit, CASE WHEN n_regionkey = 3 THEN 'true' END AS disabled,
        n_nationkey, n_regionkey FROM nation""",
}
_ORDER = list(SQL)
_NEEDS = {
    "offers": ["prices", "products", "rates"], "food_about": ["ciqual_alim", "colors"], "prices": ["shops"], "labels": ["products"], "ciqual_compo": ["compositions"], "calnut_1": ["compositions"],
}


def sql(inputs: list[str], body: str, *more: tuple[str, str]) -> str:
    """A query over derived inputs: WITH the inputs (and further named steps), then the body."""
    wanted = set(inputs)
    for name in reversed(_ORDER):
        if name in wanted:
            wanted.update(_NEEDS.get(name, []))
    steps = [(n, SQL[n]) for n in _ORDER if n in wanted] + list(more)
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in steps) + f"\n{body}"


def widened(df: DataFrame, *gaps: str) -> DataFrame:
    """Types that both sides of a comparison print alike: 32-bit floats as doubles, dates as text,
    and integer columns with NULLs (`gaps`) as doubles, which data-frame libraries make of them anyway."""
    wider = {"float": "double", "date": "string"}
    kinds = {f.name: wider.get(f.dataType.typeName()) for f in df.schema.fields} | dict.fromkeys(gaps, "double")
    return df.withColumns({name: F.col(name).cast(kind) for name, kind in kinds.items() if kind})


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns whose sums depend on the order of addition, cut to a fixed number of digits."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})
