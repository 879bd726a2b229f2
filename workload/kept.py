"""Inputs written and read back: profiles that grow, counts taken while loading, file order, XML and CSV; and cells, bitmaps and draws."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.numeric import two_decimals
from larder.functions.objective import compile_objective
from larder.operators import aggregates as A
from larder.operators.ordered import in_file_order
from larder.operators.profiles import ProfiledTable
from larder.operators.quality import write_counted
from larder.operators.regions import Plane, points_in_rectangles
from larder.runtime import shared_folder
from larder.sources import schemas as S
from larder.sources import tables as T
from larder.sources.xml import read_clean_xml_rows, read_xml_rows
from workload import inputs as I
from workload.loaders import _calnut_rows

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice"]
PLANE = Plane(-50.0, -10.0, 150.0, 100.0)


def _fresh(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def appended_profile(spark, folder):
    """The profile of the lines' stored table: most rows written and profiled, then a slice appended and profiled alone."""
    lines = I.table(spark, folder, "lineitem")
    path = _fresh(spark)
    table = ProfiledTable(spark, path, _fresh(spark), lines.schema)
    for part in ("l_orderkey % 10 <> 3", "l_orderkey % 10 = 3"):
        lines.where(part).write.mode("append").parquet(path)
        table.update()
    return table.profile().select("column_name", "n_rows", "filled", "min", "max", two_decimals(F.col("mean")).alias("mean"))


def _counted(spark, folder) -> tuple[DataFrame, DataFrame]:
    return write_counted(_calnut_rows(spark, folder), T.readable_calnut(), _fresh(spark), T.calnut_values)


def counted_table(spark, folder):
    """Composition rows as they were written, while the unreadable ones were counted."""
    return I.widened(_counted(spark, folder)[0].drop("ub"))


def counted_rules(spark, folder):
    """How many rows broke each rule, from the pass that wrote the table."""
    return _counted(spark, folder)[1]


def _xml_files(spark, folder) -> str:
    """Events as records of well-formed windows-1252 files."""
    path = _fresh(spark)
    records = I.table(spark, folder, "events").selectExpr(
        "CAST(user_id AS STRING) AS alim_code", "CAST(event_id AS STRING) AS const_code", "concat('café < ', floor(value)) AS teneur",
        "CAST(NULL AS STRING) AS min", "concat(event_type, ' & more') AS max",
    )
    written = records.write.format("xml").option("rowTag", "COMPO").option("rootTag", "TABLE")
    written.option("charset", "windows-1252").option("declaration", 'version="1.0" encoding="windows-1252"').save(path)
    return path


XML_COLUMNS = ["alim_code", "const_code", "teneur", "min", "max"]


def clean_xml(spark, folder):
    """Well-formed records by Spark's XML source."""
    schema = S._text(*XML_COLUMNS)
    return read_clean_xml_rows(spark, _xml_files(spark, folder), "COMPO", schema).drop("_corrupt_record")


def repaired_xml(spark, folder):
    """The same files by the reader that repairs records."""
    return read_xml_rows(spark, _xml_files(spark, folder), "COMPO", S._text(*XML_COLUMNS))


def file_order(spark, folder):
    """Orders numbered by their place in eight CSV files, each read in several splits."""
    orders = I.table(spark, folder, "orders").select(*ORDER_COLUMNS)
    path = _fresh(spark)
    orders.repartitionByRange(8, F.desc("o_orderkey")).sortWithinPartitions(F.desc("o_orderkey")).write.option("header", True).csv(path)
    return in_file_order(T.read_csv(spark, path, orders.schema))


def rectangle_points(spark, folder):
    """Which suppliers lie in which customers' rectangles, some of them large, some without any extent."""
    points = I.table(spark, folder, "supplier").selectExpr("s_suppkey", "s_acctbal / 100 + s_nationkey AS x", "s_acctbal / 200 AS y")
    rectangles = I.table(spark, folder, "customer").selectExpr(
        "c_custkey", "c_acctbal / 100 AS x0", "c_acctbal / 200 AS y0", "c_acctbal / 100 + c_nationkey * c_nationkey / 9 AS x1", "c_acctbal / 200 + c_custkey % 7 AS y1"
    )
    return points_in_rectangles(points, rectangles, PLANE).select("s_suppkey", "c_custkey")


DRAWN = "random() + 10 * random() * l_discount"


def seeded_random(spark, folder):
    """A random objective over lines, the same however they are dealt."""
    lines = I.table(spark, folder, "lineitem").repartition("l_tax", "l_orderkey")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(compile_objective(DRAWN, lines.schema, key, 7), 9).alias("drawn"))


def _id_sets(spark, folder) -> dict[str, DataFrame]:
    lines, parts = I.table(spark, folder, "lineitem"), I.table(spark, folder, "part")
    kept = {
        "sold": lines, "returned": lines.where("l_returnflag = 'R'"), "cheap": lines.where("l_extendedprice < 5000"), "many": lines.where("l_quantity > 45"),
    }
    sets = {name: df.select(F.col("l_partkey").alias("key")) for name, df in kept.items()}
    wanted = {"listed": "true", "small": "p_size < 5", "steel": "p_type = 'STANDARD'"}
    return sets | {name: parts.where(test).select(F.col("p_partkey").alias("key")) for name, test in wanted.items()}


def venn_bitmaps(spark, folder):
    """Parts in each combination of seven sets, by bitmaps."""
    return A.venn_bitmaps(_id_sets(spark, folder), "key")


def rates_csv(spark, folder):
    """Exchange rates written as CSV and read by their loader."""
    path = _fresh(spark)
    I.rates(spark, folder).withColumn("more", F.lit("x, y")).write.option("header", True).csv(path)
    return T.exchange_rates(spark, path)


def colors_csv(spark, folder):
    """A dimension file whose codes look like numbers."""
    path = _fresh(spark)
    I.colors(spark, folder).withColumn("alim_ssgrp_nom_eng", F.lit("a group")).select("alim_ssgrp_nom_eng", "alim_ssgrp_code", "color").write.option("header", True).csv(path)
    return T.ssgrp_colors(spark, path).select("color", "alim_ssgrp_code")


def prices_parquet(spark, folder):
    """Shelf prices stored with fewer columns than the pinned schema has; the others are NULL."""
    path = _fresh(spark)
    prices = I.prices(spark, folder)
    prices.write.parquet(path)
    read = T.prices(spark, path)
    return I.widened(read.select(*prices.columns, F.col("owner").isNull().alias("no_owner")))


def products_parquet(spark, folder):
    """Catalog rows stored with all columns that the loader needs, and its choice of a food code."""
    path = _fresh(spark)
    parts = I.table(spark, folder, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS code", "array(p_brand) AS countries_tags", "p_size AS nova_group", "p_size * 2 AS ecoscore_score", "p_size * 3 AS nutriscore_score",
        "array(named_struct('lang', 'main', 'text', p_name)) AS product_name", "'g' AS product_quantity_unit", "CAST(p_size AS STRING) AS product_quantity",
        "'about' AS quantity", "p_type AS categories", "array(p_type) AS categories_tags", "p_type AS compared_to_category",
        """named_struct('ciqual_food_code', IF(p_size % 3 = 0, p_size, NULL), 'agribalyse_food_code', IF(p_size % 3 = 1, p_size + 1, NULL),
           'agribalyse_proxy_food_code', IF(p_size % 2 = 0, p_size + 2, NULL)) AS categories_properties""",
    ).withColumn("nutriments", F.lit(None).cast(S.NUTRIMENTS))
    parts.write.parquet(path)
    shown = T.products(spark, path).select("code", "nova_group", "eco_score", "nutri_score", "product_quantity", "ciqual_food_code", "ciqual_food_code_origin")
    return I.widened(shown, "ciqual_food_code")


QUERIES = {
    "appended_profile": appended_profile,
    "counted_table": counted_table,
    "counted_rules": counted_rules,
    "clean_xml": clean_xml,
    "repaired_xml": repaired_xml,
    "file_order": file_order,
    "rectangle_points": rectangle_points,
    "seeded_random": seeded_random,
    "venn_bitmaps": venn_bitmaps,
    "rates_csv": rates_csv,
    "colors_csv": colors_csv,
    "prices_parquet": prices_parquet,
    "products_parquet": products_parquet,
}


def _drawn_sql() -> str:
    """The generator's whole-number steps, a nested query for each."""
    prime = 2**31 - 1

    def stream(n: int) -> str:
        start = (7 * 69621 + n * 40692) % prime
        step = f"SELECT *, (k % {prime} + (k >> 31) % {prime} * 3 + {start}) % {prime} AS s{n} FROM "
        inner = ""
        for factor, term, shift in ((48271, 12345, 15), (39373, 907, 13), (62089911, 11, 16), (16807, 7, 11)):
            inner = f"SELECT * EXCLUDE (s{n}), (xor(s{n}, s{n} >> {shift}) * {factor} + {term}) % {prime} AS s{n} FROM ({inner or step + '@'})"
        return inner

    lines = "(SELECT *, l_orderkey * 8 + l_linenumber AS k FROM lineitem)"
    both = stream(2).replace("@", f"({stream(1).replace('@', lines)})")
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST(s1 AS DOUBLE) / {prime} + 10 * (CAST(s2 AS DOUBLE) / {prime}) * l_discount, 9) AS drawn
      FROM ({both})"""


_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_XML = """SELECT CAST(user_id AS VARCHAR) AS alim_code, CAST(event_id AS VARCHAR) AS const_code, 'café < ' || CAST(floor(value) AS BIGINT) AS teneur,
    CAST(NULL AS VARCHAR) AS min, event_type || ' & more' AS max FROM events"""

SQL = {
    "appended_profile": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS filled, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
        printf('%.2f', CAST(avg({c}) AS FLOAT)) AS mean FROM lineitem""" for c in _NUMERIC
    ),
    "counted_table": """SELECT user_id AS ALIM_CODE, event_type AS FOOD_LABEL, event_type || '_mg' AS CONST_LABEL, event_id AS CONST_CODE,
        event_id % 2 = 1 AS combl, floor(value) + 0.25 AS lb, CASE WHEN event_id % 13 <> 0 THEN floor(value) + 0.75 END AS mean FROM events""",
    "counted_rules": " UNION ALL ".join(
        f"SELECT '{c} is readable' AS rule, {'count(*) FILTER (event_id % 13 = 0)' if c == 'MB' else '0'} AS broken, count(*) AS n_rows FROM events" for c in ("LB", "UB", "MB")
    ),
    "clean_xml": _XML,
    "repaired_xml": _XML,
    "file_order": "SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey DESC) AS row_num FROM orders",
    "rectangle_points": """SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, s_acctbal / 100 + s_nationkey AS x, s_acctbal / 200 AS y FROM supplier),
        (SELECT c_custkey, c_acctbal / 100 AS x0, c_acctbal / 200 AS y0, c_acctbal / 100 + c_nationkey * c_nationkey / 9 AS x1, c_acctbal / 200 + c_custkey % 7 AS y1 FROM customer)
      WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""",
    "seeded_random": _drawn_sql(),
    "venn_bitmaps": """WITH flagged AS (SELECT l_partkey AS key, 1 AS sold, l_returnflag = 'R' AS returned, l_extendedprice < 5000 AS cheap, l_quantity > 45 AS many,
          0 AS listed, FALSE AS small, FALSE AS steel FROM lineitem
        UNION ALL SELECT p_partkey, 0, FALSE, FALSE, FALSE, 1, p_size < 5, p_type = 'STANDARD' FROM part),
      member AS (SELECT key, max(sold) AS sold, max(returned::INT) AS returned, max(cheap::INT) AS cheap, max(many::INT) AS many, max(listed) AS listed,
        max(small::INT) AS small, max(steel::INT) AS steel FROM flagged GROUP BY key)
      SELECT sold, returned, cheap, many, listed, small, steel, count(*) AS keys FROM member GROUP BY ALL""",
    "rates_csv": "SELECT n_name AS currency, 1 + n_nationkey / 10 AS rate FROM nation WHERE n_regionkey < 4",
    "colors_csv": "SELECT '#0000' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS color, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '01' AS alim_ssgrp_code FROM nation WHERE n_nationkey < 20",
    "prices_parquet": I.sql(["prices"], """SELECT id, product_code, price, CAST(date AS VARCHAR) AS date, location_id, currency, location_osm_id, location_osm_display_name,
        location_osm_lat, location_osm_lon, TRUE AS no_owner FROM prices"""),
    "products_parquet": """SELECT CAST(p_partkey AS VARCHAR) AS code, p_size AS nova_group, p_size * 2 AS eco_score, p_size * 3 AS nutri_score, CAST(p_size AS DOUBLE) AS product_quantity,
        CAST(CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN p_size + 1 WHEN p_size % 2 = 0 THEN p_size + 2 END AS DOUBLE) AS ciqual_food_code,
        CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'agribalyse_' WHEN p_size % 2 = 0 THEN 'agribalyse_proxy_' ELSE 'unknown' END AS ciqual_food_code_origin FROM part""",
}
