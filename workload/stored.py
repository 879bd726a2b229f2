"""Stored tables: bucketed in the catalog, and marts that are refreshed by changed buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.plans import refresh as R
from larder.plans.vocabulary import PRICE_COLUMNS
from larder.runtime import materialize, shared_folder
from larder.sources import catalog as C
from workload import inputs as I
from workload.marts import FOOD_MART_SQL, PRICE_MART_SQL

COMMENTS = {"p_partkey": "Key of the part", "p_name": "It's the part's name", "p_retailprice": "Price of one, in EUR"}
BUCKETS = 16


def _fresh(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _stored(spark, folder: str) -> tuple[str, str]:
    """Line items and parts as catalog tables in the same buckets of the part's key."""
    names = []
    for table, key in (("lineitem", "l_partkey"), ("part", "p_partkey")):
        names.append(f"{table}_{uuid.uuid4().hex}")
        rows = I.table(spark, folder, table).withColumnRenamed("l_partkey", "p_partkey")
        comment = f"All of {table}, by 'part'"
        C.save_bucketed(rows, names[-1], "p_partkey", BUCKETS, _fresh(spark), comment, COMMENTS if table == "part" else None)
    return names[0], names[1]


def bucketed_join(spark, folder):
    """Line items beside their parts; bucket meets bucket, so the rows of neither table move."""
    lines, parts = _stored(spark, folder)
    joined = C.join_bucketed(spark, lines, parts, "p_partkey")
    return joined.select("l_orderkey", "l_linenumber", "p_partkey", "p_name", "p_retailprice", "l_extendedprice", "l_quantity")


def catalog_comments(spark, folder):
    """What the catalog says of a stored table and its columns, and how many values each column has."""
    _, parts = _stored(spark, folder)
    table = C.read_table(spark, parts)
    about = C.column_comments(spark, parts).withColumn("table_comment", F.lit(C.table_comment(spark, parts)))
    counted = table.agg(*[F.count(c).alias(c) for c in table.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in table.columns])
    return about.join(counted.select(F.inline(cells)), "column").select("column", "comment", "table_comment", "filled")


def _yesterday(prices: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs as they were before a few products' rows came, went and changed."""
    key = F.col("product_code").cast("long")
    before = prices.where("id % 1000 <> 41").withColumn("price", F.when(key <= 2, F.col("price") * 2).otherwise(F.col("price")))
    code = F.col("code").cast("long")
    gone = products.where(code == 7).withColumn("code", F.lit("-1"))  # a product that is no longer there
    listed = products.where(code != 4).unionByName(gone)
    return before, listed.withColumn("product_quantity", F.when(code == 5, F.lit(10).cast("float")).otherwise(F.col("product_quantity")))


def _today(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Prices and products. Refreshes read prices several times, so their rows are put together once and stored."""
    return materialize(I.prices(spark, folder)), I.products(spark, folder)


def _shared_inputs(spark, folder) -> dict[str, DataFrame]:
    """The other tables of a mart; those that are sums over events are stored, as refreshes read them several times."""
    made = {
        "ciqual_alim": I.ciqual_alim(spark, folder), "ciqual_compo": I.ciqual_compo(spark, folder), "calnut_1": I.calnut_1(spark, folder),
        "agribalyse": I.agribalyse(spark, folder), "colors": I.colors(spark, folder),
    }
    return made | {name: materialize(made[name]) for name in ("ciqual_compo", "calnut_1")}


def price_mart_refresh(spark, folder):
    """The price mart of yesterday's inputs, brought up to date: only buckets of changed products are computed."""
    today = _today(spark, folder)
    store = R.Store(spark, _fresh(spark))
    columns = {old: new for old, new in PRICE_COLUMNS.items() if old in I.PRICE_COLUMNS}
    others = {"rates": I.rates(spark, folder)} | _shared_inputs(spark, folder)
    for prices, products in (_yesterday(*today), today):
        mart = R.refresh_price_mart(store, prices, products, I.NUTRIENTS, I.IDS, columns, **others)
    return I.widened(mart.table, "ciqual_code", "ciqual_food_code")


def food_mart_refresh(spark, folder):
    """The food mart, likewise: changed offers touch the foods they are of."""
    today = _today(spark, folder)
    offers, foods = R.Store(spark, _fresh(spark)), R.Store(spark, _fresh(spark))
    others = _shared_inputs(spark, folder)
    others["calnut_0"] = others["calnut_1"].select("ALIM_CODE").distinct()
    for prices, products in (_yesterday(*today), today):
        mart = R.refresh_food_mart(offers, foods, prices, products, I.rates(spark, folder), I.NUTRIENTS, I.IDS, **others)
    return I.widened(mart.table, "ciqual_code", "price_count")


def serving_refresh(spark, folder):
    """A serving copy of the orders: first without some customers' and with others' old status, then as they are."""
    orders = I.table(spark, folder, "orders")
    store = R.Store(spark, _fresh(spark))
    old = orders.where("o_custkey % 100 <> 7").withColumn("o_orderstatus", F.expr("IF(o_custkey % 100 = 8, '?', o_orderstatus)"))
    for table in (old.unionByName(orders.where("o_custkey % 100 = 9")), orders):
        copy = R.mirror(store, table, "o_custkey")
    return copy.table


QUERIES = {
    "bucketed_join": bucketed_join,
    "catalog_comments": catalog_comments,
    "price_mart_refresh": price_mart_refresh,
    "food_mart_refresh": food_mart_refresh,
    "serving_refresh": serving_refresh,
}

_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _comments_sql() -> str:
    quoted = {c: COMMENTS.get(c, "").replace("'", "''") for c in _PART}
    rows = [f"SELECT '{c}' AS column, '{text}' AS comment, 'All of part, by ''part''' AS table_comment, count({c}) AS filled FROM part" for c, text in quoted.items()]
    return " UNION ALL ".join(rows)


SQL = {
    "bucketed_join": "SELECT l_orderkey, l_linenumber, p_partkey, p_name, p_retailprice, l_extendedprice, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey",
    "catalog_comments": _comments_sql(),
    "price_mart_refresh": PRICE_MART_SQL,
    "food_mart_refresh": FOOD_MART_SQL,
    "serving_refresh": "SELECT * FROM orders",
}
