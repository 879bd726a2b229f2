"""The readers' parsing on the test tables rendered as the text that files would hold, and the sinks read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.objective import check_objective, compile_objective
from larder.runtime import shared_folder
from larder.sources import schemas as S
from larder.sources import sinks
from larder.sources import tables as T
from larder.sources import xml
from workload import inputs as I

# Every seventh value is unknown, every eleventh a trace; every 97th record lacks its closing tags.
_MEASURE = "CASE WHEN event_id % 7 = 0 THEN '-' WHEN event_id % 11 = 0 THEN 'traces' ELSE concat(CAST(floor(value) AS BIGINT), ',5') END"


def _records(spark, folder) -> DataFrame:
    return I.table(spark, folder, "events").selectExpr(
        f"""concat('<COMPO><alim_code> ', user_id, ' </alim_code><const_code> ', event_id, ' </const_code><teneur> ', {_MEASURE},
            ' </teneur><min> - </min><max> < 5 & more </max><code_confiance> ', event_type, ' </code_confiance>',
            IF(event_id % 97 = 0, '<source_code>', concat('<source_code> ', event_id % 50, ' </source_code>'))) AS value"""
    )


def ciqual_xml(spark, folder):
    """Composition rows from XML records, with unescaped signs in them."""
    return I.widened(T.ciqual_compo(xml.xml_rows(_records(spark, folder), "COMPO", S.CIQUAL_COMPO)))


def xml_rejects(spark, folder):
    rejected = xml.unreadable_xml(_records(spark, folder), "COMPO", S.CIQUAL_COMPO)
    return rejected.select(F.regexp_extract("value", r"<const_code> (\d+) <", 1).cast("long").alias("event_id"))


def _calnut_rows(spark, folder) -> DataFrame:
    return I.table(spark, folder, "events").selectExpr(
        "CAST(user_id AS STRING) AS ALIM_CODE", "event_type AS FOOD_LABEL", "concat(event_type, '_mg') AS CONST_LABEL",
        "CAST(event_id AS STRING) AS CONST_CODE", "CAST(event_id % 2 AS STRING) AS indic_combl",
        "concat(CAST(floor(value) AS BIGINT), ',25') AS LB", "CAST(NULL AS STRING) AS UB",
        "IF(event_id % 13 = 0, 'about 3', concat(CAST(floor(value) AS BIGINT), ',75')) AS MB",
    )


def calnut_values(spark, folder):
    return I.widened(T.calnut_values(_calnut_rows(spark, folder)).drop("ub"))


def calnut_rejects(spark, folder):
    return T.unreadable_calnut(_calnut_rows(spark, folder)).select(F.col("CONST_CODE").alias("const_code"), F.col("MB").alias("given"))


def calnut_foods(spark, folder):
    """Customers listed once per hypothesis; one of the three rows is kept."""
    rows = I.table(spark, folder, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS ALIM_CODE", "c_name AS FOOD_LABEL", "explode(array('LB', 'MB', 'UB')) AS HYPOTH", "c_mktsegment AS alim_grp_code"
    )
    return T.calnut_foods(rows)


def agribalyse_values(spark, folder):
    """Suppliers as impact rows under the published headers; those without a code are padding."""
    values = {new: f"CAST(s_acctbal + {i} AS STRING)" for i, new in enumerate(S.AGRIBALYSE_NAMES.values())}
    values |= {n: f"concat('{n} of ', s_name)" for n in S.AGRIBALYSE_TEXT}
    values |= {n: "CAST(s_suppkey AS STRING)" for n in S.AGRIBALYSE_LONG}
    values["ciqual_food_code"] = "IF(s_suppkey % 5 = 0, NULL, CAST(s_suppkey AS STRING))"
    rows = I.table(spark, folder, "supplier").select(*[F.expr(values[new]).alias(old) for old, new in S.AGRIBALYSE_NAMES.items()])
    return T.agribalyse_values(rows)


def subset_rows(spark, folder):
    """Orders of two priorities and three customers, by the key lists that cut a worked example out of whole tables."""
    tables = {"orders": I.table(spark, folder, "orders"), "part": I.table(spark, folder, "part")}
    keys = {"orders": {"o_orderpriority": ["1-URGENT", "5-LOW"], "o_custkey": list(range(1, 40))}}
    return T.subset(tables, keys)["orders"]


OBJECTIVES = ["l_tax + l_discount", "l_quantity // 2", "l_linenumber + l_partkey", "isnan(l_tax)", "l_nothing + 1", "drop table lines;"]


def objective_check(spark, folder):
    """What each objective's check says, and the mean of those that pass."""
    lines = I.table(spark, folder, "lineitem")
    told = [(text, *check_objective(text, lines)) for text in OBJECTIVES]
    means = [F.avg(compile_objective(t, lines.schema)) if ok else F.lit(None).cast("double") for t, ok, _ in told]
    cells = [F.struct(F.lit(t).alias("objective"), F.lit(ok).alias("valid"), F.round(m, 6).alias("mean")) for (t, ok, _), m in zip(told, means, strict=True)]
    return lines.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def special_values(spark, folder):
    lines = I.table(spark, folder, "lineitem")
    made = {"nan": "isnan(l_tax)", "finite": "isfinite(l_extendedprice)", "infinite": "isinf(l_quantity)", "negative": "signbit(l_tax - 0.04)"}
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[compile_objective(t, lines.schema).alias(n) for n, t in made.items()])


def table_sink(spark, folder):
    """Orders written in ranges of the customer, and read back."""
    orders = I.table(spark, folder, "orders")
    return sinks.write_table(orders, f"{shared_folder(spark)}/{uuid.uuid4().hex}", ["o_custkey"], "o_orderkey")


def csv_sink(spark, folder):
    """Parts as CSV, and read back with their schema."""
    parts = I.table(spark, folder, "part")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    sinks.write_csv(parts, path)
    return spark.read.schema(parts.schema).option("header", True).option("escape", '"').csv(path)


QUERIES = {
    "ciqual_xml": ciqual_xml,
    "xml_rejects": xml_rejects,
    "calnut_values": calnut_values,
    "calnut_rejects": calnut_rejects,
    "calnut_foods": calnut_foods,
    "agribalyse_values": agribalyse_values,
    "subset_rows": subset_rows,
    "objective_check": objective_check,
    "special_values": special_values,
    "table_sink": table_sink,
    "csv_sink": csv_sink,
}


def _agribalyse_sql() -> str:
    cells = []
    for i, new in enumerate(S.AGRIBALYSE_NAMES.values()):
        if new in S.AGRIBALYSE_TEXT:
            cells.append(f"'{new} of ' || s_name AS {new}")
        else:
            cells.append(f"s_suppkey AS {new}" if new in S.AGRIBALYSE_LONG else f"s_acctbal + {i} AS {new}")
    return f"SELECT {', '.join(cells)} FROM supplier WHERE s_suppkey % 5 <> 0"


SQL = {
    "ciqual_xml": """SELECT user_id AS alim_code, event_id AS const_code, event_type AS code_confiance, event_id % 50 AS source_code,
        CAST(NULL AS DOUBLE) AS lb, CAST(NULL AS DOUBLE) AS ub,
        CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0.0 ELSE floor(value) + 0.5 END AS mean FROM events WHERE event_id % 97 <> 0""",
    "xml_rejects": "SELECT event_id FROM events WHERE event_id % 97 = 0",
    "calnut_values": """SELECT user_id AS ALIM_CODE, event_type AS FOOD_LABEL, event_type || '_mg' AS CONST_LABEL, event_id AS CONST_CODE,
        event_id % 2 = 1 AS combl, floor(value) + 0.25 AS lb, CASE WHEN event_id % 13 <> 0 THEN floor(value) + 0.75 END AS mean FROM events""",
    "calnut_rejects": "SELECT CAST(event_id AS VARCHAR) AS const_code, 'about 3' AS given FROM events WHERE event_id % 13 = 0",
    "calnut_foods": "SELECT c_custkey AS ALIM_CODE, c_name AS FOOD_LABEL, c_mktsegment AS alim_grp_code FROM customer",
    "agribalyse_values": _agribalyse_sql(),
    "subset_rows": "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey BETWEEN 1 AND 39",
    "objective_check": """SELECT 'l_tax + l_discount' AS objective, TRUE AS valid, round(avg(l_tax + l_discount), 6) AS mean FROM lineitem
      UNION ALL SELECT 'l_quantity // 2', TRUE, round(avg(l_quantity // 2), 6) FROM lineitem
      UNION ALL SELECT text, FALSE, NULL FROM (VALUES ('l_linenumber + l_partkey'), ('isnan(l_tax)'), ('l_nothing + 1'), ('drop table lines;')) AS t(text)""",
    "special_values": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, isnan(l_tax) AS nan, isfinite(l_extendedprice) AS finite,
        isinf(l_quantity) AS infinite, signbit(l_tax - 0.04) AS negative FROM lineitem""",
    "table_sink": "SELECT * FROM orders",
    "csv_sink": "SELECT * FROM part",
}
