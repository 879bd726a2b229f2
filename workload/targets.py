"""Nutrient targets, data-quality rules, extracted page tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import quality as Q
from larder.plans import recommendations as R
from larder.plans.nutrient_map import nutrient_groups as grouped_by_type
from larder.sources.html import extract_tables
from workload import inputs as I

MICRO = """CASE n_nationkey WHEN 3 THEN 'mg' WHEN 4 THEN 'µg' ELSE 'g' END"""


def _macro(spark, folder):
    """Targets by nation from the richest customers."""
    nations = I.table(spark, folder, "nation").where("n_regionkey < 2")
    best = I.table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.max("c_acctbal").alias("value_males"), F.min("c_acctbal").alias("value_females")
    )
    return nations.join(best, "n_nationkey").selectExpr(
        "n_name AS id", "'g' AS unit", "IF(n_nationkey = 5, NULL, value_males) AS value_males", "value_females",
        "IF(n_nationkey = 6, NULL, value_males * 2) AS value_upper_intake",
    )


def _micro(spark, folder):
    nations = I.table(spark, folder, "nation")
    best = I.table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.max("s_acctbal").alias("value_males"), F.min("s_acctbal").alias("value_females")
    )
    return nations.join(best, "n_nationkey").selectExpr(
        "n_name AS nutrient", f"{MICRO} AS unit", "value_males", "value_females", "IF(n_nationkey % 3 = 0, NULL, 20000.5D) AS value_upper_intake"
    )


def recommendations(spark, folder):
    nutrient_map = I.nutrient_map(spark, folder).withColumn("nnr2023_id", F.col("id"))
    return R.recommendations(nutrient_map, _macro(spark, folder), _micro(spark, folder))


def slider_bounds(spark, folder):
    return R.slider_bounds(recommendations(spark, folder))


def _target_cells(spark, folder):
    names = F.expr(
        "CASE c_nationkey WHEN 0 THEN 'Vitamin A, RE' WHEN 1 THEN 'Vitamin E, α-TE' WHEN 2 THEN 'Copper, μg' WHEN 3 THEN 'Potassium, g' "
        "WHEN 4 THEN 'Iodine, µg' WHEN 5 THEN 'Magnesium, mg' WHEN 6 THEN 'Molybdenum, μg' ELSE concat('N', c_nationkey, ', mg') END"
    )
    return I.table(spark, folder, "customer").groupBy(names.alias("label")).agg(
        F.max("c_acctbal").cast("string").alias("females"), F.min("c_acctbal").cast("string").alias("males"),
        F.when(F.count(F.lit(1)) % 2 == 0, "AI\u00a0 in NNR2023").alias("comment"),
    )


def _upper_cells(spark, folder):
    names = F.expr(
        "CASE s_nationkey WHEN 0 THEN 'Vitamin A' WHEN 1 THEN 'Vitamin E' WHEN 2 THEN 'Copper' WHEN 3 THEN 'Boron' "
        "WHEN 4 THEN 'Iodine' WHEN 5 THEN 'Magnesium' WHEN 6 THEN 'Molybdenum' ELSE concat('N', s_nationkey) END"
    )
    unit = F.expr("CASE name WHEN 'Vitamin A' THEN 'μg RE/d' WHEN 'Iodine' THEN 'μg/d' ELSE 'mg/d' END")
    best = I.table(spark, folder, "supplier").groupBy(names.alias("name")).agg(F.max("s_acctbal").cast("string").alias("value"))
    return best.withColumn("unit", unit)


def recommendation_merge(spark, folder):
    targets = R.target_rows(_target_cells(spark, folder), "label", "females", "males", "comment")
    uppers = R.upper_limit_rows(_upper_cells(spark, folder), "name", "unit", "value")
    return I.rounded(R.recommendation_merge(targets, uppers), 5, "value_males", "value_females", "value_upper_intake")


def merge_problems(spark, folder):
    return R.merge_problems(recommendation_merge(spark, folder)).select("rule", "nutrient")


def rule_violations(spark, folder):
    """Orders that break an expectation, counted by rule; customers are checked as a foreign key."""
    orders = I.table(spark, folder, "orders").withColumns(
        {
            "clerk": F.when(F.col("o_totalprice") > 1000, F.col("o_orderpriority")),
            "desk": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
        }
    )
    rich = I.table(spark, folder, "customer").where("c_acctbal > 0")
    rules = [
        Q.Rule("status known", Q.one_of("o_orderstatus", ["O", "F"])),
        Q.Rule("price positive", F.col("o_totalprice") >= 1000),
        Q.Rule("clerk and desk go together", Q.all_or_none("clerk", "desk")),
        Q.Rule("clerk or urgent", Q.empty_or("clerk", F.col("o_orderpriority") == "1-URGENT")),
        Q.Rule("desk required", Q.required("desk")),
    ]
    broken = Q.check_rules(orders, rules, [Q.Reference("customer known", "o_custkey", rich, "c_custkey")])
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_order"))


def nutrient_groups(spark, folder):
    grouped = grouped_by_type(I.nutrient_map(spark, folder))
    return grouped.select("nutrient_type", F.to_json("nutrients").alias("nutrients"))


def page_lists(spark, folder):
    """Rows of the lists in stored pages: the table extractor, pointed at <ul>, <li> and <a>."""
    rows = extract_tables(I.table(spark, folder, "pages"), "page_id", "html", "ul", "li", ("a",))
    return rows.select("page_id", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


def rows_by_age(spark, folder):
    """Events of each user as a table with section rows: every error event heads the events after it."""
    sections = F.element_at(F.array(F.lit("FEMALES"), F.lit("MALES"), F.lit("CHILDREN")), (F.col("event_id") % 3 + 1).cast("int"))
    events = I.table(spark, folder, "events").select(
        F.col("user_id").alias("table_no"),
        (F.col("event_id") + 1).alias("row_no"),
        F.when(F.col("event_type") == "error", F.array(sections))
        .otherwise(F.array(F.concat(F.lit("≤"), "event_type"), F.col("value").cast("string")))
        .alias("cells"),
    )
    labelled = R.rows_by_age(events)
    return labelled.select("table_no", "row_no", "individual_type", F.col("cells")[1].cast("double").alias("value"))


QUERIES = {
    "recommendations": recommendations,
    "slider_bounds": slider_bounds,
    "recommendation_merge": recommendation_merge,
    "merge_problems": merge_problems,
    "rule_violations": rule_violations,
    "nutrient_groups": nutrient_groups,
    "page_lists": page_lists,
    "rows_by_age": rows_by_age,
}

_TARGETS = [
    ("macro", """SELECT n_name AS id, 'g' AS unit, CASE WHEN n_nationkey <> 5 THEN max(c_acctbal) END AS value_males, min(c_acctbal) AS value_females,
        CASE WHEN n_nationkey <> 6 THEN max(c_acctbal) * 2 END AS value_upper_intake
      FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey < 2 GROUP BY n_name, n_nationkey"""),
    ("micro", f"""SELECT n_name AS nutrient, {MICRO} AS unit, max(s_acctbal) AS value_males, min(s_acctbal) AS value_females,
        CASE WHEN n_nationkey % 3 <> 0 THEN 20000.5 END AS value_upper_intake
      FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey"""),
    ("recs", """SELECT m.id, m.name, m.nutrient_type, coalesce(a.value_males, b.value_males) AS value_males,
        coalesce(a.value_females, b.value_females) AS value_females, coalesce(a.value_upper_intake, b.value_upper_intake) AS value_upper_intake,
        coalesce(a.unit, b.unit) AS unit
      FROM nutrient_map m LEFT JOIN macro a ON a.id = m.id LEFT JOIN micro b ON b.nutrient = m.id
      WHERE m.disabled IS NULL AND (a.value_males IS NOT NULL OR b.value_males IS NOT NULL) AND coalesce(a.unit, b.unit) = m.ciqual_unit"""),
]
_CELLS = [
    ("t", """SELECT CASE c_nationkey WHEN 0 THEN 'Vitamin A' WHEN 1 THEN 'Vitamin E' WHEN 2 THEN 'Copper' WHEN 3 THEN 'Potassium' WHEN 4 THEN 'Iodine'
          WHEN 5 THEN 'Magnesium' WHEN 6 THEN 'Molybdenum' ELSE 'N' || c_nationkey END AS nutrient,
        CASE c_nationkey WHEN 0 THEN 'RE' WHEN 1 THEN 'α-TE' WHEN 2 THEN 'µg' WHEN 3 THEN 'g' WHEN 4 THEN 'µg' WHEN 6 THEN 'µg' ELSE 'mg' END AS unit,
        CASE count(*) % 2 WHEN 0 THEN 'AI' ELSE 'RI' END AS RI_or_AI, min(c_acctbal) AS males, max(c_acctbal) AS females FROM customer GROUP BY ALL"""),
    ("u", """SELECT CASE s_nationkey WHEN 0 THEN 'Vitamin A' WHEN 1 THEN 'Vitamin E' WHEN 2 THEN 'Copper' WHEN 3 THEN 'Boron' WHEN 4 THEN 'Iodine'
          WHEN 6 THEN 'Molybdenum' ELSE 'N' || s_nationkey END AS nutrient,
        CASE s_nationkey WHEN 0 THEN 'µg RE' WHEN 4 THEN 'µg' ELSE 'mg' END AS unit, max(s_acctbal) AS upper
      FROM supplier WHERE s_nationkey <> 5 GROUP BY ALL"""),
    ("merged", """SELECT coalesce(t.nutrient, u.nutrient) AS nutrient, RI_or_AI,
        CASE WHEN t.nutrient = 'Vitamin E' AND u.unit IS NOT NULL THEN 'mg' WHEN t.nutrient = 'Copper' AND u.unit IS NOT NULL THEN 'mg'
          WHEN t.nutrient = 'Potassium' THEN 'mg' ELSE coalesce(t.unit, u.unit) END AS unit,
        CASE WHEN u.unit IS NULL THEN 1.0 WHEN t.nutrient = 'Vitamin E' THEN 1.5 WHEN t.nutrient = 'Copper' THEN 0.001 ELSE 1.0 END
          * CASE WHEN t.nutrient = 'Potassium' THEN 1000 ELSE 1 END AS factor,
        males, females, CASE WHEN t.nutrient IS NULL THEN upper
          ELSE round_even(upper * CASE WHEN t.unit = 'µg' AND u.unit = 'mg' AND t.nutrient <> 'Copper' THEN 1000.0 ELSE 1.0 END, 1) END AS upper
      FROM t FULL JOIN u ON t.nutrient = u.nutrient"""),
    ("scaled", """SELECT nutrient, unit, RI_or_AI, round(males * factor, 5) AS value_males, round(females * factor, 5) AS value_females,
        round(upper, 5) AS value_upper_intake FROM merged"""),
]

SQL = {
    "recommendations": I.sql(["nutrient_map"], "SELECT * FROM recs", *_TARGETS),
    "slider_bounds": I.sql(
        ["nutrient_map"],
        """SELECT id, name, unit, nutrient_type, 0 AS min, CASE WHEN top = 0 THEN 100.0 ELSE top END AS max, value_males AS lower,
          coalesce(value_upper_intake, CASE WHEN top = 0 THEN 100.0 ELSE top END) AS upper, 1 AS active
        FROM (SELECT *, CASE WHEN value_upper_intake IS NULL THEN 4 * value_males ELSE ceil(value_upper_intake + value_males) END AS top FROM recs)""",
        *_TARGETS,
    ),
    "recommendation_merge": I.sql([], "SELECT * FROM scaled", *_CELLS),
    "merge_problems": I.sql(
        [],
        """SELECT 'target of males not below upper limit' AS rule, nutrient FROM scaled WHERE value_males >= value_upper_intake
        UNION ALL SELECT 'target of females not below upper limit', nutrient FROM scaled WHERE value_females >= value_upper_intake""",
        *_CELLS,
    ),
    "rule_violations": """WITH o AS (SELECT *, CASE WHEN o_totalprice > 1000 THEN o_orderpriority END AS clerk,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS desk FROM orders),
      b AS (SELECT 'status known' AS rule, o_orderkey FROM o WHERE o_orderstatus NOT IN ('O', 'F')
        UNION ALL SELECT 'price positive', o_orderkey FROM o WHERE o_totalprice < 1000
        UNION ALL SELECT 'clerk and desk go together', o_orderkey FROM o WHERE (clerk IS NULL) <> (desk IS NULL)
        UNION ALL SELECT 'clerk or urgent', o_orderkey FROM o WHERE clerk IS NOT NULL AND o_orderpriority <> '1-URGENT'
        UNION ALL SELECT 'desk required', o_orderkey FROM o WHERE desk IS NULL
        UNION ALL SELECT 'customer known', o_orderkey FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
      SELECT rule, count(*) AS rows, min(o_orderkey) AS first_order FROM b GROUP BY rule""",
    "nutrient_groups": I.sql(
        ["nutrient_map"],
        """SELECT nutrient_type, '[' || string_agg('{"id":"' || id || '","name":"' || name || '","unit":"' || ciqual_unit || '"}', ',' ORDER BY id) || ']' AS nutrients
        FROM nutrient_map GROUP BY nutrient_type""",
    ),
    "page_lists": r"""WITH lists AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1)) AS list,
        unnest(range(len(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1)))) AS table_no FROM pages),
      items AS (SELECT page_id, table_no, unnest(regexp_extract_all(list, '(?s)<li>(.*?)</li>', 1)) AS item,
        unnest(range(len(regexp_extract_all(list, '(?s)<li>(.*?)</li>', 1)))) AS row_no FROM lists)
      SELECT page_id, CAST(table_no AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no, trim(replace(replace(replace(regexp_extract(item, '(?s)<a[^>]*>(.*?)</a>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS cells FROM items""",
    "rows_by_age": """WITH e AS (SELECT user_id, event_id, event_type, value,
        last_value(CASE WHEN event_type = 'error' THEN ['female', 'male', 'child'][event_id % 3 + 1] END IGNORE NULLS)
          OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM events)
      SELECT user_id AS table_no, event_id + 1 AS row_no, coalesce(section, 'child') || ' (<=' || event_type || ')' AS individual_type, value
      FROM e WHERE event_type <> 'error'""",
}
