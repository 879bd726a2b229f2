"""Semi, anti, full and lookup joins; key sets; grouped counts; ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as X
from larder.functions.numeric import two_decimals
from larder.operators import aggregates as A
from larder.operators import ordered as O
from larder.operators import sets as S
from larder.plans import nutrient_map as M
from workload import inputs as I

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def semi_priced(spark, folder):
    """Products with at least one large sale."""
    large = I.table(spark, folder, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return I.table(spark, folder, "part").join(large, "p_partkey", "left_semi")


def anti_unpriced(spark, folder):
    large = I.table(spark, folder, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return I.table(spark, folder, "part").join(large, "p_partkey", "left_anti")


def in_unnest(spark, folder):
    """Orders whose priority is in a list that is itself a table column."""
    lists = I.table(spark, folder, "region").select(F.array(F.concat(F.col("r_regionkey") + 1, F.lit("-URGENT")), F.concat(F.lit("5-"), F.upper("r_name"))).alias("wanted"))
    wanted = lists.select(F.explode("wanted").alias("o_orderpriority")).unionByName(lists.select(F.lit("5-LOW").alias("o_orderpriority")))
    return I.table(spark, folder, "orders").join(wanted, "o_orderpriority", "left_semi")


def label_unnest(spark, folder):
    """Measures of a line as a list of (name, amount), unnested; lines with a NULL or an empty list vanish."""
    measures = F.expr(
        """CASE l_returnflag WHEN 'A' THEN array(named_struct('name', 'quantity', 'amount', l_quantity),
             named_struct('name', 'price', 'amount', l_extendedprice), named_struct('name', 'tax', 'amount', l_tax))
           WHEN 'N' THEN array() END"""
    )
    lines = I.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", measures.alias("m"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.inline("m"))


def unit_counts(spark, folder):
    """How often each unit occurs in the label lists of the catalog."""
    units = I.products(spark, folder).select(F.explode("nutriments.unit").alias("unit"))
    return A.value_counts(units, "unit")


def nova_counts(spark, folder):
    return I.widened(A.value_counts(I.products(spark, folder), "nova_group").orderBy(F.desc("nova_group")), "nova_group")


def tag_counts(spark, folder):
    """Words of all product names, counted."""
    words = I.products(spark, folder).select(F.explode(F.split(F.col("product_name")[0]["text"], " ")).alias("tag"))
    return A.value_counts(words, "tag")


def union_codes(spark, folder):
    return S.union_codes(
        "code",
        (I.table(spark, folder, "customer"), "c_custkey"),
        (I.table(spark, folder, "events"), "user_id"),
        (I.table(spark, folder, "supplier"), "s_suppkey"),
    )


def _key_sets(spark, folder):
    return {
        "in_orders": I.table(spark, folder, "orders").select(F.col("o_custkey").alias("code")),
        "in_events": I.table(spark, folder, "events").select(F.col("user_id").alias("code")),
        "in_suppliers": I.table(spark, folder, "supplier").select((F.col("s_suppkey") * 3).alias("code")),
    }


def key_diff(spark, folder):
    sets = _key_sets(spark, folder)
    return S.key_differences(sets["in_orders"], sets["in_suppliers"], "code", ("orders", "suppliers"))


def venn_regions(spark, folder):
    return A.venn_regions(_key_sets(spark, folder), "code")


def same_keys(spark, folder):
    sets = _key_sets(spark, folder)
    return S.same_keys(sets["in_events"], sets["in_suppliers"], "code")


def only_in_first(spark, folder):
    """Customers that neither other set has, with their names."""
    sets = _key_sets(spark, folder)
    customers = I.table(spark, folder, "customer").withColumnRenamed("c_custkey", "code")
    return S.only_in_first(customers, [sets["in_events"], sets["in_suppliers"]], "code").select("code", "c_name")


def full_merge(spark, folder):
    """Totals of customers and of suppliers, one row per nation that has either."""
    customers = I.table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.max("c_acctbal").alias("best_customer"), F.count(F.lit(1)).alias("customers")
    )
    suppliers = I.table(spark, folder, "supplier").where("s_acctbal > 3000").groupBy(
        (F.col("s_nationkey") + 3).alias("nation")
    ).agg(F.max("s_acctbal").alias("best_supplier"))
    merged = customers.join(suppliers, "nation", "full")
    return I.widened(merged.withColumn("best", F.coalesce("best_supplier", "best_customer")), "customers")


def best_per_group(spark, folder):
    lines = I.table(spark, folder, "lineitem")
    order = [-F.col("l_extendedprice"), *[F.col(c) for c in LINE_ORDER]]
    return O.best_per_group(lines, ["l_orderkey"], order).select("l_orderkey", *LINE_ORDER)


def running_segments(spark, folder):
    """Cumulative quantity of each supplier's lines, latest shipment first."""
    lines = I.table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", *[c for c in LINE_ORDER if c != "l_suppkey"])
    order = [F.desc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax")]
    return O.running_segments(lines, ["l_suppkey"], order, "l_quantity")


def fill_down(spark, folder):
    """The latest error value seen by each user, carried to the events after it."""
    events = I.table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")
    marked = events.withColumn("header", F.when(F.col("event_type") == "error", F.col("value")))
    return O.fill_down(marked, ["user_id"], ["ts", "event_id"], "header", "section").drop("header")


def row_numbers(spark, folder):
    parts = I.table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    return O.numbered(parts, [F.desc("p_name"), F.asc("p_partkey")])


def column_profile(spark, folder):
    """Every numeric column of the lines."""
    profile = A.column_profile(I.table(spark, folder, "lineitem"))
    return profile.select("column_name", "min", "max", two_decimals(F.col("mean")).alias("mean"))


def column_catalog(spark, folder):
    """Described float columns of parts and prices, some left out by name."""
    lines = I.table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_tax").alias("l_tax", metadata={"comment": "Tax rate"}),
        F.col("l_discount").alias("l_discount", metadata={"comment": "Discount rate"}),
        "l_quantity",
        "l_extendedprice",
    )
    return A.column_catalog(lines, "l_extended.....|l_quantity")


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
]


def table_inventory(spark, folder):
    return A.table_inventory({n: I.table(spark, folder, n) for n in TABLES})


def nutrient_map_counts(spark, folder):
    """Nutrients of the map with how often labels name them, in the map's order."""
    fields = {c: F.lit(None).cast("string") for c in M.MAP_COLUMNS}
    numbered = I.nutrient_map(spark, folder).withColumns(
        {
            "off_id": F.expr("CASE n_nationkey WHEN 0 THEN 'proteins' WHEN 1 THEN 'fat' WHEN 2 THEN 'salt' END"),
            "row_num": F.col("n_nationkey"),
        }
    )
    filled = numbered.withColumns({c: v for c, v in fields.items() if c not in numbered.columns})
    return I.widened(M.nutrient_map_counts(filled, I.products(spark, folder)).select("id", "off_id", "count"), "count")


def nutrient_map_refresh(spark, folder):
    """Event types as constants of one source, brands as constants of the other."""
    events = I.table(spark, folder, "events").select((F.col("user_id") % 30).alias("CONST_CODE"), F.concat_ws(
        "_", F.lit("of"), F.lit("user"), (F.col("user_id") % 30).cast("string")).alias("CONST_LABEL"))
    nations = I.table(spark, folder, "customer").select(
        F.col("c_nationkey").cast("long").alias("const_code"),
        F.concat(F.lit("Constant "), F.col("c_nationkey").cast("string")).alias("const_nom_eng"),
        F.concat(F.lit("Constante "), F.col("c_nationkey").cast("string")).alias("const_nom_fr"),
    ).distinct()
    base = I.nutrient_map(spark, folder).withColumns(
        {
            "ciqual_const_code": F.col("n_nationkey").cast("long") + 5,
            "calnut_const_code": F.col("n_nationkey").cast("long") + 10,
            "row_num": F.col("n_nationkey"),
        }
    )
    filled = base.withColumns({c: F.lit(None).cast("string") for c in M.MAP_COLUMNS if c not in base.columns})
    refreshed = M.nutrient_map_refresh(filled, nations, M.calnut_constants(events))
    shown = refreshed.select(
        "id", "ciqual_const_code", "ciqual_const_name_eng", "ciqual_const_name_fr", "calnut_const_code",
        "calnut_const_name", "calnut_unit",
    )
    return I.widened(shown, "ciqual_const_code", "calnut_const_code")


def match_label_names(spark, folder):
    """Product names as table headers, matched to earlier rows by header or by lower-cased name."""
    parts = I.table(spark, folder, "part")
    headers = parts.select(
        F.when(F.col("p_size") % 3 == 0, F.concat(F.initcap("p_name"), F.lit(" or more (g/100g)")))
        .when(F.col("p_size") % 3 == 1, F.concat(F.upper("p_name"), F.lit(" (kJ/100g)")))
        .otherwise(F.col("p_name"))
        .alias("header")
    ).distinct()
    text = F.lit(None).cast("string")
    known = parts.where("p_size < 10").groupBy("p_name").agg(F.min("p_partkey").alias("position"), F.max("p_size").alias("n"))
    known = known.select(
        "position",
        F.when(F.col("n") % 2 == 0, F.concat(F.upper("p_name"), F.lit(" (kJ/100g)"))).alias("ciqual_id"),
        F.lit("g").alias("ciqual_unit"),
        F.col("p_name").alias("off_id"),
        F.col("n").cast("string").alias("count"),
        text.alias("nnr2023_id"),
        text.alias("comments"),
    )
    return M.match_label_names(headers, "header", known)


def text_parts(spark, folder):
    """Text functions over the given tables: splitting, replacing, matching, dates."""
    lines = I.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate"
    )
    shown = F.when(F.col("l_quantity") > 40, "-").when(F.col("l_quantity") < 3, "traces").otherwise(
        F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(","))
    )
    label = F.concat_ws("_", F.lit("total_of"), "l_returnflag", "l_linestatus")
    return I.widened(
        lines.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            X.measured(shown).alias("measured"),
            X.yes_no(F.when(F.col("l_returnflag") == "A", "1").otherwise("0")).alias("flag"),
            X.name_and_unit(label)["name"].alias("name"),
            X.name_and_unit(label)["unit"].alias("unit"),
            X.join_text(F.lit("a_"), F.nullif("l_returnflag", F.lit("R")), F.lit("_"), "l_linestatus").alias("joined"),
            X.one_micro_sign(F.concat(F.lit("μ"), "l_returnflag")).alias("micro"),
            X.plain_age(F.concat(F.lit("≤"), "l_returnflag", F.lit("\u00ad"))).alias("age"),
            X.is_hex_color(F.concat(F.lit("#00ff0"), "l_returnflag")).alias("is_color"),
            X.matches_whole(F.concat(F.lit("l_"), "l_returnflag"), "l_[A-M]|l_").alias("whole"),
            X.first_parts(F.concat_ws(", ", "l_returnflag", "l_linestatus", F.lit("c"), F.lit("d")), 3).alias("address"),
            X.day_month_year(F.date_format("l_shipdate", "dd MMMM yyyy")).alias("day"),
            two_decimals(F.col("l_quantity")).alias("printed"),
        )
    )


QUERIES = {
    "semi_priced": semi_priced,
    "anti_unpriced": anti_unpriced,
    "in_unnest": in_unnest,
    "label_unnest": label_unnest,
    "unit_counts": unit_counts,
    "nova_counts": nova_counts,
    "tag_counts": tag_counts,
    "union_codes": union_codes,
    "key_diff": key_diff,
    "venn_regions": venn_regions,
    "same_keys": same_keys,
    "only_in_first": only_in_first,
    "full_merge": full_merge,
    "best_per_group": best_per_group,
    "running_segments": running_segments,
    "fill_down": fill_down,
    "row_numbers": row_numbers,
    "column_profile": column_profile,
    "column_catalog": column_catalog,
    "table_inventory": table_inventory,
    "nutrient_map_counts": nutrient_map_counts,
    "nutrient_map_refresh": nutrient_map_refresh,
    "match_label_names": match_label_names,
    "text_parts": text_parts,
}

_SETS = """in_orders AS (SELECT DISTINCT o_custkey AS code FROM orders), in_events AS (SELECT DISTINCT user_id AS code FROM events),
  in_suppliers AS (SELECT DISTINCT s_suppkey * 3 AS code FROM supplier)"""
_LINES = ", ".join(LINE_ORDER)

SQL = {
    "semi_priced": "SELECT * FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)",
    "anti_unpriced": "SELECT * FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)",
    "in_unnest": "SELECT * FROM orders WHERE o_orderpriority IN (SELECT unnest(['1-URGENT', '5-LOW']))",
    "label_unnest": " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{n}' AS name, {c} AS amount FROM lineitem WHERE l_returnflag = 'A'"
        for n, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("tax", "l_tax"))
    ),
    "unit_counts": I.sql(["labels"], "SELECT unit, count(*) AS count FROM labels GROUP BY unit"),
    "nova_counts": I.sql(["products"], "SELECT CAST(nova_group AS DOUBLE) AS nova_group, count(*) AS count FROM products GROUP BY 1"),
    "tag_counts": I.sql(
        ["products"],
        "SELECT tag, count(*) AS count FROM (SELECT unnest(string_split(product_name, ' ')) AS tag FROM products) GROUP BY tag",
    ),
    "union_codes": "SELECT c_custkey AS code FROM customer UNION SELECT user_id FROM events UNION SELECT s_suppkey FROM supplier",
    "key_diff": f"""WITH {_SETS} SELECT code, 'orders' AS only_in FROM (SELECT code FROM in_orders EXCEPT SELECT code FROM in_suppliers)
      UNION ALL SELECT code, 'suppliers' FROM (SELECT code FROM in_suppliers EXCEPT SELECT code FROM in_orders)""",
    "venn_regions": f"""WITH {_SETS}, m AS (SELECT coalesce(a.code, b.code, c.code) AS code, CAST(a.code IS NOT NULL AS INT) AS in_orders,
        CAST(b.code IS NOT NULL AS INT) AS in_events, CAST(c.code IS NOT NULL AS INT) AS in_suppliers
      FROM in_orders a FULL JOIN in_events b ON a.code = b.code FULL JOIN in_suppliers c ON c.code = coalesce(a.code, b.code))
      SELECT in_orders, in_events, in_suppliers, count(*) AS keys FROM m GROUP BY ALL""",
    "same_keys": f"""WITH {_SETS}, d AS (SELECT (SELECT count(*) FROM (SELECT code FROM in_events EXCEPT SELECT code FROM in_suppliers)) AS left_only,
        (SELECT count(*) FROM (SELECT code FROM in_suppliers EXCEPT SELECT code FROM in_events)) AS right_only)
      SELECT *, left_only = 0 AND right_only = 0 AS same FROM d""",
    "only_in_first": f"""WITH {_SETS} SELECT c_custkey AS code, c_name FROM customer
      WHERE c_custkey NOT IN (SELECT code FROM in_events) AND c_custkey NOT IN (SELECT code FROM in_suppliers)""",
    "full_merge": """WITH c AS (SELECT c_nationkey AS nation, max(c_acctbal) AS best_customer, count(*) AS customers FROM customer GROUP BY 1),
      s AS (SELECT s_nationkey + 3 AS nation, max(s_acctbal) AS best_supplier FROM supplier WHERE s_acctbal > 3000 GROUP BY 1)
      SELECT coalesce(c.nation, s.nation) AS nation, best_customer, CAST(customers AS DOUBLE) AS customers, best_supplier, coalesce(best_supplier, best_customer) AS best
      FROM c FULL JOIN s ON c.nation = s.nation""",
    "best_per_group": f"""SELECT DISTINCT ON (l_orderkey) l_orderkey, {_LINES} FROM lineitem
      ORDER BY l_orderkey, l_extendedprice DESC, {_LINES}""",
    "running_segments": """SELECT *, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC,
        l_partkey DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC ROWS UNBOUNDED PRECEDING) AS end_value, end_value - l_quantity AS start_value
      FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem)""",
    "fill_down": """SELECT event_id, user_id, ts, event_type, value, last_value(CASE event_type WHEN 'error' THEN value END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events""",
    "row_numbers": "SELECT p_partkey, p_name, p_retailprice, row_number() OVER (ORDER BY p_name DESC, p_partkey) AS row_num FROM part",
    "column_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, printf('%.2f', CAST(avg({c}) AS FLOAT)) AS mean FROM lineitem"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
    "column_catalog": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS comment, min({c}) AS min, max({c}) AS max, printf('%.2f', CAST(avg({c}) AS FLOAT)) AS mean FROM lineitem"
        for c, t in (("l_tax", "Tax rate"), ("l_discount", "Discount rate"))
    ),
    "table_inventory": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, {n} AS n_cols, count(*) * {n} AS n_cells FROM {t}"
        for t, n in (
            ("region", 2), ("nation", 3), ("customer", 5), ("supplier", 4), ("part", 6), ("orders", 6), ("lineitem", 11), ("events", 6),
            ("documents", 5), ("embeddings", 3), ("pages", 3), ("benchmark", 2), ("labels", 3), ("conversations", 4),
        )
    ),
    "nutrient_map_counts": I.sql(
        ["labels", "nutrient_map"],
        """SELECT id, off_id, CAST(count AS DOUBLE) AS count FROM (SELECT id, CASE n_nationkey WHEN 0 THEN 'proteins' WHEN 1 THEN 'fat' WHEN 2 THEN 'salt' END AS off_id
        FROM nutrient_map) LEFT JOIN (SELECT off_id, count(*) AS count FROM labels GROUP BY 1) USING (off_id)""",
    ),
    "nutrient_map_refresh": I.sql(
        ["nutrient_map"],
        """SELECT id, CAST(q.code AS DOUBLE) AS ciqual_const_code, 'Constant ' || q.code AS ciqual_const_name_eng, 'Constante ' || q.code AS ciqual_const_name_fr,
          CAST(n.code AS DOUBLE) AS calnut_const_code, n.name AS calnut_const_name, n.unit AS calnut_unit
        FROM nutrient_map m FULL JOIN q ON q.code = m.n_nationkey + 5 FULL JOIN n ON n.code = m.n_nationkey + 10""",
        ("q", "SELECT DISTINCT c_nationkey AS code FROM customer"),
        ("n", """SELECT code, regexp_extract(label, '(.+)_(\\w+)', 1) AS name, regexp_extract(label, '(.+)_(\\w+)', 2) AS unit
          FROM (SELECT DISTINCT user_id % 30 AS code, 'of_user_' || user_id % 30 AS label FROM events)"""),
    ),
    "match_label_names": """WITH h AS (SELECT DISTINCT upper(p_name[1:1]) || p_name[2:] AS cap, p_name, p_size % 3 AS kind FROM part WHERE p_size % 3 < 2),
      named AS (SELECT DISTINCT CASE kind WHEN 0 THEN (SELECT string_agg(upper(w[1:1]) || w[2:], ' ') FROM unnest(string_split(p_name, ' ')) AS t(w))
          || ' or more (g/100g)' ELSE upper(p_name) || ' (kJ/100g)' END AS header,
        CASE kind WHEN 0 THEN 'g' ELSE 'kj' END AS unit, p_name AS low,
        CASE kind WHEN 0 THEN (SELECT string_agg(upper(w[1:1]) || w[2:], ' ') FROM unnest(string_split(p_name, ' ')) AS t(w)) ELSE upper(p_name) END AS name FROM h),
      k AS (SELECT p_name, CASE WHEN max(p_size) % 2 = 0 THEN upper(p_name) || ' (kJ/100g)' END AS ciqual_id, CAST(max(p_size) AS VARCHAR) AS count
        FROM part WHERE p_size < 10 GROUP BY p_name),
      listed AS (SELECT named.*, k.p_name AS off_id, k.count FROM named JOIN k ON k.ciqual_id = header)
      SELECT header AS ciqual_const_name_eng, name, unit AS ciqual_unit, off_id, count, CAST(NULL AS VARCHAR) AS nnr2023_id, CAST(NULL AS VARCHAR) AS comments FROM listed
      UNION ALL SELECT header, name, unit, k.p_name, k.count, NULL, NULL FROM named LEFT JOIN k ON k.p_name = low
        WHERE header NOT IN (SELECT header FROM listed)
      UNION ALL SELECT NULL, NULL, 'g', p_name, count, NULL, NULL FROM k WHERE ciqual_id IS NULL""",
    "text_parts": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN l_quantity > 40 THEN NULL WHEN l_quantity < 3 THEN 0 ELSE l_quantity END AS measured, l_returnflag = 'A' AS flag,
        'total_of_' || l_returnflag AS name, l_linestatus AS unit, concat('a_', nullif(l_returnflag, 'R'), '_', l_linestatus) AS joined,
        'µ' || l_returnflag AS micro, '<=' || l_returnflag AS age, l_returnflag = 'A' AS is_color, l_returnflag = 'A' AS whole,
        l_returnflag || ', ' || l_linestatus || ', c' AS address, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, printf('%.2f', l_quantity) AS printed
      FROM lineitem""",
}
