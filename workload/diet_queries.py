"""Objectives, candidate tables, optimal diets and what is reported about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.objective import compile_objective
from larder.plans import diets as D
from larder.plans import reports as R
from larder.runtime import materialize
from workload import inputs as I
from workload.marts import CHOICE_INPUTS, PER_100_G, PROFILES, SELLABLE, STEPS, build_price_mart

# Objectives over line items.
OBJECTIVES = {
    "arithmetic": "sqrt(pow(l_tax, 2) + pow(l_discount, 2)) + abs(l_quantity - 25) / 7",
    "quotients": "l_extendedprice // l_quantity + l_linenumber // 2 + l_quantity / l_linenumber",
    "bits": "((l_linenumber & 5) | 2) + (l_linenumber << 2) - (l_linenumber >> 1) + ~l_linenumber",
    "factorials": "l_linenumber! + factorial(3) * 1.0",
    "integers": "gcd(l_partkey, l_suppkey) + lcm(l_linenumber, 6) * 1.0 + bit_count(l_linenumber) + xor(l_linenumber, 3)",
    "cut": "ceil(l_extendedprice) - floor(l_quantity / 3) + trunc(-l_extendedprice) + even(l_quantity / 4)",
    "nearest": "round(l_extendedprice / 7, 2) + round_even(l_quantity / 2, 0) * 1.0",
    "bounds": "greatest(l_tax, l_discount, 0.03) - least(l_tax, l_discount, 0.05) + sign(l_tax - 0.04)",
    "division": "fdiv(l_extendedprice, l_quantity) + fmod(l_extendedprice, 7) + divide(l_quantity, 3)",
    "named": "add(multiply(l_tax, 100), subtract(l_discount, 1)) + @(l_discount - 0.05)",
}
TRANSCENDENT = {
    "powers": "(l_tax + 1) ^ 3 - l_discount ** 2 % 3",
    "logs": "ln(l_quantity) + log(l_extendedprice) + log10(l_quantity) + log2(l_linenumber)",
    "angles": "sin(l_quantity) + cos(l_tax) + tan(l_discount) + cot(l_quantity) + degrees(l_tax) + radians(l_quantity) + pi()",
    "inverse": "asin(l_tax) + acos(l_discount) + atan(l_quantity) + atan2(l_tax, l_quantity)",
    "hyperbolic": "asinh(l_quantity) + acosh(l_quantity) + atanh(l_tax)",
    "special": "gamma(l_linenumber) + lgamma(l_quantity) + cbrt(l_quantity) + exp(l_tax) + nextafter(l_tax, 1)",
}
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUTRIENTS = ["energy_fibre_kcal", "protein", "fat"]
OBJECTIVE = "price * (1 + calcium / 1000)"


def objective_value(spark, folder):
    lines = I.table(spark, folder, "lineitem")
    values = [compile_objective(t, lines.schema).cast("double").alias(n) for n, t in OBJECTIVES.items()]
    return lines.select(*LINE_KEYS, *values)


def objective_functions(spark, folder):
    """Functions whose last digits depend on the math library, to nine significant digits' worth."""
    lines = I.table(spark, folder, "lineitem")
    values = [compile_objective(t, lines.schema).cast("double").alias(n) for n, t in TRANSCENDENT.items()]
    return I.rounded(lines.select(*LINE_KEYS, *values), 6, *TRANSCENDENT)


def candidate_products(spark, folder):
    locations = I.table(spark, folder, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("location_id"))
    return I.widened(D.candidate_products(build_price_mart(spark, folder), locations, NUTRIENTS, OBJECTIVE), "ciqual_code")


def lp_input_matrix(spark, folder):
    parts = I.table(spark, folder, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") / 2).alias("a"), "p_retailprice")
    return I.widened(D.lp_input_matrix(parts, "item", ["a", "p_retailprice"]))


def _offers(spark, folder) -> DataFrame:
    """Every line item as an offer of its part's brand: cost and three contents per unit of the part."""
    parts = I.table(spark, folder, "part").selectExpr(
        "p_partkey", "p_brand AS scenario", "CAST(p_size AS DOUBLE) AS protein",
        "CAST(p_partkey * 7 % 90 + 1 AS DOUBLE) AS fat", "p_retailprice / 10 AS energy",
    )
    lines = I.table(spark, folder, "lineitem").selectExpr(
        "l_partkey AS p_partkey", "l_orderkey * 10 + l_linenumber AS item", "l_extendedprice / l_quantity / 100 AS objective"
    )
    return lines.join(parts, "p_partkey").drop("p_partkey")


def _brands(spark, folder) -> DataFrame:
    return I.table(spark, folder, "part").select(F.col("p_brand").alias("scenario")).distinct()


def _bounds(scenarios: DataFrame, asked: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    rows = [
        F.struct(F.lit(n).alias("nutrient_id"), F.lit(lo).cast("double").alias("lower"), F.lit(hi).cast("double").alias("upper"))
        for n, (lo, hi) in asked.items()
    ]
    return scenarios.select("scenario", F.inline(F.array(*rows)))


THREE = {"protein": (60.0, 90.0), "fat": (70.0, 100.0), "energy": (200.0, 220.0)}


def diet_one_bound(spark, folder):
    """Only a lower bound on protein: the optimum is the best price per gram, so SQL can check it."""
    offers = _offers(spark, folder)
    solved = D.optimize_diets(offers, _bounds(_brands(spark, folder), {"protein": (60.0, None)}), ["protein"])
    return I.rounded(solved.scenarios.select("scenario", "status", "objective"), 6, "objective")


def diet_certificates(spark, folder):
    """Three ranges per brand: status, least cost, and whether it is proven over all the brand's candidates."""
    bounds = _bounds(_brands(spark, folder), THREE)
    solved = D.optimize_diets(_offers(spark, folder), bounds, list(THREE))
    return I.rounded(D.certificate(solved, bounds).select("scenario", "status", "objective", "proven"), 6, "objective")


def diet_infeasible(spark, folder):
    """A protein target that cannot be met under the fat limit comes back as a status, not as an error."""
    offers = _offers(spark, folder)
    solved = D.optimize_diets(offers, _bounds(_brands(spark, folder), {"protein": (1e6, None), "fat": (None, 1.0)}), ["protein", "fat"])
    return solved.scenarios.select("scenario", "status")


def diet_two_bounds(spark, folder):
    """Lower bounds on two nutrients: an optimum buys one or two products, which SQL can try out."""
    bounds = _bounds(_brands(spark, folder), {"protein": (60.0, None), "fat": (70.0, None)})
    solved = D.optimize_diets(_offers(spark, folder), bounds, ["protein", "fat"])
    return I.rounded(solved.scenarios.select("scenario", "status", "objective"), 6, "objective")


#: With one bound that binds, the optimum is the offer of the best price per gram.
NEEDED = 50.0
ZONE_BOUNDS = {"protein": (NEEDED, None), "fat": (None, 1e9)}


def _solved_from_mart(spark, folder):
    """Diets per currency zone from the price mart: a zone's shops are its scenario's places.

    Zones, candidates and the report read the mart, so what they need of it is made once and stored.
    """
    item = F.concat_ws("-", "price_id", "product_code", "location_id", "price_date", F.col("product_quantity").cast("int"))
    read = [*D.OFFER_COLUMNS, *NUTRIENTS, "calcium", "product_currency", "location_id", "price_date", "product_quantity"]
    mart = materialize(build_price_mart(spark, folder).select(*read, item.alias("item")))
    zones = mart.select(F.col("product_currency").alias("scenario"), F.col("location_id").alias("place")).distinct()
    bounds = _bounds(zones.select("scenario").distinct(), ZONE_BOUNDS)
    solved = D.optimize_diets(D.place_candidates(mart, NUTRIENTS, OBJECTIVE, F.col("item")), bounds, NUTRIENTS, zones)
    return mart, bounds, solved


def diet_report(spark, folder):
    mart, _, solved = _solved_from_mart(spark, folder)
    return I.widened(D.diet_report(solved, mart), "ciqual_code")


def binding_constraints(spark, folder):
    _, bounds, solved = _solved_from_mart(spark, folder)
    return D.binding_constraints(solved, bounds)


def macro_summary(spark, folder):
    """Lines of an order as a diet: quantity as protein, discount and tax as the other two."""
    lines = I.table(spark, folder, "lineitem").selectExpr(
        "l_returnflag", "l_quantity AS protein", "l_linenumber * 1.0D AS carbohydrate", "round(l_discount * 100) AS fat"
    )
    return I.rounded(R.macro_summary(lines, ["l_returnflag"]), 6, "percent")


def total_price(spark, folder):
    lines = I.table(spark, folder, "lineitem")
    return I.rounded(R.total_price(lines, ["l_suppkey"], "l_extendedprice"), 2, "total_price")


def nutrient_segments(spark, folder):
    """Stacked bars of each supplier's lines for two measures."""
    lines = I.table(spark, folder, "lineitem").withColumn("rank", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax"))
    wide = lines.select("l_suppkey", "rank", "l_quantity", F.round(F.col("l_discount") * 100).alias("discount"))
    long = R.nutrient_segments(wide, ["l_suppkey"], "rank", ["l_quantity", "discount"])
    return long.select("l_suppkey", "nutrient_id", "rank.l_orderkey", "rank.l_linenumber", "rank.l_partkey", "rank.l_extendedprice", "level", "start_value", "end_value")


def product_facts(spark, folder):
    """All nutrient rows of the mart's latest price, found by its id."""
    mart = build_price_mart(spark, folder)
    rows = [(n, f"Name of {n}", t, u) for n, t, u in (("protein", "macro", "g"), ("fat", "macro", "g"), ("calcium", "mineral", "mg"))]
    names = spark.createDataFrame(rows, "id string, name string, nutrient_type string, ciqual_unit string")
    latest = mart.agg(F.max("price_id").alias("price_id"))
    return R.product_facts(mart, latest, names, ["protein", "fat", "calcium"])


QUERIES = {
    "objective_value": objective_value,
    "objective_functions": objective_functions,
    "candidate_products": candidate_products,
    "lp_input_matrix": lp_input_matrix,
    "diet_one_bound": diet_one_bound,
    "diet_two_bounds": diet_two_bounds,
    "diet_certificates": diet_certificates,
    "diet_infeasible": diet_infeasible,
    "diet_report": diet_report,
    "binding_constraints": binding_constraints,
    "macro_summary": macro_summary,
    "total_price": total_price,
    "nutrient_segments": nutrient_segments,
    "product_facts": product_facts,
}


def _sql_text(text: str) -> str:
    # In SQL a prefix ~ reaches over the rest of the sum, and @ may not follow another operator.
    return text.replace("~l_linenumber", "(~l_linenumber)").replace("@(", "abs(")


# Every offer with its objective: what the diets and the candidate list choose from.
_PRICED = ("priced", f"""SELECT price * (1 + CAST(calcium AS DOUBLE) / 1000) AS objective, * FROM (
    SELECT *, {PER_100_G} AS price FROM offers WHERE {SELLABLE} AND shelf > 0) AS o JOIN profiles ON code = part
    LEFT JOIN food_about ON described = profile_food""")  # fmt: skip
_OFFER = """offer AS price_id, part AS product_code, product_name, CAST(described AS DOUBLE) AS ciqual_code, alim_nom_eng AS ciqual_name,
  coalesce(color, '#ffffff') AS color, price, shop_name AS location_osm_display_name, shop_osm AS location_osm_id"""
_AMOUNTS = {n: f"coalesce(CAST({n} AS DOUBLE), 0)" for n in NUTRIENTS}
_SHOWN = ", ".join(f"round_even({amount} * bought, 4) AS {n}" for n, amount in _AMOUNTS.items())

def _three_ranges_sql() -> str:
    """All corners: one, two or three parts, in amounts that put as many nutrients on one of their bounds each."""
    rows = {"p": THREE["protein"], "f": THREE["fat"], "e": THREE["energy"]}
    sides = {r: f"(VALUES ({lo}), ({hi})) AS bound_{r}({r}0)" for r, (lo, hi) in rows.items()}
    tries = [f"SELECT a.brand, a.part AS i, NULL AS j, NULL AS k, {r}0 / a.{r} AS x, 0 AS y, 0 AS z FROM best a, {sides[r]}" for r in rows]
    for r, s in (("p", "f"), ("p", "e"), ("f", "e")):
        det = f"(a.{r} * b.{s} - b.{r} * a.{s})"
        tries.append(f"""SELECT a.brand, a.part, b.part, NULL, ({r}0 * b.{s} - b.{r} * {s}0) / {det}, (a.{r} * {s}0 - a.{s} * {r}0) / {det}, 0
          FROM best a JOIN best b ON a.brand = b.brand AND a.part < b.part, {sides[r]}, {sides[s]} WHERE abs({det}) > 1e-9""")

    def det3(one: str, two: str, three: str) -> str:
        (a, b, c), (d, e, f), (g, h, i) = ([f"{table}.{r}" if table else f"{r}0" for r in rows] for table in (one, two, three))
        return f"({a} * ({e} * {i} - {f} * {h}) - {d} * ({b} * {i} - {c} * {h}) + {g} * ({b} * {f} - {c} * {e}))"

    whole, goal = det3("a", "b", "c"), ""
    tries.append(f"""SELECT a.brand, a.part, b.part, c.part, {det3(goal, 'b', 'c')} / {whole}, {det3('a', goal, 'c')} / {whole}, {det3('a', 'b', goal)} / {whole}
      FROM best a JOIN best b ON a.brand = b.brand AND a.part < b.part JOIN best c ON c.brand = b.brand AND b.part < c.part, {', '.join(sides.values())}
      WHERE abs({whole}) > 1e-9""")
    within = " AND ".join(
        f"x * a.{r} + y * coalesce(b.{r}, 0) + z * coalesce(c.{r}, 0) BETWEEN {lo * (1 - 1e-9)} AND {hi * (1 + 1e-9)}" for r, (lo, hi) in rows.items()
    )
    return f"""WITH best AS (SELECT p_brand AS brand, p_partkey AS part, CAST(p_size AS DOUBLE) AS p, CAST(p_partkey * 7 % 90 + 1 AS DOUBLE) AS f,
        p_retailprice / 10 AS e, min(l_extendedprice / l_quantity / 100) AS cost FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL),
      tried AS (SELECT * FROM ({' UNION ALL '.join(tries)}) WHERE x >= 0 AND y >= 0 AND z >= 0),
      met AS (SELECT tried.brand, x * a.cost + y * coalesce(b.cost, 0) + z * coalesce(c.cost, 0) AS total
        FROM tried JOIN best a ON a.part = i LEFT JOIN best b ON b.part = j LEFT JOIN best c ON c.part = k WHERE {within})
      SELECT p_brand AS scenario, if(min(total) IS NULL, 'infeasible', 'optimal') AS status, round(min(total), 6) AS objective, TRUE AS proven
      FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN met ON brand = p_brand GROUP BY p_brand"""


SQL = {
    "objective_value": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + ", ".join(f"CAST({_sql_text(t)} AS DOUBLE) AS {n}" for n, t in OBJECTIVES.items())
    + " FROM lineitem",
    "objective_functions": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + ", ".join(f"round({t}, 6) AS {n}" for n, t in TRANSCENDENT.items())
    + " FROM lineitem",
    "candidate_products": I.sql(
        CHOICE_INPUTS + ["offers", "food_about"],
        f"""SELECT objective, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in NUTRIENTS)},
          {_OFFER}
        FROM priced WHERE shop IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""",
        *STEPS,
        PROFILES,
        _PRICED,
    ),
    "lp_input_matrix": """SELECT p_partkey AS item, 0 AS row, 'a' AS nutrient_id, CAST(CAST(p_size / 2 AS FLOAT) AS DOUBLE) AS amount FROM part
      UNION ALL SELECT p_partkey, 1, 'p_retailprice', CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) FROM part""",
    "diet_one_bound": """SELECT p_brand AS scenario, 'optimal' AS status, round(60 * min(l_extendedprice / l_quantity / 100 / p_size), 6) AS objective
      FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand""",
    # A part's cheapest offer is all that matters of it; an optimum buys one part, or two that meet both bounds exactly.
    "diet_two_bounds": """WITH best AS (SELECT p_brand AS brand, p_partkey AS part, CAST(p_size AS DOUBLE) AS p, CAST(p_partkey * 7 % 90 + 1 AS DOUBLE) AS f,
        min(l_extendedprice / l_quantity / 100) AS cost FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL),
      tried AS (SELECT brand, cost * greatest(60 / p, 70 / f) AS total FROM best
        UNION ALL SELECT brand, a.cost * (60 * b.f - 70 * b.p) / (a.p * b.f - b.p * a.f) + b.cost * (70 * a.p - 60 * a.f) / (a.p * b.f - b.p * a.f)
        FROM best a JOIN best b USING (brand) WHERE a.p * b.f - b.p * a.f > 1e-9 AND 60 * b.f - 70 * b.p >= 0 AND 70 * a.p - 60 * a.f >= 0)
      SELECT p_brand AS scenario, if(min(total) IS NULL, 'infeasible', 'optimal') AS status, round(min(total), 6) AS objective
      FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN tried ON brand = p_brand GROUP BY p_brand""",
    "diet_report": I.sql(
        CHOICE_INPUTS + ["offers", "food_about"],
        f"""SELECT zone AS scenario, offer AS id, part AS product_code, product_name, alim_nom_eng AS ciqual_name, CAST(described AS DOUBLE) AS ciqual_code,
          coalesce(color, '#ffffff') AS color, array_to_string(split(shop_name, ', ')[:3], ', ') AS location, shop_osm AS location_osm_id,
          round_even(100 * bought, 1) AS quantity_g, round_even(price * bought, 2) AS price, {_SHOWN}
        FROM (SELECT *, {NEEDED} / CAST(protein AS DOUBLE) AS bought FROM priced WHERE objective IS NOT NULL AND protein > 0)
        QUALIFY row_number() OVER (PARTITION BY zone ORDER BY objective * bought, offer, part, shop, seen) = 1""",
        *STEPS,
        PROFILES,
        _PRICED,
    ),
    "binding_constraints": I.sql(
        CHOICE_INPUTS + ["offers", "food_about"],
        "SELECT DISTINCT zone AS scenario, 'protein' AS nutrient_id FROM priced WHERE objective IS NOT NULL AND protein > 0",
        *STEPS,
        PROFILES,
        _PRICED,
    ),
    "diet_certificates": _three_ranges_sql(),
    # Under one unit of fat a part gives at most its protein per fat.
    "diet_infeasible": """SELECT p_brand AS scenario, if(max(p_size / (p_partkey * 7 % 90 + 1)) FILTER (l_partkey IS NOT NULL) >= 1e6, 'optimal', 'infeasible') AS status
      FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand""",
    "macro_summary": """WITH s AS (SELECT l_returnflag, sum(l_quantity) AS p, sum(l_linenumber * 1.0::DOUBLE) AS c, sum(round(l_discount * 100)) AS f
        FROM lineitem GROUP BY 1), t AS (SELECT *, 4 * p + 4 * c + 9 * f AS total FROM s)
      SELECT l_returnflag, 'protein' AS nutrient, p AS weight_g, 4 * p AS energy_kcal, round(100 * (4 * p / total), 6) AS percent FROM t
      UNION ALL SELECT l_returnflag, 'carbohydrate', c, 4 * c, round(100 * (4 * c / total), 6) FROM t
      UNION ALL SELECT l_returnflag, 'fat', f, 9 * f, round(100 * (9 * f / total), 6) FROM t""",
    "total_price": "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total_price FROM lineitem GROUP BY 1",
    "nutrient_segments": """WITH l AS (SELECT *, 'l_quantity' AS nutrient_id, l_quantity AS level FROM lineitem
        UNION ALL SELECT *, 'discount', round(l_discount * 100) FROM lineitem)
      SELECT l_suppkey, nutrient_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice, level, end_value - level AS start_value, end_value
      FROM (SELECT *, sum(level) OVER (PARTITION BY l_suppkey, nutrient_id ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC,
        l_partkey DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC ROWS UNBOUNDED PRECEDING) AS end_value FROM l)""",
    "product_facts": I.sql(
        CHOICE_INPUTS + ["offers"],
        f"""SELECT price_id, CASE nutrient_id WHEN 'calcium' THEN 'mineral' ELSE 'macro' END AS nutrient_type, nutrient_id AS id,
          'Name of ' || nutrient_id AS name, CAST(round(CAST(value AS DOUBLE), 3) AS DOUBLE) AS value, if(nutrient_id = 'calcium', 'mg', 'g') AS unit, origin
        FROM choice JOIN (SELECT offer AS price_id, min(part) AS code FROM offers WHERE {SELLABLE} GROUP BY offer ORDER BY offer DESC LIMIT 1) USING (code)
        WHERE nutrient_id IN ('protein', 'fat', 'calcium')""",
        *STEPS,
    ),
}
