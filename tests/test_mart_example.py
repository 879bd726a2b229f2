"""A worked example: two products, two nutrients, seven prices, with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from larder.plans import marts, nutrition

from larder.plans.vocabulary import COLUMN_COMMENTS, IMPACT_COLUMNS, NUTRIENT_IDS, PRICE_COLUMNS
from larder.sources import schemas

PEAS, TOFU = "3111950001928", "4099200179193"


def label(name, unit, amount):
    return (name, unit, amount, amount, None, None, None, None, None)


@pytest.fixture(scope="module")
def inputs(spark):
    nutriments = schemas.NUTRIMENTS.simpleString()
    products = spark.createDataFrame(
        [
            (PEAS, [("main", "Pois chiches")], 1000.0, "g", 20516, "",
             [label("energy", "kJ", 1480.0), label("fruits", None, 100.0), label("proteins", "g", 20.5)]),
            (TOFU, [("main", "Tofu natur")], 350.0, "g", 20904, "",
             [label("proteins", "g", 13.0), label("sodium", "g", 0.008)]),
            ("0000000000000", [("main", "Never sold")], 100.0, "g", 20904, "", []),
        ],
        "code string, product_name array<struct<lang:string,text:string>>, product_quantity float, "
        f"product_quantity_unit string, ciqual_food_code int, ciqual_food_code_origin string, nutriments {nutriments}",
    )
    day = datetime.date(2025, 2, 4)
    prices = spark.createDataFrame(
        [(29955, PEAS, 1.99, "EUR", day), (123670, PEAS, 2.05, "EUR", day), (134872, PEAS, 2.49, "EUR", day),
         (29904, TOFU, 1.10, "CHF", day), (77758, TOFU, 1.35, "CHF", day), (123186, TOFU, 1.35, "CHF", day),
         (134967, TOFU, 1.80, "CHF", day), (1, TOFU, 9.99, "XXX", day), (2, TOFU, None, "EUR", day)],
        "id long, product_code string, price float, currency string, date date",
    )
    impacts = dict.fromkeys(IMPACT_COLUMNS, 0.0) | {"energy_depletion": 14.5}
    return {
        "prices": prices,
        "price_columns": {old: new for old, new in PRICE_COLUMNS.items() if old in prices.columns},
        "products": products,
        "rates": spark.createDataFrame([("CHF", 0.9358), ("EUR", 1.0), ("NOK", 11.533)], "currency string, rate double"),
        "ciqual_alim": spark.createDataFrame(
            [(20516, "Chick pea, dried", "02", "0203", "020303"), (20904, "Tofu, plain", "04", "0411", "000000")],
            "alim_code long, alim_nom_eng string, alim_grp_code string, alim_ssgrp_code string, alim_ssssgrp_code string",
        ),
        "ciqual_compo": spark.createDataFrame(
            [(20516, 10110, "C", 81259, 23.2), (20516, 25000, "C", 81271, 20.5),
             (20904, 10110, "A", 83096, 10.0), (20904, 25000, "A", 83108, 13.4)],
            "alim_code long, const_code long, code_confiance string, source_code long, mean float",
        ),
        "calnut_1": spark.createDataFrame(
            [(20904, 10110, False, 10.0), (20904, 25000, False, 13.4)],
            "ALIM_CODE long, CONST_CODE long, combl boolean, mean float",
        ),
        "agribalyse": spark.createDataFrame([(20516, *impacts.values())], ["ciqual_food_code", *impacts]),
        "colors": spark.createDataFrame([("#7cb342", "0203")], "color string, alim_ssgrp_code string"),
        "nutrients": nutrition.read_nutrients(
            spark.createDataFrame(
                [("protein", "proteins", 25000, "g", 25000, "g"), ("sodium", "sodium", 10110, "mg", 10110, "mg"),
                 ("unusable", None, None, None, None, None)],
                "id string, off_id string, ciqual_const_code long, ciqual_unit string, calnut_const_code long, calnut_unit string",
            )
        ),
    }


def test_price_mart(inputs):
    mart = marts.price_mart(**inputs)
    rows = {r.price_id: r for r in mart.collect()}
    assert len(rows) == 7 and mart.count() == 7
    peas, tofu = rows[123670], rows[77758]
    assert (round(peas.sodium, 4), peas.sodium_unit, peas.sodium_origin) == (23.2, "mg", "ciqual_C_81259")
    assert (peas.protein, peas.protein_unit, peas.protein_origin) == (20.5, "g", "product")
    assert (tofu.protein, tofu.protein_origin) == (13.0, "product")
    # The label gives sodium in g while mg is wanted, so the label is passed over.
    assert (tofu.sodium, tofu.sodium_unit, tofu.sodium_origin) == (10.0, "mg", "ciqual_A_83096")
    assert peas.price == 0.20499999821186066 and tofu.price == 0.41217599115862913
    assert (peas.product_name, peas.color, tofu.color) == ("Pois chiches", "#7cb342", "#ffffff")
    assert (peas.energy_depletion, tofu.energy_depletion) == (14.5, None)
    assert peas.folates is None and peas.folates_origin is None
    assert set(NUTRIENT_IDS) <= set(mart.columns) and len(NUTRIENT_IDS) == 63
    assert mart.schema["protein"].metadata["comment"] == "Protein g/100g"


def test_food_mart(inputs):
    calnut_0 = inputs["calnut_1"].select("ALIM_CODE").distinct()
    rows = {r.ciqual_food_code: r for r in marts.food_mart(calnut_0=calnut_0, **{k: v for k, v in inputs.items() if k != "price_columns"}).collect()}
    assert set(rows) == {20516, 20904}
    assert (round(rows[20904].protein, 4), rows[20904].protein_origin) == (13.4, "ciqual_A_83108")
    assert (rows[20516].price, rows[20516].price_count) == (0.20499999821186066, 3)
    assert (rows[20904].price, rows[20904].price_count) == (0.41217599115862913, 4)


def test_fallback_order(inputs, spark):
    """Without the first table's value the second is used, then zero; origins say so."""
    thin = inputs | {"ciqual_compo": inputs["ciqual_compo"].where("const_code = 1"), "products": inputs["products"].withColumn(
        "ciqual_food_code_origin", F.lit("agribalyse_"))}
    rows = {r.price_id: r for r in marts.price_mart(**thin).collect()}
    assert (rows[77758].sodium, rows[77758].sodium_origin) == (10.0, "calnut_agribalyse_")
    assert (rows[123670].sodium, rows[123670].sodium_unit, rows[123670].sodium_origin) == (0.0, "mg", "assumed 0")


def test_repeated_codes(inputs):
    """A code listed twice doubles its prices, unless codes are made unique."""
    twice = inputs | {"products": inputs["products"].union(inputs["products"].withColumn("product_quantity", F.lit(500.0).cast("float")))}
    assert marts.price_mart(**twice).count() == 14
    once = marts.price_mart(**twice, dedupe=True)
    assert once.count() == 7 and set(once.columns) == set(marts.price_mart(**inputs).columns)


def test_mart_does_not_multiply_rows_before_joining_prices(inputs):
    plan = marts.price_mart(**inputs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Generate" not in plan and "Expand" not in plan


def test_prices_are_shuffled_once(inputs, spark):
    """With every join shuffled: one exchange of sold codes, one of price rows, and NULL food codes spread."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = marts.price_mart(**inputs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(product_code") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_missing_food_code(inputs):
    unknown = inputs | {"products": inputs["products"].withColumn("ciqual_food_code", F.lit(None).cast("int"))}
    rows = marts.missing_food_code(marts.price_mart(**unknown)).collect()
    assert {r.product_code for r in rows} == {PEAS, TOFU}
    assert all(r.fat is None for r in rows)


def test_comments():
    described = [c for c in COLUMN_COMMENTS if c in NUTRIENT_IDS]
    assert len(described) == 63 and len(COLUMN_COMMENTS) == 94
    assert COLUMN_COMMENTS["fa_12_0"] == "Fatty acid 12:0 g/100g"
    assert COLUMN_COMMENTS["vitamin_b12"] == "Vitamin B12 µg/100g"
    assert COLUMN_COMMENTS["energy_fibre_kj"] == "Energy in kJ/100g"
