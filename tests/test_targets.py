"""Targets, the nutrient map and its rules."""

import pytest
from pyspark.sql import functions as F

from larder.plans import nutrient_map as M
from larder.plans import recommendations as R
from larder.plans import reports
from larder.sources.schemas import NUTRIENT_MAP, RECOMMENDATIONS_NNR2023


@pytest.fixture(scope="module")
def merged(spark):
    cells = spark.createDataFrame(
        [("Vitamin A, RE", "700", "800", ""), ("Vitamin E, α-TE", "10", "11", "AI in NNR2023"), ("Vitamin K, µg", "65", "75", "AI\u00a0 in NNR2023"),
         ("Copper, µg", "900", "900", None), ("Molybdenum, µg", "65", "65", "AI in NNR2023"), ("Potassium, g", "3.5", "3.5", "AI in NNR2023"),
         ("Sodium, g", "1.5", "1.5", ""), ("Magnesium, mg", "300", "350", "AI in NNR2023"), ("Iodine, µg", "150", "150", "")],
        "label string, females string, males string, comment string",
    )
    limits = spark.createDataFrame(
        [("Vitamin A", "μg RE/d", "3000"), ("Vitamin E", "mg/d", "300"), ("Copper", "mg/d", "5"), ("Molybdenum", "mg/d", "0.6"),
         ("Magnesium", "mg/d", "250"), ("Boron", "mg/d", "10"), ("Iodine", "μg/d", "600")],
        "name string, unit string, value string",
    )
    return R.recommendation_merge(
        R.target_rows(cells, "label", "females", "males", "comment"), R.upper_limit_rows(limits, "name", "unit", "value")
    )


def test_merge(merged):
    got = {r.nutrient: (r.unit, r.RI_or_AI, r.value_males, r.value_females, r.value_upper_intake) for r in merged.collect()}
    assert got == {
        "Vitamin A": ("RE", "RI", 800.0, 700.0, 3000.0),
        "Vitamin E": ("mg", "AI", 16.5, 15.0, 300.0),
        "Vitamin K": ("µg", "AI", 75.0, 65.0, None),
        "Copper": ("mg", "RI", 0.9, 0.9, 5.0),
        "Molybdenum": ("µg", "AI", 65.0, 65.0, 600.0),
        "Potassium": ("mg", "AI", 3500.0, 3500.0, None),
        "Sodium": ("g", "RI", 1.5, 1.5, None),
        "Magnesium": ("mg", "AI", 350.0, 300.0, None),
        "Iodine": ("µg", "RI", 150.0, 150.0, 600.0),
        "Boron": ("mg", None, None, None, 10.0),
    }
    assert R.merge_problems(merged).count() == 0


def test_merge_problems(spark):
    targets = spark.createDataFrame([("X", "mg", "RI", 5.0, 1.0), ("Y", "g", "RI", 1.0, 1.0)], "nutrient string, unit string, RI_or_AI string, value_males double, value_females double")
    uppers = spark.createDataFrame([("X", "mg", 5.0), ("Y", "IU", 5.0)], "nutrient string, unit string, value_upper_intake double")
    found = R.merge_problems(R.recommendation_merge(targets, uppers)).collect()
    assert sorted((r.nutrient, r.rule) for r in found) == [("X", "target of males not below upper limit"), ("Y", "no common unit")]


def map_rows(spark, *rows):
    names = NUTRIENT_MAP.names
    return spark.createDataFrame([tuple({**dict.fromkeys(names), **r}[n] for n in names) for r in rows], NUTRIENT_MAP)


PROTEIN = {
    "id": "protein", "name": "Protein", "ciqual_const_code": 25000, "ciqual_const_name_eng": "Protein (g/100g)",
    "ciqual_const_name_fr": "Protéines", "ciqual_unit": "g", "calnut_const_code": 25000, "calnut_const_name": "proteines",
    "calnut_unit": "g", "off_id": "proteins", "count": 5, "nutrient_type": "macro",
}
NIACIN = PROTEIN | {"id": "vitamin_pp", "nnr2023_id": "Niacin", "nutrient_type": "vitamin", "ciqual_unit": "mg"}


def test_recommendations_and_sliders(spark):
    nutrients = map_rows(
        spark, PROTEIN, NIACIN, PROTEIN | {"id": "off", "disabled": "true", "nnr2023_id": "Zinc"},
        PROTEIN | {"id": "zinc", "nnr2023_id": "Zinc", "ciqual_unit": "mg"}, PROTEIN | {"id": "salt"},
    )
    macro = spark.createDataFrame([("protein", "g", 150.0, 140.0, None), ("salt", "g", 0.0, 0.0, None)], "id string, unit string, value_males double, value_females double, value_upper_intake double")
    micro = spark.createDataFrame([("Niacin", "NE", "RI", 18.0, 14.0, None), ("Zinc", "mg", "RI", 12.7, 9.7, 25.0)], RECOMMENDATIONS_NNR2023)
    recs = R.recommendations(nutrients, macro, micro)
    # Niacin falls out, as NE is not mg.
    assert {r.id: (r.value_males, r.unit) for r in recs.collect()} == {"protein": (150.0, "g"), "zinc": (12.7, "mg"), "salt": (0.0, "g")}
    sliders = {r.id: (r.min, r.max, r.lower, r.upper, r.active) for r in R.slider_bounds(recs).collect()}
    assert sliders == {"protein": (0, 600.0, 150.0, 600.0, 1), "zinc": (0, 38.0, 12.7, 25.0, 1), "salt": (0, 100.0, 0.0, 100.0, 1)}


def test_rows_by_age(spark):
    rows = [["Age group", "Calcium"], ["≤6 mo", "1"], ["CHILDREN"], ["1-3 y", "2"], ["FEMALES"], ["Preg\u00adnant", "3"], ["MALES"], ["11-14 y", "4"]]
    df = spark.createDataFrame([(t, i, r) for t in (0, 1) for i, r in enumerate(rows)], "table_no int, row_no int, cells array<string>")
    got = R.rows_by_age(df).where("table_no = 1").orderBy("row_no").collect()
    assert [r.individual_type for r in got] == ["child (<=6 mo)", "child (1-3 y)", "female (Pregnant)", "male (11-14 y)"]


def test_map_violations(spark):
    const = spark.createDataFrame([(25000, "Protein (g/100g)", "Protéines"), (1, "One", "Un")], "const_code long, const_nom_eng string, const_nom_fr string")
    calnut = M.calnut_constants(spark.createDataFrame([(25000, "proteines_g"), (25000, "proteines_g")], "CONST_CODE long, CONST_LABEL string"))
    bad = [
        PROTEIN,
        PROTEIN | {"id": "b", "ciqual_const_name_eng": "Other"},
        PROTEIN | {"id": "c", "calnut_unit": "mg", "count": None},
        PROTEIN | {"id": "d", "nutrient_type": "none", "disabled": "yes", "name": None},
        PROTEIN | {"id": "e", "calnut_const_code": None},
    ]
    found = sorted((r.id, r.rule) for r in M.map_violations(map_rows(spark, *bad), const, calnut).collect())
    assert found == [
        ("b", "ciqual code and names known"), ("c", "calnut code, name and unit known"), ("c", "count of label id"),
        ("d", "disabled"), ("d", "name"), ("d", "nutrient_type"), ("e", "calnut fields go together"), ("e", "enabled rows have codes"),
    ]


def test_other_violations(spark):
    macro = spark.createDataFrame([("a", "g", 1.0, 1.0, 1.0), ("b", "IU", None, -1.0, 0.0)], "id string, unit string, value_males double, value_females double, value_upper_intake double")
    assert sorted(r.rule for r in M.macro_violations(macro).collect()) == ["unit", "value_females", "value_males"]
    micro = spark.createDataFrame([("a", "mg", "RI", 1.0, 1.0, None), ("b", "mg", None, None, None, 5.0), ("c", "mg", "XX", 1.0, None, -1.0)], RECOMMENDATIONS_NNR2023)
    assert sorted((r.nutrient, r.rule) for r in M.micro_violations(micro).collect()) == [
        ("c", "value_females"), ("c", "value_males"), ("c", "value_upper_intake")
    ]
    units = spark.createDataFrame([("g", "g", 1.0), ("x", None, 0.0)], "from_unit string, to_unit string, conversion_factor double")
    assert sorted(r.rule for r in M.conversion_violations(units).collect()) == ["conversion_factor", "to_unit"]
    colors = spark.createDataFrame([("#00ff0A", "01", "x"), ("#00ff0", "01", "x"), ("red", None, "x")], "color string, alim_ssgrp_code string, alim_ssgrp_nom_eng string")
    assert sorted(r.rule for r in M.color_violations(colors).collect()) == ["alim_ssgrp_code", "color", "color"]


def test_map_counts_and_refresh(spark):
    nutrients = map_rows(spark, PROTEIN, PROTEIN | {"id": "fat", "off_id": "fat", "ciqual_const_code": 7, "calnut_const_code": 7}).withColumn(
        "row_num", F.when(F.col("id") == "fat", 1).otherwise(2))
    catalog = spark.createDataFrame([([("proteins",), ("salt",)],), ([("proteins",)],), ([],), (None,)], "nutriments array<struct<name:string>>")
    counted = M.nutrient_map_counts(nutrients, catalog)
    assert [(r.id, r["count"]) for r in counted.collect()] == [("fat", None), ("protein", 2)]
    assert counted.columns == M.MAP_COLUMNS
    const = spark.createDataFrame([(25000, "New name", "Nouveau"), (9, "Nine", "Neuf")], "const_code long, const_nom_eng string, const_nom_fr string")
    calnut = M.calnut_constants(spark.createDataFrame([(7, "total_fat_g"), (8, "eau_g")], "CONST_CODE long, CONST_LABEL string"))
    rows = M.nutrient_map_refresh(nutrients, const, calnut).collect()
    assert [(r.id, r.ciqual_const_code, r.ciqual_const_name_eng, r.calnut_const_code, r.calnut_const_name, r.calnut_unit) for r in rows] == [
        ("fat", None, None, 7, "total_fat", "g"), ("protein", 25000, "New name", None, None, None),
        (None, None, None, 8, "eau", "g"), (None, 9, "Nine", None, None, None),
    ]


def test_groups_in_display_order(spark):
    nutrients = map_rows(spark, NIACIN, PROTEIN, PROTEIN | {"id": "a", "name": "A"}, PROTEIN | {"id": "z", "nutrient_type": "unheard"})
    groups = M.nutrient_groups(nutrients).collect()
    assert [g.nutrient_type for g in groups] == ["macro", "vitamin", "unheard"]
    assert [n.id for n in groups[0].nutrients] == ["a", "protein"]


def test_match_label_names(spark):
    headers = spark.createDataFrame([("Fat (g/100g)",), ("Salt or NaCl (g/100g)",), ("Iron (mg/100g)",), ("Code",)], "h string")
    known = spark.createDataFrame(
        [(1, "Fat (g/100g)", "g", "fat", "9", None, "kept"), (2, "", "", "salt", "4", None, ""), (3, "", "", "salt", "1", None, ""), (4, "", "g", "alcohol", "2", None, "")],
        "position int, ciqual_id string, ciqual_unit string, off_id string, count string, nnr2023_id string, comments string",
    )
    got = {(r.name, r.off_id, r["count"], r.comments) for r in M.match_label_names(headers, "h", known).collect()}
    assert got == {("Fat", "fat", "9", "kept"), ("Salt", "salt", "4", None), ("Iron", None, None, None), (None, "alcohol", "2", "")}


def test_product_facts_and_segments(spark):
    rows = [(1, "b", 7, 2.00049, "product"), (1, "c", 7, 9.0, "y"), (1, "b", 8, 9.0, "z"), (2, "a", 7, 5.0, "x")]
    mart = spark.createDataFrame(rows, "price_id int, product_code string, location_id int, protein double, protein_origin string")
    facts = reports.product_facts(mart, mart.where("price_id = 1"), map_rows(spark, PROTEIN), ["protein"]).collect()
    assert [(r.name, r.value, r.unit, r.origin, r.nutrient_type) for r in facts] == [("Protein", 2.0, "g", "product", "macro")]
    diet = spark.createDataFrame([("s", 1, 3.0), ("s", 2, 1.0), ("s", 3, 6.0)], "scenario string, rank int, protein double")
    bars = {r["rank"]: (r.start_value, r.end_value) for r in reports.nutrient_segments(diet, ["scenario"], "rank", ["protein"]).collect()}
    assert bars == {3: (0.0, 6.0), 2: (6.0, 7.0), 1: (7.0, 10.0)}
