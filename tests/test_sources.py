"""Readers and sinks on small files."""

import csv
import datetime

import pytest
from pyspark.sql import functions as F

from larder.operators.aggregates import column_catalog
from larder.sources import html, schemas, sinks, tables, xml


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_nutrient_map(spark, tmp_path):
    header = ",".join(schemas.NUTRIENT_MAP.names)
    path = write(
        tmp_path / "map.csv",
        f'{header}\nprotein,Protein,25000,"Protein, total",Protéines,g,25000,proteines,g,proteins,7,true,,macro,,\n'
        "energy_kj,Energy,327,E,E,kj,,,,,,,,energy,true,\n",
    )
    rows = tables.nutrient_map(spark, path).collect()
    assert [(r.id, r.ciqual_const_code, r.ciqual_const_name_eng, r.disabled) for r in rows] == [
        ("protein", 25000, "Protein, total", None)
    ]


def test_missing_column_is_reported(spark, tmp_path):
    path = write(tmp_path / "units.csv", "from_unit,to_unit\ng,g\n")
    with pytest.raises(ValueError, match="conversion_factor"):
        tables.unit_conversion(spark, path)


def test_group_codes_stay_text(spark, tmp_path):
    path = write(tmp_path / "colors.csv", "alim_ssgrp_code,color,alim_ssgrp_nom_eng\n0101,#7cb342,salads\n")
    assert tables.ssgrp_colors(spark, path).first().asDict() == {
        "color": "#7cb342", "alim_ssgrp_code": "0101", "alim_ssgrp_nom_eng": "salads"
    }


def test_calnut(spark, tmp_path):
    path = write(
        tmp_path / "1.csv",
        "ALIM_CODE,FOOD_LABEL,CONST_LABEL,CONST_CODE,indic_combl,LB,UB,MB\n"
        '20904,Tofu,sodium_mg,10110,0,"5,5","40,25",10\n20904,Tofu,eau_g,400,1,,,"70,1"\n',
    )
    rows = {r.CONST_CODE: r for r in tables.calnut_1(spark, path).collect()}
    assert (rows[10110].combl, rows[10110].lb, rows[10110].ub, rows[10110].mean) == (False, 5.5, 40.25, 10.0)
    assert (rows[400].combl, rows[400].lb) == (True, None)
    path = write(
        tmp_path / "0.csv",
        "ALIM_CODE,FOOD_LABEL,HYPOTH,alim_grp_code,alim_ssgrp_code,alim_ssssgrp_code,alim_grp_nom_fr,alim_ssgrp_nom_fr,"
        "alim_ssssgrp_nom_fr\n20904,Tofu,LB,04,0411,000000,a,b,c\n20904,Tofu,MB,04,0411,000000,a,b,c\n",
    )
    assert [(r.ALIM_CODE, r.alim_grp_code) for r in tables.calnut_0(spark, path).collect()] == [(20904, "04")]


def test_agribalyse(spark, tmp_path):
    names = list(schemas.AGRIBALYSE_NAMES)
    values = ["x1", "20516", "Chick pea", "2", "0", "oven", "pack", "none", "3.1"] + ["4.9e-06"] * (len(names) - 9)
    with (tmp_path / "agb.csv").open("w", encoding="utf-8", newline="") as file:
        csv.writer(file).writerows([names, values, [""] * len(names), ["y", *[""] * (len(names) - 1)]])
    rows = tables.agribalyse(spark, str(tmp_path / "agb.csv")).collect()
    assert len(rows) == 1 and len(rows[0]) == 29
    assert (rows[0].agribalyse_food_code, rows[0].ciqual_food_code, rows[0].land_use) == ("x1", 20516, 4.9e-06)


def test_exchange_rates(spark, tmp_path):
    path = write(tmp_path / "fx.csv", "Date, USD, JPY, ISK, \n04 July 2025, 1.1767, 169.98, , \n")
    rows = {r.currency: (r.date, r.rate) for r in tables.exchange_rates_wide(spark, path).collect()}
    day = datetime.date(2025, 7, 4)
    assert rows == {"USD": (day, 1.1767), "JPY": (day, 169.98), "EUR": (day, 1.0)}


def test_food_code_origin(spark, tmp_path):
    schema = "code string, categories_properties struct<ciqual_food_code:int,agribalyse_food_code:int,agribalyse_proxy_food_code:int>"
    rows = [("a", (1, 2, 3)), ("b", (None, 2, 3)), ("c", (None, None, 3)), ("d", (None, None, None)), ("e", None)]
    got = tables.with_food_code(spark.createDataFrame(rows, schema)).select("ciqual_food_code", "ciqual_food_code_origin")
    assert [tuple(r) for r in got.collect()] == [
        (1, ""), (2, "agribalyse_"), (3, "agribalyse_proxy_"), (None, "unknown"), (None, "unknown")
    ]


def test_products(spark, tmp_path):
    schema = (
        "code string, countries_tags array<string>, nova_group int, nutriments array<struct<name:string>>, ecoscore_score int, "
        "nutriscore_score int, product_name array<struct<lang:string,text:string>>, product_quantity_unit string, product_quantity string, "
        "quantity string, categories string, categories_tags array<string>, compared_to_category string, "
        "categories_properties struct<ciqual_food_code:int,agribalyse_food_code:int,agribalyse_proxy_food_code:int>"
    )
    row = ("1", [], 1, [], 5, 6, [], "g", "350.5", "350 g", "", [], "en:x", (None, 7, None))
    spark.createDataFrame([row], schema).write.parquet(str(tmp_path / "products"))
    got = tables.products(spark, str(tmp_path / "products")).first()
    assert (got.product_quantity, got.eco_score, got.ciqual_food_code) == (350.5, 5, 7)


def test_xml_with_stray_characters(spark, tmp_path):
    text = (
        '<?xml version="1.0" encoding="windows-1252" ?>\n<TABLE>\n'
        "<COMPO><alim_code> 1000 </alim_code><const_code> 327 </const_code><teneur> 1140,5 </teneur>"
        '<min missing=" " /><max> < 0,5 </max><code_confiance> A </code_confiance><source_code> 1 </source_code></COMPO>\n'
        "<COMPO><alim_code> 1001 </alim_code><const_code> 328 </const_code><teneur> - </teneur>"
        "<min> traces </min><max> 2 </max><code_confiance> œuf & blé – B </code_confiance><source_code> 2 </source_code></COMPO>\n"
        "</TABLE>\n"
    )
    path = write(tmp_path / "compo.xml", text, "cp1252")
    rows = xml.read_xml_rows(spark, path, "COMPO", schemas.CIQUAL_COMPO)
    got = {r.alim_code: r for r in rows.collect()}
    assert (got["1000"].teneur, got["1000"].min, got["1000"].max) == ("1140,5", None, "0,5")
    assert got["1001"].code_confiance == "œuf  blé – B"
    facts = {r.alim_code: r for r in tables.ciqual_compo(rows).collect()}
    assert (facts[1000].mean, facts[1000].lb, facts[1000].ub) == (1140.5, None, 0.5)
    assert (facts[1001].mean, facts[1001].lb, facts[1001].ub) == (None, 0.0, 2.0)
    assert tables.unreadable_measures(rows).count() == 0
    assert tables.unreadable_measures(rows.withColumn("max", F.lit("about 3"))).count() == 2


PAGE = """<html><body><script>var t = "<tbody><tr><td>no</td></tr></tbody>";</script>
<table><tbody><tr><td>Age<sup>1,2</sup></td><th>Vitamin B<sub>12</sub>&nbsp;µg</th></tr>
<tr><td colspan="2">FEMALES</td></tr><tr><td> &le;6 mo </td><td>4&amp;5</td></tr></tbody></table>
<table><tbody><tr><td>second</td><td></td></tr></tbody></table></body></html>"""


def test_html_tables(spark):
    pages = spark.createDataFrame([("p", PAGE), ("none", "<p>no table</p>"), ("null", None)], "page string, html string")
    got = sorted(tuple(r) for r in html.extract_tables(pages, "page", "html").collect())
    assert got == [
        ("p", 0, 0, ["Age", "Vitamin B12µg"]),
        ("p", 0, 1, ["FEMALES"]),
        ("p", 0, 2, ["≤6 mo", "4&5"]),
        ("p", 1, 0, ["second", ""]),
    ]


def test_csv_round_trip(spark, tmp_path):
    rows = sinks.synthetic_rows(spark, 10)
    sinks.write_csv(rows, str(tmp_path / "out"))
    back = spark.read.schema(rows.schema).option("header", True).csv(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    many = sinks.synthetic_rows(spark, 10_000)
    empty = many.where("nullable_field IS NULL").count()
    assert 2700 < empty < 3300 and many.where("random_float < 0 OR random_float >= 1").count() == 0
    assert many.select("id").distinct().count() == 10_000


def test_tables_keep_comments_and_order(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.0), (1, 2.0)], "location_id int, price double").coalesce(1)
    commented = sinks.with_comments(df, {"price": "EUR per 100 g", "absent": "x"})
    back = sinks.write_table(commented, str(tmp_path / "mart"), ["location_id"])
    assert [r.location_id for r in back.collect()] == [1, 2]
    assert column_catalog(back, "nothing").first().comment == "EUR per 100 g"
    copies = sinks.write_serving_copy({"mart": back, "other": back}, str(tmp_path / "serving"), ("mart",))
    assert list(copies) == ["mart"] and copies["mart"].count() == 2


def test_subset(spark):
    frames = {"a": spark.range(5), "b": spark.range(3)}
    cut = tables.subset(frames, {"a": {"id": [1, 4]}})
    assert sorted(r.id for r in cut["a"].collect()) == [1, 4] and cut["b"].count() == 3
