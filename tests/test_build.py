"""From input files to marts, static files and the serving copy."""

import csv

from larder.plans import build
from larder.sources import schemas
from larder.sources.tables import nutrient_map_rows


def put(path, header, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8", newline="") as file:
        csv.writer(file).writerows([header, *rows])


def make_inputs(spark, folder):
    names = schemas.NUTRIENT_MAP.names
    protein = ["protein", "Protein", 25000, "P", "P", "g", 25000, "proteines", "g", "proteins", 5, "true", "", "macro", "", ""]
    energy = ["energy_kj", "Energy", 327, "E", "E", "kj", "", "", "", "", "", "", "", "energy", "true", ""]
    put(folder / "nutrient_map.csv", names, energy, protein)
    put(folder / "recommendations_macro.csv", schemas.RECOMMENDATIONS_MACRO.names, ["protein", "g", 150, 150, 300])
    put(folder / "recommendations_nnr2023.csv", schemas.RECOMMENDATIONS_NNR2023.names, ["Zinc", "mg", "RI", 12.7, 9.7, 25])
    put(folder / "unit_conversion.csv", schemas.UNIT_CONVERSION.names, ["mg", "g", 0.001, "milligram", ""])
    put(folder / "ssgrp_colors.csv", schemas.SSGRP_COLORS.names, ["#7cb342", "0203", "pulses"])
    put(folder / "ciqual2020/alim.csv", schemas.CIQUAL_ALIM.names, [20516, "Chick pea", "02", "0203", "020303"])
    (folder / "ciqual2020/compo.xml").write_text(
        "<TABLE><COMPO><alim_code> 20516 </alim_code><const_code> 25000 </const_code><teneur> 20,5 </teneur><min> - </min><max> - </max>"
        "<code_confiance> C </code_confiance><source_code> 81271 </source_code></COMPO></TABLE>", encoding="cp1252")  # fmt: skip
    put(folder / "ciqual2020/sources.csv", schemas.CIQUAL_SOURCES.names, [81271, "A book"])
    put(folder / "calnut.0.csv", schemas.CALNUT_0.names, [20516, "Pois", "MB", "02", "0203", "020303", "a", "b", "c"])
    put(folder / "calnut.1.csv", schemas.CALNUT_1.names, [20516, "Pois", "proteines_g", 25000, 0, "1,0", "2,0", "1,5"])
    put(folder / "agribalyse_synthese.csv", list(schemas.AGRIBALYSE_NAMES), ["20516", 20516, "Chick pea", 2, 0, "a", "b", "c", *[0.5] * 21])
    put(folder / "euro_exchange_rates/latest.csv", ["currency", "rate"], ["EUR", 1.0])
    spark.createDataFrame(
        [(1, "p", 2.0, "EUR", 7, 70, "Shop, Street", 1.0, 2.0), (2, "p", 3.0, "EUR", 7, 70, "Shop, Street", 1.0, 2.0), (3, "q", 1.0, "EUR", 8, 80, "Other", 3.0, 4.0)],
        "id long, product_code string, price double, currency string, location_id long, location_osm_id long, location_osm_display_name string, "
        "location_osm_lat double, location_osm_lon double",
    ).write.parquet(str(folder / "prices.parquet"))
    spark.createDataFrame(
        [("p", [], 1, [], 5, 6, [("main", "Peas")], "g", "500", "500 g", "", [], "en:peas", (20516, None, None))],
        f"code string, countries_tags array<string>, nova_group int, nutriments {schemas.NUTRIMENTS.simpleString()}, ecoscore_score int, "
        "nutriscore_score int, product_name array<struct<lang:string,text:string>>, product_quantity_unit string, product_quantity string, "
        "quantity string, categories string, categories_tags array<string>, compared_to_category string, "
        "categories_properties struct<ciqual_food_code:int,agribalyse_food_code:int,agribalyse_proxy_food_code:int>",
    ).write.parquet(str(folder / "products.parquet"))


def test_build(spark, tmp_path):
    make_inputs(spark, tmp_path / "data")
    tables = build.load(spark, str(tmp_path / "data"), {"ciqual_compo": "ciqual2020/compo.xml"})
    assert [r.ref_citation for r in tables["ciqual_sources"].collect()] == ["A book"]
    made = build.build(tables, str(tmp_path / "out"), with_foods=True)
    mart = {r.price_id: r for r in made["final_table_price"].collect()}
    assert set(mart) == {1, 2}
    assert (mart[1].price, mart[1].protein, mart[1].protein_origin, mart[1].color) == (0.4, 20.5, "ciqual_C_81271", "#7cb342")
    assert made["final_table_food"].first().price == 0.5
    assert [(r.id, r.value_upper_intake) for r in made["recommendations"].collect()] == [("protein", 300.0)]
    build.write_static(made, str(tmp_path / "static"))
    places = spark.read.option("header", True).csv(str(tmp_path / "static/locations")).collect()
    assert [(r.id, r.name, r["count"]) for r in places] == [("7", "Shop, Street", "2")]
    described = {r.column_name: r for r in spark.read.option("header", True).csv(str(tmp_path / "static/column_description")).collect()}
    assert (described["protein"].comment, described["protein"].mean) == ("Protein g/100g", "20.50")
    assert "location_osm_lat" not in described and "product_quantity" not in described
    served = build.write_serving(made, str(tmp_path / "serving"))
    assert set(served) == set(build.SERVED)


def test_map_keeps_file_order(spark, tmp_path):
    make_inputs(spark, tmp_path / "data")
    rows = nutrient_map_rows(spark, str(tmp_path / "data/nutrient_map.csv")).collect()
    assert [(r.row_num, r.id) for r in rows] == [(0, "energy_kj"), (1, "protein")]
