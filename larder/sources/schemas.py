"""Pinned input schemas. Inference would turn food-group codes such as 0203 into numbers."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType()}


def _fields(text: str) -> T.StructType:
    pairs = (field.split() for field in text.split(", "))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Column names of the published input files.
NUTRIENT_MAP = _fields(
    "id string, name string, ciqual_const_code bigint, ciqual_const_name_eng string, ciqual_const_name_fr string, "
    "ciqual_unit string, calnut_const_code bigint, calnut_const_name string, calnut_unit string, off_id string, "
    "count bigint, template string, nnr2023_id string, nutrient_type string, disabled string, comments string"
)
RECOMMENDATIONS_MACRO = _fields(
    "id string, unit string, value_males double, value_females double, value_upper_intake double"
)
RECOMMENDATIONS_NNR2023 = _fields(
    "nutrient string, unit string, RI_or_AI string, value_males double, value_females double, "
    "value_upper_intake double"
)
UNIT_CONVERSION = _fields(
    "from_unit string, to_unit string, conversion_factor double, name string, comment string"
)
SSGRP_COLORS = _text("color", "alim_ssgrp_code", "alim_ssgrp_nom_eng")
CIQUAL_ALIM = _text("alim_code", "alim_nom_eng", "alim_grp_code", "alim_ssgrp_code", "alim_ssssgrp_code")
CIQUAL_COMPO = _text("alim_code", "const_code", "teneur", "min", "max", "code_confiance", "source_code")
CIQUAL_SOURCES = _text("source_code", "ref_citation")
CIQUAL_CONST = _text("const_code", "const_nom_fr", "const_nom_eng")
CALNUT_0 = _text(
    "ALIM_CODE", "FOOD_LABEL", "HYPOTH", "alim_grp_code", "alim_ssgrp_code", "alim_ssssgrp_code",
    "alim_grp_nom_fr", "alim_ssgrp_nom_fr", "alim_ssssgrp_nom_fr",
)
CALNUT_1 = _text("ALIM_CODE", "FOOD_LABEL", "CONST_LABEL", "CONST_CODE", "indic_combl", "LB", "UB", "MB")
EXCHANGE_RATES = _fields("currency string, rate double")

NUTRIMENTS = T.ArrayType(
    _fields(
        "name string, unit string, value float, 100g float, serving float, prepared_100g float, "
        "prepared_value float, prepared_serving float, prepared_unit string"
    )
)

# Headers of the published impact table and the names they get here.
AGRIBALYSE_NAMES = {
    "Code AGB": "agribalyse_food_code",
    "Code CIQUAL": "ciqual_food_code",
    "LCI Name": "ciqual_food_name",
    "code saison": "season_code",
    "code avion": "air_transport_code",
    "Livraison": "delivery_method",
    "Approche emballage": "packaging_approach",
    "Préparation": "preparation_method",
    "DQR": "data_quality_rating",
    "Score unique EF": "eco_score",
    "Changement climatique": "climate_change",
    "Appauvrissement de la couche d'ozone": "ozone_depletion",
    "Rayonnements ionisants": "ionizing_radiation",
    "Formation photochimique d'ozone": "photochemical_ozone_formation",
    "Particules fines": "fine_particles",
    "Effets toxicologiques sur la santé humaine : substances non-cancérogènes": "non_carcinogenic_toxicity",
    "Effets toxicologiques sur la santé humaine : substances cancérogènes": "carcinogenic_toxicity",
    "Acidification terrestre et eaux douces": "terrestrial_acidification",
    "Eutrophisation eaux douces": "freshwater_eutrophication",
    "Eutrophisation marine": "marine_eutrophication",
    "Eutrophisation terrestre": "terrestrial_eutrophication",
    "Écotoxicité pour écosystèmes aquatiques d'eau douce": "freshwater_ecotoxicity",
    "Utilisation du sol": "land_use",
    "Épuisement des ressources eau": "water_depletion",
    "Épuisement des ressources énergétiques": "energy_depletion",
    "Épuisement des ressources minéraux": "mineral_depletion",
    "Changement climatique - émissions biogéniques": "biogenic_climate_change_emissions",
    "Changement climatique - émissions fossiles": "fossil_climate_change_emissions",
    "Changement climatique - émissions liées au changement d'affectation des sols": (
        "land_use_change_climate_change_emissions"
    ),
}
AGRIBALYSE_TEXT = (
    "agribalyse_food_code", "ciqual_food_name", "delivery_method", "packaging_approach", "preparation_method",
)
AGRIBALYSE_LONG = ("ciqual_food_code", "season_code", "air_transport_code")

# The price table. Columns that a file lacks are NULL.
PRICES = T.StructType(
    [
        T.StructField(name, kind)
        for kind, names in (
            (T.LongType(), ("id", "location_id", "location_osm_id")),
            (T.DoubleType(), ("price", "price_without_discount", "location_osm_lat", "location_osm_lon")),
            (T.BooleanType(), ("price_is_discounted",)),
            (T.DateType(), ("date",)),
            (T.TimestampType(), ("created", "updated", "location_created", "location_updated")),
            (
                T.StringType(),
                (
                    "product_code", "currency", "location_osm_display_name", "type", "owner", "price_per", "source", "location_type",
                    "location_osm_type", "location_osm_tag_key", "location_osm_tag_value", "location_osm_address_postcode",
                    "location_osm_address_city", "location_osm_address_country", "location_osm_address_country_code",
                    "location_website_url", "location_source",
                ),
            ),
        )
        for name in names
    ]
)

# The columns of the product catalog that are used.
_TAGS = T.ArrayType(T.StringType())
PRODUCTS = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("countries_tags", _TAGS),
        T.StructField("nova_group", T.IntegerType()),
        T.StructField("nutriments", NUTRIMENTS),
        T.StructField("ecoscore_score", T.IntegerType()),
        T.StructField("nutriscore_score", T.IntegerType()),
        T.StructField("product_name", T.ArrayType(_text("lang", "text"))),
        T.StructField("product_quantity_unit", T.StringType()),
        T.StructField("product_quantity", T.StringType()),
        T.StructField("quantity", T.StringType()),
        T.StructField("categories", T.StringType()),
        T.StructField("categories_tags", _TAGS),
        T.StructField("compared_to_category", T.StringType()),
        T.StructField(
            "categories_properties",
            T.StructType([T.StructField(n, T.IntegerType()) for n in ("ciqual_food_code", "agribalyse_food_code", "agribalyse_proxy_food_code")]),
        ),
    ]
)
