"""Keeping the nutrient map in step with its sources, and checking it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import text as X
from larder.operators.aggregates import grouped_structs
from larder.operators.quality import Reference, Rule, all_or_none, check_rules, empty_or, one_of, required
from larder.plans import vocabulary as V

# Columns of the nutrient map.
MAP_COLUMNS = [
    "id", "name", "ciqual_const_code", "ciqual_const_name_eng", "ciqual_const_name_fr", "ciqual_unit",
    "calnut_const_code", "calnut_const_name", "calnut_unit", "off_id", "count", "template", "nnr2023_id",
    "nutrient_type", "disabled", "comments",
]


def calnut_constants(calnut_1: DataFrame) -> DataFrame:
    """(const_code, name, unit) from the labels of the second composition table."""
    distinct = calnut_1.select("CONST_CODE", "CONST_LABEL").dropDuplicates()
    label = X.name_and_unit(F.col("CONST_LABEL"))
    return distinct.select(F.col("CONST_CODE").alias("const_code"), label["name"].alias("name"), label["unit"].alias("unit"))


def nutrient_map_refresh(nutrient_map: DataFrame, ciqual_const: DataFrame, calnut_const: DataFrame) -> DataFrame:
    """Codes, names and units as the sources give them now; constants missing from the map are appended.

    `nutrient_map` carries its row order in `row_num`.
    """
    ciqual = ciqual_const.select(
        F.col("const_code").alias("_q"), F.col("const_nom_eng").alias("_q_eng"), F.col("const_nom_fr").alias("_q_fr")
    )
    calnut = calnut_const.select(
        F.col("const_code").alias("_n"), F.col("name").alias("_n_name"), F.col("unit").alias("_n_unit")
    )
    joined = nutrient_map.join(ciqual, F.col("ciqual_const_code") == F.col("_q"), "full").join(
        calnut, F.col("calnut_const_code") == F.col("_n"), "full"
    )
    replaced = {
        "ciqual_const_code": "_q",
        "ciqual_const_name_eng": "_q_eng",
        "ciqual_const_name_fr": "_q_fr",
        "calnut_const_code": "_n",
        "calnut_const_name": "_n_name",
        "calnut_unit": "_n_unit",
    }
    ordered = joined.orderBy(F.col("row_num").asc_nulls_last(), "_q", "_n")
    return ordered.select(*[F.col(replaced.get(c, c)).alias(c) for c in MAP_COLUMNS])


def label_counts(products: DataFrame, nutriments: str = "nutriments") -> DataFrame:
    """How often each label nutrient occurs in the catalog; empty label lists count for nothing."""
    exploded = products.select(F.explode(f"{nutriments}.name").alias("off_id"))
    return exploded.groupBy("off_id").agg(F.count(F.lit(1)).alias("count"))


def nutrient_map_counts(nutrient_map: DataFrame, products: DataFrame) -> DataFrame:
    """The map with label counts brought up to date, in its own order."""
    counted = nutrient_map.drop("count").join(label_counts(products), "off_id", "left")
    return counted.orderBy("row_num").select(*MAP_COLUMNS)


def match_label_names(headers: DataFrame, header: str, known: DataFrame) -> DataFrame:
    """Nutrient columns of a composition table, with the label id they belong to.

    `known` has (position, ciqual_id, ciqual_unit, off_id, count, nnr2023_id, comments). A header
    listed there keeps all its rows; another gets the first label id equal to its lower-cased name.
    """
    parsed = headers.select(F.col(header).alias("ciqual_const_name_eng"), X.header_name_and_unit(F.col(header)).alias("_p"))
    named = parsed.where(F.col("_p").isNotNull()).select(
        "ciqual_const_name_eng", F.col("_p.name").alias("name"), F.col("_p.unit").alias("ciqual_unit")
    )
    kept = known.select(
        F.col("ciqual_id").alias("ciqual_const_name_eng"), "off_id", "count", "nnr2023_id", "comments"
    )
    listed = named.join(kept, "ciqual_const_name_eng")
    first = known.groupBy("off_id").agg(F.min_by("count", "position").alias("count"))
    empty = F.lit(None).cast("string")
    fresh = (
        named.join(kept, "ciqual_const_name_eng", "left_anti")
        .join(first, F.lower("name") == first.off_id, "left")
        .select(*named.columns, "off_id", "count", empty.alias("nnr2023_id"), empty.alias("comments"))
    )
    others = known.where(
        (F.coalesce("ciqual_id", F.lit("")) == "")
        & ((F.coalesce("ciqual_unit", F.lit("")) != "") | (F.coalesce("comments", F.lit("")) != ""))
    ).select(
        empty.alias("ciqual_const_name_eng"), empty.alias("name"), "ciqual_unit", "off_id", "count", "nnr2023_id", "comments"
    )
    return listed.union(fresh).union(others)


def map_violations(nutrient_map: DataFrame, ciqual_const: DataFrame, calnut_const: DataFrame) -> DataFrame:
    """Rows of the nutrient map that break one of its rules."""
    off = F.col("disabled").isNotNull()
    rules = [
        Rule("id", required("id")),
        Rule("name", required("name")),
        Rule("disabled", empty_or("disabled", one_of("disabled", ["true"]))),
        Rule("template", empty_or("template", one_of("template", ["true"]))),
        Rule("nutrient_type", one_of("nutrient_type", V.NUTRIENT_TYPES)),
        Rule(
            "ciqual fields go together",
            all_or_none("ciqual_const_code", "ciqual_const_name_eng", "ciqual_const_name_fr", "ciqual_unit"),
        ),
        Rule("ciqual unit", empty_or("ciqual_unit", one_of("ciqual_unit", V.CIQUAL_UNITS))),
        Rule("ciqual code not zero", empty_or("ciqual_const_code", F.col("ciqual_const_code") != 0)),
        Rule("calnut fields go together", all_or_none("calnut_const_code", "calnut_const_name", "calnut_unit")),
        Rule("calnut unit", empty_or("calnut_unit", one_of("calnut_unit", V.CALNUT_UNITS))),
        Rule("same code", empty_or("calnut_const_code", F.col("calnut_const_code") == F.col("ciqual_const_code"))),
        Rule("count of label id", F.when(F.col("off_id").isNull(), F.col("count").isNull()).otherwise(F.col("count") > 0)),
        Rule("enabled rows have codes", off | (F.col("ciqual_const_code").isNotNull() & F.col("calnut_const_code").isNotNull())),
    ]
    # A name or unit that differs from the source's shows as a key that the source does not have.
    ciqual_key = ["const_code", "const_nom_eng", "const_nom_fr"]
    keyed = nutrient_map.withColumns(
        {
            "_ciqual": _key("ciqual_const_code", "ciqual_const_name_eng", "ciqual_const_name_fr"),
            "_calnut": _key("calnut_const_code", "calnut_const_name", "calnut_unit"),
        }
    )
    references = [
        Reference("ciqual code and names known", "_ciqual", ciqual_const.select(_key(*ciqual_key).alias("key")), "key"),
        Reference(
            "calnut code, name and unit known",
            "_calnut",
            calnut_const.select(_key("const_code", "name", "unit").alias("key")),
            "key",
        ),
    ]
    return check_rules(keyed, rules, references).drop("_ciqual", "_calnut")


def _key(code: str, *rest: str):
    parts = F.concat_ws("|", F.col(code).cast("string"), *[F.coalesce(c, F.lit("")) for c in rest])
    return F.when(F.col(code).isNotNull(), parts)


def macro_violations(macro: DataFrame) -> DataFrame:
    amounts = ("value_males", "value_females", "value_upper_intake")
    return check_rules(
        macro,
        [Rule("id", required("id")), Rule("unit", one_of("unit", V.MACRO_UNITS))]
        + [Rule(c, F.col(c) >= 0) for c in amounts],
    )


def micro_violations(micro: DataFrame) -> DataFrame:
    classified = one_of("RI_or_AI", ["RI", "AI"])
    targets = [
        Rule(c, F.when(classified, F.col(c) >= 0).otherwise(F.col("RI_or_AI").isNull() & F.col(c).isNull()))
        for c in ("value_males", "value_females")
    ]
    return check_rules(
        micro,
        [
            Rule("nutrient", required("nutrient")),
            Rule("unit", one_of("unit", V.NNR2023_UNITS)),
            *targets,
            Rule("value_upper_intake", empty_or("value_upper_intake", F.col("value_upper_intake") >= 0)),
        ],
    )


def conversion_violations(unit_conversion: DataFrame) -> DataFrame:
    return check_rules(
        unit_conversion,
        [Rule(c, required(c)) for c in ("from_unit", "to_unit")]
        + [Rule("conversion_factor", F.col("conversion_factor") > 0)],
    )


def color_violations(colors: DataFrame) -> DataFrame:
    return check_rules(
        colors,
        [
            Rule("alim_ssgrp_code", required("alim_ssgrp_code")),
            Rule("alim_ssgrp_nom_eng", required("alim_ssgrp_nom_eng")),
            Rule("color", X.is_hex_color(F.col("color"))),
        ],
    )


def nutrient_groups(nutrient_map: DataFrame) -> DataFrame:
    """Nutrients of each type as one list, types in display order, unknown types last."""
    order = F.create_map(*[F.lit(x) for i, t in enumerate(V.NUTRIENT_TYPES) for x in (t, i)])
    groups = grouped_structs(nutrient_map.withColumn("unit", F.col("ciqual_unit")), "nutrient_type", ["id", "name", "unit"], "nutrients")
    position = F.coalesce(F.try_element_at(order, F.col("nutrient_type")), F.lit(len(V.NUTRIENT_TYPES)))
    return groups.orderBy(position)
