"""Readers for the CSV and Parquet inputs. Each returns the columns the marts use, typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import text as X
from larder.operators.ordered import in_file_order
from larder.operators.quality import Rule
from larder.sources import schemas as S
from larder.sources.xml import read_xml_rows


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns of `schema` by header name, whatever else the file holds and in whatever order.

    Everything is read as text first, so one unreadable cell cannot shift a row. The hidden column _metadata stays.
    """
    text = spark.read.option("header", True).option("multiLine", False).option("escape", '"').csv(path)
    present = {c.lower(): c for c in text.columns}
    missing = [f.name for f in schema.fields if f.name.lower() not in present]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return text.select(
        *[F.col(f"`{present[f.name.lower()]}`").cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def nutrient_map(spark: SparkSession, path: str) -> DataFrame:
    kept = [c for c in S.NUTRIENT_MAP.names if c not in ("ciqual_const_name_fr", "comments")]
    return read_csv(spark, path, S.NUTRIENT_MAP).where("calnut_const_code IS NOT NULL").select(*kept)


def nutrient_map_rows(spark: SparkSession, path: str) -> DataFrame:
    """The whole nutrient map with its file order as `row_num`, to be rewritten; from 0, over all its files and splits."""
    return in_file_order(read_csv(spark, path, S.NUTRIENT_MAP)).withColumn("row_num", F.col("row_num") - 1)


def ciqual_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Rows of one table of the first composition source, from its XML file or from a CSV made of it."""
    return read_xml_rows(spark, path, row_tag, schema) if path.endswith(".xml") else read_csv(spark, path, schema)


def recommendations_macro(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.RECOMMENDATIONS_MACRO)


def recommendations_nnr2023(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.RECOMMENDATIONS_NNR2023)


def unit_conversion(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.UNIT_CONVERSION).select("from_unit", "to_unit", "conversion_factor")


def ssgrp_colors(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.SSGRP_COLORS)


def ciqual_alim(rows: DataFrame) -> DataFrame:
    """Food names and groups from text rows (CSV or XML); group codes stay text."""
    return rows.select(
        F.col("alim_code").cast("long"), "alim_nom_eng", "alim_grp_code", "alim_ssgrp_code", "alim_ssssgrp_code"
    )


def ciqual_compo(rows: DataFrame) -> DataFrame:
    """Composition facts from text rows (CSV or XML)."""
    return rows.select(
        F.col("alim_code").cast("long"),
        F.col("const_code").cast("long"),
        "code_confiance",
        F.col("source_code").cast("long"),
        X.measured(F.col("min")).alias("lb"),
        X.measured(F.col("max")).alias("ub"),
        X.measured(F.col("teneur")).alias("mean"),
    )


def readable_measures() -> list[Rule]:
    """Of composition text rows: each number is missing, marked as unknown, or can be read."""
    return [
        Rule(f"{c} is readable", F.coalesce(F.col(c) == "-", F.lit(True)) | X.measured(F.col(c)).isNotNull()) for c in ("min", "max", "teneur")
    ]


def unreadable_measures(rows: DataFrame) -> DataFrame:
    """Composition rows whose numbers `ciqual_compo` could not read, to be looked at rather than lost."""
    first, second, third = (~r.holds for r in readable_measures())
    return rows.where(first | second | third)


def ciqual_sources(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("source_code").cast("long"), "ref_citation")


def calnut_0(spark: SparkSession, path: str) -> DataFrame:
    return calnut_foods(read_csv(spark, path, S.CALNUT_0))


def calnut_foods(rows: DataFrame) -> DataFrame:
    """One row per food: the file repeats each food for three hypotheses, of which MB is kept."""
    return rows.where(F.col("HYPOTH") == "MB").drop("HYPOTH").withColumn("ALIM_CODE", F.col("ALIM_CODE").cast("long"))


def calnut_1(spark: SparkSession, path: str) -> DataFrame:
    return calnut_values(read_csv(spark, path, S.CALNUT_1))


_CALNUT_NUMBERS = {"LB": "lb", "UB": "ub", "MB": "mean"}


def calnut_values(rows: DataFrame) -> DataFrame:
    """Text rows of the composition file, typed; numbers that can't be read are NULL, and in unreadable_calnut."""
    return rows.select(
        F.col("ALIM_CODE").cast("long"),
        "FOOD_LABEL",
        "CONST_LABEL",
        F.col("CONST_CODE").cast("long"),
        X.yes_no(F.col("indic_combl")).alias("combl"),
        *[X.decimal_comma(F.col(old)).alias(new) for old, new in _CALNUT_NUMBERS.items()],
    )


def readable_calnut() -> list[Rule]:
    """Of the composition file's text rows: each number is missing or can be read."""
    return [Rule(f"{c} is readable", F.coalesce(F.trim(c) == "", F.lit(True)) | X.decimal_comma(F.col(c)).isNotNull()) for c in _CALNUT_NUMBERS]


def unreadable_calnut(rows: DataFrame) -> DataFrame:
    """Text rows with a number that is given but can't be read."""
    first, second, third = (~r.holds for r in readable_calnut())
    return rows.where(first | second | third)


def agribalyse(spark: SparkSession, path: str) -> DataFrame:
    return agribalyse_values(read_csv(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in S.AGRIBALYSE_NAMES])))


def agribalyse_values(rows: DataFrame) -> DataFrame:
    """Life-cycle impacts by food; rows without either code (blank padding rows among them) are left out."""

    def typed(name: str) -> str:
        if name in S.AGRIBALYSE_TEXT:
            return "string"
        return "long" if name in S.AGRIBALYSE_LONG else "double"

    named = rows.select(*[F.col(f"`{old}`").cast(typed(new)).alias(new) for old, new in S.AGRIBALYSE_NAMES.items()])
    return named.where("agribalyse_food_code IS NOT NULL AND ciqual_food_code IS NOT NULL")


def exchange_rates(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.EXCHANGE_RATES)


def exchange_rates_wide(spark: SparkSession, path: str) -> DataFrame:
    """The published one-row file (a date and one column per currency) as (date, currency, rate)."""
    wide = spark.read.option("header", True).csv(path)
    return rates_to_long(wide)


def rates_to_long(wide: DataFrame, date: str = "Date") -> DataFrame:
    """Unpivot currency columns, drop blanks, add EUR = 1."""
    named = wide.withColumn("EUR", F.lit("1.0"))
    named = named.withColumnsRenamed({c: c.strip() for c in named.columns})
    currencies = [c for c in named.columns if c and c != date and not c.startswith("_c")]
    long = named.select(date, *[F.col(f"`{c}`").cast("string").alias(c) for c in currencies]).unpivot(
        [date], currencies, "currency", "rate"
    )
    return long.where(F.trim("rate") != "").select(
        X.day_month_year(F.col(date)).alias("date"), "currency", F.trim("rate").cast("double").alias("rate")
    )


def prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PRICES).parquet(path)


def products(spark: SparkSession, path: str) -> DataFrame:
    """The catalog's columns that are used, typed as S.PRODUCTS says. A file that lacks one would read as NULL: that is an error."""
    missing = sorted(set(S.PRODUCTS.names) - set(spark.read.parquet(path).columns))  # names alone, from a footer
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    rows = spark.read.schema(S.PRODUCTS).parquet(path)
    return with_food_code(rows).select(
        "code", "countries_tags", "nova_group", "nutriments",
        F.col("ecoscore_score").alias("eco_score"), F.col("nutriscore_score").alias("nutri_score"),
        "product_name", "product_quantity_unit", F.col("product_quantity").cast("float").alias("product_quantity"),
        F.col("quantity").alias("quantity_str"), "categories", "categories_tags", "compared_to_category",
        "categories_properties", "ciqual_food_code", "ciqual_food_code_origin",
    )


def with_food_code(products: DataFrame, properties: str = "categories_properties") -> DataFrame:
    """Add the best known food code and which of the three sources it came from."""
    own, exact, proxy = (
        F.col(f"{properties}.{name}")
        for name in ("ciqual_food_code", "agribalyse_food_code", "agribalyse_proxy_food_code")
    )
    origin = (
        F.when(own.isNotNull(), "")
        .when(exact.isNotNull(), "agribalyse_")
        .when(proxy.isNotNull(), "agribalyse_proxy_")
        .otherwise("unknown")
    )
    return products.withColumns(
        {"ciqual_food_code": F.coalesce(own, exact, proxy).cast("int"), "ciqual_food_code_origin": origin}
    )


def subset(tables: dict[str, DataFrame], keys: dict[str, dict[str, list]]) -> dict[str, DataFrame]:
    """The rows of each table whose columns are in the given lists; other tables stay whole."""
    out = dict(tables)
    for name, wanted in keys.items():
        for column, values in wanted.items():
            out[name] = out[name].where(F.col(column).isin(values))
    return out
