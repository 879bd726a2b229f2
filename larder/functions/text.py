"""Text clean-up used by the loaders and by the recommendation tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_text(*parts: Column | str) -> Column:
    """Concatenate, skipping NULL parts (Spark's own concat would return NULL)."""
    return F.concat_ws("", *parts)


def decimal_comma(text: Column) -> Column:
    """'1,5' to 1.5 as float; NULL where the text is no number, which the tables' reject functions report."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("float")


def measured(text: Column) -> Column:
    """Composition-table number: '-' means unknown, 'traces' means 0."""
    without_traces = F.replace(text, F.lit("traces"), F.lit("0"))
    return F.when(text != "-", decimal_comma(without_traces))


def yes_no(text: Column) -> Column:
    return text.cast("boolean")


def first_parts(text: Column, count: int, separator: str = ", ") -> Column:
    return F.substring_index(text, separator, count)


def one_micro_sign(text: Column) -> Column:
    """Greek small mu to the micro sign, so that unit names compare equal."""
    return F.translate(text, "μ", "µ")


def plain_age(text: Column) -> Column:
    """Age-group label without soft hyphens and with '<=' spelled in ASCII."""
    return F.regexp_replace(F.regexp_replace(text, "\u00ad", ""), "≤", "<=")


def without_hard_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "\u00a0", "")


def name_and_unit(label: Column) -> Column:
    """'sodium_mg' to struct(name, unit), cut at the last underscore."""
    pattern = r"(.+)_(\w+)"  # fixed value: the label format
    return F.struct(
        F.regexp_extract(label, pattern, 1).alias("name"), F.regexp_extract(label, pattern, 2).alias("unit")
    )


def header_name_and_unit(header: Column) -> Column:
    """'Fibres or fiber (g/100g)' to struct('Fibres', 'g'); NULL where the header has no such unit."""
    pattern = r"^(.+)\s+\((\w*g|kJ|kcal)/100g\)"  # fixed value: the header format
    name = F.split(F.regexp_extract(header, pattern, 1), " or ")[0]
    unit = F.replace(F.regexp_extract(header, pattern, 2), F.lit("kJ"), F.lit("kj"))
    return F.when(header.rlike(pattern), F.struct(name.alias("name"), unit.alias("unit")))


def day_month_year(text: Column) -> Column:
    """'04 July 2025' to a date."""
    return F.to_date(F.trim(text), "d MMMM yyyy")


def is_hex_color(text: Column) -> Column:
    return text.rlike("^#[0-9a-fA-F]{6}$")


def matches_whole(text: Column, pattern: str) -> Column:
    """SIMILAR TO: the pattern has to cover the whole string."""
    return text.rlike(f"^(?:{pattern})$")
