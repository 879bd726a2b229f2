"""Record-oriented XML: every repeated element becomes a row, its children become text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Windows-1252 gives these bytes printable characters; Latin-1 has control codes there.
_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_LATIN = "".join(map(chr, _BYTES))
_WINDOWS = bytes(_BYTES).decode("cp1252")


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Rows of a windows-1252 file in which '<' and '&' may stand unescaped in text.

    The closing row tag serves as line separator, so that a large file is still
    read in splits by many tasks.
    """
    records = spark.read.option("lineSep", f"</{row_tag}>").text(path).select(_windows_1252("value").alias("value"))
    return xml_rows(records, row_tag, schema)


def read_clean_xml_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType, charset: str = "windows-1252") -> DataFrame:
    """Rows of a well-formed file by Spark's own XML source; `_corrupt_record` is the text of a record that does not parse.

    For files whose signs are escaped; read_xml_rows repairs those that are not. The source splits large files itself.
    """
    checked = T.StructType([*[T.StructField(n, T.StringType()) for n in schema.names], T.StructField("_corrupt_record", T.StringType())])
    options = {"rowTag": row_tag, "charset": charset, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreSurroundingSpaces": "true"}
    rows = spark.read.format("xml").options(**options).schema(checked).load(path)
    return rows.select(*[F.nullif(F.trim(f"`{n}`"), F.lit("")).alias(n) for n in schema.names], "_corrupt_record")


def xml_rows(records: DataFrame, row_tag: str, schema: T.StructType) -> DataFrame:
    """Rows from text records (`value`), each up to a closing row tag; one that does not parse is left out."""
    parsed = _parsed(records, row_tag, schema).where("row._corrupt_record IS NULL")
    return parsed.select(*[F.nullif(F.trim(f"row.`{n}`"), F.lit("")).alias(n) for n in schema.names])


def unreadable_xml(records: DataFrame, row_tag: str, schema: T.StructType) -> DataFrame:
    """The records (`value`) that have an opening row tag, but do not parse."""
    return _parsed(records, row_tag, schema).where("row._corrupt_record IS NOT NULL").select("value")


def _parsed(records: DataFrame, row_tag: str, schema: T.StructType) -> DataFrame:
    opening = F.instr("value", f"<{row_tag}>")
    body = F.substring("value", opening + len(row_tag) + 2, F.length("value"))
    checked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return records.where(opening > 0).select(
        "value",
        F.from_xml(
            F.concat(F.lit("<row>"), _repaired(body), F.lit("</row>")),
            F.lit(checked.simpleString()),
            {"ignoreSurroundingSpaces": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
        ).alias("row"),
    )


def _windows_1252(name: str) -> Column:
    raw = F.decode(F.col(name).cast("binary"), "ISO-8859-1")
    return F.translate(raw, _LATIN, _WINDOWS)


def _repaired(body: Column) -> Column:
    """Drop the '<' and '&' that start neither a tag nor an entity, and the attributes of empty markers."""
    no_stray_less = F.regexp_replace(body, r"<(?![A-Za-z_/!?])", "")
    no_stray_and = F.regexp_replace(no_stray_less, r"&(?!(?:#\d+|#x[0-9A-Fa-f]+|[A-Za-z]\w*);)", "")
    return F.regexp_replace(no_stray_and, r"<([A-Za-z_][\w.-]*)\s[^<>]*?(/?)>", "<$1$2>")
