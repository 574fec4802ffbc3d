"""Delimited files, index extracts and polygon tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: StructType,
    sep: str = ";",
    decimal_comma: bool = False,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Survey file with a header; fields trimmed, empty fields NULL.

    With `decimal_comma`, double columns are read as text, because the reader takes doubles
    with a point only, and cast in full precision; points before the comma group digits.
    Text that is no number is NULL.
    """
    reader = (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("encoding", encoding)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
    )
    if not decimal_comma:
        return reader.schema(schema).csv(path)
    doubles = {f.name for f in schema if isinstance(f.dataType, DoubleType)}
    fields = [StructField(f.name, StringType() if f.name in doubles else f.dataType, f.nullable) for f in schema]
    frame = reader.schema(StructType(fields)).option("locale", "pt-BR").csv(path)

    def number(name: str):
        text = F.col(name)
        grouped = F.when(text.contains(","), F.translate(text, ".", "")).otherwise(text)
        return F.translate(grouped, ",", ".").try_cast("double")

    return frame.withColumns({c: number(c) for c in doubles})


def comma_numbers(frame: DataFrame) -> DataFrame:
    """Fractional columns as text with a decimal comma, in the shortest form that reads back as the same number.

    Numbers too large or too small to be written out have an exponent.
    """
    numeric = [f.name for f in frame.schema if f.dataType.typeName() in ("double", "float", "decimal")]

    def text(name: str):
        number = F.col(name).cast("double")
        shortest = F.regexp_replace(number.cast("string"), r"\.0$", "")
        decimal = number.try_cast("decimal(38,18)")
        plain = F.regexp_replace(decimal.cast("string"), r"\.?0+$", "")
        written = F.when(shortest.contains("E") & (plain.try_cast("double") == number), plain).otherwise(shortest)
        return F.translate(written, ".", ",")

    return frame.withColumns({name: text(name) for name in numeric})


def write_delimited(frame: DataFrame, path: str, sep: str = ";", encoding: str = "ISO-8859-1") -> None:
    """Delimited file in the form the readers of the survey expect: latin-1, decimal comma, empty NULLs."""
    (
        comma_numbers(frame)
        .write.option("sep", sep)
        .option("header", True)
        .option("encoding", encoding)
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def read_index_extract(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Saved extract of the price index: period code, period label, monthly change in %."""
    reader = spark.read.option("header", True)
    raw = reader.schema("`Mês (Código)` string, `Mês` string, `Valor` string, classe int").format(fmt).load(path)
    return index_columns(raw)


def index_columns(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed({"Mês (Código)": "ref", "Mês": "ref1", "Valor": "valor"}).withColumn(
        "valor", F.col("valor").try_cast("double")
    )


def read_polygons(spark: SparkSession, attributes: str, vertices: str) -> tuple[DataFrame, DataFrame]:
    """Polygon attributes, and vertices (poly_id, ring, seq, x, y)."""
    return spark.read.parquet(attributes), spark.read.parquet(vertices)
