"""Answers of a quotes service that were landed as JSON pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import CODE
from ..operators.cleaning import norm_code, standard_headers

# The fields that each page is known to have, and their types.
LISTING = {"Date": "string", "Code": "string", "CompanyName": "string", "Sector": "string",
           "Market": "string"}
QUOTES = {"Code": "string", "Date": "string", "Open": "double", "High": "double",
          "Low": "double", "Close": "double", "Volume": "double"}


def landed_rows(spark: SparkSession, path: str, field: str, known: dict[str, str],
                whole_files: bool, schema: str | None) -> DataFrame:
    """All fields of the rows that the pages hold: the known ones first, in their types, then
    every other that a page has. Without a schema the fields are found by a pass over the pages."""
    reader = spark.read.option("multiLine", whole_files)
    pages = (reader.schema(schema) if schema else reader).json(path)
    rows = dict(pages.dtypes).get(field, "")
    if not rows.startswith("array<struct<"):
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in known.items()))
    found = pages.select(F.explode(field).alias("x")).select("x.*")
    of = {c: F.col(c).cast(t) if c in found.columns else F.lit(None).cast(t) for c, t in known.items()}
    return found.select(*[x.alias(c) for c, x in of.items()],
                        *[c for c in found.columns if c not in known])


def read_listing(spark: SparkSession, path: str, whole_files: bool = False,
                 schema: str | None = None) -> DataFrame:
    listed = landed_rows(spark, path, "info", LISTING, whole_files, schema)
    return listed.withColumn("Code", norm_code(F.col("Code")))


def read_quotes(spark: SparkSession, path: str, whole_files: bool = False,
                schema: str | None = None) -> DataFrame:
    quotes = landed_rows(spark, path, "daily_quotes", QUOTES, whole_files, schema)
    return (standard_headers(quotes).withColumn(CODE, norm_code(F.col("Code"))).drop("Code")
            .withColumn("date", F.try_to_date("date", "yyyy-MM-dd")))
