"""Price files: CSV, one instrument per file or per partition folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import CODE
from ..operators.cleaning import (HEADER_ALIASES, OHLC, REQUIRED, clean_prices, missing_columns,
                                  norm_code)
from ..operators.selection import date_filter, min_history, semi_join_codes, union_sources
from .tables import stored

#: Bytes of all headers up to which they are sent to every task.
SMALL_HEADERS = 8 << 20


def code_of_file(path: Column) -> Column:
    """The instrument a file belongs to: its ``stock_code=`` folder, else its own name
    without extension and without a trailing ``_price``."""
    folder = F.regexp_extract(path, r"stock_code=([^/]+)/", 1)
    name = F.regexp_extract(path, r"([^/]+?)(_price)?\.csv$", 1)
    return norm_code(F.when(folder != "", folder).otherwise(name))


def discover_codes(spark: SparkSession, path: str) -> DataFrame:
    """Codes that have a price file below a folder. Only file listings are read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.csv").load(path).select("path"))
    return files.select(code_of_file(F.col("path")).alias(CODE)).distinct()


def read_price_files(spark: SparkSession, path: str) -> DataFrame:
    """All files of a folder that share one header, every column as text. The code is taken
    from the column of that name where the files have one, else from the file's place:
    thousands of instruments are better kept in few large files. A file with other columns, or
    with the same in another order, is refused: see ``read_mixed_price_files`` for those."""
    df = (spark.read.option("header", True).option("recursiveFileLookup", True)
          .option("enforceSchema", False).option("pathGlobFilter", "*.csv").csv(path))
    held = next((c for c in ("Code", "code", CODE) if c in df.columns), None)
    if held:
        return df.withColumn(held, norm_code(F.col(held))).withColumnRenamed(held, CODE)
    return df.withColumn(CODE, code_of_file(F.col("_metadata.file_path")))


def fields_of(line: Column) -> Column:
    """The fields of a CSV line, however many. A comma with an even number of quotes behind it
    ends a field; quotes around a field go, and two inside it are one."""
    raw = F.when(F.contains(line, F.lit('"')), F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')).otherwise(
        F.split(line, ","))
    bare = lambda f: F.when(f.startswith('"') & f.endswith('"') & (F.length(f) > 1),
                            F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(F.transform(raw, lambda f: F.btrim(f, F.lit("\r"))), bare)


def lines_and_headers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The lines of all files without their headers, and one row per file with the names of
    its columns. Only the header lines are parsed here."""
    lines = (spark.read.option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.csv").text(path)
             .select("value", F.col("_metadata.file_path").alias("file")))
    is_header = F.col("value").rlike(r'(^|,)"?(date|Date|DATE)"?(,|\r?$)')
    alias = F.create_map(*[F.lit(x) for pair in HEADER_ALIASES.items() for x in pair])
    names = F.transform(fields_of(F.col("value")), lambda f: F.coalesce(alias[f], f))
    headers = lines.where(is_header).groupBy("file").agg(F.min(names).alias("names"))
    return lines.where(~is_header), stored(headers, "headers")


def with_own_header(body: DataFrame, headers: DataFrame) -> DataFrame:
    """Each line's columns by the header of its file; a column that a file lacks is NULL. The
    headers are sent to all tasks where they are small, so that the lines stay where they are."""
    size = headers.agg(F.sum(F.length("file") + F.length(F.to_json("names")))).head()[0] or 0
    headers = F.broadcast(headers) if size < SMALL_HEADERS else headers
    lines = body.join(headers, "file").withColumn("fields", fields_of(F.col("value")))
    place = lambda c: F.array_position("names", F.lit(c)).cast("int")
    value = lambda c: F.when(place(c) > 0, F.get("fields", place(c) - 1))
    given = lambda c: F.when(value(c) != "", value(c)).alias(c)
    return lines.select(code_of_file(F.col("file")).alias(CODE),
                        *[given(c) for c in ("date",) + OHLC + ("volume", "adj_close")])


def read_mixed_price_files(spark: SparkSession, path: str) -> DataFrame:
    """Files whose headers differ in spelling, order or number of columns: each file's own
    header line says which field is which."""
    return with_own_header(*lines_and_headers(spark, path))


def read_price_layouts(spark: SparkSession, root: str) -> DataFrame:
    """Each code's prices from the first of its three possible files that has the required
    columns: ``<code>.csv``, ``<code>_price.csv``, ``prices/<code>.csv`` (``source`` 0, 1, 2)."""
    body, headers = lines_and_headers(spark, root)
    file = F.col("file")
    rank = (F.when(file.rlike(r"/prices/[^/]+\.csv$"), 2)
            .when(file.rlike(r"_price\.csv$"), 1).otherwise(0))
    usable = F.forall(F.array(*map(F.lit, REQUIRED)), lambda c: F.array_contains("names", c))
    own = Window.partitionBy(CODE).orderBy("source", "file")
    chosen = (headers.where(usable).withColumns({CODE: code_of_file(file), "source": rank})
              .withColumn("place", F.row_number().over(own)).where("place = 1"))
    chosen = stored(chosen.select("file", "names", CODE, "source"), "chosen")
    prices = with_own_header(body, chosen.select("file", "names"))
    return prices.join(chosen.select(CODE, "source"), CODE)


def first_source(tables: list[DataFrame]) -> DataFrame:
    """Of several tables keyed by code, each code's rows from the first usable table that
    has it. A table without the required columns is passed over."""
    usable = [t.withColumn("source", F.lit(i)) for i, t in enumerate(tables)
              if not missing_columns(t)]
    if not usable:
        raise ValueError("no source has the required columns")
    tagged = union_sources(*usable)
    first = tagged.groupBy(CODE).agg(F.min("source").alias("source"))
    return tagged.join(first, [CODE, "source"], "left_semi")


def load_prices(raw: DataFrame, codes: DataFrame | None = None, start: str | None = None,
                end: str | None = None, min_rows: int = 100) -> DataFrame:
    """Cleaned prices of the listed codes in a date range, without short series."""
    prices = clean_prices(raw)
    if codes is not None:
        prices = semi_join_codes(prices, codes)
    # counted and kept from one table, so that the files are read and parsed once
    return min_history(stored(date_filter(prices, start, end), "cleaned"), min_rows)


def write_price_files(prices: DataFrame, path: str) -> None:
    """One folder per code. Rows are brought together by code first, so a folder gets one file;
    only what is too much for a task, as of a code with any share of the rows, is divided among
    several. Each task moves its files to their place itself."""
    (prices.hint("rebalance", CODE).write.partitionBy(CODE).option("header", True)
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(path))
