"""From raw string columns to a valid price table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import CODE

# Header spellings of price files and the column each one stands for.
HEADER_ALIASES = {
    "Date": "date", "DATE": "date",
    "Open": "open", "OPEN": "open",
    "High": "high", "HIGH": "high",
    "Low": "low", "LOW": "low",
    "Close": "close", "CLOSE": "close",
    "Volume": "volume", "VOLUME": "volume",
    "Adj Close": "adj_close", "ADJ_CLOSE": "adj_close",
}

OHLC = ("open", "high", "low", "close")
REQUIRED = ("date",) + OHLC


def norm_code(code: Column) -> Column:
    """Left-pads with zeros to five characters and never shortens."""
    text = code.cast("string")
    return F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)


def standard_headers(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in HEADER_ALIASES.items() if k in df.columns})


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED if c not in standard_headers(df).columns]


def to_number(c: str, text: bool = True) -> Column:
    """A double, or NULL for text that is none; NaN counts as missing. A digit or point with
    a type letter behind it (1.5d) is no number, though Java reads one."""
    x = F.col(c).try_cast("double")
    known = ~F.isnan(x)
    return F.when(known & ~F.col(c).rlike(r"[0-9.][dDfF]\s*$") if text else known, x)


def to_date(c: str, date_format: str) -> Column:
    """A date, or NULL for text that is none. ISO dates need no formatter object."""
    if date_format != "yyyy-MM-dd":
        return F.try_to_date(c, date_format)
    return F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(c).try_cast("date"))


def typed_prices(raw: DataFrame, date_format: str = "yyyy-MM-dd", keep_raw: bool = False) -> DataFrame:
    """The columns with their types, NULL where a text does not parse; no row is dropped. With
    ``keep_raw``, ``raw`` has the texts as they were read.

    The values of a row are made as the one element of an array that is unfolded: filters on them
    cannot be moved below it, where each comparison would parse its texts again."""
    df = standard_headers(raw)
    absent = [c for c in REQUIRED if c not in df.columns]
    if absent:
        raise ValueError(f"price table lacks {absent}")
    numbers = [c for c in OHLC + ("volume", "adj_close") if c in df.columns]
    kinds = dict(df.dtypes)
    made = {"date": to_date("date", date_format),
            **{c: to_number(c, kinds[c] == "string") for c in numbers}}
    rest = [F.col(c) for c in df.columns if c not in made]
    before = [F.struct(*[F.col(c).cast("string").alias(c) for c in made]).alias("raw")] * keep_raw
    typed = df.select(*rest, *before, F.inline(F.array(F.struct(*[x.alias(c) for c, x in made.items()]))))
    return typed.select(*df.columns, *["raw"] * keep_raw)


def parse_prices(raw: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Typed columns; rows without a date or without all four prices are dropped."""
    return typed_prices(raw, date_format).dropna(subset=list(REQUIRED))


def first_fault() -> Column:
    """The first rule that a typed row breaks, in the order of the cleaning chain; NULL for a good row."""
    o, h, l, c = (F.col(x) for x in OHLC)
    rules = [*((F.col(x).isNull(), f"no {x}") for x in REQUIRED),
             (h < l, "high below low"), (h < o, "high below open"), (h < c, "high below close"),
             (l > o, "low above open"), (l > c, "low above close"),
             ((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0), "price not positive")]
    return F.coalesce(*[F.when(broken, F.lit(name)) for broken, name in rules])


def judge_prices(raw: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Every row that was read, typed, with the first rule it breaks as ``reason`` (NULL for a good row)
    and its texts as they were read as ``raw``."""
    return typed_prices(raw, date_format, keep_raw=True).withColumn("reason", first_fault())


def is_invalid_bar() -> Column:
    o, h, l, c = (F.col(x) for x in OHLC)
    return ((h < l) | (h < o) | (h < c) | (l > o) | (l > c)
            | (o <= 0) | (h <= 0) | (l <= 0) | (c <= 0))


def validate_ohlc(prices: DataFrame) -> DataFrame:
    return prices.where(~is_invalid_bar())


def invalid_ohlc_counts(prices: DataFrame) -> DataFrame:
    return prices.groupBy(CODE).agg(
        F.count_if(is_invalid_bar()).alias("invalid_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def fill_volume(prices: DataFrame) -> DataFrame:
    volume = F.col("volume") if "volume" in prices.columns else F.lit(None).cast("double")
    return prices.withColumn("volume", F.coalesce(volume, F.lit(0.0)))


def clean_prices(raw: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """The whole cleaning chain: one narrow pass, no shuffle."""
    return fill_volume(validate_ohlc(parse_prices(raw, date_format)))


def write_judged(raw: DataFrame, path: str, date_format: str = "yyyy-MM-dd") -> None:
    """Good rows and rejected ones as two parts of one table, written in one pass over the input."""
    judged = judge_prices(raw, date_format)
    judged.withColumn("part", F.when(F.col("reason").isNull(), "kept").otherwise("rejected")).write.partitionBy("part").parquet(path)


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    """The price table that ``clean_prices`` makes of the same input."""
    return fill_volume(spark.read.parquet(path).where("part = 'kept'").drop("part", "reason", "raw"))


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """The rows that were left out, each with the reason and its texts as they were read."""
    return spark.read.parquet(path).where("part = 'rejected'").drop("part")


def clean_stock_list(raw: DataFrame) -> DataFrame:
    """Padded codes; the sector falls back to the industry where it has no column."""
    df = raw.withColumnRenamed("Code", "code") if "Code" in raw.columns else raw
    df = df.withColumn("code", norm_code(F.col("code")))
    if "sector_name" not in df.columns and "industry_name" in df.columns:
        df = df.withColumn("sector_name", F.col("industry_name"))
    return df
