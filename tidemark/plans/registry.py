"""The registered queries: each reads the given tables, whole, and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import CODE, lay_out, settle, with_position
from ..functions.ewm import macd
from ..operators import cleaning, ensembles, features, forecasts, indicators, learning, medians, model_tables, moments
from ..operators import reversals as turns
from ..operators import selection, trends
from ..operators.evaluation import eval_classification, eval_regression
from ..params import KINDS, TrendParams
from ..session import workspace
from ..sources import landed_json, price_files, tables
from ..streaming import bars as stream_bars
from .fixtures import bar_rows, bars, bars_by_code, raw_prices, stock_list, table

# Prices of the derived bars jump by hundreds a day and their volumes are small, so the
# thresholds that leave something on both sides differ from the defaults.
WIDE = TrendParams(trend_threshold=300.0)
LIQUID = 28.0
LONG_HISTORY = 533
RUN_TS = "2025-01-01T00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 4, **apart: int) -> DataFrame:
    """Doubles rounded for the comparison. Exact halves are common among these prices, and
    the last bits of a sum differ between engines: the boundary lies a little below half."""
    def cut(c: str):
        unit = float(10 ** apart.get(c, digits))
        return F.floor(F.col(c) * unit + 0.50001) / F.lit(unit) + F.lit(0.0)

    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: cut(c) for c in doubles})


def pick(df: DataFrame, *cols: str, digits: int = 4, **apart: int) -> DataFrame:
    return rounded(df.select(CODE, "date", *cols), digits, **apart)


# --- sources and sinks -----------------------------------------------------------------

@query
def stock_list_clean(spark, d):
    path = workspace(spark, "listing")
    stock_list(spark, d).write.option("header", True).csv(path)
    return cleaning.clean_stock_list(spark.read.option("header", True).csv(path))


QUERIES["stock_list"] = QUERIES.pop("stock_list_clean")


def raw_files(spark, d) -> str:
    path = workspace(spark, "prices")
    raw = raw_prices(spark, d).withColumn(CODE, F.col("Code")).drop("Code")
    price_files.write_price_files(raw, path)
    return path


@query
def load_prices(spark, d):
    listed = cleaning.clean_stock_list(stock_list(spark, d)).select(F.col("code").alias(CODE))
    path = workspace(spark, "raw")
    raw_prices(spark, d).write.option("header", True).csv(path)
    raw = price_files.read_price_files(spark, path)
    df = price_files.load_prices(raw, listed, "1995-01-01", "2001-06-30", 400)
    return pick(df, "open", "high", "low", "close", "volume")


@query
def load_mixed_prices(spark, d):
    df = cleaning.clean_prices(price_files.read_mixed_price_files(spark, raw_files(spark, d)))
    return pick(df, "open", "high", "low", "close", "volume")


@query
def discover_codes(spark, d):
    return price_files.discover_codes(spark, raw_files(spark, d))


@query
def ticks_to_bars(spark, d):
    """Daily bars of the events' values, built by a stream that ends with what is there now."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    ticks = events.select(F.col("user_id").cast("string").alias(CODE), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
                          F.col("value").alias("price"), F.lit(1.0).alias("size"))
    out = workspace(spark, "bars")
    stream_bars.write_bars(ticks, out, workspace(spark, "bars-checkpoint"), lateness="40 days").awaitTermination()
    made = stream_bars.latest_bars(spark, out)
    return rounded(made.select(CODE, F.to_date("start").alias("date"), *stream_bars.VALUES))


@query
def resolve_sources(spark, d):
    raw = raw_prices(spark, d).withColumn(CODE, cleaning.norm_code(F.col("Code")))
    n = F.col("Code").cast("long")
    found = price_files.first_source([raw.where(n % 2 == 0).drop("Close"),
                                      raw.where(n % 3 == 0).withColumn("Volume", F.lit("1")), raw])
    return found.groupBy(CODE, "source").agg(F.count(F.lit(1)).alias("rows"))


@query
def ingest_listing(spark, d):
    path = workspace(spark, "listing-pages")
    s = stock_list(spark, d).select(
        F.lit("2025-05-01").alias("Date"), F.col("code").alias("Code"),
        F.col("name").alias("CompanyName"), F.col("industry_name").alias("Sector"),
        F.col("market_name").alias("Market"), F.lower("name").alias("CompanyNameLower"),
        F.length("name").cast("long").alias("NameLength"))
    page = F.floor(F.col("Code").cast("long") / 20).alias("page")
    rows = F.struct(*s.columns)
    s.groupBy(page).agg(F.collect_list(rows).alias("info")).select("info").write.json(path)
    return landed_json.read_listing(spark, path)


@query
def ingest_quotes(spark, d):
    path = workspace(spark, "quote-pages")
    b = bars(spark, d).select(
        F.col(CODE).alias("Code"), F.date_format("date", "yyyy-MM-dd").alias("Date"),
        *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")],
        (F.col("close") * F.col("volume")).alias("TurnoverValue"))
    quarter = F.trunc(F.col("Date").cast("date"), "quarter").alias("page")
    rows = F.struct(*b.columns)
    (b.groupBy("Code", quarter).agg(F.collect_list(rows).alias("daily_quotes"))
     .select("daily_quotes").write.json(path))
    return pick(landed_json.read_quotes(spark, path), "open", "high", "low", "close", "volume",
                "TurnoverValue", TurnoverValue=2)


@query
def features_roundtrip(spark, d):
    path = workspace(spark, "features")
    tables.save_features(indicators.basic_features(bars_by_code(spark, d)), path)
    df = tables.load_features(spark, path)
    return pick(df, "price_range", "volatility_20d", "rsi", "volume_ratio", volatility_20d=7)


@query
def liquid_stock_list(spark, d):
    """The listing without illiquid codes, written to a new table."""
    b = bars(spark, d)
    liquid = selection.median_above(b, LIQUID)
    illiquid = selection.anti_join_codes(selection.distinct_codes(b), liquid)
    listed = cleaning.clean_stock_list(stock_list(spark, d)).withColumnRenamed("code", CODE)
    return tables.stored(selection.anti_join_codes(listed, illiquid), "liquid-list")


# --- cleaning and selection --------------------------------------------------------------

@query
def norm_code(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("code"))
    long = s.select(F.concat(F.lit("12"), "code", F.lit("345")).alias("code"))
    both = selection.union_sources(s, long)
    return both.select("code", cleaning.norm_code(F.col("code")).alias(CODE))


def with_code(spark, d) -> DataFrame:
    return raw_prices(spark, d).withColumn(CODE, cleaning.norm_code(F.col("Code"))).drop("Code")


@query
def clean_prices(spark, d):
    df = cleaning.clean_prices(with_code(spark, d))
    return pick(df, "open", "high", "low", "close", "volume")


@query
def validate_ohlc(spark, d):
    df = cleaning.validate_ohlc(cleaning.parse_prices(with_code(spark, d)))
    return pick(df, "open", "high", "low", "close")


@query
def invalid_ohlc_counts(spark, d):
    return cleaning.invalid_ohlc_counts(cleaning.parse_prices(with_code(spark, d)))


@query
def rejected_prices(spark, d):
    """What cleaning left out, by the first rule that a row breaks, and what it kept."""
    path = workspace(spark, "judged")
    cleaning.write_judged(with_code(spark, d), path)
    kept, rejected = cleaning.read_kept(spark, path), cleaning.read_rejected(spark, path)
    told = selection.union_sources(
        kept.select(F.lit("kept").alias("reason"), "close", "volume"),
        rejected.select("reason", F.col("raw.close").try_cast("double").alias("close"), F.col("raw.volume").try_cast("double").alias("volume")))
    return rounded(told.groupBy("reason").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("close").alias("closes"), F.sum("volume").alias("volumes")), 1)


@query
def date_filter(spark, d):
    return pick(selection.date_filter(bars(spark, d), "1996-01-01", "1997-12-31"), "close", "volume")


@query
def min_history(spark, d):
    return pick(selection.min_history(bars(spark, d), LONG_HISTORY), "close")


@query
def liquidity_filter(spark, d):
    return pick(selection.liquidity_filter(bars(spark, d), LIQUID), "close", "volume")


@query
def median_volume(spark, d):
    return rounded(selection.median_volume(bars(spark, d)))


@query
def median_volume_sliced(spark, d):
    """Of series in slabs, by selection."""
    return rounded(selection.median_volume(cut_bars(spark, d)))


@query
def median_price_by_flag(spark, d):
    """Few keys, of which one holds half of all rows, and about as many prices as rows."""
    return rounded(medians.median_by_selection(
        table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "median_price", most=2048), 3)


@query
def semi_join_codes(spark, d):
    s = cleaning.clean_stock_list(stock_list(spark, d))
    some = s.where("market_name = 'ASIA' or industry_name like '%1%'").select(
        F.col("code").alias(CODE))
    return pick(selection.semi_join_codes(bars(spark, d), some), "close")


@query
def anti_join_illiquid(spark, d):
    b = bars(spark, d)
    return pick(selection.anti_join_codes(b, selection.median_above(b, LIQUID)), "close", "volume")


@query
def latest_data(spark, d):
    return pick(selection.latest_data(bars(spark, d), ["00001", "00004", "00007"]), "close")


@query
def latest_row(spark, d):
    return pick(selection.latest_row(bars(spark, d)), "open", "high", "low", "close", "volume")


@query
def distinct_codes(spark, d):
    return selection.distinct_codes(bars(spark, d))


@query
def head_codes(spark, d):
    return selection.head_codes(bars(spark, d), 5)


@query
def union_sources(spark, d):
    b = bars(spark, d)
    early, late = b.where("date < '1997-01-01'"), b.where("date >= '1997-01-01'").drop("volume")
    return pick(selection.union_sources(early, late), "close", "volume")


@query
def points_per_stock(spark, d):
    return selection.points_per_stock(bars(spark, d))


@query
def data_summary(spark, d):
    return rounded(selection.data_summary(bars(spark, d)))


# --- indicators --------------------------------------------------------------------------

@query
def candle_features(spark, d):
    return pick(indicators.candle_features(bars(spark, d)),
                "price_range", "body_size", "upper_shadow", "lower_shadow")


@query
def returns(spark, d):
    return pick(indicators.returns(bars(spark, d)), "return_1d", "return_1d_log", digits=7)


@query
def moving_averages(spark, d):
    return pick(indicators.moving_averages(bars(spark, d)), "ma_5", "ma_10", "ma_25", "ma_50")


@query
def volatility(spark, d):
    return pick(indicators.volatility(bars(spark, d)), "volatility_5d", "volatility_20d", digits=7)


VOLATILITY = ("price_volatility", "ma_short_volatility", "ma_long_volatility", "volatility_ratio")


@query
def volatility_features(spark, d):
    return pick(indicators.volatility_features(bars(spark, d)), *VOLATILITY, digits=3,
                volatility_ratio=7)


@query
def rsi(spark, d):
    b = bars(spark, d)
    df = indicators.rsi(b, fill=None).withColumn("rsi_filled", F.coalesce("rsi", F.lit(50.0)))
    return pick(df, "rsi_filled", "rsi", digits=6)


@query
def bollinger(spark, d):
    return pick(indicators.bollinger(bars(spark, d)), "bb_upper", "bb_lower", digits=3)


@query
def volume_features(spark, d):
    return pick(indicators.volume_features(bars(spark, d)), "volume_ma_5", "volume_ratio", digits=6)


@query
def momentum(spark, d):
    return pick(indicators.momentum(bars(spark, d)), "roc_5", "roc_25", "ma_convergence",
                "ma_convergence_pct", digits=6, ma_convergence=4)


@query
def ema(spark, d):
    return pick(indicators.ema(bars(spark, d)), "ema_5", "ema_25")


# Windows so far apart that their averages cannot share one pass.
FAR = TrendParams(short_window=10, long_window=100, lookback=120)
FARTHER = TrendParams(short_window=20, long_window=200, lookback=220)


@query
def ema_wide(spark, d):
    df = indicators.ema(bars_by_code(spark, d), FAR)
    return pick(indicators.ema(df, FARTHER), "ema_10", "ema_100", "ema_20", "ema_200")


@query
def macd_recursive(spark, d):
    return pick(macd(bars(spark, d)), "macd", "macd_signal")


QUERIES["macd"] = QUERIES.pop("macd_recursive")


@query
def macd_adjusted(spark, d):
    return pick(macd(bars(spark, d), adjust=True), "macd", "macd_signal")


BASIC = ("price_range", "body_size", "upper_shadow", "lower_shadow", "return_1d", "return_1d_log",
         "volatility_5d", "volatility_20d", "volume_ma_5", "volume_ratio", "rsi", "bb_upper",
         "bb_lower", "macd", "macd_signal")
FINE = {"return_1d": 7, "return_1d_log": 7, "volatility_5d": 7, "volatility_20d": 7,
        "bb_upper": 3, "bb_lower": 3, "price_volatility": 3, "ma_short_volatility": 3,
        "ma_long_volatility": 3, "volatility_ratio": 6}


@query
def basic_features(spark, d):
    return pick(indicators.basic_features(bars(spark, d)), *BASIC, **FINE)


# --- trends ------------------------------------------------------------------------------

SLOPES = ("short_trend_slope", "short_trend_slope_simple", "long_trend_slope",
          "long_trend_slope_simple")
DIRECTIONS = ("short_trend_direction", "short_trend", "long_trend_direction", "long_trend")
STRENGTHS = ("short_trend_strength", "long_trend_strength", "trend_agreement")
CONSISTENCIES = ("short_trend_consistency", "long_trend_consistency")


@query
def trend_slopes(spark, d):
    return pick(trends.trend_slopes(bars(spark, d)), *SLOPES)


@query
def trend_directions(spark, d):
    return pick(trends.trend_directions(bars(spark, d)), *DIRECTIONS)


@query
def trend_directions_wide(spark, d):
    return pick(trends.trend_directions(bars(spark, d), WIDE), *DIRECTIONS)


@query
def trend_features(spark, d):
    return pick(trends.trend_features(bars(spark, d), WIDE), *STRENGTHS)


@query
def trend_consistency(spark, d):
    return pick(trends.trend_consistency(bars(spark, d), WIDE), *CONSISTENCIES)


INDICATORS = ("return_1d", "volatility_5d", "volatility_20d", "rsi", "macd", "macd_signal",
              "ma_5", "ma_25", "ma_10", "ma_50", "ema_5", "ema_25", *SLOPES, *DIRECTIONS,
              *STRENGTHS, *CONSISTENCIES, *VOLATILITY, "roc_5", "roc_25", "ma_convergence",
              "ma_convergence_pct")


@query
def indicators_full(spark, d):
    return pick(trends.indicators(bars_by_code(spark, d)), *INDICATORS, **FINE)


QUERIES["indicators"] = QUERIES.pop("indicators_full")


def shared_bars(spark, d) -> DataFrame:
    """Series that no calendar bounds: several suppliers share a code, so dates repeat."""
    shared = F.lpad((F.col(CODE).cast("long") % 25).cast("string"), 5, "0")
    return bars(spark, d).withColumn(CODE, shared)


def cut_bars(spark, d) -> DataFrame:
    """The same cut into short slabs."""
    return lay_out(shared_bars(spark, d), rows_per_slab=1100, rows=bar_rows(spark, d))


@query
def repeated_dates(spark, d):
    """Series with repeated dates as they are: equal dates stand in the order of the figures."""
    df = indicators.moving_averages(shared_bars(spark, d))
    return pick(df, "close", "ma_5", "ma_25")


@query
def missing_volumes(spark, d):
    """Averages where every seventh day's volume is missing inside a series."""
    b = bars(spark, d).withColumn("volume", F.when(F.dayofyear("date") % 7 != 0, F.col("volume")))
    return pick(indicators.volume_features(b), "volume_ma_5", "volume_ratio", digits=6)


@query
def current_trend_sliced(spark, d):
    return rounded(trends.current_trend(cut_bars(spark, d)))


@query
def last_sequences_sliced(spark, d):
    df = features.last_sequences(cut_bars(spark, d), 60, ["close", "volume"])
    return df.select(CODE, F.size("sequence").alias("rows"))


@query
def data_summary_sliced(spark, d):
    return rounded(selection.data_summary(cut_bars(spark, d)))


@query
def indicators_sliced(spark, d):
    return pick(settle(trends.indicators(cut_bars(spark, d), own=True)), "pos", *INDICATORS, **FINE)


@query
def current_trend(spark, d):
    return rounded(trends.current_trend(bars(spark, d)))


# --- reversals ---------------------------------------------------------------------------

def show_reversals(df: DataFrame) -> DataFrame:
    return rounded(df, 3, actual_price=4)


@query
def reversals_short(spark, d):
    return show_reversals(turns.reversals(bars_by_code(spark, d), "short"))


@query
def reversals_long(spark, d):
    return show_reversals(turns.reversals(bars_by_code(spark, d), "long"))


@query
def recent_reversals(spark, d):
    return show_reversals(turns.recent_reversals(turns.all_reversals(bars_by_code(spark, d))))


@query
def reversal_magnitude(spark, d):
    return rounded(turns.reversal_magnitude(turns.all_reversals(bars_by_code(spark, d))))


@query
def reversal_confidence(spark, d):
    return rounded(forecasts.reversal_confidences(bars_by_code(spark, d), WIDE), 6)


@query
def next_reversal(spark, d):
    return rounded(forecasts.next_reversals(bars_by_code(spark, d), WIDE), 4, confidence=6)


@query
def trend_summary(spark, d):
    df = forecasts.trend_summary(bars_by_code(spark, d), WIDE)
    out = [CODE, "current_price", "analysis_date", "short_trend", "long_trend", "trend_agreement"]
    for k in KINDS:
        nxt = F.col(f"{k}_reversal_prediction")
        out += [nxt["price"].alias(f"{k}_price"), nxt["confidence"].alias(f"{k}_confidence"),
                nxt["type"].alias(f"{k}_type"),
                F.size(f"recent_reversals.{k}").alias(f"{k}_recent"),
                F.element_at(f"recent_reversals.{k}", -1)["type"].alias(f"{k}_last_type")]
    return rounded(df.select(*out), 4, short_confidence=6, long_confidence=6)


# --- splits and learning features -----------------------------------------------------------

@query
def time_split(spark, d):
    return pick(features.time_split(bars(spark, d), 0.8), "split")


@query
def time_split_3way(spark, d):
    return pick(features.time_split_3way(bars(spark, d)), "split")


@query
def training_targets(spark, d):
    df = features.training_targets(trends.indicators(bars_by_code(spark, d), WIDE), WIDE)
    return pick(df, "short_trend_label", "long_trend_label", "short_reversal_label",
                "long_reversal_label", "confidence_label", digits=6)


@query
def targets_wide_sliced(spark, d):
    """Forward returns over 100 rows of series in slabs."""
    df = lay_out(shared_bars(spark, d), rows_per_slab=2500, p=FAR, rows=bar_rows(spark, d))
    df = features.training_targets(trends.indicators(df, FAR), FAR)
    return pick(settle(df), "pos", "ema_100", "ma_100", "long_reversal_label", digits=6)


@query
def ffill_features(spark, d):
    """Known gaps: prices of every seventh day and the warm-up of the averages."""
    b = indicators.moving_averages(bars(spark, d))
    gap = F.when(F.dayofyear("date") % 7 != 0, F.col("close"))
    df = features.ffill_features(b.withColumn("gappy", gap), ["gappy", "ma_25"])
    return pick(df, "gappy", "ma_25")


@query
def scaler_params(spark, d):
    return rounded(features.scaler_params(indicators.candle_features(bars(spark, d))), 3)


@query
def scaler_by_batches(spark, d):
    """The scaler of all rows, merged from the moments that each year's rows left apart."""
    df = indicators.candle_features(bars(spark, d))
    parts = moments.moments(df.withColumn("year", F.year("date")), features.numeric_columns(df), "year")
    return rounded(moments.scaler_of(tables.stored(parts, "moments")), 3)


@query
def scale_features(spark, d):
    df = features.scale_features(indicators.candle_features(bars(spark, d)))
    return pick(df, "open", "close", "volume", "body_size", "upper_shadow", digits=6)


@query
def sequences(spark, d):
    """Sequences of 60 rows: their number per code, and sums over first and last entries."""
    cols = ["close", "volume"]
    df = features.sequences(bars(spark, d), 60, cols)
    first = F.element_at("sequence", 1)
    last = F.element_at("sequence", -1)
    return rounded(df.groupBy(CODE).agg(
        F.count(F.lit(1)).alias("sequences"), F.min("date").alias("first_target"),
        F.sum(F.size("sequence")).alias("rows"),
        F.sum(first[0]).alias("oldest_close"), F.sum(last[0]).alias("newest_close"),
        F.sum(last[1]).alias("newest_volume")), 2)


@query
def last_sequences(spark, d):
    """What a model would be given: the last 60 rows of each code."""
    df = features.last_sequences(bars(spark, d), 60, ["close", "volume"])
    total = lambda i: F.aggregate(F.transform("sequence", lambda r: r[i]), F.lit(0.0),
                                  lambda a, x: a + x)
    return rounded(df.select(CODE, F.size("sequence").alias("rows"),
                             total(0).alias("close_sum"), total(1).alias("volume_sum"),
                             F.element_at("sequence", -1)[0].alias("newest_close")), 2)


# --- forecasts -----------------------------------------------------------------------------

@query
def fallback_trend(spark, d):
    return rounded(forecasts.fallback_trend(bars(spark, d), WIDE), 6)


@query
def fallback_reversal(spark, d):
    return rounded(forecasts.fallback_reversal(bars(spark, d), WIDE), 4)


@query
def confidence_short(spark, d):
    return rounded(forecasts.confidence(bars(spark, d), "short"), 6)


@query
def confidence_long(spark, d):
    return rounded(forecasts.confidence(bars(spark, d), "long"), 6)


def with_change(spark, d) -> DataFrame:
    """The last distance of the price to its long average, taken as a predicted change."""
    prof = forecasts.profile(bars(spark, d))
    return prof.withColumn("change", F.col("long_ma_1") / F.col("current_price") - 1)


@query
def clamp_reversal_price(spark, d):
    df = with_change(spark, d)
    return rounded(df.select(CODE, forecasts.clamp_reversal_price(
        F.col("current_price"), F.col("change")).alias("price")))


@query
def adjust_reversal_confidence(spark, d):
    df = with_change(spark, d)
    return rounded(df.select(CODE, forecasts.adjust_reversal_confidence(
        F.lit(0.5), F.col("change"), F.col("recent_spread")).alias("confidence")), 6)


@query
def predict_stock(spark, d):
    df = forecasts.predict_stock(bars(spark, d), WIDE, ensembles=False)
    return rounded(df.select("*", "prediction_methods.*", "data_quality.*")
                   .drop("prediction_methods", "data_quality"), 4)


@query
def predict_stock_analyzer(spark, d):
    df = forecasts.predict_stock(bars_by_code(spark, d), WIDE, "analyzer", ensembles=False)
    return rounded(df.select(CODE, "current_price", "analysis_date", "short_trend", "long_trend",
                             "short_reversal_price", "long_reversal_price",
                             "short_confidence", "long_confidence"), 4)


@query
def predict_with_ensembles(spark, d):
    """All codes asked for, each with the vote of its disturbed copies beside it."""
    df = forecasts.batch_predict(bars(spark, d), requested(spark, d), STRICT)
    return rounded(df.select(CODE, "error", "short_trend", "long_reversal_price",
                             F.col("ensemble_trends.short_trend").alias("voted_trend"),
                             F.col("ensemble_reversals.long_reversal_price").alias("voted_price")), 3)


@query
def ensemble_analyzer(spark, d):
    """Both votes of the fitted trends and the series' own reversals."""
    b = bars_by_code(spark, d, copies=WIDE.ensemble_size)
    df = ensembles.ensemble_structs(b, WIDE, "analyzer")
    return rounded(df.select(
        CODE, *[F.col(f"ensemble_trends.{k}_trend").alias(f"{k}_trend") for k in KINDS],
        F.col("ensemble_trends.ensemble_confidence").alias("trend_confidence"),
        *[F.col(f"ensemble_reversals.{k}_reversal_price").alias(f"{k}_price") for k in KINDS],
        F.col("ensemble_reversals.ensemble_confidence").alias("reversal_confidence")), 3)


@query
def predict_sliced(spark, d):
    df = forecasts.predict_stock(cut_bars(spark, d), WIDE, "analyzer", ensembles=False)
    return rounded(df.select(CODE, "current_price", "analysis_date", "short_trend", "long_trend",
                             "short_reversal_price", "long_reversal_price",
                             "short_confidence", "long_confidence"), 4)


def requested(spark, d) -> DataFrame:
    """All listed codes and as many unknown ones as there are nations."""
    listed = cleaning.clean_stock_list(stock_list(spark, d)).select(F.col("code").alias(CODE))
    unknown = table(spark, d, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias(CODE))
    return selection.union_sources(listed, unknown)


STRICT = TrendParams(trend_threshold=300.0, min_data_points=520)


def batch(spark, d) -> DataFrame:
    return forecasts.batch_predict(bars(spark, d), requested(spark, d), STRICT, ensembles=False)


@query
def batch_predict(spark, d):
    return rounded(batch(spark, d).select(
        CODE, "error", "short_trend", "long_trend", "short_reversal_price",
        "long_reversal_price", "short_confidence", "long_confidence", "current_price",
        "analysis_date"), 4)


@query
def predictions_csv(spark, d):
    path = tables.write_predictions_csv(batch(spark, d), workspace(spark, "predictions"), RUN_TS)
    kinds = {c: "double" for c in tables.PREDICTION_COLUMNS
             if c.endswith(("price", "confidence"))}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in tables.PREDICTION_COLUMNS)
    return rounded(spark.read.schema(schema).option("header", True).csv(path), 4)


@query
def predictions_json(spark, d):
    path = workspace(spark, "predictions-json")
    made = batch(spark, d)
    tables.write_predictions_json(made, path, RUN_TS)
    back = spark.read.schema(made.schema).json(path)
    return rounded(back.select(CODE, "error", "short_trend", "short_reversal_price",
                               "data_quality.data_points"), 4)


@query
def prediction_summary(spark, d):
    return rounded(forecasts.prediction_summary(batch(spark, d)), 4,
                   short_avg_change=7, long_avg_change=7)


@query
def trend_distribution(spark, d):
    return forecasts.trend_distribution(batch(spark, d))


@query
def ensemble_trend(spark, d):
    return rounded(ensembles.ensemble_trend(bars(spark, d), WIDE), 5)


@query
def ensemble_reversal(spark, d):
    return rounded(ensembles.ensemble_reversal(bars(spark, d), WIDE), 3)


# --- evaluation and models ------------------------------------------------------------------

@query
def eval_classification_fixed(spark, d):
    df = with_position(trends.trend_directions(bars(spark, d), WIDE))
    df = df.select((F.col("short_trend_direction") + 1).alias("label"),
                   F.pmod("pos", F.lit(3)).alias("pred"))
    return rounded(eval_classification(df), 6)


QUERIES["eval_classification"] = QUERIES.pop("eval_classification_fixed")


@query
def eval_regression_fixed(spark, d):
    df = indicators.moving_averages(bars(spark, d)).where("ma_5 is not null")
    return rounded(eval_regression(df, "close", "ma_5"), 2, r2=6)


QUERIES["eval_regression"] = QUERIES.pop("eval_regression_fixed")


# The folder that one session has saved models of one input to: the queries that only read saved
# models share it. Those that train do so each time.
_TRAINED: dict[tuple[str, str], tuple] = {}


def trained(spark, d):
    """The folder of the saved models, the models, the learning data and the metrics."""
    from .pipeline import update_models as update
    key = spark.sparkContext.applicationId, d
    if key not in _TRAINED:
        root = workspace(spark, "models")
        _TRAINED[key] = (root, *update(bars(spark, d), root, RUN_TS, WIDE, rows=bar_rows(spark, d)))
    return _TRAINED[key]


def judged(data: learning.Learning, name: str, model) -> DataFrame:
    return learning.evaluate_models({name: model}, data.sequences("test"))


@query
def learning_rows(spark, d):
    """Rows and sums of labels of each part that models learn from or are judged on."""
    table = trained(spark, d)[2].table
    return rounded(table.groupBy("split", "validates").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("short_trend_label").alias("short_trends"),
        F.sum("long_trend_label").alias("long_trends"),
        F.sum("long_reversal_label").alias("long_returns")), 3)


@query
def learning_scaler(spark, d):
    """Mean and deviation of what only training rows were allowed to say."""
    scaler = trained(spark, d)[2].scaler
    return rounded(scaler.select(CODE, F.col("close.mean").alias("close_mean"),
                                 F.col("close.scale").alias("close_scale"),
                                 F.col("volume.mean").alias("volume_mean")), 3)


@query
def train_trend_classifier(spark, d):
    data = learning.prepare_learning(bars(spark, d), WIDE, rows=bar_rows(spark, d))
    model, _ = learning.train_trend_classifier(data, "short")
    return judged(data, "short_trend_classifier", model)


@query
def train_reversal_regressor(spark, d):
    data = learning.prepare_learning(bars(spark, d), WIDE, rows=bar_rows(spark, d))
    return judged(data, "short_reversal_regressor", learning.train_reversal_regressor(data, "short"))


@query
def train_confidence(spark, d):
    data = learning.prepare_learning(bars(spark, d), WIDE, rows=bar_rows(spark, d))
    return judged(data, "confidence_estimator", learning.train_confidence(data))


def model_inputs(spark, d) -> tuple[dict, DataFrame]:
    _, models, data, _ = trained(spark, d)
    return models, learning.prediction_input(bars_by_code(spark, d), data.scaler, data.params, WIDE)


@query
def predict_trend_model(spark, d):
    models, inputs = model_inputs(spark, d)
    return learning.predict_trend(learning.apply_models(models, inputs), "long")


@query
def predict_reversal_model(spark, d):
    models, inputs = model_inputs(spark, d)
    answers = learning.apply_models(models, inputs)
    return learning.predict_reversal(answers, forecasts.profile(bars_by_code(spark, d), WIDE), "long")


@query
def model_table_scores(spark, d):
    """For how many codes the answers of the saved models' tables, by joins and sums over layers,
    trees and coefficients, differ from those of the models."""
    root = trained(spark, d)[0]
    models, inputs = model_inputs(spark, d)
    return model_tables.table_differences(models, spark, root, tables.stored(inputs, "inputs"))


@query
def update_models(spark, d):
    from .pipeline import update_models as update
    return update(bars(spark, d), workspace(spark, "models"), RUN_TS, WIDE, rows=bar_rows(spark, d))[2]


@query
def model_summary(spark, d):
    return learning.model_summary(spark, trained(spark, d)[1])


@query
def model_shapes(spark, d):
    """What goes into each model and comes out, for all rows that it was judged on."""
    _, _, data, metrics = trained(spark, d)
    shapes = model_summary(spark, d).select("model", "inputs", "outputs")
    return shapes.join(metrics.select("model", "rows"), "model")


@query
def model_roundtrip(spark, d):
    """Predictions of the models in memory beside those from the saved folder alone."""
    from .pipeline import Saved, make_predictions
    root, models, data, _ = trained(spark, d)
    b, asked = bars_by_code(spark, d), requested(spark, d)
    told = [make_predictions(b, asked, WIDE, models=m, ensembles=False).select(
        CODE, *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(f"{c}_{i}")
                for c in ("error", "short_trend", "long_reversal_price", "long_confidence")])
        for i, m in enumerate((root, Saved(models, data.scaler, data.params, WIDE)))]
    both = told[0].join(told[1], CODE, "full")
    same = F.lit(True)
    for c in told[0].columns[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"{c[:-2]}_1"))
    return both.agg(F.count(F.lit(1)).alias("codes"), F.count_if(~same).alias("differing"))


@query
def full_pipeline(spark, d):
    """All codes asked for; models predict, and their disturbed copies vote."""
    from .pipeline import make_predictions
    b = bars_by_code(spark, d, copies=TrendParams().ensemble_size)
    df = make_predictions(b, requested(spark, d), models=trained(spark, d)[0])
    return df


@query
def full_pipeline_errors(spark, d):
    """Which codes the run could not predict, and that all others have every figure."""
    df = full_pipeline(spark, d)
    parts = ("short_trend", "long_trend", "short_reversal_price", "long_confidence",
             "ensemble_trends.long_trend", "ensemble_reversals.long_reversal_price")
    whole = F.lit(True)
    for c in parts:
        whole = whole & F.col(c).isNotNull()
    return df.select(CODE, "error", whole.alias("complete"),
                     F.col("prediction_methods.long_trend_method").alias("method"))
