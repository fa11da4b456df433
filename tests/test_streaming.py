import json

from pyspark.sql import functions as F

from tidemark.functions.series import CODE
from tidemark.operators.forecasts import predict_stock
from tidemark.streaming.refresh import latest_predictions, refresh_predictions

RAW = "stock_code string, date string, open string, high string, low string, close string, volume string"


def land(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def bar(code, day, close):
    return dict(stock_code=code, date=f"2025-01-{day:02d}", open=str(close), high=str(close + 1),
                low=str(close - 1), close=str(close), volume="5")


def test_refresh(spark, tmp_path):
    landed, store, out, check = (tmp_path / x for x in ("in", "store", "out", "check"))

    def refresh():
        raw = spark.readStream.schema(RAW).json(str(landed))
        refresh_predictions(raw, str(store), str(out), str(check)).awaitTermination()

    land(landed, "1.json", [bar("a", d, 10 + d) for d in range(1, 11)]
         + [bar("b", d, 50 - d) for d in range(1, 11)])
    refresh()
    first = {r[CODE]: r for r in latest_predictions(spark, str(out)).collect()}
    assert first["a"].short_trend == "+" and first["b"].short_trend == "-"
    land(landed, "2.json", [bar("a", 10, 7), bar("a", 11, 5), bar("a", 12, 4), dict(bar("a", 13, 3), close="x")])
    refresh()
    second = {r[CODE]: r for r in latest_predictions(spark, str(out)).collect()}
    assert second["b"] == first["b"]
    assert second["a"].current_price == 4.0 and second["a"].data_quality.data_points == 12
    closes = [11.0 + d for d in range(9)] + [7.0, 5.0, 4.0]
    rows = [("a", i, c) for i, c in enumerate(closes)]
    whole = spark.createDataFrame(rows, "stock_code string, i int, close double").select(
        CODE, F.date_add(F.lit("2025-01-01").cast("date"), F.col("i")).alias("date"), "close")
    assert predict_stock(whole).first().short_confidence == second["a"].short_confidence
