"""Bars from ticks that come in files, in order and late."""

import datetime
import json

from pyspark.sql import functions as F

from tidemark.functions.series import CODE
from tidemark.streaming.bars import latest_bars, ticks_to_bars, write_bars

TICKS = "stock_code string, ts timestamp, seq long, price double, size double"


def tick(code, minute, seq, price, size=1.0):
    return dict(stock_code=code, ts=f"2025-01-02T{minute // 60:02d}:{minute % 60:02d}:00Z", seq=seq, price=price, size=size)


def told(df):
    return sorted((r[CODE], r.start.hour, r.open, r.high, r.low, r.close, r.volume, r.ticks) for r in df.collect())


def test_bars_of_late_and_repeated_ticks(spark, tmp_path):
    landed, out, check = (tmp_path / x for x in ("in", "out", "check"))
    landed.mkdir()

    def land(name, rows):
        (landed / name).write_text("\n".join(json.dumps(r) for r in rows))
        ticks = spark.readStream.schema(TICKS).json(str(landed))
        write_bars(ticks, str(out), str(check), "1 hour", "30 minutes").awaitTermination()

    first = [tick("a", 5, 1, 10.0), tick("a", 5, 2, 12.0), tick("a", 50, 3, 9.0, None), tick("b", 20, 4, 7.0),
             tick(None, 20, 5, 7.0), tick("b", 21, 6, None)]
    land("1.json", first)
    assert told(latest_bars(spark, str(out))) == [("a", 0, 10.0, 12.0, 9.0, 9.0, 2.0, 3), ("b", 0, 7.0, 7.0, 7.0, 7.0, 1.0, 1)]
    # within half an hour of the latest tick so far: an earlier open and a bar that goes on
    late = [tick("a", 1, 7, 11.0), tick("a", 70, 8, 8.0), tick("b", 59, 9, 6.5)]
    land("2.json", late)
    whole = spark.createDataFrame([(r["stock_code"], datetime.datetime.fromisoformat(r["ts"].replace("Z", "+00:00")), r["seq"], r["price"], r["size"]) for r in first + late], TICKS)
    assert told(latest_bars(spark, str(out))) == told(ticks_to_bars(whole, "1 hour"))
    # the watermark passes the first hour with the third file; a tick of it in the fourth comes too late
    land("3.json", [tick("b", 200, 10, 5.0)])
    land("4.json", [tick("a", 2, 11, 99.0), tick("a", 201, 12, 4.0)])
    bars = {(c, h): rest for c, h, *rest in told(latest_bars(spark, str(out)))}
    assert bars["a", 0] == [11.0, 12.0, 9.0, 9.0, 3.0, 4] and bars["a", 3][0] == 4.0 and bars["b", 3][0] == 5.0


def test_a_state_row_a_bar(spark):
    made = ticks_to_bars(spark.createDataFrame([], TICKS), "1 hour")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan and made.count() == 0
