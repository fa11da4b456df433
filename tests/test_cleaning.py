import re
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.series import CODE
from tidemark.operators import cleaning, selection
from tidemark.sources import landed_json, price_files, tables

RAW = "stock_code string, Date string, Open string, High string, Low string, Close string, Volume string"


def test_bad_rows_are_dropped(spark):
    good = ("1", "2025-01-02", "10", "12", "9", "11", "100")
    bad = [("1", "2025-13-01", "10", "12", "9", "11", "1"), ("1", "2025-1-2", "10", "12", "9", "11", "1"),
           ("1", None, "10", "12", "9", "11", "1"), ("1", "2025-01-03", "abc", "12", "9", "11", "1"),
           ("1", "2025-01-03", "NaN", "12", "9", "11", "1"), ("1", "2025-01-03", "10", "8", "9", "11", "1"),
           ("1", "2025-01-03", "10", "12", "10.5", "11", "1"), ("1", "2025-01-03", "0", "12", "0", "11", "1")]
    empty = ("1", "2025-01-04", "10", "12", "9", "11", None)
    out = cleaning.clean_prices(spark.createDataFrame([good, *bad, empty], RAW)).orderBy("date").collect()
    assert [(str(r.date), r.volume) for r in out] == [("2025-01-02", 100.0), ("2025-01-04", 0.0)]


def test_required_columns(spark):
    df = spark.createDataFrame([("2025-01-02", "1")], "DATE string, Close string")
    assert cleaning.missing_columns(df) == ["open", "high", "low"]
    with pytest.raises(ValueError, match="open"):
        cleaning.clean_prices(df)


def test_volume_column_may_be_absent(spark):
    df = spark.createDataFrame([("1", "2025-01-02", "10", "12", "9", "11", "1")], RAW).drop("Volume")
    assert cleaning.clean_prices(df).first().volume == 0.0


def test_codes_are_padded_never_cut(spark):
    df = spark.createDataFrame([("7",), ("12345",), ("1234567",)], "code string")
    out = [r[0] for r in df.select(cleaning.norm_code(F.col("code"))).collect()]
    assert out == ["00007", "12345", "1234567"]


def test_sector_falls_back_to_industry(spark):
    df = spark.createDataFrame([("7", "Retail")], "Code string, industry_name string")
    assert cleaning.clean_stock_list(df).first().sector_name == "Retail"


@pytest.mark.parametrize("seed", range(3))
def test_liquidity_equals_the_median(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"{c:05d}", float(v)) for c in range(60)
            for v in rng.integers(0, 6, rng.integers(1, 9))] + [("none", None)]
    df = spark.createDataFrame(rows, "stock_code string, volume double")
    med = pd.DataFrame(rows, columns=["c", "v"]).groupby("c")["v"].median()
    for threshold in (2, 2.5, 3):
        got = {r[0] for r in selection.median_above(df, threshold).collect()}
        assert got == set(med[med > threshold].index)
    exact = {r[0]: r[1] for r in selection.median_volume(df).collect()}
    assert exact == med.dropna().to_dict()


def test_history_and_joins(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "stock_code string, x int")
    assert {r[0] for r in selection.min_history(df, 2).collect()} == {"a"}
    codes = spark.createDataFrame([("b",), ("b",), ("z",)], "stock_code string")
    assert selection.semi_join_codes(df, codes).count() == 1
    assert selection.anti_join_codes(df, codes).count() == 2


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_files_with_different_headers(spark, tmp_path):
    write(tmp_path / "7.csv", 'DATE,CLOSE,OPEN,HIGH,LOW,note\n2025-01-02,11,10,12,9,"x, y"\n')
    write(tmp_path / "12345_price.csv", '"date","open","high","low","close","volume"\n2025-01-02,10,12,9,11,5\n')
    write(tmp_path / "99.csv", "Date,Open,High,Low\n2025-01-02,10,12,9\n")
    raw = price_files.read_mixed_price_files(spark, str(tmp_path))
    out = {r[CODE]: (r.open, r.close, r.volume) for r in cleaning.clean_prices(raw).collect()}
    assert out == {"00007": (10.0, 11.0, 0.0), "12345": (10.0, 11.0, 5.0)}
    codes = {r[0] for r in price_files.discover_codes(spark, str(tmp_path)).collect()}
    assert codes == {"00007", "12345", "00099"}


def test_first_usable_source_wins(spark):
    one = spark.createDataFrame([("1", "2025-01-02", "1", "1", "1", "1", "1")], RAW)
    two = spark.createDataFrame([("1", "2025-01-02", "2", "2", "2", "2", "2"),
                                 ("2", "2025-01-02", "2", "2", "2", "2", "2")], RAW)
    out = price_files.first_source([one.drop("Open"), one, two]).orderBy(CODE)
    assert [(r[CODE], r.source) for r in out.collect()] == [("1", 1), ("2", 2)]


def test_files_of_one_layout(spark, tmp_path):
    df = spark.createDataFrame([(str(c), f"2025-01-{d:02d}", "10", "12", "9", "11", "5")
                                for c in (7, 8) for d in range(1, 4 + c)], RAW)
    price_files.write_price_files(df, str(tmp_path / "p"))
    raw = price_files.read_price_files(spark, str(tmp_path / "p"))
    listed = spark.createDataFrame([("00007",), ("00008",), ("00009",)], "stock_code string")
    out = price_files.load_prices(raw, listed, "2025-01-02", "2025-01-11", 10)
    assert {r[0] for r in out.collect()} == {"00008"} and out.count() == 10


def test_landed_pages(spark, tmp_path):
    write(tmp_path / "a.json", '{"daily_quotes":[{"Code":"7","Date":"2025-01-02","Close":11.0}],\n "pagination_key":"k"}')
    write(tmp_path / "b.json", '{"daily_quotes":[{"Code":"12345","Date":"2025-01-03","Close":12.0}]}')
    out = landed_json.read_quotes(spark, str(tmp_path), whole_files=True).orderBy(CODE).collect()
    assert [(r[CODE], str(r.date), r.close) for r in out] == [
        ("00007", "2025-01-02", 11.0), ("12345", "2025-01-03", 12.0)]


def test_output_path():
    assert [tables.csv_path(x) for x in ("a.csv", "a.json", "a")] == ["a.csv", "a.csv", "a.csv"]


def test_many_columns_and_other_orders(spark, tmp_path):
    notes = ",".join(f"n{i}" for i in range(70))
    write(tmp_path / "1.csv", f"{notes},Close,Open,High,Low,Date\n" + ",".join("x" * 70) + ",11,10,12,9,2025-01-02\r\n")
    write(tmp_path / "2.csv", 'date,low,high,open,close,volume,"a ""b"", c"\n2025-01-02,9,12,10,11,5,"1,""2"",3"\n')
    raw = price_files.read_mixed_price_files(spark, str(tmp_path))
    out = {r[CODE]: (r.open, r.high, r.low, r.close, r.volume) for r in cleaning.clean_prices(raw).collect()}
    assert out == {"00001": (10.0, 12.0, 9.0, 11.0, 0.0), "00002": (10.0, 12.0, 9.0, 11.0, 5.0)}
    with pytest.raises(Exception, match="(?i)header"):
        price_files.read_price_files(spark, str(tmp_path)).collect()


def test_first_readable_layout(spark, tmp_path):
    line = "2025-01-02,10,12,9,{},1\n"
    head = "date,open,high,low,close,volume\n"
    write(tmp_path / "00001.csv", head + line.format(10))
    write(tmp_path / "00001_price.csv", head + line.format(11))
    write(tmp_path / "00002.csv", "date,open,high,low\n2025-01-02,10,12,9\n")
    write(tmp_path / "00002_price.csv", head + line.format(11))
    write(tmp_path / "prices" / "00001.csv", head + line.format(12))
    write(tmp_path / "prices" / "00003.csv", head + line.format(12))
    out = cleaning.clean_prices(price_files.read_price_layouts(spark, str(tmp_path)))
    assert {(r[CODE], r.source, r.close) for r in out.collect()} == {
        ("00001", 0, 10.0), ("00002", 1, 11.0), ("00003", 2, 12.0)}


def test_landed_fields_are_kept(spark, tmp_path):
    write(tmp_path / "a.json", '{"info":[{"Code":"7","MarketCode":"0111"},{"Code":"8","Scale":3}]}')
    out = landed_json.read_listing(spark, str(tmp_path)).orderBy("Code").collect()
    assert [(r.Code, r.CompanyName, r.MarketCode, r.Scale) for r in out] == [
        ("00007", None, "0111", None), ("00008", None, None, 3)]


def test_numbers_are_not_java_literals(spark):
    rows = [("a", "2025-01-02", x, "3", "1", "2") for x in ("1.5", "1.5d", "2f", "1e0", " 2 ", "inf")]
    df = spark.createDataFrame(rows, "stock_code string, Date string, Open string, High string, Low string, Close string")
    assert sorted(r.open for r in cleaning.parse_prices(df).collect()) == [1.0, 1.5, 2.0, float("inf")]


def test_last_day_with_times(spark):
    df = spark.sql("select timestamp_ntz'2025-01-02 15:00:00' as date union all select timestamp_ntz'2025-01-03 00:00:00'")
    assert selection.date_filter(df, "2025-01-02", "2025-01-02").count() == 1


def test_every_row_is_kept_or_rejected_with_its_first_fault(spark, tmp_path):
    rows = [("1", "2024-01-02", "10", "12", "9", "11", "5"), ("2", "2024-01-02", "10", "12", "9", "11", "x"),
            ("3", "2024-13-02", "a", "12", "9", "11", "5"), ("4", "2024-01-02", "a", "8", "9", "11", "5"),
            ("5", "2024-01-02", "10", "8", "9", "11", "5"), ("6", "2024-01-02", "10", "9.5", "9", "9", "5"),
            ("7", "2024-01-02", "10", "12", "10.5", "11", "5"), ("8", "2024-01-02", "0", "12", "0", "11", "5"),
            ("9", "2024-01-02", "10", "12", "9", None, "5"), ("9", "2024-01-02", "10", "12", "9", None, "5")]
    raw = spark.createDataFrame(rows, "stock_code string, Date string, Open string, High string, Low string, Close string, Volume string")
    path = str(tmp_path / "judged")
    cleaning.write_judged(raw, path)
    kept, rejected = cleaning.read_kept(spark, path), cleaning.read_rejected(spark, path)
    as_rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert as_rows(kept) == as_rows(cleaning.clean_prices(raw))
    told = sorted((r[CODE], r.reason) for r in rejected.collect())
    assert told == [("3", "no date"), ("4", "no open"), ("5", "high below low"), ("6", "high below open"),
                    ("7", "low above open"), ("8", "price not positive"), ("9", "no close"), ("9", "no close")]
    assert kept.count() + rejected.count() == len(rows)
    assert {r[CODE]: tuple(r.raw) for r in rejected.collect()}["3"] == ("2024-13-02", "a", "12", "9", "11", "5")
    empty = str(tmp_path / "none")
    cleaning.write_judged(raw.limit(0), empty)
    assert spark.read.schema(raw.schema).parquet(empty).count() == 0


def test_texts_are_parsed_once(spark):
    raw = spark.createDataFrame([("1", "2024-01-02", "10", "12", "9", "11", "5")], "stock_code string, Date string, Open string, High string, Low string, Close string, Volume string")
    plan = cleaning.clean_prices(raw).where("close > 1")._jdf.queryExecution().optimizedPlan().toString()
    for column in ("Open", "High", "Low", "Close", "Volume"):
        assert len(re.findall(rf"cast\({column}#\d+ as double\)", plan)) <= 2, plan  # the value, and whether it is NaN
    assert "Generate inline" in plan


def test_a_code_is_one_file_whatever_its_decades(spark, tmp_path):
    from tidemark.sources.price_files import read_price_files, write_price_files
    rows = [(c, f"{y}-01-02", 1.0, 1.0, 1.0, 1.0, 1.0) for c in ("00001", "00002") for y in (1989, 1995, 2005, 2015)]
    prices = spark.createDataFrame(rows, "stock_code string, date string, open double, high double, low double, close double, volume double")
    write_price_files(prices.repartition(3), str(tmp_path / "p"))
    assert len(list((tmp_path / "p").glob("*/*.csv"))) == 2
    assert read_price_files(spark, str(tmp_path / "p")).count() == 8
