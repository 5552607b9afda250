"""Value predicates: Python-float text, value classes, null tokens, datetime parsing."""

from pyspark.sql import functions as F

from tabflaw.functions.values import NA_TOKENS, float_value, is_float_text, na_to_null, value_type
from tabflaw.operators.metrics import parse_datetime


def _py_float(s):
    try:
        float(s)
        return True
    except ValueError:
        return False


CASES = ["1", "-1.5", " 1.5 ", "1e3", "1E-2", ".5", "5.", "1_0", "1__0", "1d", "0x10", "nan", "NaN",
         "inf", "-Infinity", "", "abc", "1,5", "+.5e+1", "_1", "1_", "--1", "12x"]


def test_float_text_matches_python(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "v string")
    got = {r["v"]: r["ok"] for r in df.select("v", is_float_text(F.col("v")).alias("ok")).collect()}
    assert got == {c: _py_float(c) for c in CASES}


def test_float_value(spark):
    df = spark.createDataFrame([("1_000",), (" 2.5 ",), ("x",)], "v string")
    got = [r["f"] for r in df.select(float_value("v").alias("f")).collect()]
    assert got == [1000.0, 2.5, None]


def test_value_type(spark):
    df = spark.createDataFrame([("-3",), ("2020-01-01",), ("7:10 p.m.",), ("hello",), (None,)], "v string")
    got = [r["t"] for r in df.select(value_type("v").alias("t")).collect()]
    assert got == ["numeric", "datetime", "datetime", "text", None]


def test_na_tokens(spark):
    df = spark.createDataFrame([(t,) for t in NA_TOKENS + ["NaNa", "0"]], "v string")
    got = [r["n"] for r in df.select(na_to_null("v").alias("n")).collect()]
    assert got == [None] * len(NA_TOKENS) + ["NaNa", "0"]


def test_parse_datetime_formats(spark):
    df = spark.createDataFrame([("2020-12-31",), ("31/12/2020",), ("2020-12-31 10:00:00",), ("soon",)], "v string")
    got = [r["t"] for r in df.select(parse_datetime(F.col("v")).alias("t")).collect()]
    assert got[0] is not None and got[1] == got[0] and got[2] is not None and got[3] is None


def test_datetimes_month_first_and_free_forms(spark):
    cases = {"03/04/2020": "2020-03-04 00:00:00", "2020-03-04": "2020-03-04 00:00:00", "25/12/2011": "2011-12-25 00:00:00",
             "12/2/2011 7:00 a.m.": "2011-12-02 07:00:00", "12/2/2011 7:05 p.m.": "2011-12-02 19:05:00", "7:05 p.m.": "1970-01-01 19:05:00",
             "2020-03-04T05:06:07.250Z": "2020-03-04 05:06:07", "2020-03-04 05:06": "2020-03-04 05:06:00", "20200304": "2020-03-04 00:00:00",
             "Mar 4, 2020": "2020-03-04 00:00:00", "4 March 2020 10:00": "2020-03-04 10:00:00", "12:30": "1970-01-01 12:30:00",
             "2023-13-45": None, "2023-02-30": None, "never": None, "": None, None: None, "99999999999999999999": None}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    got = {r["v"]: None if r["t"] is None else str(r["t"]) for r in df.select("v", parse_datetime(F.col("v")).alias("t")).collect()}
    assert got == cases


def test_datetimes_with_zones_and_more_forms(spark):
    from pyspark.sql import functions as F
    want = {"2020-01-01T10:00:00+02:00": "2020-01-01 08:00:00", "2020-01-01 10:00:00 UTC": "2020-01-01 10:00:00",
            "Mon, 02 Jan 2006 15:04:05 GMT": "2006-01-02 15:04:05", "20200101T101112": "2020-01-01 10:11:12", "2011-12": "2011-12-01 00:00:00",
            "2020.01.02": "2020-01-02 00:00:00", "5-Mar-2020": "2020-03-05 00:00:00", "5-mar-2020 7:05 pm": "2020-03-05 19:05:00",
            "2020-01-01T10:00:00-0330": "2020-01-01 13:30:00", "Sunday, March 1, 2020": "2020-03-01 00:00:00", "MARCH 2020": "2020-03-01 00:00:00",
            "2020-13-01": None, "10-20": None, "Mon": None, "": None, "2020-01-01 25:00": None}
    df = spark.createDataFrame([(v,) for v in want], "v string")
    got = {r["v"]: None if r["t"] is None else str(r["t"]) for r in df.select("v", parse_datetime(F.col("v")).alias("t")).collect()}
    assert got == want
