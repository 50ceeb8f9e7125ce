from datetime import date
from math import inf, nan

import pytest
from pyspark.sql import functions as F

from weekloom import functions as fn
from weekloom.operators import filters, schema


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_parse_percent(frame):
    df = frame([("2.3%",), ("-1%",), (None,)], "x string")
    assert column(df, fn.parse_percent("x")) == [2.3, -1.0, None]


def test_parse_percent_raises_on_other_text(frame):
    with pytest.raises(Exception):
        column(frame([("abc%",)], "x string"), fn.parse_percent("x"))


def test_truncate_goes_toward_zero(frame):
    assert column(frame([(2.9,), (-2.9,)], "x double"), fn.truncate_int("x")) == [2, -2]


def test_iso_week_at_year_start(frame):
    df = frame([(date(2016, 1, 3),)], "d date")
    row = df.select(*fn.date_features("d", "Time_", ["Yr", "Week", "Mon", "Qtr", "Day"])).first()
    assert row.asDict() == {"Time_Yr": 2016, "Time_Week": 53, "Time_Mon": 1, "Time_Qtr": 1, "Time_Day": 3}


def test_week_ending_keeps_sundays(frame):
    df = frame([(date(2016, 1, 1),), (date(2021, 1, 3),), (date(2021, 1, 4),)], "d date")
    assert column(df, fn.week_ending("d")) == [date(2016, 1, 3), date(2021, 1, 3), date(2021, 1, 10)]


def test_year_to_date(frame):
    assert column(frame([(2016,)], "y int"), fn.year_to_date("y")) == [date(2016, 1, 1)]


def test_inf_and_nan_to_null(frame):
    df = frame([(1.0,), (inf,), (-inf,), (nan,), (None,)], "x double")
    assert column(df, fn.inf_to_null("x")) == [1.0, None, None, None, None]
    assert [r.x for r in filters.infinite_to_null(df).collect()] == [1.0, None, None, None, None]


def test_threshold_class_rounds_half_to_even(frame):
    assert column(frame([(0.5,), (0.51,), (0.2,)], "p double"), fn.threshold_class("p")) == [0, 1, 0]


def test_clamp_and_percent_error(frame):
    df = frame([(1.0, 2.0), (0.0, 1.0), (10.0, 5.0)], "y double, p double")
    assert column(df, fn.clamp("y", 1.0, 4.0)) == [1.0, 1.0, 4.0]
    assert column(df, fn.percent_error("y", "p")) == [100.0, None, 50.0]
    assert column(df, fn.percent_error("y", "p", signed=True)) == [-100.0, None, 50.0]


def test_logs(frame):
    df = frame([(0.0,), (1.5,)], "x double")
    assert df.select(fn.log_plus_one("x").alias("x")).schema["x"].dataType.simpleString() == "float"
    back = df.select(fn.log_target("x").alias("x")).select(fn.unlog("x"))
    assert [round(r[0], 12) for r in back.collect()] == [0.0, 1.5]


def test_band_sum_is_null_with_a_null_part(frame):
    assert column(frame([(1.0, 2.0), (1.0, None)], "a double, b double"), fn.band_sum(["a", "b"])) == [3.0, None]


def test_names_and_order(frame):
    df = frame([(0,), (1,), (9,)], "c int")
    assert column(df, fn.label_name("c", {0: "First", 1: "Second"})) == ["First", "Second", None]
    named = df.select(fn.label_name("c", {0: "First", 1: "Second"}).alias("s"))
    assert column(named, fn.ordinal("s", ["First", "Second"])) == [0, 1, None]
    assert column(frame([("xK1A",)], "s string"), fn.strip_prefix("s")) == ["K1A"]


def test_clean_colnames(frame):
    df = schema.clean_colnames(frame([(1, 2)], '`"Total Population"` int, `Total 60+` int'))
    assert df.columns == ["Total_Population", "Total_60+"]


def test_vintage_mapping_has_its_exceptions():
    names = schema.DEMOGRAPHIC_NAMES
    assert len(names.suffixes) == 41
    assert names.mapping(2016)["EHYBASPOP"] == "Total Population"
    assert names.mapping(2016)["ECYHRIAVG"] == "Average Income"
    assert names.mapping(2019)["Y19HRIAVG"] == "Average Income"
    assert names.mapping(2020)["Y21HRIAVG"] == "Average Income"
    assert names.mapping(2020)["Y20PTAAVG"] == "Average AGE"
    assert names.mapping(2021)["ECYHRI_020"] == "Household Income $0 To $19,999 (Constant Year 2015 $)"
    assert all(len(names.mapping(y)) == 41 for y in names.prefixes)


def test_bands_use_mapped_names():
    known = set(schema.DEMOGRAPHIC_NAMES.suffixes.values())
    for spec in (schema.AGE_BANDS, schema.INCOME_BANDS, schema.INCOME_BANDS_ONCE):
        assert {c for parts in spec.values() for c in parts} <= known


def test_cast_numeric(frame):
    df = frame([("a", "1.5"), ("b", "x")], "CODE string, v string")
    assert [r.v for r in schema.cast_numeric(df, ["CODE"], lenient=True).collect()] == [1.5, None]
    with pytest.raises(Exception):
        schema.cast_numeric(df, ["CODE"]).collect()


def test_before_year_on_dates_and_numbers(frame):
    dates = frame([(date(2020, 12, 31),), (date(2021, 1, 1),)], "d date")
    assert filters.before_year(dates, "d", 2021).count() == 1
    assert filters.before_year(frame([(2020,), (2021,)], "y int"), "y", 2021).count() == 1


def test_drop_nulls_and_null_keys(frame):
    df = frame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    assert filters.drop_nulls(df).count() == 2
    assert [r.k for r in filters.null_keys(df, "k", "v").collect()] == ["a"]


def test_columns_by_type(frame):
    df = frame([(1, "a", 2.0)], "i int, s string, d double")
    assert schema.columns_by_type(df) == [(1, "s")]
    assert schema.numeric_columns(df) == ["i", "d"]
    assert df.select(F.col("s")).columns == ["s"]
