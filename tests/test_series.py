from datetime import date, timedelta

import numpy as np
import pytest

from weekloom.operators import ordered, series

WEEK = date(2016, 1, 3)


def denoise_by_definition(x, threshold):
    """The step rule spelled out: a near value takes the mean of the step's earlier results."""
    result, start = [], 0
    for i, v in enumerate(x):
        near = i > 0 and round(abs(v - x[i - 1]), 4) < round(abs(v * threshold), 4)
        if not near:
            start = i
        result.append(round(float(np.mean(result[start:i])), 4) if near else round(v, 4))
    return result


def series_frame(frame, data):
    rows = [(k, WEEK + timedelta(weeks=i), v) for k, values in data.items() for i, v in enumerate(values)]
    return frame(rows, "k string, d date, v double")


def values(df):
    out = {}
    for r in df.orderBy("k", "d").collect():
        out.setdefault(r.k, []).append(r.v)
    return out


@pytest.mark.parametrize("bounded", [True, False])
def test_denoise_hand_made(frame, bounded):
    df = series_frame(frame, {"a": [1.0, 1.005, 1.009, 2.0, 2.0], "z": [0.0, 0.0, 5.0]})
    got = values(series.denoise_series(df, ["k"], ["d"], "v", 0.01, one_row_per_date=bounded, runs=4))
    assert got == {"a": [1.0, 1.0, 1.0, 2.0, 2.0], "z": [0.0, 0.0, 5.0]}


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("threshold", [0.01, 0.2, 0.9])
def test_denoise_with_a_hot_series(frame, bounded, threshold):
    rng = np.random.default_rng(7)
    data = {k: [round(float(v), 2) for v in rng.uniform(1, 3, n)] for k, n in {"hot": 600, "b": 1, "c": 40}.items()}
    data["flat"] = [2.0] * 300  # one step across many runs
    got = values(series.denoise_series(series_frame(frame, data), ["k"], ["d"], "v", threshold, bounded, runs=8))
    assert got == {k: denoise_by_definition(x, threshold) for k, x in data.items()}


@pytest.mark.parametrize("bounded", [True, False])
def test_denoise_null_is_its_own_step(frame, bounded):
    df = series_frame(frame, {"a": [1.0, None, 1.0, 1.0]})
    assert values(series.denoise_series(df, ["k"], ["d"], "v", 0.5, bounded, runs=3)) == {"a": [1.0, None, 1.0, 1.0]}


@pytest.mark.parametrize("bounded", [True, False])
def test_null_keys_keep_their_rows(frame, bounded):
    df = frame([(None, WEEK, 1.0), (None, WEEK + timedelta(7), 1.1), ("a", WEEK, 2.0)], "k string, d date, v double")
    assert series.denoise_series(df, ["k"], ["d"], "v", 0.5, bounded).count() == 3
    changed = series.pct_change(df, ["k"], ["d"], ["v"], bounded).filter("k is null").orderBy("d").collect()
    assert [r.v and round(r.v, 6) for r in changed] == [None, 0.1]


def test_long_series_is_cut_into_runs(frame):
    df = series_frame(frame, {"hot": [float(i) for i in range(400)]})
    sizes = [r["count"] for r in ordered.cut_into_runs(df, ["k", "d"], 8).groupBy(ordered.RUN).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 150


@pytest.mark.parametrize("bounded", [True, False])
def test_pct_change(frame, bounded):
    df = series_frame(frame, {"a": [0.0, 0.0, 5.0, 5.0], "b": [2.0, 3.0]})
    got = values(series.pct_change(df, ["k"], ["d"], ["v"], one_row_per_date=bounded, runs=4))
    assert got == {"a": [None, None, None, 0.0], "b": [None, 0.5]}


def test_pct_change_hot_series_matches_plain(frame):
    rng = np.random.default_rng(3)
    data = {"hot": rng.uniform(1, 2, 500).tolist(), "b": [1.0], "c": rng.uniform(1, 2, 30).tolist()}
    got = values(series.pct_change(series_frame(frame, data), ["k"], ["d"], ["v"], runs=8))
    for k, x in data.items():
        assert got[k][0] is None
        assert got[k][1:] == [b / a - 1 for a, b in zip(x, x[1:])]


def yearly(frame, rows):
    return frame(rows, "CODE string, YEAR int, m double, n double")


def test_weekly_span(frame):
    df = yearly(frame, [("a", 2016, 1.0, 1.0), ("a", 2021, 2.0, None)])
    weeks = series.resample_weekly(df, "CODE", "YEAR", ["m"]).orderBy("week_end").collect()
    assert (len(weeks), weeks[0].week_end, weeks[-1].week_end) == (262, date(2016, 1, 3), date(2021, 1, 3))
    assert sum(r.m is not None for r in weeks) == 2


def test_interpolation_rules(frame):
    df = yearly(frame, [
        ("a", 2016, 1.0, 5.0), ("a", 2017, None, 5.0), ("a", 2018, 3.0, 5.0), ("a", 2019, None, 4.0),
        ("b", 2016, None, 1.0), ("b", 2017, 10.0, 2.0),
    ])
    rows = series.interpolate_linear(df, "CODE", "YEAR", ["m", "n"]).orderBy("CODE", "week_end").collect()
    a = {r.week_end: r for r in rows if r.CODE == "a"}
    b = {r.week_end: r for r in rows if r.CODE == "b"}
    assert (a[date(2016, 1, 3)].m, a[date(2018, 1, 7)].m, a[date(2019, 1, 6)].m) == (1.0, 3.0, 3.0)
    full = (date(2018, 1, 7) - date(2016, 1, 3)).days
    for day, r in a.items():  # straight line across the gap, then flat
        expected = min(1 + 2 * (day - date(2016, 1, 3)).days / full, 3.0)
        assert r.m == pytest.approx(expected)
    assert b[date(2016, 1, 3)].m is None and b[date(2016, 12, 25)].m is None  # not filled from code a
    assert b[date(2017, 1, 1)].m == 10.0
    assert b[date(2016, 1, 3)].n == 1.0


def test_forward_fill(frame):
    df = yearly(frame, [("a", 2016, 1.0, 5.0), ("a", 2017, 2.0, None), ("a", 2018, 3.0, 7.0)])
    rows = series.resample_ffill(df, "CODE", "YEAR", ["m", "n"]).orderBy("week_end").collect()
    assert [r.m for r in rows] == [1.0 if r.week_end < date(2017, 1, 1) else 2.0 if r.week_end < date(2018, 1, 7) else 3.0 for r in rows]
    assert {r.n for r in rows[:-1]} == {5.0} and rows[-1].n == 7.0
