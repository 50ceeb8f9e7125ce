"""Time-series operators and the flagship query."""

from __future__ import annotations

from queries import views as v
from queries.registry import out, query, r
from queries.relations import SHARES
from weekloom.functions import date_features
from weekloom.operators import series
from weekloom.operators.filters import in_year
from weekloom.operators.joins import keep_keys
from weekloom.operators.shares import cumulative_share_cut
from weekloom.session import materialize


def denoise_sql(source: str, keys: str, order: str, column: str, threshold: float) -> str:
    """CTEs ending in `denoised`: break flags, step numbers, first value of each step."""
    return f"""lagged AS (
  SELECT *, lag({column}) OVER (PARTITION BY {keys} ORDER BY {order}) AS before_ FROM {source}),
flagged AS (
  SELECT *, CASE WHEN round(abs({column} - before_), 4) < round(abs({column} * {threshold}), 4) THEN 0 ELSE 1 END AS starts
  FROM lagged),
stepped AS (
  SELECT *, sum(starts) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS step FROM flagged),
denoised AS (
  SELECT * EXCLUDE (before_, starts, step),
    first_value(round({column}, 4)) OVER (PARTITION BY {keys}, step ORDER BY {order}) AS smooth
  FROM stepped)"""


_SERIES_SQL = "brand, ka, fsa, segment"


@query("denoise_series", f"SELECT brand, ka, fsa, segment, CAST(week_end AS VARCHAR) AS week_end, {r('smooth', 'qty')} FROM denoised",
       v.POS + ",\n" + denoise_sql("pos", _SERIES_SQL, "week_end", "qty", 0.2))
def denoise_series(spark, sf):
    data = v.pos(spark, sf).select(*v.FLAGGED, "week_end", "qty")
    return out(series.denoise_series(data, v.FLAGGED, ["week_end"], "qty", 0.2, one_row_per_date=True))


def _runs(spark) -> int:
    """More runs than there are series, also on small data, so that borders are crossed."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("denoise_long_series", f"SELECT event_type, event_id, {r('smooth', 'value')} FROM denoised",
       denoise_sql("events", "event_type", "ts, event_id", "value", 0.5))
def denoise_long_series(spark, sf):
    """A handful of series hold all rows, at any moment in time."""
    runs = _runs(spark)
    data = v.table(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    smooth = series.denoise_series(data, ["event_type"], ["ts", "event_id"], "value", 0.5, runs=runs)
    return out(smooth.select("event_type", "event_id", "value"))


@query("pct_change", f"""SELECT province, fsa, CAST(week_end AS VARCHAR) AS week_end,
  {r('qty / nullif(lag(qty) OVER w, 0) - 1', 'qty')}, {r('price / nullif(lag(price) OVER w, 0) - 1', 'price')}
  FROM pos_week WINDOW w AS (PARTITION BY province, fsa ORDER BY pos_week.week_end)""", v.POS_WEEK)
def pct_change(spark, sf):
    weekly = v.pos_week(spark, sf).select("province", "fsa", "week_end", "qty", "price")
    return out(series.pct_change(weekly, ["province", "fsa"], ["week_end"], ["qty", "price"], one_row_per_date=True))


@query("pct_change_long_series", f"""SELECT event_type, event_id, {r('value / nullif(lag(value) OVER w, 0) - 1', 'value')}
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def pct_change_long_series(spark, sf):
    data = v.table(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    changed = series.pct_change(data, ["event_type"], ["ts", "event_id"], ["value"], runs=_runs(spark))
    return out(changed.select("event_type", "event_id", "value"))


def _weekly(inner: str) -> str:
    measures = ", ".join(r(f'"{m}"', f'"{m}"', 4) for m in v.MEASURES)
    return f'SELECT code AS "CODE", CAST(week_end AS VARCHAR) AS week_end, {measures} FROM ({inner})'


_EMPTY_WEEKS = (
    "SELECT weeks.code, weeks.week_end, points.* EXCLUDE (code, week_end) FROM weeks "
    "LEFT JOIN points ON points.code = weeks.code AND points.week_end = weeks.week_end"
)


@query("resample_weekly", _weekly(_EMPTY_WEEKS), v.DEMO_WEEKS)
def resample_weekly(spark, sf):
    return out(series.resample_weekly(v.demo(spark, sf), "CODE", "YEAR", v.MEASURES), 4)


@query("interpolate_linear", _weekly(v.weekly_select(v.LINEAR)), v.DEMO_WEEKS)
def interpolate_linear(spark, sf):
    return out(series.interpolate_linear(v.demo(spark, sf), "CODE", "YEAR", v.MEASURES), 4)


@query("resample_ffill", _weekly(v.weekly_select(v.FORWARD)), v.DEMO_WEEKS)
def resample_ffill(spark, sf):
    return out(series.resample_ffill(v.demo(spark, sf), "CODE", "YEAR", v.MEASURES), 4)


@query("cumulative_share_cut", f"SELECT brand, ka, fsa, {r('sales_share', None, 9)}, {r('cum_share', None, 9)} FROM kept",
       v.POS + ",\n" + SHARES)
def cumulative_share(spark, sf):
    kept = cumulative_share_cut(v.pos(spark, sf, 2000), v.SERIES, "price", "qty", 0.05)
    return out(kept.select(*v.SERIES, "sales_share", "cum_share"), 9)


# Prices and quantities denoised at 1 %, then the combinations judged by their smoothed sales of 2000.
LARGE = (
    v.POS
    + ",\n" + denoise_sql("pos", _SERIES_SQL, "week_end", "price", 0.01).replace("denoised AS", "by_price AS").replace("smooth", "smooth_price")
    + ",\n" + denoise_sql("by_price", _SERIES_SQL, "week_end", "qty", 0.01)
    .replace("lagged", "lagged2").replace("flagged", "flagged2").replace("stepped", "stepped2").replace("denoised AS", "by_both AS")
    + """,
denoised AS (SELECT * EXCLUDE (price, qty, smooth, smooth_price), smooth_price AS price, smooth AS qty FROM by_both)"""
    + ",\n" + SHARES.replace("FROM pos ", "FROM denoised ")
)


@query("large_combination_prices", f"""SELECT brand, ka, province, fsa, segment, CAST(week_end AS VARCHAR) AS week_end,
  CAST(year(denoised.week_end) AS INTEGER) AS "Time_Yr", CAST(week(denoised.week_end) AS INTEGER) AS "Time_Week",
  CAST(month(denoised.week_end) AS INTEGER) AS "Time_Mon", {r('price')}
  FROM denoised WHERE (brand, ka, fsa) IN (SELECT (brand, ka, fsa) FROM kept)""", LARGE)
def large_combination_prices(spark, sf):
    data = v.pos(spark, sf).select(*v.FLAGGED, "province", "week_end", "qty", "price")
    smooth = materialize(
        series.denoise_series(data, v.FLAGGED, ["week_end"], ["price", "qty"], 0.01, one_row_per_date=True), "denoised")
    judged = in_year(smooth, "week_end", 2000)
    kept = cumulative_share_cut(judged, v.SERIES, "price", "qty", 0.05)
    large = keep_keys(smooth, kept, v.SERIES)
    parts = date_features("week_end", "Time_", ["Yr", "Week", "Mon"])
    return out(large.select("brand", "ka", "province", "fsa", "segment", "week_end", *parts, "price")).orderBy(
        "brand", "ka", "fsa", "segment", "week_end")
