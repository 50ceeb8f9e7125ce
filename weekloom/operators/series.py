"""Time-series operators: rows keyed by a tuple of columns and ordered in time.

`one_row_per_date` is the caller's word that keys plus order columns identify a row and the order
is by calendar date, as after grouping by key and week. A series then has no more rows than the
calendar has dates, and a plain window per series is safe whatever the data size. Without it a
series may hold any share of the data, so all rows are cut into runs along keys and order and worked on
run by run. A run follows on from the one before, so what crosses a border is one row per run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weekloom.functions import as_column, round_4, week_ending, year_to_date
from weekloom.operators.ordered import RUN, cut_into_runs


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [as_column(c) for c in names]


def _so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _in_step(x: Column, previous: Column, threshold: float) -> Column:
    """Whether a value is close enough to its raw predecessor to stay in the running step."""
    near = F.round(F.abs(x - previous), 4) < F.round(F.abs(x * threshold), 4)
    return F.coalesce(near, F.lit(False))


def pct_change(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    one_row_per_date: bool = False,
    runs: int | None = None,
) -> DataFrame:
    """Replace each column by its relative change from the previous row of its series.

    Null in the first row of a series and where the previous value is 0 or null.
    """
    if one_row_per_date:
        window = Window.partitionBy(*_columns(keys)).orderBy(*_columns(order))
        return df.withColumns(
            {c: F.try_divide(as_column(c), F.lag(as_column(c)).over(window)) - 1 for c in columns}
        )
    cut = cut_into_runs(df, [*keys, *order], runs)
    inside = _along_run(keys, order)
    values = F.struct(*[as_column(c).alias(str(i)) for i, c in enumerate(columns)])
    row = F.struct(_key(keys).alias("k"), values.alias("v"))
    # One row per run: the last one of the run before, which only the first row of a run can follow.
    ends = cut.groupBy(RUN).agg(F.max_by(row, F.struct(*_columns([*keys, *order]))).alias("_end"))
    border = ends.select(RUN, F.lag("_end").over(Window.orderBy(RUN)).alias("_border"))
    previous = F.coalesce("_lag", "_border")
    followed = previous["k"].eqNullSafe(_key(keys))
    return (
        cut.withColumn("_lag", F.lag(row).over(inside))
        .join(F.broadcast(border), RUN)
        .withColumn("_before", F.when(followed, previous["v"]))
        .withColumns({c: F.try_divide(as_column(c), F.col("_before")[str(i)]) - 1 for i, c in enumerate(columns)})
        .drop("_lag", "_border", "_before", RUN)
    )


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*_columns(keys))


def _along_run(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """All rows of a run, series by series. Runs are of similar size, however long a series is."""
    return Window.partitionBy(RUN).orderBy(*_columns([*keys, *order]))


def denoise_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    column: str | Sequence[str],
    threshold: float,
    one_row_per_date: bool = False,
    runs: int | None = None,
) -> DataFrame:
    """Flatten small moves: a value within `threshold` times itself of its raw predecessor takes
    the first value of the running step, rounded to 4 places; any other value starts a step.

    Several columns are flattened each by itself, in the same pass over the rows.
    """
    columns = [column] if isinstance(column, str) else list(column)
    if one_row_per_date:
        window = Window.partitionBy(*_columns(keys)).orderBy(*_columns(order))
        # The struct keeps a null value a step of its own.
        starts = {
            f"_start{i}": F.when(
                ~_in_step(as_column(c), F.lag(as_column(c)).over(window), threshold), F.struct(round_4(c).alias("v"))
            )
            for i, c in enumerate(columns)
        }
        flat = {
            c: F.last(f"_start{i}", ignorenulls=True).over(_so_far(window))["v"] for i, c in enumerate(columns)
        }
        return df.withColumns(starts).withColumns(flat).drop(*starts)

    cut = cut_into_runs(df, [*keys, *order], runs)
    inside = _along_run(keys, order)
    position = F.struct(*_columns([*keys, *order]))
    row = F.struct(_key(keys).alias("k"), *[as_column(c).alias(f"x{i}") for i, c in enumerate(columns)])
    local = cut.withColumn("_row", F.row_number().over(inside)).withColumn("_lag", F.lag(row).over(inside))
    # Steps that start inside the run; its first row is decided with the border table.
    local = local.withColumns(
        {
            f"_start{i}": F.when(
                (F.col("_row") > 1)
                & ~(F.col("_lag.k").eqNullSafe(_key(keys)) & _in_step(as_column(c), F.col(f"_lag.x{i}"), threshold)),
                F.struct(round_4(c).alias("v")),
            )
            for i, c in enumerate(columns)
        }
    )
    ends = local.groupBy(RUN).agg(
        F.min_by(row, position).alias("_first"),
        F.max_by(row, position).alias("_last"),
        *[
            F.max_by(f"_start{i}", F.when(F.col(f"_start{i}").isNotNull(), position)).alias(f"_latest{i}")
            for i in range(len(columns))
        ],
    )
    # One row per run, so never more rows than range partitions. What a run's first rows carry on is the
    # step open at the end of the run before, or the step that the first row itself starts.
    along = Window.orderBy(RUN)
    border = ends.withColumn("_end", F.lag("_last").over(along))
    for i in range(len(columns)):
        goes_on = F.col("_end.k").eqNullSafe(F.col("_first.k")) & F.col("_end").isNotNull()
        goes_on &= _in_step(F.col(f"_first.x{i}"), F.col(f"_end.x{i}"), threshold)
        border = border.withColumn(f"_own{i}", F.when(~goes_on, F.struct(F.round(F.col(f"_first.x{i}"), 4).alias("v"))))
        close = F.last(F.coalesce(f"_latest{i}", f"_own{i}"), ignorenulls=True)
        earlier = close.over(along.rowsBetween(Window.unboundedPreceding, -1))
        border = border.withColumn(f"_carry{i}", F.coalesce(f"_own{i}", earlier))
    carries = [f"_carry{i}" for i in range(len(columns))]
    flat = {
        c: F.coalesce(F.last(f"_start{i}", ignorenulls=True).over(_so_far(inside)), F.col(f"_carry{i}"))["v"]
        for i, c in enumerate(columns)
    }
    return (
        local.join(F.broadcast(border.select(RUN, *carries)), RUN)
        .withColumns(flat)
        .drop("_row", "_lag", RUN, *carries, *[f"_start{i}" for i in range(len(columns))])
    )


def _yearly_points(df: DataFrame, code: str, year: str, measures: Sequence[str]) -> DataFrame:
    """One row per code and week that has data: the mean of each measure in that week."""
    date = F.col(year) if df.schema[year].dataType.typeName() == "date" else year_to_date(year)
    return df.groupBy(as_column(code).alias(code), week_ending(date).alias("week_end")).agg(
        *[F.avg(as_column(m)).alias(m) for m in measures]
    )


def resample_weekly(df: DataFrame, code: str, year: str, measures: Sequence[str]) -> DataFrame:
    """Yearly rows on a weekly grid: all weeks between a code's first and last, null where empty."""
    points = _yearly_points(df, code, year, measures)
    by_code = Window.partitionBy(code).orderBy("week_end")  # at most one row per code and week
    stop = F.lead("week_end").over(by_code)
    weeks = F.when(stop.isNull(), F.array("week_end")).otherwise(
        F.sequence("week_end", F.date_sub(stop, 7), F.expr("interval 7 days"))
    )
    return (
        points.withColumn("_weeks", weeks)
        .withColumn("_week", F.explode("_weeks"))
        .select(
            code,
            F.col("_week").alias("week_end"),
            *[F.when(F.col("_week") == F.col("week_end"), as_column(m)).alias(m) for m in measures],
        )
    )


def _fill_weeks(df: DataFrame, code: str, year: str, measures: Sequence[str], linear: bool) -> DataFrame:
    """Weekly values from the yearly points around them. Only the points go through windows; each
    point is then exploded into its weeks up to the next one."""
    points = _yearly_points(df, code, year, measures)
    by_code = Window.partitionBy(code).orderBy("week_end")  # at most one row per code and week
    upto = by_code.rowsBetween(Window.unboundedPreceding, 0)
    after = by_code.rowsBetween(1, Window.unboundedFollowing)

    def known(m: str) -> Column:
        return F.when(as_column(m).isNotNull(), F.struct(F.col("week_end").alias("w"), as_column(m).alias("v")))

    stop = F.lead("week_end").over(by_code)
    around = points.select(
        code,
        "week_end",
        F.when(stop.isNull(), F.array("week_end"))
        .otherwise(F.sequence("week_end", F.date_sub(stop, 7), F.expr("interval 7 days")))
        .alias("_weeks"),
        *[F.last(known(m), ignorenulls=True).over(upto).alias(f"_p{i}") for i, m in enumerate(measures)],
        *[F.first(known(m), ignorenulls=True).over(after).alias(f"_q{i}") for i, m in enumerate(measures)],
    )
    week = F.col("_week")

    def value(i: int) -> Column:
        p, q = F.col(f"_p{i}"), F.col(f"_q{i}")
        if not linear:
            return p["v"]
        slope = (q["v"] - p["v"]) * F.datediff(week, p["w"]) / F.datediff(q["w"], p["w"])
        return p["v"] + F.coalesce(slope, F.lit(0.0))

    return around.withColumn("_week", F.explode("_weeks")).select(
        code, week.alias("week_end"), *[value(i).alias(m) for i, m in enumerate(measures)]
    )


def interpolate_linear(df: DataFrame, code: str, year: str, measures: Sequence[str]) -> DataFrame:
    """Yearly to weekly, linear between a measure's known points. After the last known point it is
    repeated, before the first one the value stays null. Every code is filled from itself only."""
    return _fill_weeks(df, code, year, measures, linear=True)


def resample_ffill(df: DataFrame, code: str, year: str, measures: Sequence[str]) -> DataFrame:
    """Yearly to weekly, repeating the last known value."""
    return _fill_weeks(df, code, year, measures, linear=False)
