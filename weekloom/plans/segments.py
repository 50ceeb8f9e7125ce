"""Weekly sales and yearly demographics to segments of areas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions import as_column, band_sum, clean_name
from weekloom.operators.aggregates import group_reduce
from weekloom.operators.clustering import Segments, cluster_segments
from weekloom.operators.filters import drop_nulls, filter_level, infinite_to_null, select_slice
from weekloom.operators.joins import join_left_diffkeys
from weekloom.operators.schema import cast_numeric, clean_colnames
from weekloom.operators.series import interpolate_linear, pct_change
from weekloom.session import materialize


@dataclass(frozen=True)
class AreaColumns:
    """Names of the input columns by role."""

    province: str = "province"
    area: str = "fsa"
    week: str = "week_end"
    quantity: str = "qty"
    price: str = "price"
    population: str = "population"


def weekly_area_sales(sales: DataFrame, columns: AreaColumns) -> DataFrame:
    """One row per province, area and week: total quantity, mean price and population."""
    c = columns
    return group_reduce(sales, [c.province, c.area, c.week], sums=[c.quantity], means=[c.price, c.population])


def weekly_demographics(
    vintages: DataFrame, measures: Sequence[str], code: str = "CODE", year: str = "YEAR",
    level: tuple[str, str] | None = None,
) -> DataFrame:
    """Stacked yearly files to weekly values per code, for one geographic level."""
    df = filter_level(vintages, *level) if level else vintages
    numbers = cast_numeric(df.select(code, year, *[as_column(m) for m in measures]), keep=[code, year])
    return interpolate_linear(numbers, code, year, measures)


def area_changes(
    weekly: DataFrame, demographics: DataFrame, columns: AreaColumns, bands: Mapping[str, Sequence[str]],
    changes: Sequence[str], averages: Sequence[str] = (), code: str = "CODE",
) -> DataFrame:
    """Join, sum fine bands, drop incomplete rows, turn the `changes` columns into relative changes.

    Names are cleaned on the way out; rows without a previous week, or with a base of 0, go.
    """
    c = columns
    demo = demographics.withColumnRenamed("week_end", "_demo_week")
    joined = join_left_diffkeys(weekly, demo, {c.area: code, c.week: "_demo_week"})
    banded = joined.select(
        *[as_column(k) for k in (c.province, c.area, c.week, c.quantity, c.price)],
        *[band_sum(parts).alias(band) for band, parts in bands.items()],
        *[as_column(a) for a in averages],
    )
    complete = clean_colnames(drop_nulls(banded))
    # One row per area and week since weekly_area_sales.
    changed = pct_change(
        complete, [c.province, c.area], [c.week], [clean_name(x) for x in changes], one_row_per_date=True
    )
    return drop_nulls(infinite_to_null(changed))


def area_segments(
    changes: DataFrame, columns: AreaColumns, province: str, measures: Sequence[str], k: int = 2, **options
) -> Segments:
    """Segments of one province from its weekly measures and area labels."""
    c = columns
    rows = select_slice(changes, **{c.province: province}).select(
        as_column(c.area), *[F.col(f"`{m}`").cast("double").alias(m) for m in measures]
    )
    return cluster_segments(materialize(rows, "areas"), c.area, measures, k, **options)
