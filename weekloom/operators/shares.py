"""Selection of the combinations that make up most of the sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions import as_column
from weekloom.operators.ordered import running_total
from weekloom.operators.sums import steady_sum
from weekloom.session import materialize


def cumulative_share_cut(
    df: DataFrame, keys: Sequence[str], price: str, quantity: str, threshold: float
) -> DataFrame:
    """Combinations left after dropping the smallest ones that together hold less than `threshold`
    of sales; equal shares in key order. `df` is the year to judge by.

    Columns as in `combination_sales`. All sums are the same however rows are partitioned, so a share that meets the
    threshold exactly is kept or dropped for good.
    """
    rows = materialize(df.select(*[as_column(c) for c in (*keys, price, quantity)]), "judged")
    grouped = rows.groupBy(*[as_column(k) for k in keys]).agg(
        (steady_sum(rows, as_column(price)) / F.count(as_column(price))).alias(price),
        steady_sum(rows, as_column(quantity)).alias(quantity),
        F.count(F.lit(1)).alias("n"),
    )
    sales = materialize(grouped.withColumn("sales", as_column(price) * as_column(quantity)), "combinations")
    total = sales.agg(steady_sum(sales, F.col("sales")).alias("_total")).scalar()
    shares = sales.withColumn("sales_share", F.try_divide(F.col("sales"), total))
    ranked = running_total(shares, ["sales_share", *keys], "sales_share", "cum_share")
    return ranked.filter(F.col("cum_share") >= threshold)
