"""Operators over ordered elements: gaps and islands, 1-D clusters, orders.

All of them are window functions within a page (or another key), so a page is
the largest unit that meets in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, by: list[str], order: list, breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 1: a row for which `breaks` holds starts one.

    breaks may use lag() columns of df; null counts as a start.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("s_new", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(name, F.sum("s_new").over(w)).drop("s_new")


def before(df: DataFrame, by: list[str], order: list, *columns: str) -> DataFrame:
    """df with p_<column>: the value of the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    for c in columns:
        df = df.withColumn(f"p_{c}", F.lag(c).over(w))
    return df


def clusters_1d(df: DataFrame, by: list[str], value: str, tie: str, tolerance: float) -> DataFrame:
    """Single linkage on a line: by, cluster (from 1), centre (mean), n. The tolerance is inclusive."""
    rows = before(df.select(*by, value, tie), by, [value, tie], value)
    rows = islands(rows, by, [value, tie], F.col(value) - F.col(f"p_{value}") > tolerance, "cluster")
    return rows.groupBy(*by, "cluster").agg(F.avg(value).alias("centre"), F.count(F.lit(1)).alias("n"))


def reading_order(df: DataFrame, by: list[str], name: str = "rank", first: list | None = None) -> DataFrame:
    """Rank from 1 by `first`, then rounded top, rounded left and id."""
    order = [*(first or []), F.round("y0", 1), F.round("x0", 1), F.col("id")]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
