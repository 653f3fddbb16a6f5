"""Aggregates with the tie rules and medians of layout data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_mode(df: DataFrame, by: list[str], value: str, pos: str) -> DataFrame:
    """by, value: the most frequent value that is not null; of equals the one seen first, by pos."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("at"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", (-F.col("at")).alias("at"))).alias(value))


def upper_median(x: Column) -> Column:
    """The value at place n div 2 of the sorted values: one that occurs; null if there is none."""
    values = F.array_sort(F.collect_list(x))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def weighted_mean(x: Column, weight: Column) -> Column:
    return F.sum(x * weight) / F.greatest(F.lit(1), F.sum(weight))


def trimmed(df: DataFrame, by: list[str], value: str, pos: str, ratio: float = 0.1) -> DataFrame:
    """df without the lowest and highest n * ratio (cut to a whole number) values of each group."""
    order = Window.partitionBy(*by).orderBy(value, pos)
    rows = df.where(F.col(value).isNotNull()).withColumn("t_i", F.row_number().over(order)).withColumn("t_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    cut = F.floor(F.col("t_n") * ratio)
    return rows.where((F.col("t_i") > cut) & (F.col("t_i") <= F.col("t_n") - cut)).drop("t_i", "t_n")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def multiset_scores(overlap: Column, n_reference: Column, n_candidate: Column) -> dict[str, Column]:
    """Precision, recall and F1 of a bag overlap: both bags empty 1, one empty 0."""
    empty = (n_reference == 0) & (n_candidate == 0)
    p = F.when(empty, 1.0).when((n_reference == 0) | (n_candidate == 0), 0.0).otherwise(overlap / F.greatest(n_candidate, F.lit(1)))
    r = F.when(empty, 1.0).when((n_reference == 0) | (n_candidate == 0), 0.0).otherwise(overlap / F.greatest(n_reference, F.lit(1)))
    return {"precision": p, "recall": r, "f1": F.when(p + r <= 0, 0.0).otherwise(2 * p * r / F.greatest(p + r, F.lit(1e-12)))}
