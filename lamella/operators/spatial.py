"""Joins of element tables on page and geometry.

Each join has the page as equi key, so it is a shuffle join on pages (or a
broadcast one, where the engine finds a side small enough); the geometric part
is a residual condition within a page. No step pairs elements of two pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions.geometry import Box, box

Theta = Callable[[Box, Box], Column]


def _sides(left: DataFrame, right: DataFrame, theta: Column | Theta):
    on = theta(box("a"), box("b")) if callable(theta) else theta
    return left.alias("a"), right.alias("b"), (F.col("a.page") == F.col("b.page")) & on


def semi(left: DataFrame, right: DataFrame, theta: Column | Theta) -> DataFrame:
    """Rows of left with a partner."""
    a, b, on = _sides(left, right, theta)
    return a.join(b, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, theta: Column | Theta) -> DataFrame:
    """Rows of left without a partner."""
    a, b, on = _sides(left, right, theta)
    return a.join(b, on, "left_anti")


def flagged(left: DataFrame, right: DataFrame, theta: Column | Theta, name: str, keys: tuple = ("page", "id")) -> DataFrame:
    """left with a boolean: whether the row has a partner. keys: what names a row of left."""
    found = semi(left, right, theta).select(*keys).distinct().withColumn(name, F.lit(True))
    return left.join(found, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def pairs(left: DataFrame, right: DataFrame, theta: Column | Theta) -> DataFrame:
    """All pairs that meet, with aliases a and b."""
    a, b, on = _sides(left, right, theta)
    return a.join(b, on)


def best(left: DataFrame, right: DataFrame, score: Theta, theta: Column | Theta, tie: Column, take: list[Column], keys: tuple = ("page", "id")) -> DataFrame:
    """For each row of left with a partner: keys, the highest score and `take` of its partner.

    Equal scores go to the smallest tie. One partial aggregation, no sort of pairs.
    """
    s = score(box("a"), box("b"))
    rows = pairs(left, right, theta).select(*[F.col(f"a.{k}") for k in keys], s.alias("score"), F.struct((-s).alias("s"), tie.alias("tie"), *take).alias("best"))
    top = rows.groupBy(*keys).agg(F.min("best").alias("best"))
    return top.select(*keys, (-F.col("best.s")).alias("score"), "best.*").drop("s", "tie")


def nearest(values: DataFrame, centres: DataFrame, value: str, centre: str, index: str, tolerance: float) -> DataFrame:
    """Index of the nearest centre of the page within the tolerance, both ends included; the last of equals; null if none."""
    v, c = values.alias("v"), centres.alias("c")
    off = F.abs(F.col(f"v.{value}") - F.col(f"c.{centre}"))
    hit = v.join(c, (F.col("v.page") == F.col("c.page")) & (off <= tolerance))
    got = hit.groupBy("v.page", "v.id").agg(F.min(F.struct(off.alias("off"), (-F.col(f"c.{index}")).alias("i"))).alias("m"))
    return values.join(got.select("page", "id", (-F.col("m.i")).alias("cluster")), ["page", "id"], "left")


def as_of(values: DataFrame, centres: DataFrame, value: str, centre: str, index: str, tolerance: float) -> DataFrame:
    """Index of the last centre that is at most value + tolerance; 0 if none."""
    v, c = values.alias("v"), centres.alias("c")
    hit = v.join(c, (F.col("v.page") == F.col("c.page")) & (F.col(f"c.{centre}") <= F.col(f"v.{value}") + tolerance))
    got = hit.groupBy("v.page", "v.id").agg(F.max_by(F.col(f"c.{index}"), F.col(f"c.{centre}")).alias("column"))
    return values.join(got, ["page", "id"], "left").withColumn("column", F.coalesce("column", F.lit(0)))


def ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
