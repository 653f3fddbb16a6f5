"""Writers of decks, reports and batch summaries.

Each writes whole folders by Spark's committers, so a reader sees all or
nothing of a file; overwriting replaces the earlier result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import VERSION


def page_json(blocks: DataFrame) -> DataFrame:
    """(page, json): a page with its blocks by id, and their ids in reading order; null fields are left out."""
    block = F.struct("id", "source", F.array("x0", "y0", "x1", "y1").alias("bbox"), "text", "confidence", "font_size", "bold", "italic", "reading_order")
    got = blocks.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", block.alias("b")))).alias("bs"), F.array_sort(F.collect_list(F.struct("reading_order", "id"))).alias("os"))
    page = F.struct(F.col("page").alias("page_number"), F.transform("bs", lambda x: x["b"]).alias("text_blocks"), F.transform("os", lambda x: x["id"]).alias("reading_order"))
    return got.select("page", F.to_json(page).alias("json"))


def write_decks(pages: DataFrame, path: str, width: float, height: float) -> None:
    """pages (deck, page_number, text_blocks) as one JSON document a line for each deck, pages in order."""
    if pages.isEmpty():
        raise ValueError("a deck needs a page")
    fields = [c for c in pages.columns if c != "deck"]
    deck = pages.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("page_number", F.struct(*fields).alias("p")))).alias("ps"))
    deck.select(F.lit(VERSION).alias("schema_version"), F.col("deck").cast("string").alias("source_path"), F.lit(width).alias("slide_width_pt"), F.lit(height).alias("slide_height_pt"), F.transform("ps", lambda x: x["p"]).alias("pages")).write.mode("overwrite").json(path)


def summary_line(path: Column, status: Column, seconds: Column, cost: Column) -> Column:
    """A row of a batch summary as Markdown."""
    money = F.when(cost.isNull(), "-").otherwise(F.format_string("$%.6f", cost))
    return F.format_string("| %s | %s | %.3f | %s |", path, status, seconds, money)


def summary_csv(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as text, nested ones by their last name, nulls as empty texts."""
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c.split(".")[-1]) for c in columns])


def write_summaries(rows: DataFrame, folder: str) -> None:
    """A batch's rows as JSON, CSV and Markdown under folder, each replaced as a whole."""
    rows.write.mode("overwrite").json(f"{folder}/summary.json")
    summary_csv(rows, ["id", "path", "status", "n_pages", "seconds", "cost"]).write.mode("overwrite").option("header", True).csv(f"{folder}/summary.csv")
    rows.orderBy("path", "id").select(summary_line(F.col("path"), F.col("status"), F.col("seconds"), F.col("cost")).alias("value")).write.mode("overwrite").text(f"{folder}/summary.md")


def write_report(rows: DataFrame, path: str) -> None:
    """Any rows as a JSON report, nulls left out."""
    rows.write.mode("overwrite").json(path)
