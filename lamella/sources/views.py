"""Element tables (blocks, regions, shapes, ...) derived from the driver tables.

The SQL of a view is common to Spark and, but for two functions, to the engine
that checks it, in exact integer arithmetic. Pages are 960 by 540 points. Elements of a page stay about
as many at any scale; the number of pages grows with the tables.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

PAGE_W, PAGE_H = 960.0, 540.0

_BOX = "CAST(({id} * 37) % 800 AS DOUBLE) AS x0, CAST(({id} * 53) % 480 AS DOUBLE) AS y0, CAST(({id} * 37) % 800 + {w} AS DOUBLE) AS x1, CAST(({id} * 53) % 480 + {h} AS DOUBLE) AS y1"


def _box(key: str, w: str, h: str) -> str:
    return _BOX.format(id=key, w=w, h=h)


def _page(key: str, per: int) -> str:
    return f"CAST(floor(({key}) / {per}.0D) AS BIGINT)"


_TEXT = """CASE event_id % 8
 WHEN 0 THEN concat('• ', event_type, ' item') WHEN 1 THEN CAST(event_id * 7919 AS STRING)
 WHEN 2 THEN concat('中文標題', event_type) WHEN 3 THEN concat('1. ', event_type, chr(10), 'second line')
 WHEN 4 THEN concat('Figure ', CAST(event_id % 9 AS STRING)) WHEN 5 THEN concat('b) ', event_type, ' ', CAST(event_id AS STRING))
 WHEN 6 THEN '' ELSE concat(event_type, ' body text of block ', CAST(event_id AS STRING)) END"""

#: Common SQL of both engines; STRING is a type of both.
SQL = {
    "blocks": f"""SELECT user_id AS page, event_id AS id, CASE WHEN event_type IN ('view', 'click') THEN 'native' ELSE 'ocr' END AS source,
 {_box("event_id", "20 + (event_id * 7) % 140", "8 + (event_id * 11) % 24")},
 CAST((event_id * 13) % 100 AS DOUBLE) / 100.0D AS confidence, CAST(8 + (event_id * 5) % 33 AS DOUBLE) AS font_size,
 {_TEXT} AS text, event_id % 3 = 0 AS bold, event_id % 4 = 0 AS italic,
 CASE event_id % 4 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Courier New' WHEN 2 THEN 'Times New Roman' END AS font,
 CAST(event_id % 17 AS INT) AS reading_order FROM events""",
    "pages_": "SELECT DISTINCT user_id AS page, CASE user_id % 3 WHEN 0 THEN 'digital' WHEN 1 THEN 'scanned' ELSE 'hybrid' END AS kind FROM events",
    "regions": f"""SELECT page, id, x0 - 10.0D AS x0, y0 - 10.0D AS y0, x1 + 10.0D AS x1, y1 + 10.0D AS y1, confidence,
 CASE id % 7 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'figure' WHEN 3 THEN 'table' WHEN 4 THEN 'list' WHEN 5 THEN 'chart' ELSE 'header' END AS label
 FROM (SELECT user_id AS page, event_id AS id, {_box("event_id", "20 + (event_id * 7) % 140", "8 + (event_id * 11) % 24")}, CAST((event_id * 13) % 100 AS DOUBLE) / 100.0D AS confidence FROM events WHERE event_type = 'click') b""",
    "tables_": f"""SELECT page, id, x0 - 30.0D AS x0, y0 - 20.0D AS y0, x1 + 30.0D AS x1, y1 + 40.0D AS y1, id % 2 = 0 AS borderless, CAST(10000 + id % 50 AS INT) AS z
 FROM (SELECT CAST(floor(s_suppkey * 1.5D) AS BIGINT) AS page, s_suppkey AS id, {_box("s_suppkey", "60 + (s_suppkey * 7) % 240", "40 + (s_suppkey * 11) % 80")} FROM supplier) t""",
    "shapes": f"""SELECT {_page("o_orderkey", 100)} AS page, o_orderkey AS id, {_box("o_orderkey", "2 + (o_orderkey * 7) % 300", "1 + (o_orderkey * 11) % 90")},
 CASE o_orderstatus WHEN 'O' THEN '#FF0000' WHEN 'F' THEN '#00FF00' END AS fill, CASE WHEN o_orderkey % 3 = 0 THEN '#000000' END AS stroke,
 CAST(o_orderkey % 7 AS DOUBLE) / 2.0D AS stroke_width, CASE WHEN o_orderkey % 4 = 0 THEN 0.5D ELSE 1.0D END AS opacity, CAST(o_orderkey % 40 AS INT) AS z,
 CASE o_orderkey % 3 WHEN 0 THEN 'rect' WHEN 1 THEN 'line' ELSE 'freeform' END AS kind FROM (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders) o""",
    "images": f"""SELECT {_page("p_partkey * 15", 200)} AS page, p_partkey AS id, {_box("p_partkey", "30 + (p_partkey * 7) % 200", "20 + (p_partkey * 11) % 120")}, CAST(p_size AS INT) AS z FROM part""",
    "words": f"""SELECT {_page("l_orderkey", 100)} AS page, l_orderkey * 10 + l_linenumber AS id, {_box("(l_orderkey * 10 + l_linenumber)", "4 + (l_orderkey * 7) % 60", "6 + (l_orderkey * 11) % 10")},
 concat('w', CAST(l_linenumber AS STRING)) AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l""",
    # Every tenth page has no paint log.
    "paint": """SELECT page, id * 2 AS ord, 'path' AS kind, x0, y0, x1, y1 FROM shapes WHERE (fill IS NOT NULL OR stroke IS NOT NULL) AND page % 10 <> 3
 UNION ALL SELECT page, id * 3 AS ord, 'image' AS kind, x0, y0, x1, y1 FROM images WHERE page % 10 <> 3""",
    "calls": """SELECT user_id AS worker, event_id AS id, ts, event_type = 'error' AS failed, event_type = 'view' AS cached,
 CAST(event_id * 31 % 8000 AS BIGINT) AS tokens_in, CAST(event_id * 17 % 1600 AS BIGINT) AS tokens_out FROM events""",
    "annotations": """SELECT page, id, CASE id % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'body' WHEN 2 THEN 'header' WHEN 3 THEN 'list' WHEN 4 THEN 'footer' ELSE 'caption' END AS role,
 CAST((id * 7) % 23 AS INT) AS ord, CAST((id * 19) % 100 AS DOUBLE) / 100.0D AS conf, CAST(id % 12 AS INT) AS grp FROM blocks""",
    "edits": "SELECT page, id, CASE WHEN id % 3 = 0 THEN 'title' WHEN id % 3 = 1 THEN 'body' END AS role, id % 4 = 1 AS excluded, page % 9 = 0 AS raster FROM (SELECT user_id AS page, event_id AS id FROM events WHERE event_type = 'purchase') e",
    "attempts": f"""SELECT DISTINCT {_page("l_orderkey", 100)} AS page, l_orderkey AS id, CAST(l_orderkey * 7 % 1000 AS DOUBLE) / 1000.0D AS ssim_before,
 CAST((l_orderkey * 7 + l_orderkey % 5) % 1000 AS DOUBLE) / 1000.0D AS ssim_after, CAST(l_orderkey % 11 AS DOUBLE) / 10.0D AS edit_before, CAST((l_orderkey % 11 + (l_orderkey % 3) - 1) AS DOUBLE) / 10.0D AS edit_after,
 CAST(l_orderkey % 7 AS DOUBLE) / 7.0D AS f1_before, CAST((l_orderkey % 7 + l_orderkey % 2) AS DOUBLE) / 7.0D AS f1_after, CAST(1 + l_orderkey % 9 AS DOUBLE) AS seconds FROM lineitem""",
    "issues": f"""SELECT page, id, CASE id % 5 WHEN 0 THEN 'text_overflow' WHEN 1 THEN 'extra_wrap' WHEN 2 THEN 'line_drift' WHEN 3 THEN 'low_local_ssim' ELSE 'color' END AS kind,
 CAST((id * 7) % 40 AS DOUBLE) / 10.0D AS severity, id % 2 = 0 AS evidence, x0, y0, x1, y1, id % 9 <> 0 AS has_box, CASE WHEN id % 4 = 0 THEN 'table' WHEN id % 4 = 1 THEN 'shape' ELSE 'text' END AS element
 FROM (SELECT user_id AS page, event_id AS id, {_box("event_id", "20 + (event_id * 7) % 140", "8 + (event_id * 11) % 24")} FROM events WHERE event_type IN ('error', 'signup')) e""",
    "files": """SELECT o_orderkey AS id, concat(CASE WHEN o_orderkey % 13 = 0 THEN '.hid/' WHEN o_orderkey % 3 = 0 THEN 'sub/' ELSE '' END, 'Doc_', CAST(o_orderkey % 700 AS STRING), CASE o_orderkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' ELSE '.Pdf' END) AS path,
 CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'ok' END AS status, CAST(o_orderkey % 40 AS INT) AS n_pages, CAST(o_orderkey % 90 AS DOUBLE) AS seconds,
 CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 50 AS DOUBLE) / 64.0D END AS cost, o_orderdate AS updated_at FROM (SELECT DISTINCT o_orderkey, o_orderdate FROM orders)""",
    "bands": "SELECT page, id, x0, y0, x1, y1, fill FROM shapes WHERE fill IS NOT NULL AND y1 - y0 BETWEEN 10 AND 64 AND x1 - x0 >= 2.5D * (y1 - y0) AND (x1 - x0) * (y1 - y0) < 0.5D * 518400.0D",
    "cells": """SELECT page, id AS table_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, x0 + c * 40.0D AS x0, y0 + r * 20.0D AS y0, x0 + (c + 1) * 40.0D AS x1, y0 + (r + 1) * 20.0D AS y1,
 CASE WHEN (id + r * 3 + c) % 4 = 0 THEN '' WHEN (id + r) % 3 = 0 THEN CAST(id * 10 + c AS STRING) ELSE concat('cell ', CAST(id % 10 AS STRING)) END AS text
 FROM (SELECT *, explode(sequence(0, 3)) AS c FROM (SELECT *, explode(sequence(0, 2)) AS r FROM tables_) t) u""",
    "lines": "SELECT doc_id, pos, line FROM documents {explode}",
}
_BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _needs(text: str) -> set[str]:
    return {v for v in SQL if re.search(rf"\b{v}\b", text)}


def duck(name: str) -> str:
    text = re.sub(r"(\d)D\b", r"\1::DOUBLE", SQL[name])
    text = re.sub(r"explode\(sequence\((\d+), (\d+)\)\)", r"unnest(range(\1, \2 + 1))", text)
    if name == "lines":
        return "SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
    return text


def with_views(query: str) -> str:
    """The query for DuckDB, with the views it names in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in sorted(_needs(SQL[name]) - {name}):
            visit(need)
        if name not in order:
            order.append(name)

    for name in sorted(_needs(query)):
        visit(name)
    query = query.strip()
    if not order:
        return query
    head = ", ".join(f"{n} AS ({duck(n)})" for n in order)
    for start in ("WITH RECURSIVE ", "WITH "):
        if query.upper().startswith(start):
            return f"{start}{head}, {query[len(start):]}"
    return f"WITH {head} {query}"


class Views:
    """The tables of a folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in _BASE:
                self._made[name] = self.table(name)
            elif name in SQL:
                text = SQL[name].replace("{explode}", "LATERAL VIEW posexplode(split(text, '\\n')) e AS pos, line")
                parts = {n: getattr(self, n) for n in [*_BASE, *SQL] if n != name and re.search(rf"(?:FROM|JOIN)\s+\(?{n}\b", text)}
                for n in parts:
                    text = re.sub(rf"((?:FROM|JOIN)\s+\(?){n}\b", rf"\1{{{n}}}", text)
                self._made[name] = self.spark.sql(text, **parts)
            else:
                raise AttributeError(name)
        return self._made[name]
