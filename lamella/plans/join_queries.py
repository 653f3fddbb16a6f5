"""Queries over page-keyed spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.functions import geometry as G
from lamella.operators import spatial as J

from . import sqltext as S
from .registry import query

_K = "a.page, a.id"


@query("join_select_blocks", "JOIN-01", f"""
SELECT b.page, b.id, source FROM blocks b JOIN pages_ p USING (page) WHERE (kind = 'digital' AND source = 'native') OR (kind = 'scanned' AND source = 'ocr') OR (kind = 'hybrid' AND (source = 'native' OR
 NOT EXISTS (SELECT 1 FROM blocks n WHERE n.page = b.page AND n.source = 'native' AND {S.share("b", "n")} >= 0.5)))""")
def select_blocks(v):
    rows = v.blocks.join(v.pages_, "page")
    native, ocr = rows.where("source = 'native'"), rows.where("source = 'ocr'")
    hybrid = J.anti(ocr.where("kind = 'hybrid'"), native.select("page", "x0", "y0", "x1", "y1"), lambda a, b: G.share_of_first(a, b) >= 0.5)
    parts = [native.where("kind <> 'scanned'"), ocr.where("kind = 'scanned'"), hybrid]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("page", "id", "source")


_RS = f"({S.share('a', 'b')} * CASE WHEN b.label IN ('figure', 'table') THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END)"


@query("join_best_region", "JOIN-02 WIN-06", f"""
SELECT page, id, region, label, score FROM (SELECT {_K}, b.id AS region, b.label, {_RS} AS score, row_number() OVER (PARTITION BY a.page, a.id ORDER BY {_RS} DESC, b.id) AS n FROM blocks a JOIN regions b ON a.page = b.page AND {_RS} > 0) WHERE n = 1 AND score >= 0.35""")
def best_region(v):
    weight = F.when(F.col("b.label").isin("figure", "table"), 0.85).otherwise(1.0)
    got = J.best(v.blocks, v.regions, lambda a, b: G.share_of_first(a, b) * weight, lambda a, b: G.intersection_area(a, b) > 0, F.col("b.id"), [F.col("b.id").alias("region"), F.col("b.label").alias("label")])
    return got.where("score >= 0.35").select("page", "id", "region", "label", "score")


@query("join_table_absorption", "JOIN-03 JOIN-04 JOIN-05 UDF-07", f"""
WITH f AS (SELECT {_K}, bool_or(b.id = a.id OR {S.share("a", "b")} >= 0.6) AS inside, bool_or({S.share("a", "b")} >= 0.5 OR {S.centre_in("a", "b")}) AS absorbed FROM blocks a JOIN tables_ b ON a.page = b.page GROUP BY ALL)
SELECT page, b.id, coalesce(inside, false) AS inside, coalesce(absorbed, false) AS absorbed FROM blocks b LEFT JOIN f USING (page, id) WHERE b.source = 'native' OR NOT coalesce(absorbed, false)""")
def table_absorption(v):
    inside = J.flagged(v.blocks.select("page", "id", "source", "x0", "y0", "x1", "y1"), v.tables_, lambda a, b: (F.col("b.id") == F.col("a.id")) | (G.share_of_first(a, b) >= 0.6), "inside")
    both = J.flagged(inside, v.tables_, lambda a, b: (G.share_of_first(a, b) >= 0.5) | G.centre_inside(a, b), "absorbed")
    kept = both.where("source <> 'native'").join(both.where("absorbed").select("page", "id"), ["page", "id"], "left_anti")
    return both.where("source = 'native'").unionByName(kept).select("page", "id", "inside", "absorbed")


@query("join_obstacles", "JOIN-06 JOIN-27 JOIN-12 JOIN-29", f"""
WITH f AS (SELECT {_K}, bool_or(least(a.x1, b.x1) > greatest(a.x0, b.x0) AND a.y0 - b.y1 BETWEEN 0 AND 40) AS above, bool_or({S.coef("a", "b")} >= 0.5) AS inside,
 bool_or({S.inter("a", "b")} / {S.area("b")} >= 0.25 OR {S.inter("a", "b")} / {S.area("a")} >= 0.25) AS on_image, bool_or({S.share("a", "b")} >= 0.2) AS fifth FROM blocks a JOIN images b ON a.page = b.page GROUP BY ALL)
SELECT page, id, coalesce(above, false) AS above, coalesce(inside, false) AS inside, coalesce(on_image, false) AS on_image, coalesce(fifth, false) AS fifth FROM blocks LEFT JOIN f USING (page, id)""")
def obstacles(v):
    a, b = G.box("a"), G.box("b")
    inter = G.intersection_area(a, b)
    tests = {
        "above": (F.least(a.x1, b.x1) > F.greatest(a.x0, b.x0)) & (a.y0 - b.y1).between(0, 40),
        "inside": G.overlap_coefficient(a, b) >= 0.5,
        "on_image": (inter / G.area(b) >= 0.25) | (inter / G.area(a) >= 0.25),
        "fifth": G.share_of_first(a, b) >= 0.2,
    }
    found = J.pairs(v.blocks, v.images, F.lit(True)).groupBy("a.page", "a.id").agg(*[F.bool_or(t).alias(n) for n, t in tests.items()])
    return v.blocks.select("page", "id").join(found, ["page", "id"], "left").select("page", "id", *[F.coalesce(n, F.lit(False)).alias(n) for n in tests])


@query("join_figure_overlap", "JOIN-07 FLT-32", f"""
WITH r AS (SELECT * FROM regions WHERE label IN ('figure', 'chart')), o AS (SELECT {_K}, sum({S.inter("a", "b")}) AS total, bool_or({S.inter("a", "b")} / greatest(1.0, {S.area("b")}) >= 0.5) AS hit FROM r a JOIN images b ON a.page = b.page GROUP BY ALL)
SELECT page, r.id, (1000 + row_number() OVER (PARTITION BY page ORDER BY r.id))::INT AS z FROM r LEFT JOIN o USING (page, id) WHERE NOT coalesce(hit OR total / {S.area("r")} >= 0.25, false) AND floor(x1) - floor(x0) >= 4 AND floor(y1) - floor(y0) >= 4""")
def figure_overlap(v):
    r = v.regions.where("label IN ('figure', 'chart')")
    a, b = G.box("a"), G.box("b")
    inter = G.intersection_area(a, b)
    o = J.pairs(r, v.images, F.lit(True)).groupBy("a.page", "a.id").agg(F.sum(inter).alias("total"), F.bool_or(inter / F.greatest(F.lit(1.0), G.area(b)) >= 0.5).alias("hit"))
    free = r.join(o, ["page", "id"], "left").where(~F.coalesce(F.col("hit") | (F.col("total") / G.area(G.box()) >= 0.25), F.lit(False)))
    free = free.where("floor(x1) - floor(x0) >= 4 AND floor(y1) - floor(y0) >= 4")
    return J.ranked(free, ["page"], F.col("id")).select("page", "id", (F.col("rank") + 1000).alias("z"))


_HAIR = "((a.stroke IS NOT NULL AND a.stroke_width > 0 AND a.stroke_width <= 2 AND greatest(a.x1 - a.x0, a.y1 - a.y0) >= 8) OR (a.fill IS NOT NULL AND least(a.x1 - a.x0, a.y1 - a.y0) <= 1.5 AND greatest(a.x1 - a.x0, a.y1 - a.y0) >= 8))"


def hairline(b, stroke, width, fill):
    long, short = F.greatest(b.w, b.h) >= 8, F.least(b.w, b.h) <= 1.5
    return (stroke.isNotNull() & (width > 0) & (width <= 2) & long) | (fill.isNotNull() & short & long)


@query("join_drawings_in_tables", "JOIN-08 FLT-07 JOIN-32", f"""
SELECT page, id, bool_or(hair AND borderless AND mid) AS raised, bool_or(NOT (hair AND borderless) AND (mid OR s >= 0.85) AND small) AS owned, max(CASE WHEN hair AND borderless AND mid THEN z END) AS over_z
FROM (SELECT {_K}, coalesce({_HAIR}, false) AS hair, b.borderless, {S.centre_in("a", "b", 1.0)} AS mid, {S.share("a", "b")} AS s, {S.area("a")} < 0.95 * 518400.0 AS small, b.z FROM shapes a JOIN tables_ b ON a.page = b.page) GROUP BY page, id HAVING raised OR owned""")
def drawings_in_tables(v):
    a, b = G.box("a"), G.box("b")
    hair = F.coalesce(hairline(a, F.col("a.stroke"), F.col("a.stroke_width"), F.col("a.fill")), F.lit(False))
    mid = G.centre_inside(a, b, 1.0)
    line = hair & F.col("b.borderless")
    rows = J.pairs(v.shapes, v.tables_, F.lit(True)).groupBy("a.page", "a.id").agg(
        F.bool_or(line & mid).alias("raised"),
        F.bool_or(~line & (mid | (G.share_of_first(a, b) >= 0.85)) & (G.area(a) < 0.95 * 518400.0)).alias("owned"),
        F.max(F.when(line & mid, F.col("b.z"))).alias("over_z"),
    )
    return rows.where("raised OR owned")


@query("join_cell_fill", "JOIN-09 JOIN-34 RAS-36", f"""
WITH c AS (SELECT table_id * 100 + row * 10 + col AS id, page, x0, y0, x1, y1 FROM cells),
m AS (SELECT {_K}, arg_min(row(b.fill, b.opacity), row({S.area("b")}, b.id)) AS r, bool_or(b.fill = '#FF0000' AND {S.share("a", "b")} >= 0.5 AND {S.area("b")} <= 12 * {S.area("a")}) AS like_cell,
 count(*) FILTER (WHERE b.x0 - 2 <= a.x0 AND b.y0 - 2 <= a.y0 AND b.x1 + 2 >= a.x1 AND b.y1 + 2 >= a.y1 AND least(b.x1 - b.x0, b.y1 - b.y0) > 1.5) AS n FROM c a JOIN shapes b ON a.page = b.page WHERE b.fill IS NOT NULL GROUP BY ALL),
k AS (SELECT {_K}, arg_min(row(b.fill, b.opacity), row({S.area("b")}, b.id)) AS r FROM c a JOIN shapes b ON a.page = b.page WHERE b.fill IS NOT NULL AND b.x0 - 2 <= a.x0 AND b.y0 - 2 <= a.y0 AND b.x1 + 2 >= a.x1 AND b.y1 + 2 >= a.y1 AND least(b.x1 - b.x0, b.y1 - b.y0) > 1.5 GROUP BY ALL)
SELECT c.page, c.id, CASE WHEN k.r[2] >= 0.99 THEN k.r[1] END AS fill, coalesce(like_cell, false) AS like_cell FROM c LEFT JOIN m ON c.id = m.id AND c.page = m.page LEFT JOIN k ON c.id = k.id AND c.page = k.page""")
def cell_fill(v):
    c = v.cells.select("page", (F.col("table_id") * 100 + F.col("row") * 10 + F.col("col")).alias("id"), "x0", "y0", "x1", "y1")
    a, b = G.box("a"), G.box("b")
    holds = (b.x0 - 2 <= a.x0) & (b.y0 - 2 <= a.y0) & (b.x1 + 2 >= a.x1) & (b.y1 + 2 >= a.y1) & (F.least(b.w, b.h) > 1.5)
    like = (F.col("b.fill") == "#FF0000") & (G.share_of_first(a, b) >= 0.5) & (G.area(b) <= 12 * G.area(a))
    smallest = F.min(F.when(holds, F.struct(G.area(b).alias("area"), F.col("b.id").alias("i"), F.col("b.fill").alias("fill"), F.col("b.opacity").alias("op"))))
    got = J.pairs(c, v.shapes.where("fill IS NOT NULL"), F.lit(True)).groupBy("a.page", "a.id").agg(smallest.alias("s"), F.bool_or(like).alias("like_cell"))
    return c.select("page", "id").join(got, ["page", "id"], "left").select("page", "id", F.when(F.col("s.op") >= 0.99, F.col("s.fill")).alias("fill"), F.coalesce("like_cell", F.lit(False)).alias("like_cell"))


@query("join_fill_underneath", "JOIN-10", f"""
SELECT {_K}, arg_min(b.fill, row({S.area("b")}, b.id)) AS fill FROM regions a JOIN shapes b ON a.page = b.page AND b.fill IS NOT NULL AND b.opacity >= 0.99 AND {S.centre_in("a", "b")} AND {S.area("b")} >= {S.area("a")} GROUP BY ALL""")
def fill_underneath(v):
    a, b = G.box("a"), G.box("b")
    on = F.col("b.fill").isNotNull() & (F.col("b.opacity") >= 0.99) & G.centre_inside(a, b) & (G.area(b) >= G.area(a))
    return J.pairs(v.regions, v.shapes, on).groupBy("a.page", "a.id").agg(F.min_by(F.col("b.fill"), F.struct(G.area(b), F.col("b.id"))).alias("fill"))


_PO = f"SELECT a.page, a.id, arg_max(b.ord, row({S.iou('a', 'b')}, -b.ord)) AS ord FROM {{}} a JOIN paint b ON a.page = b.page AND b.kind = '{{}}' AND {S.iou('a', 'b')} >= 0.5 GROUP BY ALL"


@query("join_under_raster", "JOIN-13 JOIN-14 SRC-08 SRC-09", f"""
WITH so AS ({_PO.format("shapes", "path")}), io AS ({_PO.format("images", "image")}),
p AS (SELECT a.page, a.id, b.id AS image, {S.area("a")} AS sa, {S.area("b")} AS ia FROM shapes a JOIN images b ON a.page = b.page WHERE a.fill IS NOT NULL AND a.opacity >= 0.99 AND ({S.inter("a", "b")} / {S.area("b")} >= 0.25 OR {S.inter("a", "b")} / {S.area("a")} >= 0.25))
SELECT p.page, p.id, bool_or(CASE WHEN p.page % 10 = 3 THEN sa >= ia ELSE coalesce(so.ord < io.ord, false) END) AS under FROM p LEFT JOIN so ON p.page = so.page AND p.id = so.id LEFT JOIN io ON p.page = io.page AND p.image = io.id GROUP BY ALL""")
def under_raster(v):
    """A page without a paint log (null) goes by area, one with a log by paint order."""
    a, b = G.box("a"), G.box("b")

    def order(of, kind):
        near = (F.col("b.kind") == kind) & (G.iou(a, b) >= 0.5)
        return J.pairs(of, v.paint, near).groupBy("a.page", "a.id").agg(F.max_by(F.col("b.ord"), F.struct(G.iou(a, b), -F.col("b.ord"))).alias("ord"))

    inter = G.intersection_area(a, b)
    opaque = F.col("a.fill").isNotNull() & (F.col("a.opacity") >= 0.99)
    met = J.pairs(v.shapes, v.images, opaque & ((inter / G.area(b) >= 0.25) | (inter / G.area(a) >= 0.25)))
    met = met.select("a.page", "a.id", F.col("b.id").alias("image"), G.area(a).alias("sa"), G.area(b).alias("ia"))
    so, io = order(v.shapes, "path").withColumnRenamed("ord", "so"), order(v.images, "image").select("page", F.col("id").alias("image"), F.col("ord").alias("io"))
    rows = met.join(so, ["page", "id"], "left").join(io, ["page", "image"], "left")
    no_log = F.col("page") % 10 == 3
    return rows.groupBy("page", "id").agg(F.bool_or(F.when(no_log, F.col("sa") >= F.col("ia")).otherwise(F.coalesce(F.col("so") < F.col("io"), F.lit(False)))).alias("under"))


@query("join_nearest_column", "JOIN-15 JOIN-16", """
WITH c AS (SELECT page, x0 AS centre, (row_number() OVER (PARTITION BY page ORDER BY x0, id) - 1)::INT AS i FROM regions QUALIFY row_number() OVER (PARTITION BY page, x0 ORDER BY id) = 1),
n AS (SELECT w.page, w.id, arg_min(c.i, row(abs(w.x0 - c.centre), -c.i)) AS cluster FROM words w JOIN c ON w.page = c.page AND abs(w.x0 - c.centre) <= 12 GROUP BY ALL),
s AS (SELECT w.page, w.id, c.i AS "column" FROM words w ASOF JOIN c ON w.page = c.page AND w.x0 + 6.0 >= c.centre)
SELECT page, w.id, cluster, coalesce("column", 0) AS "column" FROM words w LEFT JOIN n USING (page, id) LEFT JOIN s USING (page, id)""")
def nearest_column(v):
    firsts = v.regions.groupBy("page", F.col("x0").alias("centre")).agg(F.min("id").alias("id"))
    centres = J.ranked(v.regions.select("page", "id", F.col("x0").alias("centre")), ["page"], F.col("centre"), F.col("id")).join(firsts, ["page", "id", "centre"], "left_semi").withColumn("i", F.col("rank") - 1)
    both = J.as_of(J.nearest(v.words.select("page", "id", "x0"), centres, "x0", "centre", "i", 12.0), centres, "x0", "centre", "i", 6.0)
    return both.select("page", "id", "cluster", "column")


@query("join_zebra_fills", "JOIN-18 FLT-31", f"""
WITH r AS (SELECT page, id, i, y0 + (i + 0.5) * 20.0 AS cy, x0 FROM tables_, (SELECT unnest(range(3)) AS i)), m AS (SELECT r.page, r.id, r.i, arg_min(b.fill, row(b.y0, b.id)) AS fill FROM r JOIN bands b ON r.page = b.page AND r.cy BETWEEN b.y0 AND b.y1 AND abs(b.x0 - r.x0) <= 160 GROUP BY ALL)
SELECT page, id, string_agg(fill, ',' ORDER BY i) AS fills FROM m GROUP BY page, id HAVING count(*) = 3 AND count(DISTINCT fill) >= 2""")
def zebra_fills(v):
    rows = v.tables_.select("page", "id", "x0", "y0", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).withColumn("cy", F.col("y0") + (F.col("i") + 0.5) * 20.0)
    on = F.col("a.cy").between(F.col("b.y0"), F.col("b.y1")) & (F.abs(F.col("b.x0") - F.col("a.x0")) <= 160)
    m = J.pairs(rows, v.bands, on).groupBy("a.page", "a.id", "a.i").agg(F.min_by(F.col("b.fill"), F.struct("b.y0", "b.id")).alias("fill"))
    got = m.groupBy("page", "id").agg(F.array_sort(F.collect_list(F.struct("i", "fill"))).alias("f"), F.count_distinct("fill").alias("n"))
    return got.where("size(f) = 3 AND n >= 2").select("page", "id", F.array_join(F.transform("f", lambda x: x["fill"]), ",").alias("fills"))


@query("join_source_match", "JOIN-22", f"""
SELECT {_K}, b.id AS source_id FROM regions a JOIN blocks b ON a.page = b.page WHERE (abs(a.x0 - b.x0) <= 1 AND abs(a.y0 - b.y0) <= 1) OR {S.share("b", "a")} >= 0.45 OR (contains(a.label, left(b.text, 2)) AND b.text <> '' AND {S.share("b", "a")} >= 0.15) OR (a.id = b.id AND {S.share("b", "a")} >= 0.25)""")
def source_match(v):
    a, b = G.box("a"), G.box("b")
    s = G.share_of_first(b, a)
    on = ((F.abs(a.x0 - b.x0) <= 1) & (F.abs(a.y0 - b.y0) <= 1)) | (s >= 0.45) | (F.col("a.label").contains(F.left(F.col("b.text"), F.lit(2))) & (F.col("b.text") != "") & (s >= 0.15)) | ((F.col("a.id") == F.col("b.id")) & (s >= 0.25))
    return J.pairs(v.regions, v.blocks, on).select("a.page", "a.id", F.col("b.id").alias("source_id"))


@query("join_table_words", "JOIN-30 FLT-18", f"""
WITH t AS (SELECT a.page, a.id FROM tables_ a WHERE a.borderless OR NOT EXISTS (SELECT 1 FROM images b WHERE a.page = b.page AND {S.share("a", "b")} >= 0.2))
SELECT DISTINCT w.page, w.id, w.x0 - 1.5::DOUBLE AS x0, w.y1 + 1.5::DOUBLE AS y1 FROM words w JOIN tables_ b ON w.page = b.page AND {S.centre_in("w", "b")} WHERE (b.page, b.id) NOT IN (SELECT (page, id) FROM t)""")
def table_words(v):
    over = J.semi(v.tables_, v.images, lambda a, b: G.share_of_first(a, b) >= 0.2).where("NOT borderless")
    return J.semi(v.words, over, lambda a, b: G.centre_inside(a, b)).select("page", "id", (F.col("x0") - 1.5).alias("x0"), (F.col("y1") + 1.5).alias("y1"))


@query("join_cell_blocks", "JOIN-31", f"""
WITH c AS (SELECT *, table_id * 100 + row * 10 + col AS id FROM cells), m AS (SELECT {_K}, string_agg(b.text, ' ' ORDER BY b.id) AS texts, string_agg(b.id::VARCHAR, ',' ORDER BY b.id) AS ids FROM c a JOIN blocks b ON a.page = b.page AND ({S.share("a", "b")} >= 0.45 OR {S.share("b", "a")} >= 0.45) GROUP BY ALL)
SELECT page, c.id, CASE WHEN c.text = '' THEN coalesce(m.texts, '') ELSE c.text END AS text, m.ids FROM c LEFT JOIN m USING (page, id)""")
def cell_blocks(v):
    c = v.cells.withColumn("id", F.col("table_id") * 100 + F.col("row") * 10 + F.col("col"))
    met = J.pairs(c, v.blocks, lambda a, b: (G.share_of_first(a, b) >= 0.45) | (G.share_of_first(b, a) >= 0.45))
    m = met.groupBy("a.page", "a.id").agg(F.array_sort(F.collect_list(F.struct(F.col("b.id"), F.col("b.text")))).alias("m"))
    rows = c.join(m, ["page", "id"], "left")
    texts = F.array_join(F.transform("m", lambda x: x["text"]), " ")
    return rows.select("page", "id", F.when(F.col("text") == "", F.coalesce(texts, F.lit(""))).otherwise(F.col("text")).alias("text"), F.array_join(F.transform("m", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("join_erase_regions", "JOIN-33 FLT-16 FLT-17 FLT-06", f"""
SELECT a.page, a.id, 'shape' AS kind FROM shapes a WHERE a.fill IS NOT NULL AND a.opacity >= 0.99 AND {S.area("a")} / 518400.0 < 0.05 AND NOT EXISTS (SELECT 1 FROM images b WHERE a.page = b.page AND ({S.inter("a", "b")} / {S.area("b")} >= 0.25 OR {S.inter("a", "b")} / {S.area("a")} >= 0.25))
UNION ALL SELECT a.page, a.id, 'translucent' FROM shapes a WHERE a.fill IS NOT NULL AND a.opacity >= 0.02 AND a.opacity < 0.99
UNION ALL SELECT a.page, a.id, 'table' FROM tables_ a WHERE a.borderless OR NOT EXISTS (SELECT 1 FROM images b WHERE a.page = b.page AND {S.share("a", "b")} >= 0.2)""")
def erase_regions(v):
    def on_image(a, b):
        inter = G.intersection_area(a, b)
        return (inter / G.area(b) >= 0.25) | (inter / G.area(a) >= 0.25)

    filled = v.shapes.where("fill IS NOT NULL")
    opaque = filled.where((F.col("opacity") >= 0.99) & (G.area(G.box()) / 518400.0 < 0.05))
    kept = J.anti(opaque, v.images, on_image).select("page", "id", F.lit("shape").alias("kind"))
    clear = filled.where("opacity >= 0.02 AND opacity < 0.99").select("page", "id", F.lit("translucent").alias("kind"))
    free = J.anti(v.tables_.where("NOT borderless"), v.images, lambda a, b: G.share_of_first(a, b) >= 0.2).unionByName(v.tables_.where("borderless"))
    return kept.unionByName(clear).unionByName(free.select("page", "id", F.lit("table").alias("kind")))


@query("join_cards", "JOIN-35", f"""
SELECT {_K}, count(*) AS n_cards FROM tables_ a JOIN shapes b ON a.page = b.page AND b.fill IS NOT NULL AND b.x1 - b.x0 >= 80 AND b.y1 - b.y0 >= 80 AND {S.area("b")} >= 8000 AND {S.inter("a", "b")} > 0 GROUP BY ALL HAVING count(*) >= 2""")
def cards(v):
    met = J.pairs(v.tables_, v.shapes, lambda a, b: F.col("b.fill").isNotNull() & (b.w >= 80) & (b.h >= 80) & (G.area(b) >= 8000) & (G.intersection_area(a, b) > 0))
    return met.groupBy("a.page", "a.id").agg(F.count(F.lit(1)).alias("n_cards")).where("n_cards >= 2")


@query("join_plan", "JOIN-23 JOIN-36 AGG-15", """
WITH b AS (SELECT b.page, b.id, b.text, n.role, n.ord, n.conf, n.grp FROM blocks b JOIN annotations n USING (page, id) WHERE n.role NOT IN ('header', 'footer')),
g AS (SELECT page, grp, min(ord) AS ord, min(id) AS id, arg_max(role, row(CASE role WHEN 'title' THEN 3 WHEN 'list' THEN 2 ELSE 1 END, conf, id)) AS top, bool_and(role = 'title') AS all_title, count(*) AS n FROM b WHERE grp < 6 GROUP BY page, grp),
u AS (SELECT page, id, ord, CASE WHEN top = 'title' AND NOT all_title THEN 'body' ELSE top END AS role, n FROM g UNION ALL SELECT page, id, ord, role, 1 FROM b WHERE grp >= 6)
SELECT page, id, role, n, (row_number() OVER (PARTITION BY page ORDER BY ord, id) - 1)::INT AS reading_order FROM u""")
def plan(v):
    """Annotated blocks; members of a planned group become one; the rest stay; 0-based order."""
    b = v.blocks.select("page", "id", "text").join(v.annotations, ["page", "id"]).where("role NOT IN ('header', 'footer')")
    claimed = b.where("grp < 6")
    priority = F.when(F.col("role") == "title", 3).when(F.col("role") == "list", 2).otherwise(1)
    g = claimed.groupBy("page", "grp").agg(F.min("ord").alias("ord"), F.min("id").alias("first"), F.max_by("role", F.struct(priority, "conf", "id")).alias("top"), F.bool_and(F.col("role") == "title").alias("all_title"), F.count(F.lit(1)).alias("n"))
    merged = g.select("page", F.col("first").alias("id"), "ord", F.when((F.col("top") == "title") & ~F.col("all_title"), "body").otherwise(F.col("top")).alias("role"), "n")
    single = b.join(claimed.select("page", "id"), ["page", "id"], "left_anti").select("page", "id", "ord", "role", F.lit(1).cast("long").alias("n"))
    return J.ranked(merged.unionByName(single), ["page"], F.col("ord"), F.col("id")).select("page", "id", "role", "n", (F.col("rank") - 1).alias("reading_order"))


@query("join_preview", "JOIN-24 UI-06 UI-07 SRC-22", """
SELECT b.page, b.id, coalesce(e.role, n.role) AS role, coalesce(e.excluded, false) AS excluded, coalesce(e.raster, false) AS raster, bool_or(coalesce(e.role, n.role) = 'title') OVER (PARTITION BY b.page) AS has_title
FROM blocks b JOIN annotations n USING (page, id) LEFT JOIN edits e USING (page, id)""")
def preview(v):
    from pyspark.sql.window import Window

    rows = v.blocks.select("page", "id").join(v.annotations.select("page", "id", F.col("role").alias("planned")), ["page", "id"]).join(v.edits, ["page", "id"], "left")
    rows = rows.select("page", "id", F.coalesce("role", "planned").alias("role"), F.coalesce("excluded", F.lit(False)).alias("excluded"), F.coalesce("raster", F.lit(False)).alias("raster"))
    return rows.withColumn("has_title", F.bool_or(F.col("role") == "title").over(Window.partitionBy("page")))


@query("join_apply_edits", "JOIN-25 UI-05", """
WITH r AS (SELECT DISTINCT page FROM edits WHERE raster) SELECT page, id, coalesce(e.role, n.role) AS role, coalesce(e.role, n.role) = 'title' AS is_title FROM annotations n LEFT JOIN edits e USING (page, id) WHERE NOT coalesce(e.excluded, false) AND page NOT IN (SELECT page FROM r)""")
def apply_edits(v):
    """Excluded elements go, roles are overridden, raster pages lose their elements."""
    kept = v.annotations.select("page", "id", F.col("role").alias("planned")).join(v.edits.where("excluded").select("page", "id"), ["page", "id"], "left_anti")
    kept = kept.join(v.edits.where("raster").select("page").distinct(), "page", "left_anti")
    rows = kept.join(v.edits.select("page", "id", "role"), ["page", "id"], "left")
    return rows.select("page", "id", F.coalesce("role", "planned").alias("role"), (F.coalesce("role", "planned") == "title").alias("is_title"))


@query("join_resume", "JOIN-26 SRC-19 SRC-20 SRC-21 SORT-11", """
WITH p AS (SELECT id, path FROM files WHERE regexp_matches(path, '(?i)\\.pdf$') AND NOT regexp_matches(path, '(^|/)\\.')), d AS (SELECT path, min(id) AS id FROM p GROUP BY path), prev AS (SELECT path, arg_max(status, id) AS status FROM files WHERE cost IS NOT NULL GROUP BY path)
SELECT d.path, (row_number() OVER (ORDER BY d.path))::INT AS ord, CASE WHEN prev.status = 'ok' THEN 'kept' WHEN prev.status = 'skipped' THEN 'skipped' ELSE 'run' END AS action FROM d LEFT JOIN prev USING (path)""")
def resume(v):
    """Planned files against an earlier summary: what is kept, skipped and run, in plan order."""
    found = v.files.where(F.col("path").rlike("(?i)\\.pdf$") & ~F.col("path").rlike("(^|/)\\."))
    plan_ = found.select("path").distinct()
    prev = v.files.where("cost IS NOT NULL").groupBy("path").agg(F.max_by("status", "id").alias("status"))
    done = plan_.join(prev.where("status IN ('ok', 'skipped')"), "path").select("path", F.when(F.col("status") == "ok", "kept").otherwise("skipped").alias("action"))
    todo = plan_.join(done.select("path"), "path", "left_anti").withColumn("action", F.lit("run"))
    from pyspark.sql.window import Window

    # A plan is one row for each file of a batch; its order is global by definition.
    return done.unionByName(todo).withColumn("ord", F.row_number().over(Window.orderBy("path")))
