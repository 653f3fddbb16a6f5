"""Queries over bounding-box expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.functions import geometry as G
from lamella.functions.geometry import box
from lamella.sources.views import PAGE_H, PAGE_W

from . import sqltext as S
from .registry import query

_PAIRS = "a.page, a.id AS a_id, b.id AS b_id"
_JOIN = "FROM blocks a JOIN regions b ON a.page = b.page"


@query("geo_overlap_measures", "GEO-01 GEO-02 GEO-03 GEO-04 GEO-05 GEO-06 GEO-07 GEO-08 GEO-09 GEO-10", f"""
SELECT {_PAIRS}, {S.area("a")} AS area_a, {S.inter("a", "b")} AS inter, {S.share("a", "b")} AS share_a, {S.iou("a", "b")} AS iou, {S.coef("a", "b")} AS coef,
 CASE WHEN {S.inter("a", "b")} > 0 THEN greatest(a.x0, b.x0) END AS ix0, CASE WHEN {S.inter("a", "b")} > 0 THEN least(a.y1, b.y1) END AS iy1,
 least(a.x0, b.x0) AS ux0, greatest(a.y1, b.y1) AS uy1 {_JOIN}""")
def overlap_measures(v):
    a, b = box("a"), box("b")
    pairs = v.blocks.alias("a").join(v.regions.alias("b"), F.col("a.page") == F.col("b.page"))
    u, i = G.union_box(a, b), G.intersection(a, b)
    return pairs.select(
        "a.page", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), G.area(a).alias("area_a"), G.intersection_area(a, b).alias("inter"),
        G.share_of_first(a, b).alias("share_a"), G.iou(a, b).alias("iou"), G.overlap_coefficient(a, b).alias("coef"),
        i["x0"].alias("ix0"), i["y1"].alias("iy1"), u.x0.alias("ux0"), u.y1.alias("uy1"),
    )


@query("geo_pair_predicates", "GEO-18 GEO-19 GEO-20 GEO-28 GEO-29 UI-03", f"""
SELECT {_PAIRS}, greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS v_overlap, a.x1 > b.x0 AND b.x1 > a.x0 AS h_overlap,
 {S.centre_in("a", "b", 2.0)} AS centre_in, greatest(greatest(0.0, greatest(a.x0, b.x0) - least(a.x1, b.x1)), greatest(0.0, greatest(a.y0, b.y0) - least(a.y1, b.y1))) AS gap,
 a.x0 - 6 <= b.x1 AND b.x0 <= a.x1 + 6 AND a.y0 - 6 <= b.y1 AND b.y0 <= a.y1 + 6 AS near_6, a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AS touching {_JOIN}""")
def pair_predicates(v):
    a, b = box("a"), box("b")
    pairs = v.blocks.alias("a").join(v.regions.alias("b"), F.col("a.page") == F.col("b.page"))
    return pairs.select(
        "a.page", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), G.vertical_overlap(a, b).alias("v_overlap"), G.horizontal_overlap(a, b).alias("h_overlap"),
        G.centre_inside(a, b, 2.0).alias("centre_in"), G.gap(a, b).alias("gap"), G.near(a, b, 6.0).alias("near_6"), G.touching(a, b).alias("touching"),
    )


@query("geo_scaling", "GEO-11 GEO-12 GEO-16 GEO-17 GEO-24 GEO-25 GEO-26 GEO-27 GEO-30 GEO-31 UI-04", f"""
SELECT page, id, x0 * (1920.0::DOUBLE / 960.0) AS to_px_x0, y1 * (1080.0::DOUBLE / 540.0) AS to_px_y1, x0 * (960.0::DOUBLE / 1920.0) AS to_pt_x0,
 CAST(greatest(0, least(800, floor(x0 * 1.25::DOUBLE) - 2)) AS INT) AS px_x0, CAST(greatest(0, least(600, ceil(y1 * 1.25::DOUBLE) + 2)) AS INT) AS px_y1,
 y0 + 0.85::DOUBLE * greatest(font_size, 1.0) AS baseline, greatest(6.0, 0.75::DOUBLE * (y1 - y0)) AS font_guess, greatest(0.0, least(400.0, x1)) AS clamped_x1,
 CAST(floor(x0 * 12700 + 0.5::DOUBLE) AS BIGINT) AS emu_left, CAST(floor(greatest(0.0, y1 - y0) * 12700 + 0.5::DOUBLE) AS BIGINT) AS emu_height,
 CASE WHEN least(x1, 400.0) > greatest(x0, 0.0) AND least(y1, 300.0) > greatest(y0, 0.0) THEN CAST(trunc(least(x1, 400.0)) AS INT) END AS crop_x1,
 CAST(trunc(least(greatest(x1, 0.0), 400.0)) AS INT) AS safe_x1, greatest(0.0, least(x0, 956.0)) AS min_x0, greatest(4.0, x1 - x0) AS min_w FROM blocks""")
def scaling(v):
    b = box()
    px, inside = G.pixels(b, 1.25, 1.25, 2, 800, 600), G.clamped(b, 400.0, 300.0)
    cut = G.overlap_box(b, G.Box(*map(F.lit, (0.0, 0.0, 400.0, 300.0))))
    e = G.emu(b)
    return v.blocks.select(
        "page", "id", G.scaled(b, 1920.0 / PAGE_W, 2.0).x0.alias("to_px_x0"), G.scaled(b, 2.0, 1080.0 / PAGE_H).y1.alias("to_px_y1"), G.scaled(b, PAGE_W / 1920.0, 0.5).x0.alias("to_pt_x0"),
        px.x0.alias("px_x0"), px.y1.alias("px_y1"), G.baseline(b, F.col("font_size")).alias("baseline"), G.font_from_height(b).alias("font_guess"), inside.x1.alias("clamped_x1"),
        e[0].alias("emu_left"), e[3].alias("emu_height"), F.when((cut.w > 0) & (cut.h > 0), cut.x1.cast("int")).alias("crop_x1"), inside.x1.cast("int").alias("safe_x1"),
        F.greatest(F.lit(0.0), F.least(b.x0, F.lit(956.0))).alias("min_x0"), F.greatest(F.lit(4.0), b.w).alias("min_w"),
    )


_POINTS = "[{'x': x0, 'y': y0}, {'x': x1, 'y': y0}, {'x': x1, 'y': y0}, {'x': x1, 'y': y1}, {'x': CASE WHEN id % 2 = 0 THEN x0 + 1 ELSE x0 + 9 END, 'y': y0}]"


@query("geo_polygons", "GEO-13 GEO-14 GEO-15 GEO-32 GEO-33 GEO-34", f"""
WITH p AS (SELECT page, id, {_POINTS} AS pts FROM blocks)
SELECT page, id, list_min(list_transform(pts, lambda p: p.x)) AS bx0, list_max(list_transform(pts, lambda p: p.y)) AS by1, list_max(list_transform(pts, lambda p: p.x * 2)) AS scaled_x1,
 sqrt((pts[1].x - pts[5].x) * (pts[1].x - pts[5].x) + (pts[1].y - pts[5].y) * (pts[1].y - pts[5].y)) <= 1.5 AS closed,
 4 AS n_stepwise, CASE WHEN id % 2 = 0 THEN 3 ELSE 4 END AS n_distinct FROM p""")
def polygons(v):
    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    b = box()
    pts = F.array(point(b.x0, b.y0), point(b.x1, b.y0), point(b.x1, b.y0), point(b.x1, b.y1), point(b.x0 + F.when(F.col("id") % 2 == 0, 1.0).otherwise(9.0), b.y0))
    p = v.blocks.select("page", "id", pts.alias("pts"))
    around = G.polygon_box(F.col("pts"))
    larger = G.polygon_box(F.transform("pts", lambda q: F.struct((q["x"] * 2).alias("x"), (q["y"] * 2).alias("y"))))
    return p.select(
        "page", "id", around.x0.alias("bx0"), around.y1.alias("by1"), larger.x1.alias("scaled_x1"), G.closed_loop(F.col("pts")).alias("closed"),
        F.size(G.without_repeats(F.col("pts"))).alias("n_stepwise"), F.size(G.distinct_points(F.col("pts"), 2.0)).alias("n_distinct"),
    )


@query("geo_cell_boxes", "GEO-21 GEO-22", """
SELECT page, id, c AS col, x0 + (x1 - x0) * (CASE c WHEN 0 THEN 0 WHEN 1 THEN 40 WHEN 2 THEN 60 ELSE 90 END)::DOUBLE / 120.0 AS cell_x0,
 x0 + (x1 - x0) * (CASE c WHEN 0 THEN 40 WHEN 1 THEN 60 WHEN 2 THEN 90 ELSE 120 END)::DOUBLE / 120.0 AS cell_x1
FROM tables_, (SELECT unnest(range(4))::INT AS c)""")
def cell_boxes(v):
    widths = F.array(*map(F.lit, (40.0, 20.0, 30.0, 30.0)))
    b = box()
    edges = G.prefix_sums(widths)
    t = v.tables_.select("page", "id", "x0", "y0", "x1", "y1", edges.alias("e"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("col"))
    total = F.element_at("e", -1)
    return t.select("page", "id", "col", (b.x0 + b.w * F.element_at("e", F.col("col") + 1) / total).alias("cell_x0"), (b.x0 + b.w * F.element_at("e", F.col("col") + 2) / total).alias("cell_x1"))


@query("geo_line_boxes", "GEO-23", """
SELECT page, id, i::INT AS line, y0 + (y1 - y0) * i / n AS ly0, y0 + (y1 - y0) * (i + 1) / n AS ly1 FROM (SELECT page, id, y0, y1, n, unnest(range(n))::INT AS i FROM (SELECT *, (id % 3 + 1)::INT AS n FROM blocks))""")
def line_boxes(v):
    lines = G.line_boxes(box(), (F.col("id") % 3 + 1).cast("int"))
    return v.blocks.select("page", "id", F.posexplode(lines).alias("line", "l")).select("page", "id", "line", F.col("l.y0").alias("ly0"), F.col("l.y1").alias("ly1"))


@query("geo_arrow_direction", "GEO-35", """
WITH n AS (SELECT page, id, x1 - x0 >= y1 - y0 AS wide, (x1 - x0) * 0.08::DOUBLE AS bx, (y1 - y0) * 0.08::DOUBLE AS by_,
 [{'x': x0, 'y': (y0 + y1) / 2}, {'x': x0, 'y': y0}, {'x': CASE WHEN id % 2 = 0 THEN x0 ELSE x1 END, 'y': y1}, {'x': x1, 'y': CASE WHEN id % 3 = 0 THEN y0 ELSE y1 END}] AS pts, x0, y0, x1, y1 FROM shapes),
c AS (SELECT *, len(list_filter(pts, lambda p: CASE WHEN wide THEN p.x <= x0 + bx ELSE p.y <= y0 + by_ END)) AS near_n, len(list_filter(pts, lambda p: CASE WHEN wide THEN p.x >= x1 - bx ELSE p.y >= y1 - by_ END)) AS far_n FROM n)
SELECT page, id, CASE WHEN wide THEN (CASE WHEN near_n < far_n THEN 'left' ELSE 'right' END) ELSE (CASE WHEN near_n < far_n THEN 'up' ELSE 'down' END) END AS direction FROM c""")
def arrow_direction(v):
    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    b, i = box(), F.col("id")
    pts = F.array(point(b.x0, b.cy), point(b.x0, b.y0), point(F.when(i % 2 == 0, b.x0).otherwise(b.x1), b.y1), point(b.x1, F.when(i % 3 == 0, b.y0).otherwise(b.y1)))
    wide = b.w >= b.h
    low = F.size(F.filter(pts, lambda p: F.when(wide, p["x"] <= b.x0 + b.w * 0.08).otherwise(p["y"] <= b.y0 + b.h * 0.08)))
    high = F.size(F.filter(pts, lambda p: F.when(wide, p["x"] >= b.x1 - b.w * 0.08).otherwise(p["y"] >= b.y1 - b.h * 0.08)))
    tip = F.when(wide, F.when(low < high, "left").otherwise("right")).otherwise(F.when(low < high, "up").otherwise("down"))
    return v.shapes.select("page", "id", tip.alias("direction"))


_RATIOS = ", ".join(f"({i}, '{n}', {r!r}::DOUBLE)" for i, (n, r) in enumerate(G.ASPECTS))


@query("geo_aspect", "GEO-36 GEO-37", f"""
WITH r(i, label, ratio) AS (VALUES {_RATIOS}),
best AS (SELECT s.id, arg_min(label, row(round(abs(ln((s.x1 - s.x0) / (s.y1 - s.y0) / r.ratio)), 9), i)) AS label FROM images s, r GROUP BY s.id)
SELECT s.page, s.id, b.label AS aspect, CAST(CASE WHEN (x1 - x0) / (y1 - y0) > 1.5 THEN x1 - x0 ELSE ceil((y1 - y0) * 1.5) END AS BIGINT) AS pad_w,
 CAST(CASE WHEN (x1 - x0) / (y1 - y0) > 1.5 THEN ceil((x1 - x0) / 1.5) ELSE y1 - y0 END AS BIGINT) AS pad_h FROM images s JOIN best b USING (id)""")
def aspect(v):
    b = box()
    pad = G.aspect_pad(b.w, b.h, F.lit(1.5))
    return v.images.select("page", "id", G.closest_aspect(b.w, b.h).alias("aspect"), pad[2].alias("pad_w"), pad[3].alias("pad_h"))
