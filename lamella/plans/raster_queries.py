"""Queries over page rasters.

The sample rasters are 96 by 54 pixels, made from a page's number and blocks
by integer arithmetic, so that errors, masks, rings, ink and fills can be
checked by SQL, pixel by pixel; the other kernels are tested one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from lamella.operators import engines as E
from lamella.operators import pages as P
from lamella.operators import raster as I
from lamella.sources import slides as D

from .registry import query

W, H = 96, 54


def noise(page: int) -> np.ndarray:
    y, x, c = np.indices((H, W, 3))
    return ((x * 3 + y * 5 + page * 7 + c * 11) % 256).astype(np.uint8)


def disturbed(image: np.ndarray, page: int) -> np.ndarray:
    y, x = np.indices((H, W))
    return ((image.astype(int) + ((x * y + page) % 5)[..., None]) % 256).astype(np.uint8)


def slide(page: int, boxes: list[tuple]) -> np.ndarray:
    """A soft gradient with strokes of text in the boxes and a ruled frame."""
    y, x = np.indices((H, W))
    image = np.stack([200 + x // 8, 205 + y // 8, np.full((H, W), 210 + page % 20)], axis=2).astype(np.uint8)
    for x0, y0, x1, y1 in boxes:
        image[y0 : y1 + 1 : 2, x0 : x1 + 1] = 30
    image[[2, H - 3], 2 : W - 2] = 90
    image[2 : H - 2, [2, W - 3]] = 90
    return image


def _rasters(v, work, schema):
    """work(page, pixel boxes by id) for each page; a frame for each block of pages, as one for each page takes as long as some kernels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "id"])
        pages, b = pdf["page"].to_numpy(), np.floor(P.boxes(pdf) / 10).astype(int)
        cuts = np.flatnonzero(np.r_[True, pages[1:] != pages[:-1], True]).tolist()
        return pd.DataFrame([{**work(int(pages[i]), [tuple(r) for r in b[i:j].tolist()]), "page": int(pages[i])} for i, j in zip(cuts, cuts[1:])])

    return P.by_block(v.blocks.select("page", "id", *P.BOX), run, schema)


@query("raster_errors", "RAS-02 RAS-03 RAS-10 RAS-19 RAS-28 RAS-33 AGG-26 AGG-31", """
WITH px AS (SELECT page, x, y, c, (x * 3 + y * 5 + page * 7 + c * 11) % 256 AS a FROM pages_, (SELECT unnest(range(96)) AS x), (SELECT unnest(range(54)) AS y), (SELECT unnest(range(3)) AS c)), q AS (SELECT *, (a + (x * y + page) % 5) % 256 AS b FROM px),
r AS (SELECT page, floor(x0 / 10) AS x0, floor(y0 / 10) AS y0, floor(x1 / 10) AS x1, floor(y1 / 10) AS y1 FROM blocks), p AS (SELECT page, x, y FROM pages_, (SELECT unnest(range(96)) AS x), (SELECT unnest(range(54)) AS y)), m AS (SELECT DISTINCT p.page, p.x, p.y FROM p JOIN r ON p.page = r.page AND p.x BETWEEN r.x0 AND r.x1 AND p.y BETWEEN r.y0 AND r.y1),
j AS (SELECT q.*, m.page IS NOT NULL AS masked, abs(a - b) AS d FROM q LEFT JOIN m ON q.page = m.page AND q.x = m.x AND q.y = m.y), o AS (SELECT page, x, y, max(d) AS d FROM j WHERE NOT masked GROUP BY ALL), og AS (SELECT page, count(*) FILTER (WHERE d > 0) AS changed, max(d) AS most FROM o GROUP BY page),
k AS (SELECT page, list_sort(list(a) FILTER (WHERE c = 0 AND ((x = 1 OR x = 94) AND (y = 1 OR y = 52))))[3] AS corner FROM q GROUP BY page)
SELECT j.page, round(avg(d), 4) AS mae, round(avg(d * d), 4) AS mse, round(avg(d) FILTER (WHERE masked), 4) AS masked_mae, round(count(*) FILTER (WHERE masked)::DOUBLE / count(*), 6) AS mask_share, coalesce(min(most), 0)::INT AS most, coalesce(min(changed), 0)::INT AS changed, min(corner)::INT AS corner, true AS white_kept FROM j LEFT JOIN og USING (page) JOIN k USING (page) GROUP BY j.page""")
def raster_errors(v):
    def work(page, boxes):
        a = noise(page)
        b, m = disturbed(a, page), I.box_mask(boxes, (H, W))
        e, o = I.pixel_error(a, b), I.outside_changes(a, b, m)
        return {"mae": e["mae"], "mse": e["mse"], "masked_mae": I.masked_mae(a, b, m), "mask_share": round(float(m.mean()), 6), "most": o["most"], "changed": o["changed"], "corner": I.corner_colour(a)[0], "white_kept": I.unchanged_outside(a, I.white_boxes(a, m), m)}

    return _rasters(v, work, "mae double, mse double, masked_mae double, mask_share double, most int, changed int, corner int, white_kept boolean")


@query("raster_fidelity", "RAS-01 RAS-04 RAS-05 RAS-06 RAS-07 RAS-37")
def raster_fidelity(v):
    """A page against itself with its text moved by a pixel."""

    def work(page, boxes):
        a, b, ground = slide(page, boxes), slide(page, [(x0 + 1, y0, x1 + 1, y1) for x0, y0, x1, y1 in boxes]), slide(page, [])
        first = boxes[0]
        return {"ssim": I.ssim(a, b), "rim": I.seam_mae(a, b, I.box_mask(boxes, (H, W)), 1), **I.edge_scores(a, b), "local_ssim": I.region_ssim(a, b, first), "local_mae": I.region_mae(a, b, first), **I.region_metrics(ground, a, boxes, 1, 1)}

    return _rasters(v, work, "ssim double, rim double, edge_precision double, edge_recall double, edge_f1 double, local_ssim double, local_mae double, region_mae double, rim_mae double")


@query("raster_ink", "RAS-08 RAS-09 RAS-34 RAS-35 AGG-27")
def raster_ink(v):
    """Ink bands and extent of a page's first block, its colour and weight."""

    def work(page, boxes):
        x0, y0, x1, y1 = boxes[0]
        image = slide(page, boxes[:1])
        area = (max(0, x0 - 2), max(0, y0 - 2), min(W, x1 + 3), min(H, y1 + 3))
        part = I.crop(image, area)
        m = I.foreground(I.gray(part))
        return {"rows": I.ink_rows(image, area), "extent": list(I.ink_extent(image, area) or ()), "colour": I.text_colour(part, m), "bold": I.is_bold(m, "latin")}

    return _rasters(v, work, "rows array<double>, extent array<int>, colour string, bold boolean")


@query("raster_masks", "RAS-11 RAS-12 RAS-39 RAS-40")
def raster_masks(v):
    """Masks of text, grown by line height, less the rules that run through it."""

    def work(page, boxes):
        image = slide(page, boxes)
        plain = I.box_mask(boxes, (H, W))
        horizontal, vertical = I.line_masks(image)
        refined = I.refined_text_mask(image, boxes, 1)
        lines = I.lines_off_text(I.grid_lines(horizontal, vertical), plain)
        return {"plain": int(plain.sum()), "refined": int(refined.sum()), "grown": int(I.dilated_by_height(plain, boxes, most=3, least=1).sum()), "rules": int((horizontal | vertical).sum()), "kept_rules": int(lines.sum())}

    return _rasters(v, work, "plain int, refined int, grown int, rules int, kept_rules int")


@query("raster_grounds", "RAS-13 RAS-14 RAS-16 RAS-17 RAS-25 RAS-27 RAS-29 RAS-30 RAS-36 AGG-18")
def raster_grounds(v):
    """What a page's text stands on: complexity, flatness, fitted surface, fills."""

    def work(page, boxes):
        image, m = slide(page, boxes[:3]), I.box_mask(boxes[:3], (H, W))
        ground = slide(page, [])
        fit = I.surface(image, I.ring(m, 3) & ~m)
        wiped = I.erased(image, [tuple(10 * c for c in b) for b in boxes[:3]], (960.0, 540.0), (255, 255, 255))
        return {
            "complexity": I.complexity(image, m), "flat": I.flat_share(image, m), "residual": round(fit[1], 6) if fit else None, "groups": len(set(I.span_groups(np.array(boxes, float)).tolist())),
            "wiped_mae": I.masked_mae(ground, wiped, m), "ring": "#%02X%02X%02X" % (I.ring_median(image, boxes[0]) or (0, 0, 0)), "texture": round(I.ring_texture(image, m), 6), "low": round(I.low_frequency_mae(image, ground, m), 6), "fill": I.cell_fill(image, (20, 10, 60, 40), boxes[:3]),
        }

    return _rasters(v, work, "complexity double, flat double, residual double, groups int, wiped_mae double, ring string, texture double, low double, fill string")


@query("raster_repairs", "RAS-15 RAS-18 RAS-22 RAS-23 RAS-24 RAS-26 RAS-32 RAS-38 AGG-32 UDF-02 UDF-08")
def raster_repairs(v):
    """A page's text taken away by each engine, and how well."""

    def work(page, boxes):
        few = boxes[:3]
        image, ground, m = slide(page, few), slide(page, []), I.dilated(I.box_mask(few, (H, W)), 1)
        fixed, patched = I.inpainted(image, m), I.inpainted_by_patches(image, m, I.diffused)
        mixed = I.composited(image, fixed, m)
        over, engine = I.overlay_background(image, few)
        tint = [((200.0, 100.0, 500.0, 300.0), (255, 0, 0), 0.5)]
        tinted = ground.astype(float)
        tinted[10:30, 20:50] = 0.5 * tinted[10:30, 20:50] + 0.5 * np.array([255, 0, 0])
        check = I.residual_checker(lambda i: few)
        return {
            "fixed_mae": I.masked_mae(ground, fixed, m), "patched_mae": I.masked_mae(ground, patched, m), "kept": I.unchanged_outside(image, patched, m) and I.unchanged_outside(image, mixed, m), "alpha": round(float(I.feather(m).mean()), 6),
            "engine": engine, "seam": I.seam_roughness(fixed, m), "untinted_mae": I.pixel_error(ground, I.uncomposited(np.round(tinted).astype(np.uint8), tint, (960.0, 540.0)))["mae"], "still_read": check(fixed, m),
        }

    return _rasters(v, work, "fixed_mae double, patched_mae double, kept boolean, alpha double, engine string, seam double, untinted_mae double, still_read boolean")


#: Pieces of check SQL: pixels and channels of noise and what is disturbed, boxes in pixels, and the pixels of boxes.
_GRID = "xy AS (SELECT page, x, y FROM pages_, (SELECT unnest(range(96)) AS x), (SELECT unnest(range(54)) AS y))"
_NOISE = f"{_GRID}, q AS (SELECT *, abs(a - b) AS d FROM (SELECT *, (a + (x * y + page) % 5) % 256 AS b FROM (SELECT page, x, y, c, (x * 3 + y * 5 + page * 7 + c * 11) % 256 AS a FROM xy, (SELECT unnest(range(3)) AS c))))"
_BOXES = "r AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY id) AS n, floor(x0 / 10)::INT AS x0, floor(y0 / 10)::INT AS y0, floor(x1 / 10)::INT AS x1, floor(y1 / 10)::INT AS y1 FROM blocks)"


def _in_boxes(pad: int, where: str = "true") -> str:
    return f"SELECT DISTINCT xy.page, xy.x, xy.y FROM xy JOIN r ON xy.page = r.page AND xy.x BETWEEN r.x0 - {pad} AND r.x1 + {pad} AND xy.y BETWEEN r.y0 - {pad} AND r.y1 + {pad} WHERE {where}"


def _rim(mask: str, px: int) -> str:
    """Pixels of a mask with one outside it within px; all of the mask, if there is none."""
    off = f"(SELECT unnest(range(-{px}, {px} + 1)) AS dx), (SELECT unnest(range(-{px}, {px} + 1)) AS dy)"
    return f"SELECT DISTINCT m.page, m.x, m.y FROM (SELECT *, x + dx AS ox, y + dy AS oy FROM {mask}, {off}) m JOIN (SELECT * FROM xy EXCEPT SELECT * FROM {mask}) o ON o.page = m.page AND o.x = ox AND o.y = oy"


@query("raster_regions", "RAS-04 RAS-07 RAS-37", f"""
WITH {_NOISE}, {_BOXES}, m0 AS ({_in_boxes(0)}), m1 AS ({_in_boxes(1)}), e0 AS ({_rim("m0", 2)}), e1 AS ({_rim("m1", 2)}), s AS (SELECT page, round_even(avg(d), 4) AS seam FROM q JOIN e0 USING (page, x, y) GROUP BY page),
g AS (SELECT page, round_even(avg(d), 4) AS region_mae FROM q JOIN m1 USING (page, x, y) GROUP BY page), k AS (SELECT page, round_even(avg(d), 4) AS rim_mae FROM q JOIN e1 USING (page, x, y) GROUP BY page),
l AS (SELECT q.page, round_even(avg(d), 4) AS local_mae FROM q JOIN r ON q.page = r.page AND n = 1 AND x >= x0 AND x < x1 + 2 AND y >= y0 AND y < y1 + 2 WHERE x1 - x0 >= 2 AND y1 - y0 >= 2 GROUP BY q.page) SELECT page, seam, local_mae, region_mae, rim_mae FROM pages_ LEFT JOIN s USING (page) LEFT JOIN l USING (page) LEFT JOIN g USING (page) LEFT JOIN k USING (page)""")
def raster_regions(v):
    """Errors in a region, in all text regions, and on the inner rims of their masks."""

    def work(page, boxes):
        a = noise(page)
        b = disturbed(a, page)
        x0, y0, x1, y1 = boxes[0]
        return {"seam": I.seam_mae(a, b, I.box_mask(boxes, (H, W)), 2), "local_mae": I.region_mae(a, b, (x0, y0, x1 + 2, y1 + 2)), **I.region_metrics(a, b, boxes, 1, 2)}

    return _rasters(v, work, "seam double, local_mae double, region_mae double, rim_mae double")


@query("raster_readings", "RAS-26 RAS-32 UDF-08", f"""
WITH {_NOISE}, {_BOXES}, m AS ({_in_boxes(0)}), few AS ({_in_boxes(0, "n <= 3")}), s AS (SELECT page, count(*) AS n FROM m GROUP BY page), f AS (SELECT page, count(*) AS n FROM few GROUP BY page),
u AS (SELECT page, round_even(avg(CASE WHEN x BETWEEN 20 AND 49 AND y BETWEEN 10 AND 24 THEN abs(a - greatest(0, least(255, 2 * ((a + t) // 2) - t))) ELSE 0 END), 4) AS untinted FROM (SELECT *, CASE c WHEN 0 THEN 255 WHEN 1 THEN 40 ELSE 0 END AS t FROM q) GROUP BY page)
SELECT page, round_even(f.n::DOUBLE / s.n, 6) AS still_share, f.n::DOUBLE / s.n > 0.3 AS still_read, untinted FROM s JOIN f USING (page) JOIN u USING (page)""")
def raster_readings(v):
    """How much of a mask is still read, and a translucent fill taken off a page."""
    colour = np.array([255, 40, 0])

    def work(page, boxes):
        a, m = noise(page), I.box_mask(boxes, (H, W))
        tinted = a.copy()
        tinted[10:25, 20:50] = (a[10:25, 20:50].astype(int) + colour) // 2
        back = I.uncomposited(tinted, [((20.0, 10.0, 50.0, 25.0), tuple(colour), 0.5)], (float(W), float(H)))
        check = I.residual_checker(lambda i: boxes[:3], 0.3)
        return {"still_share": round(I.residual_share(m, boxes[:3]), 6), "still_read": check(a, m), "untinted": I.pixel_error(a, back)["mae"]}

    return _rasters(v, work, "still_share double, still_read boolean, untinted double")


@query("raster_rings", "RAS-25 RAS-27", f"""
WITH {_NOISE}, {_BOXES}, o AS (SELECT page, n, greatest(0, x0 - 1) AS x0, greatest(0, y0 - 1) AS y0, least(96, x1 + 1) AS x1, least(54, y1 + 1) AS y1 FROM r WHERE n <= 3),
c AS (SELECT o.page, n, c, floor(median(a)) AS v FROM q JOIN o ON q.page = o.page AND x >= x0 - 3 AND x < x1 + 3 AND y >= y0 - 3 AND y < y1 + 3 AND NOT (x >= x0 AND x < x1 AND y >= y0 AND y < y1) GROUP BY ALL),
w AS (SELECT q.page, q.x, q.y, q.c, max(n) AS n FROM q JOIN o ON q.page = o.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL), e AS (SELECT q.page, round_even(avg(coalesce(v, a)), 4) AS mean FROM q LEFT JOIN w USING (page, x, y, c) LEFT JOIN c ON c.page = q.page AND c.n = w.n AND c.c = q.c GROUP BY q.page)
SELECT page, max(v) FILTER (WHERE c = 0)::INT AS ring_r, max(v) FILTER (WHERE c = 1)::INT AS ring_g, max(v) FILTER (WHERE c = 2)::INT AS ring_b, min(mean) AS mean FROM c JOIN e USING (page) WHERE n = 1 GROUP BY page""")
def raster_rings(v):
    """Colours around a page's first boxes, taken before any is painted over with its own."""

    def work(page, boxes):
        a = noise(page)
        page_size, regions = (float(W), float(H)), [tuple(map(float, b)) for b in boxes[:3]]
        r, g, b = I.ring_median(a, I.pixel_box(regions[0], 1.0, 1.0, 1, (H, W)))
        return {"ring_r": r, "ring_g": g, "ring_b": b, "mean": round(float(I.erased(a, regions, page_size, (255, 255, 255)).mean()), 4)}

    return _rasters(v, work, "ring_r int, ring_g int, ring_b int, mean double")


_SLIDE = f"{_GRID}, {_BOXES}, i AS (SELECT xy.*, CASE WHEN frame THEN 90 WHEN stroke THEN 30 ELSE 200 + x // 8 END AS r, CASE WHEN frame THEN 90 WHEN stroke THEN 30 ELSE 205 + y // 8 END AS g, CASE WHEN frame THEN 90 WHEN stroke THEN 30 ELSE 210 + page % 20 END AS b FROM (SELECT xy.*, (y IN (2, 51) AND x BETWEEN 2 AND 93) OR (x IN (2, 93) AND y BETWEEN 2 AND 50) AS frame, coalesce(x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND (y - y0) % 2 = 0, false) AS stroke FROM xy LEFT JOIN r ON xy.page = r.page AND n = 1) xy)"


@query("raster_ink_rows", "RAS-08 RAS-09", f"""
WITH {_SLIDE}, k AS (SELECT i.page, x, y, y0, abs(l - median(l) OVER (PARTITION BY i.page)) > 24 AS ink FROM (SELECT i.page, x, y, x0, y0, x1, y1, floor(0.299 * i.r + 0.587 * i.g + 0.114 * i.b + 0.5) AS l FROM i JOIN r ON i.page = r.page AND n = 1 AND x >= x0 - 2 AND x < x1 + 3 AND y >= y0 - 2 AND y < y1 + 3) i),
d AS (SELECT *, avg(density) OVER (PARTITION BY page) AS mean FROM (SELECT page, y, avg(ink::INT) AS density FROM k GROUP BY ALL)), t AS (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS run FROM d WHERE density > greatest(0.02, 0.5 * mean)), u AS (SELECT page, (min(y) + max(y)) / 2.0 AS centre FROM t GROUP BY page, run),
c AS (SELECT page, count(*) AS n_rows, min(centre)::DOUBLE AS first_row, max(centre)::DOUBLE AS last_row FROM u GROUP BY page) SELECT page, n_rows::INT AS n_rows, first_row, last_row, min(x)::INT AS x0, min(y)::INT AS y0, max(x)::INT + 1 AS x1, max(y)::INT + 1 AS y1 FROM k JOIN c USING (page) WHERE ink GROUP BY ALL""")
def raster_ink_rows(v):
    """Centres of the bands of rows with ink around a page's first block, and the box of its ink."""

    def work(page, boxes):
        x0, y0, x1, y1 = boxes[0]
        image, area = slide(page, boxes[:1]), (max(0, x0 - 2), max(0, y0 - 2), min(W, x1 + 3), min(H, y1 + 3))
        rows, extent = I.ink_rows(image, area), I.ink_extent(image, area)
        return {"n_rows": len(rows), "first_row": rows[0], "last_row": rows[-1], **dict(zip(P.BOX, extent))}

    return _rasters(v, work, "n_rows int, first_row double, last_row double, x0 int, y0 int, x1 int, y1 int")


@query("raster_cell_fills", "AGG-18 RAS-36", f"""
WITH {_SLIDE.replace("AND n = 1) xy)", "AND n = 0) xy)")}, w AS ({_in_boxes(1, "n <= 3")}), s AS (SELECT i.page, i.r, i.g, i.b, (i.r // 16) * 65536 + (i.g // 16) * 256 + i.b // 16 AS q FROM i LEFT JOIN w USING (page, x, y) WHERE i.x BETWEEN 20 AND 59 AND i.y BETWEEN 10 AND 39 AND w.page IS NULL),
n AS (SELECT page, q, count(*) AS n, sum(count(*)) OVER (PARTITION BY page) AS all_, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, q) AS place FROM s GROUP BY page, q), m AS (SELECT * FROM n WHERE place = 1)
SELECT s.page, printf('#%02X%02X%02X', floor(median(r))::INT, floor(median(g))::INT, floor(median(b))::INT) AS fill FROM s JOIN m ON s.page = m.page AND (s.q = m.q OR m.n < 0.6 * m.all_) GROUP BY s.page""")
def raster_cell_fills(v):
    """Fill of a cell: the median of its most frequent shade, if that has the share, else of all its pixels off words."""
    return _rasters(v, lambda page, boxes: {"fill": I.cell_fill(slide(page, []), (20, 10, 60, 40), boxes[:3])}, "fill string")


@query("sink_debug_images", "SNK-12", f"""
WITH {_NOISE}, {_BOXES}, m AS ({_in_boxes(0)}) SELECT page, sum(a)::BIGINT AS page_sum, (255 * count(m.page) FILTER (WHERE c = 0))::BIGINT AS mask_sum, sum(CASE WHEN m.page IS NULL THEN a ELSE 255 END)::BIGINT AS masked_sum FROM q LEFT JOIN m USING (page, x, y) GROUP BY page""")
def debug_images(v):
    """The debug images of a page as files, and the sums of the pixels read from them."""

    def work(page, boxes):
        files = D.debug_artifacts(noise(page), I.box_mask(boxes, (H, W)))
        return {f"{k}_sum": int(D.pixels_of(data).sum()) for k, data in files.items()}

    return _rasters(v, work, "page_sum long, mask_sum long, masked_sum long")


class _Flat:
    """A stand-in for a service: the mask in one colour, at a price by its size."""

    def edit(self, request: E.Edit) -> E.Edited:
        return E.Edited(np.where(request.mask[..., None], np.uint8(100), request.image), float(request.mask.sum()) / 4096)


@query("raster_engines", "UDF-02 UDF-03 STATE-18", f"""
WITH {_NOISE}, {_BOXES}, m AS ({_in_boxes(0)}), n AS (SELECT page, count(*) AS n FROM m GROUP BY page), s AS (SELECT page, n, n > 2048 AS refused FROM n)
SELECT page, CASE WHEN refused THEN 0 ELSE n::DOUBLE / 4096 END AS spent, refused::INT AS refused, round_even(avg(CASE WHEN m.page IS NULL OR refused THEN 0 ELSE abs(a - 100) END), 4) AS moved FROM q JOIN s USING (page) LEFT JOIN m USING (page, x, y) GROUP BY page, n, refused""")
def raster_engines(v):
    """A service's edits within a budget that a page with much text would overrun, kept to the mask."""

    def work(page, boxes):
        a, m = noise(page), I.box_mask(boxes, (H, W))
        engine = E.ServiceEngine(_Flat(), 0.5, float(m.sum()) / 4096)
        made = engine.repair(a, m)
        return {"spent": engine.spent, "refused": engine.refused, "moved": I.pixel_error(a, np.where(m[..., None], made, a))["mae"]}

    return _rasters(v, work, "spent double, refused int, moved double")


def _kernel(sigma: float, radius: int) -> str:
    return f"(SELECT d, exp(-(d * d) / {2 * sigma * sigma}) / (SELECT sum(exp(-(d * d) / {2 * sigma * sigma})) FROM (SELECT unnest(range(-{radius}, {radius} + 1)) AS d)) AS k FROM (SELECT unnest(range(-{radius}, {radius} + 1)) AS d))"


def _blurred(rows: str, by: str, values: list[str], sigma: float, radius: int, w: int, h: int) -> str:
    """SQL of values blurred along y and then x; at the borders rows (by, x, y) are mirrored."""
    fold = lambda at, n: f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} > {n - 1} THEN {2 * n - 2} - ({at}) ELSE {at} END"
    down = ", ".join(f"sum(k * s.{v}) AS {v}" for v in values)
    tall = f"(SELECT t.page, {by}t.x, t.y, {down} FROM (SELECT page, {by}x, y, k, {fold('y + d', h)} AS yy FROM {rows}, {_kernel(sigma, radius)}) t JOIN {rows} s USING (page, {by}x) WHERE s.y = yy GROUP BY ALL)"
    return f"SELECT t.page, {by}t.y, t.x, {down} FROM (SELECT page, {by}x, y, k, {fold('x + d', w)} AS xx FROM {rows}, {_kernel(sigma, radius)}) t JOIN tall s USING (page, {by}y) WHERE s.x = xx GROUP BY ALL".replace("JOIN tall s", f"JOIN {tall} s")


_LUMA = f"{_NOISE}, l AS (SELECT page, x, y, floor(0.299 * sum(a) FILTER (WHERE c = 0) + 0.587 * sum(a) FILTER (WHERE c = 1) + 0.114 * sum(a) FILTER (WHERE c = 2) + 0.5) AS u, floor(0.299 * sum(b) FILTER (WHERE c = 0) + 0.587 * sum(b) FILTER (WHERE c = 1) + 0.114 * sum(b) FILTER (WHERE c = 2) + 0.5) AS v FROM q GROUP BY ALL)"
_SSIM = "avg((2 * u * v + 6.5025) * (2 * (uv - u * v) + 58.5225) / ((u * u + v * v + 6.5025) * (uu - u * u + vv - v * v + 58.5225)))"


@query("raster_ssim", "RAS-01 RAS-06", f"""
WITH {_LUMA}, whole AS MATERIALIZED (SELECT page, x, y, u, v, u * u AS uu, v * v AS vv, u * v AS uv FROM l), part AS MATERIALIZED (SELECT page, x - 20 AS x, y - 10 AS y, u, v, uu, vv, uv FROM whole WHERE x BETWEEN 20 AND 59 AND y BETWEEN 10 AND 39),
a AS ({_blurred("whole", "", ["u", "v", "uu", "vv", "uv"], 1.5, 5, 96, 54)}), b AS ({_blurred("part", "", ["u", "v", "uu", "vv", "uv"], 1.5, 5, 40, 30)}), c AS (SELECT page, round({_SSIM}, 6) AS ssim FROM a GROUP BY page), d AS (SELECT page, round({_SSIM}, 6) AS local_ssim FROM b GROUP BY page) SELECT page, ssim, local_ssim FROM c JOIN d USING (page)""")
def raster_ssim(v):
    """Structural similarity of two rasters, and of a region of theirs."""

    def work(page, boxes):
        a = noise(page)
        b = disturbed(a, page)
        return {"ssim": I.ssim(a, b), "local_ssim": I.region_ssim(a, b, (20, 10, 60, 40))}

    return _rasters(v, work, "ssim double, local_ssim double")


@query("raster_blurs", "RAS-29 RAS-30", f"""
WITH {_LUMA}, {_BOXES}, m AS MATERIALIZED ({_in_boxes(0, "n <= 3")}), o AS MATERIALIZED ({_in_boxes(4, "n <= 3")}), e AS MATERIALIZED (SELECT page, x, y, c, (a - b)::DOUBLE AS z FROM q), f AS ({_blurred("e", "c, ", ["z"], 2.0, 6, 96, 54)}), w AS MATERIALIZED (SELECT page, x, y, u FROM l), g AS ({_blurred("w", "", ["u"], 3.0, 9, 96, 54)}),
h AS (SELECT page, round(avg(abs(z)), 6) AS low FROM f JOIN m USING (page, x, y) GROUP BY page), t AS (SELECT w.page, round(stddev_pop(w.u - g.u), 6) AS texture, round(stddev_pop(w.u), 6) AS spread FROM w JOIN g USING (page, x, y) JOIN o USING (page, x, y) ANTI JOIN m USING (page, x, y) GROUP BY w.page) SELECT page, low, texture, spread FROM h JOIN t USING (page)""")
def raster_blurs(v):
    """Errors of low frequency within a mask, and texture around it."""

    def work(page, boxes):
        a, m = noise(page), I.box_mask(boxes[:3], (H, W))
        b = disturbed(a, page)
        return {"low": round(I.low_frequency_mae(a, b, m, 2.0), 6), "texture": round(I.ring_texture(a, m, "highpass", 4), 6), "spread": round(I.ring_texture(a, m, "std", 4), 6)}

    return _rasters(v, work, "low double, texture double, spread double")
