"""Rule cascades: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Box, vertical_overlap
from .text import is_list_line, without_space


def suspicious(conf: Column, text: Column, b: Box, page_w: float, page_h: float) -> Column:
    """Large boxes with little, doubtful text."""
    return (conf < 0.35) & (F.length(without_space(text)) <= 2) & ((b.w * b.h / (page_w * page_h) >= 0.015) | (b.h / page_h >= 0.18))


def page_kind(chars: Column, text_share: Column, image_share: Column, drawings: Column) -> Column:
    texty = (chars >= 40) & (text_share >= 0.01)
    return (
        F.when(texty & (image_share <= 0.75), "digital").when(texty, "hybrid")
        .when((chars <= 12) & (image_share >= 0.45), "scanned").when((chars <= 12) & (drawings == 0), "scanned").otherwise("hybrid")
    )


def background_mode(kind: Column, editable: Column, has_text: Column, has_visuals: Column, has_vectors: Column) -> Column:
    """struct<mode, reason>"""

    def pick(mode: str, reason: str | None) -> Column:
        return F.struct(F.lit(mode).alias("mode"), F.lit(reason).cast("string").alias("reason"))

    low = (editable < 0.4) | ~has_text
    return (
        F.when(low & (kind == "digital") & has_vectors, pick("elements", None)).when(low & ~has_text, pick("full_page", "no_text")).when(low, pick("full_page", "low_quality"))
        .when((kind == "digital") & (editable >= 0.8) & ~has_visuals, pick("elements", None)).otherwise(pick("overlay", None))
    )


def vector_gate(mode: Column, kind: Column, drawings: Column, most: int) -> Column:
    """Why drawings are not taken over; null if they are."""
    return F.when(mode == "off", "disabled").when(kind == "scanned", "scanned_page").when(drawings == 0, "no_drawings").when(drawings > most, "too_complex")


def label_by_place(b: Box, font: Column, base: Column, text: Column, page_w: float, page_h: float, blocked: Column) -> Column:
    t = F.trim(text)
    return (
        F.when((b.y1 <= 0.06 * page_h) & (font < 1.2 * base), "header")
        .when((b.y0 >= 0.9 * page_h) & t.rlike("^[0-9]{1,4}$"), "page_number")
        .when((b.y0 >= 0.93 * page_h) & ~blocked, "footer")
        .when((font >= 1.4 * base) & (b.y0 <= 0.28 * page_h), "title")
        .when(is_list_line(text), "list")
        .when(t.rlike("^(Figure|Table|Fig\\.)\\s") & (font <= base), "caption")
        .otherwise("text")
    )


def joins_paragraph(a: Box, b: Box, text: Column, page_w: float) -> Column:
    """Whether block b goes on with the paragraph of the block a before it."""
    share = vertical_overlap(a, b) / F.greatest(F.lit(1.0), F.least(a.h, b.h))
    mean_h = (a.h + b.h) / 2
    side = (b.x0 - a.x1 <= 0.08 * page_w) & (b.x0 - a.x1 <= 0.6 * mean_h)
    down = b.y0 - a.y1
    stacked = (down >= -0.2 * b.h) & (down <= 1.35 * b.h) & (F.abs(a.cx - b.cx) <= 0.18 * page_w) & ((F.abs(a.x0 - b.x0) <= 0.12 * page_w) | is_list_line(text))
    return F.when(share >= 0.45, side).otherwise(stacked)


def minor_fragment(b: Box, median_h: Column) -> Column:
    return (b.h < 0.25 * median_h) | ((b.h < 0.4 * median_h) & (b.w < 0.4 * median_h))


def same_line(a: Box, b: Box, centre_gap: Column) -> Column:
    """The literal 1 in the divisor makes the share an absolute one; kept so on purpose."""
    over = vertical_overlap(a, b)
    return (F.abs(a.cy - b.cy) <= centre_gap) & (over > 0) & (over / F.least(F.least(a.h, b.h), F.lit(1.0)) >= 0.3)


def merges_sideways(a: Box, b: Box, median_h: Column) -> Column:
    free = b.x0 - a.x1
    return (free <= 1.25 * median_h) & same_line(a, b, 0.75 * median_h) & ((free <= 0.35 * median_h) | ((a.x1 > b.x0) & (b.x1 > a.x0)))


def path_kind(ops: Column, b: Box, closed: Column) -> Column:
    """Kind of a drawing from its operators (re, l, qu, c); null if none fits."""
    n, curves, lines = F.size(ops), F.size(F.filter(ops, lambda o: o == "c")), F.size(F.filter(ops, lambda o: o == "l"))
    aspect = b.w / F.greatest(b.h, F.lit(0.001))
    rounded = (n >= 6) & (curves >= 4) & (lines >= 2) & (curves <= 8) & aspect.between(0.15, 8)
    arrow = (curves == 0) & n.between(5, 12) & (F.greatest(aspect, 1 / aspect) >= 1.8) & (closed | (F.element_at(ops, 1) == "l"))
    return (
        F.when(n == 0, None).when((n == 1) & (ops[0] == "re"), "rect").when((n == 1) & (ops[0] == "l"), "line").when((n == 1) & (ops[0] == "qu"), "polygon")
        .when((n == 4) & (curves == 4), "ellipse").when(rounded, "round_rect").when(arrow, "arrow")
        .when((curves == 0) & closed, "polygon").when(curves == 0, "polyline").when(n <= 60, "freeform")
    )


def engine_choice(asked: Column, mask_share: Column, cap: float, low_texture: Column, onnx: Column) -> Column:
    return (
        F.when(asked != "auto", asked).when(mask_share <= cap, "fast")
        .when((mask_share <= min(0.35, 2.5 * cap)) & (low_texture >= 0.75), "fast").when(onnx, "onnx").otherwise("white")
    )
