"""Queries over filters and rule cascades."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions import geometry as G
from lamella.functions import rules as R
from lamella.functions.geometry import Box, box
from lamella.operators import spatial as J
from lamella.sources.views import PAGE_H, PAGE_W

from . import sqltext as S
from .registry import query

_BARE = r"regexp_replace(text, '[\s\x{00a0}\x{3000}]', '', 'g')"
_BUL = r"^\s*([•◦▪‣·*-]|[0-9]{1,3}[.)]|[A-Za-z][.)]|\([A-Za-z0-9]{1,3}\)|[ivxIVX]{1,5}[.)])\s+"


@query("flt_suspicious", "FLT-01 FLT-33 UI-02", f"""
SELECT page, id, confidence >= 0.75 AS detected, trim(text) = '' AS empty, confidence < 0.6 AS low FROM blocks WHERE NOT (confidence < 0.35 AND length({_BARE}) <= 2 AND ((x1 - x0) * (y1 - y0) / 518400.0 >= 0.0015::DOUBLE * 10 / 10 * 10 / 10 OR (y1 - y0) / 540.0 >= 0.18))""".replace("0.0015::DOUBLE * 10 / 10 * 10 / 10", "0.015"))
def suspicious(v):
    c = F.col("confidence")
    kept = v.blocks.where(~R.suspicious(c, F.col("text"), box(), PAGE_W, PAGE_H))
    return kept.select("page", "id", (c >= 0.75).alias("detected"), (F.trim("text") == "").alias("empty"), (c < 0.6).alias("low"))


_SIG = f"""s AS (SELECT page, sum(length({_BARE}))::BIGINT AS chars, sum((x1 - x0) * (y1 - y0)) / 518400.0 AS text_share FROM blocks WHERE source = 'native' GROUP BY page), i AS (SELECT page, sum((x1 - x0) * (y1 - y0)) / 518400.0 AS image_share FROM images GROUP BY page), d AS (SELECT page, count(*) AS drawings FROM shapes GROUP BY page),
g AS (SELECT p.page, p.kind AS given, coalesce(chars, 0) AS chars, round(coalesce(text_share, 0.0), 9) AS text_share, round(coalesce(image_share, 0.0), 9) AS image_share, coalesce(drawings, 0) AS drawings FROM pages_ p LEFT JOIN s USING (page) LEFT JOIN i USING (page) LEFT JOIN d USING (page)),
k AS (SELECT *, CASE WHEN chars >= 40 AND text_share >= 0.01 THEN CASE WHEN image_share <= 0.75 THEN 'digital' ELSE 'hybrid' END WHEN chars <= 12 AND image_share >= 0.45 THEN 'scanned' WHEN chars <= 12 AND drawings = 0 THEN 'scanned' ELSE 'hybrid' END AS kind FROM g)"""


def signals(v):
    """Per page: characters, text and image share, drawings; pages without elements stay."""
    from lamella.functions.text import without_space

    s = v.blocks.where("source = 'native'").groupBy("page").agg(F.sum(F.length(without_space(F.col("text")))).alias("chars"), (F.sum(box().w * box().h) / 518400.0).alias("text_share"))
    i = v.images.groupBy("page").agg((F.sum(box().w * box().h) / 518400.0).alias("image_share"))
    d = v.shapes.groupBy("page").agg(F.count(F.lit(1)).alias("drawings"))
    g = v.pages_.withColumnRenamed("kind", "given").join(s, "page", "left").join(i, "page", "left").join(d, "page", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chars", "drawings")] + [F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("text_share", "image_share")]
    return g.select("page", "given", *zero)


def with_kind(g):
    return g.withColumn("kind", R.page_kind(*map(F.col, ("chars", "text_share", "image_share", "drawings"))))


@query("page_signals", "AGG-02 FLT-04", f"WITH {_SIG} SELECT page, chars, text_share, image_share, drawings, kind FROM k")
def page_signals(v):
    return with_kind(signals(v)).drop("given")


_SCORE = """q AS (SELECT k.page, k.kind, k.given, k.drawings, k.image_share, round(avg(confidence) + 1e-9, 4) AS conf, round(avg(CASE WHEN source = 'native' THEN 1.0 ELSE 0.45 END), 4) AS style, bool_or(b.id IS NOT NULL) AS has_text, bool_or(source = 'native') AS any_native
 FROM k LEFT JOIN blocks b ON k.page = b.page AND (k.given = 'hybrid' OR (k.given = 'digital' AND source = 'native') OR (k.given = 'scanned' AND source = 'ocr')) GROUP BY ALL),
e AS (SELECT *, CASE given WHEN 'digital' THEN 0.95::DOUBLE WHEN 'scanned' THEN 0.72::DOUBLE ELSE 0.82::DOUBLE END AS layout, CASE given WHEN 'digital' THEN 1.0::DOUBLE WHEN 'scanned' THEN 0.65::DOUBLE ELSE CASE WHEN any_native THEN 0.85::DOUBLE ELSE 0.55::DOUBLE END END AS editable FROM q)"""


@query("page_report", "AGG-04 FLT-05 FLT-08 FLT-19 FLT-25 FLT-28", f"""
WITH {_SIG}, {_SCORE} SELECT page, kind, given, conf, style, layout, editable, drawings,
 CASE WHEN (editable < 0.4 OR NOT has_text) THEN CASE WHEN given = 'digital' AND drawings > 0 THEN 'elements' ELSE 'full_page' END WHEN given = 'digital' AND editable >= 0.8 AND NOT (image_share > 0) THEN 'elements' ELSE 'overlay' END AS mode,
 CASE WHEN given = 'scanned' THEN 'scanned_page' WHEN drawings = 0 THEN 'no_drawings' WHEN drawings > 70 THEN 'too_complex' END AS vector_skip, image_share > 0 OR drawings > 60 AS visuals_left, given IN ('scanned', 'hybrid') AS used_ocr,
 CASE WHEN page % 5 = 0 THEN 'onnx' WHEN image_share <= 0.12 THEN 'fast' WHEN image_share <= 0.3 AND conf >= 0.4 THEN 'fast' WHEN page % 2 = 0 THEN 'onnx' ELSE 'white' END AS engine FROM e""")
def page_report(v):
    """One row for each page: kind, quality, background mode."""
    k = with_kind(signals(v))
    b = v.blocks.select(F.col("page").alias("bp"), "id", "source", "confidence")
    chosen = (F.col("given") == "hybrid") | ((F.col("given") == "digital") & (F.col("source") == "native")) | ((F.col("given") == "scanned") & (F.col("source") == "ocr"))
    q = k.join(b, (F.col("page") == F.col("bp")) & chosen, "left").groupBy("page", "kind", "given", "drawings", "image_share").agg(
        F.round(F.avg("confidence") + 1e-9, 4).alias("conf"), F.round(F.avg(F.when(F.col("source") == "native", 1.0).when(F.col("source") == "ocr", 0.45).otherwise(0.45)), 4).alias("style"),
        F.bool_or(F.col("id").isNotNull()).alias("has_text"), F.bool_or(F.col("source") == "native").alias("any_native"),
    )
    g, draw = F.col("given"), F.col("drawings")
    e = q.withColumn("layout", F.when(g == "digital", 0.95).when(g == "scanned", 0.72).otherwise(0.82))
    e = e.withColumn("editable", F.when(g == "digital", 1.0).when(g == "scanned", 0.65).when(F.col("any_native"), 0.85).otherwise(0.55))
    mode = R.background_mode(g, F.col("editable"), F.col("has_text"), F.col("image_share") > 0, draw > 0)["mode"]
    asked = F.when(F.col("page") % 5 == 0, "onnx").otherwise("auto")
    return e.select(
        "page", "kind", "given", "conf", "style", "layout", "editable", "drawings", mode.alias("mode"), R.vector_gate(F.lit("on"), g, draw, 70).alias("vector_skip"),
        ((F.col("image_share") > 0) | (draw > 60)).alias("visuals_left"), g.isin("scanned", "hybrid").alias("used_ocr"),
        R.engine_choice(asked, F.col("image_share"), 0.12, F.when(F.col("conf") >= 0.4, 1.0).otherwise(0.0), F.col("page") % 2 == 0).alias("engine"),
    )


@query("flt_label_cascade", "FLT-03 AGG-06", f"""
WITH m AS (SELECT *, median(font_size) OVER (PARTITION BY page) AS base FROM blocks), o AS (SELECT DISTINCT a.page, a.id FROM blocks a JOIN tables_ b ON a.page = b.page AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND a.y0 - b.y1 BETWEEN 0 AND 40)
SELECT m.page, m.id, CASE WHEN font_size >= 1.4::DOUBLE * base THEN 'title' WHEN regexp_matches(text, '{_BUL}') THEN 'list' ELSE 'body' END AS role, CASE WHEN y1 <= 0.06::DOUBLE * 540 AND font_size < 1.2::DOUBLE * base THEN 'header' WHEN y0 >= 0.9::DOUBLE * 540 AND regexp_matches(trim(text), '^[0-9]{{1,4}}$') THEN 'page_number'
 WHEN y0 >= 0.93::DOUBLE * 540 AND o.id IS NULL THEN 'footer' WHEN font_size >= 1.4::DOUBLE * base AND y0 <= 0.28::DOUBLE * 540 THEN 'title' WHEN regexp_matches(text, '{_BUL}') THEN 'list' WHEN regexp_matches(trim(text), '^(Figure|Table|Fig\\.)\\s') AND font_size <= base THEN 'caption' ELSE 'text' END AS label FROM m LEFT JOIN o ON m.page = o.page AND m.id = o.id""")
def label_cascade(v):
    from lamella.functions.text import is_list_line

    rows = v.blocks.withColumn("base", F.median("font_size").over(Window.partitionBy("page")))
    rows = J.flagged(rows, v.tables_, lambda a, b: (F.least(a.x1, b.x1) > F.greatest(a.x0, b.x0)) & (a.y0 - b.y1).between(0, 40), "blocked")
    font, base = F.col("font_size"), F.col("base")
    role = F.when(font >= 1.4 * base, "title").when(is_list_line(F.col("text")), "list").otherwise("body")
    return rows.select("page", "id", role.alias("role"), R.label_by_place(box(), font, base, F.col("text"), PAGE_W, PAGE_H, F.col("blocked")).alias("label"))


_OPS = "CASE id % 9 WHEN 0 THEN ['re'] WHEN 1 THEN ['l'] WHEN 2 THEN ['qu'] WHEN 3 THEN ['c','c','c','c'] WHEN 4 THEN ['c','l','c','l','c','l','c','l'] WHEN 5 THEN ['l','l','l','l','l','l','l'] WHEN 6 THEN ['l','l','l'] WHEN 7 THEN ['c','l'] ELSE []::VARCHAR[] END"


@query("flt_path_kinds", "FLT-09 FLT-10 FLT-11 FLT-12 FLT-13", f"""
WITH p AS (SELECT *, {_OPS} AS ops, id % 2 = 0 AS closed, (x1 - x0) / greatest(y1 - y0, 0.001) AS aspect FROM shapes), c AS (SELECT *, len(ops) AS n, len(list_filter(ops, lambda o: o = 'c')) AS curves, len(list_filter(ops, lambda o: o = 'l')) AS ls FROM p),
k AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN n = 1 AND ops[1] = 're' THEN 'rect' WHEN n = 1 AND ops[1] = 'l' THEN 'line' WHEN n = 1 AND ops[1] = 'qu' THEN 'polygon' WHEN n = 4 AND curves = 4 THEN 'ellipse' WHEN n >= 6 AND curves >= 4 AND ls >= 2 AND curves <= 8 AND aspect BETWEEN 0.15 AND 8 THEN 'round_rect'
 WHEN curves = 0 AND n BETWEEN 5 AND 12 AND greatest(aspect, 1 / aspect) >= 1.8 AND (closed OR ops[1] = 'l') THEN 'arrow' WHEN curves = 0 AND closed THEN 'polygon' WHEN curves = 0 THEN 'polyline' ELSE 'freeform' END AS shape FROM c)
SELECT page, id, shape, CASE WHEN shape IN ('rect', 'line', 'ellipse') THEN 0.95::DOUBLE ELSE 0.75::DOUBLE END AS conf FROM k WHERE shape IS NOT NULL AND n <= 7""")
def path_kinds(v):
    sets = [["re"], ["l"], ["qu"], ["c"] * 4, ["c", "l"] * 4, ["l"] * 7, ["l"] * 3, ["c", "l"]]
    ops = F.array().cast("array<string>")
    for i, s in enumerate(sets):
        ops = F.when(F.col("id") % 9 == i, F.array(*map(F.lit, s))).otherwise(ops)
    rows = v.shapes.withColumn("ops", ops).withColumn("shape", R.path_kind(F.col("ops"), box(), F.col("id") % 2 == 0)).where("shape IS NOT NULL AND size(ops) <= 7")
    return rows.select("page", "id", "shape", F.when(F.col("shape").isin("rect", "line", "ellipse"), 0.95).otherwise(0.75).alias("conf"))


@query("flt_table_guards", "FLT-14 FLT-15 AGG-21", """
WITH c AS (SELECT page, table_id AS id, count(*) AS n, avg(CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0.0 END) AS occupancy, median(length(text)) FILTER (WHERE text <> '') AS mid, max(length(text)) AS longest FROM cells GROUP BY ALL),
f AS (SELECT page, table_id AS id, max(s) AS fullest FROM (SELECT page, table_id, col, avg(CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0.0 END) AS s FROM cells GROUP BY ALL) GROUP BY ALL),
z AS (SELECT a.page, a.id, b.fill, lag(b.fill) OVER (PARTITION BY a.page, a.id ORDER BY b.y0, b.id) AS prev FROM tables_ a JOIN bands b ON a.page = b.page AND b.x0 < a.x1 AND a.x0 < b.x1 AND b.y0 < a.y1 AND a.y0 < b.y1),
w AS (SELECT page, id, count(*) >= 3 AND count(DISTINCT fill) >= 2 AND count(*) FILTER (WHERE fill <> prev) >= greatest(1, count(*) - 2) AS zebra FROM z GROUP BY ALL)
SELECT page, id, occupancy >= 0.45 AND coalesce(mid, 0) <= 28 AND longest <= 72 AND fullest >= 0.7 AS passes, coalesce(zebra, false) AS zebra, n <= 2 OR NOT (borderless OR coalesce(zebra, false)) AS spurious FROM c JOIN f USING (page, id) JOIN tables_ USING (page, id) LEFT JOIN w USING (page, id)""")
def table_guards(v):
    full = (F.trim("text") != "").cast("double")
    by_col = v.cells.groupBy("page", F.col("table_id").alias("id"), "col").agg(F.avg(full).alias("s")).groupBy("page", "id").agg(F.max("s").alias("fullest"))
    c = v.cells.groupBy("page", F.col("table_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.avg(full).alias("occupancy"), F.median(F.when(F.col("text") != "", F.length("text"))).alias("mid"), F.max(F.length("text")).alias("longest"))
    met = J.pairs(v.tables_, v.bands, lambda a, b: (b.x0 < a.x1) & (a.x0 < b.x1) & (b.y0 < a.y1) & (a.y0 < b.y1)).select("a.page", "a.id", F.col("b.id").alias("band"), "b.fill", "b.y0")
    prev = F.lag("fill").over(Window.partitionBy("page", "id").orderBy("y0", "band"))
    w = met.withColumn("turn", F.col("fill") != prev).groupBy("page", "id").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("fill").alias("d"), F.count_if("turn").alias("t"))
    zebra = F.coalesce((F.col("k") >= 3) & (F.col("d") >= 2) & (F.col("t") >= F.greatest(F.lit(1), F.col("k") - 2)), F.lit(False))
    rows = c.join(by_col, ["page", "id"]).join(v.tables_.select("page", "id", "borderless"), ["page", "id"]).join(w, ["page", "id"], "left")
    ok = (F.col("occupancy") >= 0.45) & (F.coalesce("mid", F.lit(0)) <= 28) & (F.col("longest") <= 72) & (F.col("fullest") >= 0.7)
    return rows.select("page", "id", ok.alias("passes"), zebra.alias("zebra"), ((F.col("n") <= 2) | ~(F.col("borderless") | zebra)).alias("spurious"))


_PREV = "lag({}) OVER (PARTITION BY page ORDER BY y0, x0, id)"


@query("flt_pair_rules", "FLT-21 FLT-22 FLT-23 FLT-24", f"""
WITH p AS (SELECT *, {_PREV.format("x0")} AS ax0, {_PREV.format("y0")} AS ay0, {_PREV.format("x1")} AS ax1, {_PREV.format("y1")} AS ay1, median(y1 - y0) OVER (PARTITION BY page) AS mh FROM blocks),
o AS (SELECT *, greatest(0.0, least(ay1, y1) - greatest(ay0, y0)) AS ov, ay1 - ay0 AS ah, y1 - y0 AS h, y0 - ay1 AS down, x0 - ax1 AS gap FROM p WHERE ax0 IS NOT NULL),
l AS (SELECT *, abs((ay0 + ay1) / 2 - (y0 + y1) / 2) <= 0.75::DOUBLE * mh AND ov > 0 AND ov / least(least(ah, h), 1.0) >= 0.3 AS same FROM o)
SELECT page, id, CASE WHEN ov / greatest(1.0, least(ah, h)) >= 0.45 THEN gap <= 0.08::DOUBLE * 960 AND gap <= 0.6::DOUBLE * ((ah + h) / 2) ELSE down >= -0.2::DOUBLE * h AND down <= 1.35::DOUBLE * h AND abs((ax0 + ax1) / 2 - (x0 + x1) / 2) <= 0.18::DOUBLE * 960 AND (abs(ax0 - x0) <= 0.12::DOUBLE * 960 OR regexp_matches(text, '{_BUL}')) END AS paragraph,
 h < 0.25::DOUBLE * mh OR (h < 0.4::DOUBLE * mh AND x1 - x0 < 0.4::DOUBLE * mh) AS minor, same AS same_line, gap <= 1.25::DOUBLE * mh AND same AND (gap <= 0.35::DOUBLE * mh OR (ax1 > x0 AND x1 > ax0)) AS merges FROM l""")
def pair_rules(v):
    w = Window.partitionBy("page").orderBy("y0", "x0", "id")
    rows = v.blocks.select("*", *[F.lag(c).over(w).alias(f"a{c}") for c in Box._fields], F.median(box().h).over(Window.partitionBy("page")).alias("mh")).where("ax0 IS NOT NULL")
    a, b, mh = Box(*[F.col(f"a{c}") for c in Box._fields]), box(), F.col("mh")
    return rows.select("page", "id", R.joins_paragraph(a, b, F.col("text"), PAGE_W).alias("paragraph"), R.minor_fragment(b, mh).alias("minor"), R.same_line(a, b, 0.75 * mh).alias("same_line"), R.merges_sideways(a, b, mh).alias("merges"))


@query("flt_group_guards", "FLT-30", f"""
WITH g AS (SELECT b.page, grp, count(*) AS n, count(DISTINCT role) AS roles, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(font_size) / min(font_size) AS fonts, bool_or(role IN ('header', 'footer')) AS skip FROM blocks b JOIN annotations n USING (page, id) GROUP BY ALL),
h AS (SELECT DISTINCT a.page, a.grp FROM g a JOIN tables_ b ON a.page = b.page AND {S.coef("a", "b")} >= 0.5)
SELECT page, grp, CASE WHEN n < 2 THEN 'single' WHEN skip THEN 'skipped role' WHEN roles > 2 THEN 'mixed roles' WHEN fonts > 3 THEN 'fonts differ' WHEN x1 - x0 > 0.9::DOUBLE * 960 THEN 'too wide' WHEN h.grp IS NOT NULL THEN 'obstacle' ELSE 'ok' END AS verdict FROM g LEFT JOIN h USING (page, grp)""")
def group_guards(v):
    """Why planned groups are not merged; the first guard that holds."""
    g = v.blocks.join(v.annotations.select("page", "id", "role", "grp"), ["page", "id"]).groupBy("page", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("role").alias("roles"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        (F.max("font_size") / F.min("font_size")).alias("fonts"), F.bool_or(F.col("role").isin("header", "footer")).alias("skip"),
    )
    rows = J.flagged(g, v.tables_, lambda a, b: G.overlap_coefficient(a, b) >= 0.5, "hit", ("page", "grp"))
    verdict = F.when(F.col("n") < 2, "single").when(F.col("skip"), "skipped role").when(F.col("roles") > 2, "mixed roles").when(F.col("fonts") > 3, "fonts differ").when(box().w > 0.9 * PAGE_W, "too wide").when(F.col("hit"), "obstacle").otherwise("ok")
    return rows.select("page", "grp", verdict.alias("verdict"))


@query("flt_warnings", "FLT-26 FLT-34 FLT-35", """
SELECT page, id, (id % 2 = 0)::INT + (id % 3 = 0)::INT + (id % 5 = 0)::INT + (trim(text) = '')::INT AS n_warnings, bold OR font_size >= 30 AS bold, CASE WHEN trim(text) = '' THEN concat('read ', id) ELSE text END AS text, CASE WHEN trim(text) = '' THEN 0.5::DOUBLE ELSE confidence END AS confidence FROM blocks""")
def warnings(v):
    i = F.col("id")
    empty = F.trim("text") == ""
    reasons = [F.when(i % n == 0, "x") for n in (2, 3, 5)] + [F.when(empty, "x")]
    return v.blocks.select("page", "id", F.size(F.array_compact(F.array(*reasons))).alias("n_warnings"), (F.col("bold") | (F.col("font_size") >= 30)).alias("bold"), F.when(empty, F.concat(F.lit("read "), i.cast("string"))).otherwise(F.col("text")).alias("text"), F.when(empty, 0.5).otherwise(F.col("confidence")).alias("confidence"))


@query("flt_plan_validation", "FLT-27 SET-01 SRC-18", """
WITH n AS (SELECT page, id, role, ord, conf FROM annotations WHERE id % 50 <> 0 UNION ALL SELECT page, id + 1000000000, role, ord, conf FROM annotations WHERE id % 70 = 0 UNION ALL SELECT page, id, role, ord, conf FROM annotations WHERE id % 90 = 1), c AS (SELECT page, id, count(*) AS n, min(conf) AS conf FROM n GROUP BY ALL)
SELECT page, id, 'missing' AS problem FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.page = b.page AND n.id = b.id) UNION ALL SELECT page, id, 'unknown' FROM c WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE c.page = b.page AND c.id = b.id)
UNION ALL SELECT page, id, 'duplicate' FROM c WHERE n > 1 UNION ALL SELECT page, id, 'confidence' FROM c WHERE conf < 0.55""")
def plan_validation(v):
    a = v.annotations.select("page", "id", "role", "ord", "conf")
    n = a.where("id % 50 <> 0").unionByName(a.where("id % 70 = 0").withColumn("id", F.col("id") + 1000000000)).unionByName(a.where("id % 90 = 1"))
    c = n.groupBy("page", "id").agg(F.count(F.lit(1)).alias("n"), F.min("conf").alias("conf"))
    known = v.blocks.select("page", "id")
    parts = [known.join(c, ["page", "id"], "left_anti").withColumn("problem", F.lit("missing")), c.join(known, ["page", "id"], "left_anti").select("page", "id", F.lit("unknown").alias("problem"))]
    parts += [c.where("n > 1").select("page", "id", F.lit("duplicate").alias("problem")), c.where("conf < 0.55").select("page", "id", F.lit("confidence").alias("problem"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("flt_edit_rows", "FLT-29 SET-05", """
WITH e AS (SELECT page, id, id % 2 AS part FROM edits WHERE excluded OR role IS NULL) SELECT page, count(*) AS n_ids, string_agg(DISTINCT (id % 40)::VARCHAR, ',' ORDER BY (id % 40)::VARCHAR) AS ids, count(DISTINCT part) > 1 AS repeated FROM e GROUP BY page""")
def edit_rows(v):
    e = v.edits.where("excluded OR role IS NULL").withColumn("part", F.col("id") % 2)
    ids = F.array_sort(F.array_distinct(F.transform(F.collect_list(F.col("id") % 40), lambda x: x.cast("string"))))
    return e.groupBy("page").agg(F.count(F.lit(1)).alias("n_ids"), F.array_join(ids, ",").alias("ids"), (F.count_distinct("part") > 1).alias("repeated"))


@query("flt_budget", "FLT-36 AGG-22 AGG-23 STATE-15", """
WITH c AS (SELECT worker, id, cached, failed, (CASE WHEN cached THEN 0 ELSE tokens_in + 4 * tokens_out END)::BIGINT AS cost FROM calls), r AS (SELECT *, sum(cost) OVER (PARTITION BY worker ORDER BY id ROWS UNBOUNDED PRECEDING) AS spent, count(*) FILTER (WHERE NOT cached) OVER (PARTITION BY worker ORDER BY id ROWS UNBOUNDED PRECEDING) AS billed FROM c)
SELECT worker, count(*) FILTER (WHERE spent <= 200000 AND billed <= 40) AS affordable, count(*) FILTER (WHERE cached) AS hits, count(*) FILTER (WHERE failed) AS failures, sum(cost)::BIGINT AS cost FROM r GROUP BY worker""")
def budget(v):
    cost = F.when(F.col("cached"), 0).otherwise(F.col("tokens_in") + 4 * F.col("tokens_out")).cast("long")
    w = Window.partitionBy("worker").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    r = v.calls.withColumn("cost", cost).withColumn("spent", F.sum("cost").over(w)).withColumn("billed", F.count_if(~F.col("cached")).over(w))
    return r.groupBy("worker").agg(F.count_if((F.col("spent") <= 200000) & (F.col("billed") <= 40)).alias("affordable"), F.count_if("cached").alias("hits"), F.count_if("failed").alias("failures"), F.sum("cost").alias("cost"))
