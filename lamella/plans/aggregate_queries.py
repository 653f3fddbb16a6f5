"""Queries over aggregates of pages, cells, files and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions import aggregates as A
from lamella.functions import geometry as G
from lamella.functions import text as T
from lamella.functions.geometry import box
from lamella.operators import spatial as J

from . import join_queries, rule_queries
from . import sqltext as S
from .registry import query

_DECK = "CAST(floor(page / 10.0::DOUBLE) AS BIGINT)"


def deck():
    return F.floor(F.col("page") / 10.0).cast("long").alias("deck")


@query("agg_extent", "AGG-01 AGG-10 UI-09", """
SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n, round(avg(CASE WHEN source = 'ocr' THEN confidence END), 6) AS mean_ocr FROM blocks GROUP BY page""")
def extent(v):
    mean = F.round(F.avg(F.when(F.col("source") == "ocr", F.col("confidence"))), 6)
    return v.blocks.groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n"), mean.alias("mean_ocr"))


@query("agg_mode_first", "AGG-03 UI-01", """
WITH c AS (SELECT page, font, count(*) AS n, min(id) AS f FROM blocks WHERE font IS NOT NULL GROUP BY ALL), m AS (SELECT page, arg_max(font, row(n, -f)) AS font FROM c GROUP BY page),
s AS (SELECT page, source, min(id) AS f, count(*) AS n FROM blocks GROUP BY ALL) SELECT m.page, font, string_agg(concat(source, ':', n), ',' ORDER BY f) AS boxes FROM m JOIN s USING (page) GROUP BY ALL""")
def mode_first(v):
    """The usual font of a page, and its boxes by source in the order of their first ones."""
    groups = v.blocks.groupBy("page", "source").agg(F.min("id").alias("f"), F.count(F.lit(1)).alias("n"))
    boxes = groups.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("f", F.concat_ws(":", "source", "n").alias("t")))).alias("b"))
    return A.first_mode(v.blocks, ["page"], "font", "id").join(boxes, "page").select("page", "font", F.array_join(F.transform("b", lambda x: x["t"]), ",").alias("boxes"))


_CELL = "c.page, c.table_id, c.row, c.col"


@query("agg_cell_style", "AGG-05 JOIN-11", f"""
WITH m AS (SELECT {_CELL}, c.x0 AS cx0, c.y0 AS cy0, c.x1 AS cx1, c.y1 AS cy1, b.id, b.font, b.font_size, b.bold, b.x0, b.y0, b.x1, b.y1 FROM cells c JOIN blocks b ON c.page = b.page AND ({S.centre_in("b", "c")} OR {S.share("b", "c")} >= 0.5)),
n AS (SELECT page, table_id, row, col, font, count(*) AS n, min(id) AS f FROM m WHERE font IS NOT NULL GROUP BY ALL), fm AS (SELECT page, table_id, row, col, arg_max(font, row(n, -f)) AS font FROM n GROUP BY page, table_id, row, col),
g AS (SELECT page, table_id, row, col, median(font_size) AS font_size, bool_or(bold) AS bold, min(x0) - min(cx0) AS lg, min(cx1) - max(x1) AS rg, min(y0) - min(cy0) AS tg, min(cy1) - max(y1) AS bg, greatest(1.0, min(cx1) - min(cx0)) AS w, greatest(1.0, min(cy1) - min(cy0)) AS h, median(greatest(1.0, y1 - y0)) AS line FROM m GROUP BY page, table_id, row, col),
a AS (SELECT *, CASE WHEN abs(lg - rg) <= w * 0.12::DOUBLE AND lg > w * 0.08::DOUBLE THEN 'center' WHEN rg < lg * 0.45::DOUBLE AND rg < w * 0.12::DOUBLE THEN 'right' ELSE 'left' END AS align FROM g)
SELECT page, table_id, row, col, font, font_size, bold, align, CASE WHEN h >= greatest(3.0 * line, 72.0) AND tg <= greatest(line * 0.85::DOUBLE, h * 0.12::DOUBLE) THEN 'top' WHEN abs(tg - bg) <= h * 0.35::DOUBLE THEN 'middle' WHEN tg + h * 0.1::DOUBLE < bg AND tg < h * 0.12::DOUBLE THEN 'top' WHEN bg + h * 0.1::DOUBLE < tg AND bg < h * 0.12::DOUBLE THEN 'bottom' ELSE 'middle' END AS anchor,
 CASE WHEN align = 'left' THEN greatest(0.0, least(12.0, lg)) END AS margin_left, CASE WHEN align = 'right' THEN greatest(0.0, least(12.0, rg)) END AS margin_right, greatest(0.0, least(12.0, tg)) AS margin_top FROM a LEFT JOIN fm USING (page, table_id, row, col)""")
def cell_style(v):
    """Look of a table cell from the text spans in it: by centre, or half their area."""
    keys = ["page", "table_id", "row", "col"]
    inside = lambda a, b: G.centre_inside(b, a) | (G.share_of_first(b, a) >= 0.5)
    m = J.pairs(v.cells, v.blocks, inside).select(*[f"a.{k}" for k in keys], *[F.col(f"a.{c}").alias(f"c{c}") for c in box()._fields], *[f"b.{c}" for c in ("id", "font", "font_size", "bold", *box()._fields)])
    one = F.lit(1.0)
    g = m.groupBy(*keys).agg(
        F.median("font_size").alias("font_size"), F.bool_or("bold").alias("bold"), (F.min("x0") - F.min("cx0")).alias("lg"), (F.min("cx1") - F.max("x1")).alias("rg"), (F.min("y0") - F.min("cy0")).alias("tg"),
        (F.min("cy1") - F.max("y1")).alias("bg"), F.greatest(one, F.min("cx1") - F.min("cx0")).alias("w"), F.greatest(one, F.min("cy1") - F.min("cy0")).alias("h"), F.median(F.greatest(one, box().h)).alias("line"),
    )
    lg, rg, tg, bg, w, h, line = map(F.col, ("lg", "rg", "tg", "bg", "w", "h", "line"))
    align = F.when((F.abs(lg - rg) <= w * 0.12) & (lg > w * 0.08), "center").when((rg < lg * 0.45) & (rg < w * 0.12), "right").otherwise("left")
    tall = (h >= F.greatest(3.0 * line, F.lit(72.0))) & (tg <= F.greatest(line * 0.85, h * 0.12))
    anchor = F.when(tall, "top").when(F.abs(tg - bg) <= h * 0.35, "middle").when((tg + h * 0.1 < bg) & (tg < h * 0.12), "top").when((bg + h * 0.1 < tg) & (bg < h * 0.12), "bottom").otherwise("middle")
    inset = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(12.0), x))
    rows = g.withColumn("align", align).join(A.first_mode(m, keys, "font", "id"), keys, "left")
    return rows.select(*keys, "font", "font_size", "bold", "align", anchor.alias("anchor"), F.when(F.col("align") == "left", inset(lg)).alias("margin_left"), F.when(F.col("align") == "right", inset(rg)).alias("margin_right"), inset(tg).alias("margin_top"))


_PR = f"""pr AS (SELECT page, coalesce(conf, 0.0) AS conf, editable, CASE WHEN editable < 0.4 OR NOT has_text THEN CASE WHEN given = 'digital' AND drawings > 0 THEN 'elements' ELSE 'full_page' END WHEN given = 'digital' AND editable >= 0.8 AND NOT (image_share > 0) THEN 'elements' ELSE 'overlay' END AS mode, given IN ('scanned', 'hybrid') AS used_ocr FROM e)"""


@query("agg_batch_metrics", "AGG-07 AGG-17 SNK-05", f"""
WITH {rule_queries._SIG}, {rule_queries._SCORE}, {_PR}, dk AS (SELECT {_DECK} AS deck, count(*) AS pages, count(*) FILTER (WHERE used_ocr) AS ocr_pages, count(*) FILTER (WHERE mode = 'full_page') AS raster_pages, count(*) FILTER (WHERE mode IN ('elements', 'overlay')) AS editable_pages, avg(editable) AS me, avg(conf) AS mc FROM pr GROUP BY ALL)
SELECT deck, pages, ocr_pages > 0 AS ocr_used, ocr_pages, raster_pages, editable_pages, round(greatest(0.0, least(1.0, 0.5::DOUBLE * me + 0.3::DOUBLE * mc + 0.2::DOUBLE * (1.0 - raster_pages::DOUBLE / pages))) + 1e-9::DOUBLE, 4) AS quality, round(me + 1e-9::DOUBLE, 4) AS mean_editable, round(mc + 1e-9::DOUBLE, 4) AS mean_conf FROM dk""")
def batch_metrics(v):
    """Per deck of ten pages: counts by lane and the quality indicator."""
    pr = rule_queries.page_report(v).select("page", F.coalesce("conf", F.lit(0.0)).alias("conf"), "editable", "mode", "used_ocr")
    d = pr.groupBy(deck()).agg(F.count(F.lit(1)).alias("pages"), F.count_if("used_ocr").alias("ocr_pages"), F.count_if(F.col("mode") == "full_page").alias("raster_pages"), F.count_if(F.col("mode").isin("elements", "overlay")).alias("editable_pages"), F.avg("editable").alias("me"), F.avg("conf").alias("mc"))
    quality = A.clamp01(0.5 * F.col("me") + 0.3 * F.col("mc") + 0.2 * (1.0 - F.col("raster_pages") / F.col("pages")))
    r4 = lambda x: F.round(x + 1e-9, 4)
    return d.select("deck", "pages", (F.col("ocr_pages") > 0).alias("ocr_used"), "ocr_pages", "raster_pages", "editable_pages", r4(quality).alias("quality"), r4(F.col("me")).alias("mean_editable"), r4(F.col("mc")).alias("mean_conf"))


@query("agg_batch_totals", "AGG-08", """
SELECT count(*) AS files, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, sum(n_pages) FILTER (WHERE status = 'ok')::BIGINT AS pages, round(sum(seconds), 3) AS seconds, round(sum(cost), 6) AS cost FROM files""")
def batch_totals(v):
    is_ = lambda s: F.col("status") == s
    return v.files.agg(F.count(F.lit(1)).alias("files"), *[F.count_if(is_(s)).alias(s) for s in ("ok", "failed", "skipped")], F.sum(F.when(is_("ok"), F.col("n_pages"))).alias("pages"), F.round(F.sum("seconds"), 3).alias("seconds"), F.round(F.sum("cost"), 6).alias("cost"))


@query("agg_slide_summary", "AGG-09 AGG-30", f"""
SELECT {_DECK} AS deck, count(*) AS n, round(avg(ssim_after) + 1e-9::DOUBLE, 6) AS ssim_mean, round(avg(edit_after) + 1e-9::DOUBLE, 4) AS edit_mean, round(avg(CASE WHEN id % 5 <> 0 THEN f1_after END) + 1e-9::DOUBLE, 6) AS f1_mean, round(avg(ssim_after - ssim_before) + 1e-9::DOUBLE, 6) AS delta_mean,
 count(*) FILTER (WHERE edit_after - edit_before < -0.005) AS regressions, sum(seconds) AS seconds_total FROM attempts GROUP BY ALL""")
def slide_summary(v):
    """Means over the attempts of a deck; text F1 is missing for every fifth."""
    f1 = F.when(F.col("id") % 5 != 0, F.col("f1_after"))
    r = lambda x, d: F.round(F.avg(x) + 1e-9, d)
    return v.attempts.groupBy(deck()).agg(
        F.count(F.lit(1)).alias("n"), r("ssim_after", 6).alias("ssim_mean"), r("edit_after", 4).alias("edit_mean"), r(f1, 6).alias("f1_mean"), r(F.col("ssim_after") - F.col("ssim_before"), 6).alias("delta_mean"),
        F.count_if(F.col("edit_after") - F.col("edit_before") < -0.005).alias("regressions"), F.sum("seconds").alias("seconds_total"),
    )


_TOK = r"regexp_extract_all(text, '([\p{L}\p{N}_\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}]+)', 1)"


@query("agg_text_f1", "AGG-11 SRC-27", f"""
WITH k AS (SELECT count(*) AS k FROM benchmark), items AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, text FROM benchmark),
d AS (SELECT doc_id, list_transform({_TOK}, lambda x: lower(x)) AS t FROM documents), b AS (SELECT i, list_transform({_TOK}, lambda x: lower(x)) AS t FROM items),
p AS (SELECT d.doc_id, coalesce(d.t, []) AS t, coalesce(b.t, []) AS r FROM d JOIN k ON true JOIN b ON b.i = d.doc_id % k.k),
ct AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(t) AS w FROM p) GROUP BY ALL), cr AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(r) AS w FROM p) GROUP BY ALL),
o AS (SELECT doc_id, sum(least(ct.n, cr.n)) AS o FROM ct JOIN cr USING (doc_id, w) GROUP BY doc_id),
s AS (SELECT p.doc_id, len(t) AS nt, len(r) AS nr, coalesce(o, 0)::DOUBLE AS o FROM p LEFT JOIN o USING (doc_id)),
f AS (SELECT doc_id, CASE WHEN nt = 0 AND nr = 0 THEN 1.0 WHEN nt = 0 OR nr = 0 THEN 0.0 ELSE o / nt END::DOUBLE AS p, CASE WHEN nt = 0 AND nr = 0 THEN 1.0 WHEN nt = 0 OR nr = 0 THEN 0.0 ELSE o / nr END::DOUBLE AS r FROM s)
SELECT doc_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r <= 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM f""")
def text_f1(v):
    """Bag-of-words agreement of each document with a benchmark item, dealt round."""
    items = v.benchmark.select(F.col("item_id"), T.tokens(F.col("text")).alias("r"))
    # One row an item: a reference list is small beside the documents, whatever its size it is joined by key.
    items = items.withColumn("i", F.row_number().over(Window.orderBy("item_id")) - 1)
    docs = v.documents.select("doc_id", T.tokens(F.col("text")).alias("t"), (F.col("doc_id") % max(1, v.benchmark.count())).alias("i"))
    none = F.array().cast("array<string>")
    p = docs.join(items, "i").select("doc_id", F.coalesce("t", none).alias("t"), F.coalesce("r", none).alias("r"))
    # A reference is short: its words are looked up in the document's, row by row, and nothing is shuffled but the join.
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    shared = F.array_intersect("t", "r")
    o = F.aggregate(shared, F.lit(0), lambda n, w: n + F.least(times("t", w), times("r", w)))
    rows = p.select("doc_id", o.alias("o"), F.size("t").alias("nt"), F.size("r").alias("nr"))
    return rows.select("doc_id", *[F.round(c, 6).alias(n) for n, c in A.multiset_scores(F.col("o"), F.col("nr"), F.col("nt")).items()])


@query("agg_char_regression", "AGG-12 SET-06", """
WITH b AS (SELECT page, id, regexp_replace(text, '[\\s\\x{00a0}\\x{3000}]', '', 'g') AS t FROM blocks), gone AS (SELECT page, id FROM edits WHERE excluded), drops AS (SELECT page, id FROM annotations WHERE role IN ('header', 'footer')),
c AS (SELECT page, id, unnest(string_split(t, '')) AS ch FROM b WHERE t <> ''), before AS (SELECT page, ch, count(*) AS n FROM c GROUP BY ALL),
after_ AS (SELECT page, ch, count(*) AS n FROM c WHERE (page, id) NOT IN (SELECT (page, id) FROM gone) AND (page, id) NOT IN (SELECT (page, id) FROM drops) GROUP BY ALL), allowed AS (SELECT page, ch, count(*) AS n FROM c WHERE (page, id) IN (SELECT (page, id) FROM drops) GROUP BY ALL),
l AS (SELECT page, ch, b.n - coalesce(a.n, 0) - coalesce(d.n, 0) AS n FROM before b LEFT JOIN after_ a USING (page, ch) LEFT JOIN allowed d USING (page, ch)) SELECT page, sum(n)::BIGINT AS n_lost, string_agg(ch, '' ORDER BY ch) AS lost FROM l WHERE n > 0 GROUP BY page""")
def char_regression(v):
    """Characters of a page that an edit loses, beyond those that may go: a multiset difference by signed counts."""
    b = v.blocks.select("page", "id", T.without_space(F.col("text")).alias("t")).where("t <> ''")
    mark = lambda df, name: df.select("page", "id").distinct().withColumn(name, F.lit(True))
    b = b.join(mark(v.edits.where("excluded"), "gone"), ["page", "id"], "left").join(mark(v.annotations.where("role IN ('header', 'footer')"), "drop"), ["page", "id"], "left")
    # A dropped element counts as allowed, a kept one as there still; both take away what stood before.
    lost = b.where("drop IS NULL AND gone").select("page", F.explode(F.split("t", "")).alias("ch")).where("ch <> ''")
    n = lost.groupBy("page", "ch").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("page").agg(F.sum("n").alias("n_lost"), F.array_join(F.array_sort(F.collect_list("ch")), "").alias("lost"))


@query("agg_region_groups", "AGG-13", f"""
WITH r AS (SELECT page, id, region, label FROM (SELECT a.page, a.id, b.id AS region, b.label, {join_queries._RS} AS score, row_number() OVER (PARTITION BY a.page, a.id ORDER BY {join_queries._RS} DESC, b.id) AS n FROM blocks a JOIN regions b ON a.page = b.page AND {join_queries._RS} > 0) WHERE n = 1 AND score >= 0.35)
SELECT page, region, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, chr(10) ORDER BY y0, x0, b.id) FILTER (WHERE trim(text) <> '') AS text, list_sort(list(font_size))[len(list(font_size)) // 2 + 1] AS font_size, round(avg(confidence), 6) AS confidence, bool_or(bold) AS bold, bool_or(italic) AS italic, arg_min(source, row(y0, x0, b.id)) AS source, min(label) IN ('title', 'paragraph_title') AS is_title
FROM blocks b JOIN r USING (page, id) GROUP BY page, region""")
def region_groups(v):
    """The blocks of a region as one: extent, text in reading order, upper median size."""
    rows = v.blocks.join(join_queries.best_region(v).select("page", "id", "region", "label"), ["page", "id"])
    parts = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("y0", "x0", "id", "text"))))
    got = rows.groupBy("page", "region").agg(
        F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"), parts.alias("parts"), A.upper_median(F.col("font_size")).alias("font_size"), F.round(F.avg("confidence"), 6).alias("confidence"),
        F.bool_or("bold").alias("bold"), F.bool_or("italic").alias("italic"), F.min_by("source", F.struct("y0", "x0", "id")).alias("source"), F.min("label").isin("title", "paragraph_title").alias("is_title"),
    )
    text = F.when(F.size("parts") > 0, F.array_join(F.transform("parts", lambda x: x["text"]), "\n"))
    return got.select("page", "region", *[F.col(f"b{c}").alias(c) for c in box()._fields], text.alias("text"), "font_size", "confidence", "bold", "italic", "source", "is_title")


@query("agg_merged_lines", "AGG-14", """
SELECT page, CAST(floor(y0 / 20.0::DOUBLE) AS BIGINT) AS line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(sum(confidence * length(text)) / greatest(1, sum(length(text))), 6) AS confidence, sum(length(text))::BIGINT AS n_chars, arg_min(id, row(x0, id)) AS anchor FROM blocks WHERE source = 'ocr' GROUP BY ALL""")
def merged_lines(v):
    """Blocks of a line as one: extent, confidence weighed by characters."""
    n = F.length("text")
    return v.blocks.where("source = 'ocr'").groupBy("page", F.floor(F.col("y0") / 20.0).cast("long").alias("line")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(A.weighted_mean(F.col("confidence"), n), 6).alias("confidence"), F.sum(n).alias("n_chars"), F.min_by("id", F.struct("x0", "id")).alias("anchor"),
    )


_PRE = f"""WITH {rule_queries._SIG}, {rule_queries._SCORE}, {_PR}, cb AS (SELECT page, count(*) AS nb, count(*) FILTER (WHERE font_size >= 24) AS nl FROM blocks GROUP BY page), cs AS (SELECT page, count(*) AS ns FROM shapes GROUP BY page), ct AS (SELECT page, count(*) AS nt FROM tables_ GROUP BY page), ci AS (SELECT page, count(*) AS ni FROM images GROUP BY page),
risk AS (SELECT page, round(0.3::DOUBLE * coalesce(nb, 0) + 0.5::DOUBLE * coalesce(ns, 0) + 0.8::DOUBLE * coalesce(nt, 0) + 0.4::DOUBLE * coalesce(ni, 0) + 1.5::DOUBLE * ((1.0 - conf) + (1.0 - editable)) + CASE WHEN mode = 'elements' THEN 0.0 ELSE 0.5 END + CASE WHEN mode = 'full_page' THEN 1.0 ELSE 0.0 END + 0.4::DOUBLE * coalesce(nl, 0), 6) AS score FROM pr LEFT JOIN cb USING (page) LEFT JOIN cs USING (page) LEFT JOIN ct USING (page) LEFT JOIN ci USING (page))"""


def prerank(v):
    """Risk of each page before it is rendered."""
    count = lambda df, name, *more: df.groupBy("page").agg(F.count(F.lit(1)).alias(name), *more)
    pr = rule_queries.page_report(v).select("page", F.coalesce("conf", F.lit(0.0)).alias("conf"), "editable", "mode")
    for df in (count(v.blocks, "nb", F.count_if(F.col("font_size") >= 24).alias("nl")), count(v.shapes, "ns"), count(v.tables_, "nt"), count(v.images, "ni")):
        pr = pr.join(df, "page", "left")
    nb, nl, ns, nt, ni = (F.coalesce(c, F.lit(0)) for c in ("nb", "nl", "ns", "nt", "ni"))
    risk = 1.5 * ((1.0 - F.col("conf")) + (1.0 - F.col("editable"))) + F.when(F.col("mode") == "elements", 0.0).otherwise(0.5) + F.when(F.col("mode") == "full_page", 1.0).otherwise(0.0)
    return pr.select("page", F.round(0.3 * nb + 0.5 * ns + 0.8 * nt + 0.4 * ni + risk + 0.4 * nl, 6).alias("score"))


@query("agg_prerank", "AGG-16", f"{_PRE} SELECT page, score FROM risk")
def agg_prerank(v):
    return prerank(v)


@query("sort_budget_pages", "SORT-05 STATE-12", f"""
{_PRE}, r AS (SELECT {_DECK} AS deck, page, score, 4.0 + {_DECK} % 5 AS remaining, row_number() OVER (PARTITION BY {_DECK} ORDER BY score DESC, page) AS k, count(*) OVER (PARTITION BY {_DECK}) AS n FROM risk),
est_ AS (SELECT *, 2.5::DOUBLE + 0.12::DOUBLE * k + 0.45::DOUBLE * k AS est, 2.5::DOUBLE + 0.57::DOUBLE * n AS full_est FROM r), c AS (SELECT deck, min(n) AS n, min(remaining) AS remaining, min(full_est) AS full_est, count(*) FILTER (WHERE est + 2.5 <= remaining + 1e-9 AND est <= greatest(remaining * 0.4::DOUBLE, remaining - 2.5) + 1e-9) AS fits, min(est) AS first_est FROM est_ GROUP BY deck),
best_ AS (SELECT deck, CASE WHEN remaining + 1e-9 < 2.5 THEN 0 WHEN full_est + 2.5 <= remaining + 1e-9 THEN n WHEN fits > 0 THEN fits WHEN first_est <= remaining + 1e-9 THEN 1 ELSE 0 END AS best FROM c)
SELECT deck, page, k AS place, est, CASE WHEN best >= n THEN 'full' ELSE 'partial' END AS mode FROM est_ JOIN best_ USING (deck) WHERE k <= best""")
def budget_pages(v):
    """The riskiest pages of a deck whose render and diagnosis fit the time left."""
    w = Window.partitionBy("deck")
    r = prerank(v).withColumn("deck", deck()).withColumn("remaining", 4.0 + F.col("deck") % 5)
    r = r.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "page"))).withColumn("n", F.count(F.lit(1)).over(w))
    k, left, least = F.col("place"), F.col("remaining"), 2.5
    r = r.withColumn("est", 2.5 + 0.12 * k + 0.45 * k).withColumn("full", 2.5 + 0.57 * F.col("n"))
    fits = F.count_if((F.col("est") + least <= left + 1e-9) & (F.col("est") <= F.greatest(left * 0.4, left - least) + 1e-9)).over(w)
    best = F.when(left + 1e-9 < least, 0).when(F.col("full") + least <= left + 1e-9, F.col("n")).when(fits > 0, fits).when(F.min("est").over(w) <= left + 1e-9, 1).otherwise(0)
    return r.withColumn("best", best).where("place <= best").select("deck", "page", "place", "est", F.when(F.col("best") >= F.col("n"), "full").otherwise("partial").alias("mode"))


@query("agg_border_style", "AGG-19", f"""
WITH m AS (SELECT a.page, a.id AS t, b.id, b.stroke, b.stroke_width AS w, (abs(b.x0 - a.x0) <= 2 AND abs(b.x1 - a.x0) <= 2) OR (abs(b.x0 - a.x1) <= 2 AND abs(b.x1 - a.x1) <= 2) OR (abs(b.y0 - a.y0) <= 2 AND abs(b.y1 - a.y0) <= 2) OR (abs(b.y0 - a.y1) <= 2 AND abs(b.y1 - a.y1) <= 2) AS edge FROM tables_ a JOIN shapes b ON a.page = b.page AND b.stroke IS NOT NULL AND b.stroke_width <= 4 AND {S.centre_in("b", "a", 4.0)}),
c AS (SELECT page, t, stroke, count(*) AS n, min(id) AS f FROM m GROUP BY ALL), k AS (SELECT page, t, arg_max(stroke, row(n, -f)) AS colour FROM c GROUP BY ALL), g AS (SELECT page, t, median(w) AS width, median(w) FILTER (WHERE edge) AS o, median(w) FILTER (WHERE NOT edge) AS i FROM m GROUP BY page, t)
SELECT page, t AS id, colour, width, coalesce(o, width) AS outer_width, coalesce(i, width) AS inner_width FROM g JOIN k USING (page, t)""".replace("arg_max(stroke, row(n, -f)) AS colour FROM c GROUP BY ALL", "arg_max(stroke, row(n, -f)) AS colour FROM c GROUP BY page, t"))
def border_style(v):
    """Usual colour of the rules of a table, and median widths of outer and inner ones."""
    a, b = box("a"), box("b")
    thin = F.col("b.stroke").isNotNull() & (F.col("b.stroke_width") <= 4)
    near = lambda x, y: F.abs(x - y) <= 2
    edge = (near(b.x0, a.x0) & near(b.x1, a.x0)) | (near(b.x0, a.x1) & near(b.x1, a.x1)) | (near(b.y0, a.y0) & near(b.y1, a.y0)) | (near(b.y0, a.y1) & near(b.y1, a.y1))
    m = J.pairs(v.tables_, v.shapes, thin & G.centre_inside(b, a, 4.0)).select("a.page", F.col("a.id").alias("t"), F.col("b.id").alias("id"), "b.stroke", F.col("b.stroke_width").alias("w"), edge.alias("edge"))
    g = m.groupBy("page", "t").agg(F.median("w").alias("width"), F.median(F.when(F.col("edge"), F.col("w"))).alias("o"), F.median(F.when(~F.col("edge"), F.col("w"))).alias("i"))
    rows = g.join(A.first_mode(m, ["page", "t"], "stroke", "id"), ["page", "t"])
    return rows.select("page", F.col("t").alias("id"), F.col("stroke").alias("colour"), "width", F.coalesce("o", "width").alias("outer_width"), F.coalesce("i", "width").alias("inner_width"))


@query("agg_table_geometry", "AGG-20", """
WITH m AS (SELECT c.page, c.table_id AS id, c.col, median(c.x0) AS l, median(c.x1) AS r FROM cells c JOIN tables_ t ON c.page = t.page AND c.table_id = t.id WHERE NOT (c.x1 - c.x0 > (t.x1 - t.x0) / 4 * 1.6::DOUBLE) GROUP BY ALL),
e AS (SELECT m.*, t.x0, t.x1, CASE WHEN m.col = 0 THEN t.x0 ELSE (lag(m.r) OVER w + m.l) / 2 END AS a, coalesce((m.r + lead(m.l) OVER w) / 2, t.x1) AS b, count(*) OVER (PARTITION BY m.page, m.id) AS n FROM m JOIN tables_ t USING (page, id) WINDOW w AS (PARTITION BY m.page, m.id ORDER BY m.col)),
x AS (SELECT page, id, col, CASE WHEN n = 4 THEN greatest(1.0, b - a) ELSE greatest(1.0, (x1 - x0) / 4) END AS raw, greatest(1.0, x1 - x0) AS target FROM e), s AS (SELECT *, sum(raw) OVER (PARTITION BY page, id) AS total FROM x)
SELECT page, id, col, round(CASE WHEN abs(total - target) > 0.5 THEN raw * target / total ELSE raw END, 9) AS width FROM s""")
def table_geometry(v):
    """Column widths of a table of four columns from the medians of its cells' edges, fitted to its box."""
    t = v.tables_.select("page", "id", F.col("x0").alias("tx0"), F.col("x1").alias("tx1"))
    c = v.cells.withColumnRenamed("table_id", "id").join(t, ["page", "id"]).where("NOT (x1 - x0 > (tx1 - tx0) / 4 * 1.6D)")
    m = c.groupBy("page", "id", "col").agg(F.median("x0").alias("l"), F.median("x1").alias("r")).join(t, ["page", "id"])
    w = Window.partitionBy("page", "id")
    o = w.orderBy("col")
    a = F.when(F.col("col") == 0, F.col("tx0")).otherwise((F.lag("r").over(o) + F.col("l")) / 2)
    b = F.coalesce((F.col("r") + F.lead("l").over(o)) / 2, F.col("tx1"))
    one, span = F.lit(1.0), F.col("tx1") - F.col("tx0")
    x = m.withColumn("a", a).withColumn("b", b).withColumn("n", F.count(F.lit(1)).over(w))
    x = x.withColumn("raw", F.when(F.col("n") == 4, F.greatest(one, F.col("b") - F.col("a"))).otherwise(F.greatest(one, span / 4))).withColumn("total", F.sum("raw").over(w))
    target = F.greatest(one, span)
    return x.select("page", "id", "col", F.round(F.when(F.abs(F.col("total") - target) > 0.5, F.col("raw") * target / F.col("total")).otherwise(F.col("raw")), 9).alias("width"))


@query("agg_editability", "AGG-24 AGG-25", """
WITH b AS (SELECT page, count(*) AS boxes, sum(greatest(1, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))) AS paragraphs, count(*) FILTER (WHERE starts_with(text, '•')) AS bullets FROM blocks GROUP BY page), s AS (SELECT page, count(*) FILTER (WHERE kind <> 'line') AS auto, count(*) FILTER (WHERE kind = 'line') AS lines_ FROM shapes GROUP BY page),
t AS (SELECT page, count(*) AS n_tables FROM tables_ GROUP BY page), c AS (SELECT page, count(*) AS n_cells FROM cells WHERE text <> '' GROUP BY page), i AS (SELECT page, count(*) AS pictures, max(least(1.0, (x1 - x0) * (y1 - y0) * 12 / 518400.0)) AS top FROM images GROUP BY page),
j AS (SELECT page, coalesce(boxes, 0) AS boxes, coalesce(paragraphs, 0) AS paragraphs, coalesce(bullets, 0) AS bullets, coalesce(auto, 0) AS auto, coalesce(lines_, 0) AS lines_, coalesce(n_tables, 0) AS n_tables, coalesce(n_cells, 0) AS n_cells, coalesce(pictures, 0) AS pictures, CASE WHEN top >= 0.85 THEN top ELSE 0.0 END AS raster FROM pages_ LEFT JOIN b USING (page) LEFT JOIN s USING (page) LEFT JOIN t USING (page) LEFT JOIN c USING (page) LEFT JOIN i USING (page)),
u AS (SELECT *, greatest(paragraphs, boxes) + n_cells AS units, auto + n_tables * 4 + lines_ * 0.5::DOUBLE AS structure FROM j)
SELECT page, boxes, paragraphs::BIGINT AS paragraphs, bullets, auto, n_tables, pictures, boxes + auto + n_tables + lines_ AS native, round(greatest(0.0, least(1.0, least(1.0, units / 6.0::DOUBLE) * 0.4::DOUBLE + least(1.0, structure / 8.0::DOUBLE) * 0.45::DOUBLE + 0.15::DOUBLE - raster * CASE WHEN units = 0 AND boxes + auto + n_tables + lines_ = 0 THEN 0.4::DOUBLE WHEN structure >= 2 THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END)), 6) AS score FROM u""".replace("lines_", "n_lines"))
def editability(v):
    """How much of a page can be edited: counts by type of object, and the score."""
    n_par = F.greatest(F.lit(1), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")))
    parts = [
        v.blocks.groupBy("page").agg(F.count(F.lit(1)).alias("boxes"), F.sum(n_par).alias("paragraphs"), F.count_if(F.startswith("text", F.lit("•"))).alias("bullets")),
        v.shapes.groupBy("page").agg(F.count_if(F.col("kind") != "line").alias("auto"), F.count_if(F.col("kind") == "line").alias("n_lines")),
        v.tables_.groupBy("page").agg(F.count(F.lit(1)).alias("n_tables")),
        v.cells.where("text <> ''").groupBy("page").agg(F.count(F.lit(1)).alias("n_cells")),
        v.images.groupBy("page").agg(F.count(F.lit(1)).alias("pictures"), F.max(F.least(F.lit(1.0), box().w * box().h * 12 / 518400.0)).alias("top")),
    ]
    rows = v.pages_.select("page")
    for p in parts:
        rows = rows.join(p, "page", "left")
    rows = rows.na.fill(0, ["boxes", "paragraphs", "bullets", "auto", "n_lines", "n_tables", "n_cells", "pictures"])
    raster = F.when(F.col("top") >= 0.85, F.col("top")).otherwise(0.0)
    units = F.greatest("paragraphs", "boxes") + F.col("n_cells")
    structure = F.col("auto") + F.col("n_tables") * 4 + F.col("n_lines") * 0.5
    native = F.col("boxes") + F.col("auto") + F.col("n_tables") + F.col("n_lines")
    weight = F.when((units == 0) & (native == 0), 0.4).when(structure >= 2, 0.1).otherwise(0.15)
    score = A.clamp01(F.least(F.lit(1.0), units / 6.0) * 0.4 + F.least(F.lit(1.0), structure / 8.0) * 0.45 + 0.15 - raster * weight)
    return rows.select("page", "boxes", "paragraphs", "bullets", "auto", "n_tables", "pictures", native.alias("native"), F.round(score, 6).alias("score"))


@query("agg_trimmed", "AGG-28 AGG-29", """
WITH r AS (SELECT page, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY y1 - y0, id) AS i, count(*) OVER (PARTITION BY page) AS n FROM blocks)
SELECT page, round(avg(h), 6) AS mean, round(quantile_cont(h, 0.1), 6) AS p10, round(quantile_cont(h, 0.5), 6) AS p50, round(quantile_cont(h, 0.9), 6) AS p90 FROM r WHERE i > floor(n * 0.1::DOUBLE) AND i <= n - floor(n * 0.1::DOUBLE) GROUP BY page""")
def trimmed_heights(v):
    rows = A.trimmed(v.blocks.withColumn("h", box().h), ["page"], "h", "id")
    return rows.groupBy("page").agg(F.round(F.avg("h"), 6).alias("mean"), *[F.round(F.percentile("h", F.lit(p)), 6).alias(f"p{int(100 * p)}") for p in (0.1, 0.5, 0.9)])
