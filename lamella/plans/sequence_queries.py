"""Queries over orders, runs and positional matches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions import geometry as G
from lamella.functions import scalar as X
from lamella.functions import text as T
from lamella.functions.geometry import Box, box
from lamella.operators import sequence as Q
from lamella.operators import spatial as J
from lamella.sources.views import PAGE_H, PAGE_W

from . import sqltext as S
from .registry import query

_RO = "round(y0, 1), round(x0, 1), id"


@query("win_reading_order", "WIN-01 SORT-01 SORT-02 SORT-09", f"""
SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY {_RO})::INT AS rank, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, x0, id)::INT AS ocr_rank,
 row_number() OVER (PARTITION BY page ORDER BY confidence, reading_order, id)::INT AS by_confidence, row_number() OVER (PARTITION BY page ORDER BY source, reading_order, id)::INT AS by_source FROM blocks""")
def reading_order(v):
    w = Window.partitionBy("page")
    rows = Q.reading_order(v.blocks, ["page"])
    return rows.select("page", "id", "rank", F.row_number().over(w.orderBy(box().cy, "x0", "id")).alias("ocr_rank"), F.row_number().over(w.orderBy("confidence", "reading_order", "id")).alias("by_confidence"), F.row_number().over(w.orderBy("source", "reading_order", "id")).alias("by_source"))


@query("win_line_sessions", "WIN-02", """
WITH p AS (SELECT *, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM blocks WHERE source = 'native' WINDOW w AS (PARTITION BY page ORDER BY y0, x0, id)),
m AS (SELECT *, greatest(1.0, py1 - py0) AS ph, greatest(1.0, y1 - y0) AS h, greatest(0.0, least(py1, y1) - greatest(py0, y0)) AS vo, greatest(0.0, greatest(x0 - px1, px0 - x1)) AS hg FROM p), k AS (SELECT *, vo / least(ph, h) >= 0.45::DOUBLE AS same FROM m),
b AS (SELECT *, CASE WHEN px0 IS NULL THEN true WHEN same AND hg > 76.8::DOUBLE THEN true WHEN NOT same AND y0 - py1 BETWEEN 0 AND (ph + h) / 2 * 1.35::DOUBLE THEN false WHEN same AND hg <= (ph + h) / 2 * 0.6::DOUBLE THEN false ELSE true END AS brk FROM k)
SELECT page, id, sum(brk::INT) OVER (PARTITION BY page ORDER BY y0, x0, id ROWS UNBOUNDED PRECEDING)::BIGINT AS line_group FROM b""")
def line_sessions(v):
    """Stacked or abutting lines go on in one group; wide gaps in a line split."""
    order = ["y0", "x0", "id"]
    rows = Q.before(v.blocks.where("source = 'native'"), ["page"], order, *Box._fields)
    a, b = Box(*[F.col(f"p_{c}") for c in Box._fields]), box()
    one = F.lit(1.0)
    ph, h = F.greatest(one, a.h), F.greatest(one, b.h)
    same = G.vertical_overlap(a, b) / F.least(ph, h) >= 0.45
    side = F.greatest(F.lit(0.0), F.greatest(b.x0 - a.x1, a.x0 - b.x1))
    mid = (ph + h) / 2
    stays = F.when(same & (side > PAGE_W * 0.08), False).when(~same & (b.y0 - a.y1).between(F.lit(0.0), mid * 1.35), True).when(same & (side <= mid * 0.6), True).otherwise(False)
    return Q.islands(rows, ["page"], order, a.x0.isNull() | ~stays, "line_group").select("page", "id", "line_group")


@query("win_cluster_1d", "WIN-03", """
WITH p AS (SELECT page, id, x0, coalesce(x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0, id) > 4, true) AS brk FROM blocks), g AS (SELECT *, sum(brk::INT) OVER (PARTITION BY page ORDER BY x0, id ROWS UNBOUNDED PRECEDING) AS cluster FROM p)
SELECT page, cluster::BIGINT AS cluster, avg(x0) AS centre, count(*) AS n FROM g GROUP BY ALL""")
def cluster_1d(v):
    return Q.clusters_1d(v.blocks, ["page"], "x0", "id", 4.0)


@query("win_zebra_runs", "WIN-04", """
WITH p AS (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM bands WINDOW w AS (PARTITION BY page ORDER BY y0, x0, id)), b AS (SELECT *, NOT coalesce(abs(x0 - px0) <= 120 AND abs(x1 - px1) <= 300 AND y0 - py1 BETWEEN -60 AND 60, false) AS brk FROM p),
g AS (SELECT *, sum(brk::INT) OVER (PARTITION BY page ORDER BY y0, x0, id ROWS UNBOUNDED PRECEDING) AS run FROM b), f AS (SELECT *, lag(fill) OVER (PARTITION BY page, run ORDER BY y0, x0, id) AS pf FROM g)
SELECT page, run::BIGINT AS run, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, arg_max(y1, row(y0, x0, id)) AS y1, count(*) FILTER (WHERE fill <> pf) AS alternations FROM f GROUP BY page, run HAVING count(*) >= 3 AND count(DISTINCT fill) >= 2 AND count(*) FILTER (WHERE fill <> pf) >= greatest(1, count(*) - 2)""")
def zebra_runs(v):
    """Stacks of alternating bands. The tolerances are wide, as the sample boxes are not drawn as tables."""
    return zebra_stacks(v.bands, 120.0, 300.0, -60.0, 60.0)


def zebra_stacks(bands, left_drift: float = 8.0, right_drift: float = 8.0, least_gap: float = -2.0, most_gap: float = 6.0):
    order = ["y0", "x0", "id"]
    rows = Q.before(bands, ["page"], order, "x0", "x1", "y1")
    goes_on = (F.abs(F.col("x0") - F.col("p_x0")) <= left_drift) & (F.abs(F.col("x1") - F.col("p_x1")) <= right_drift) & (F.col("y0") - F.col("p_y1")).between(least_gap, most_gap)
    rows = Q.before(Q.islands(rows, ["page"], order, ~goes_on, "run"), ["page", "run"], order, "fill")
    g = rows.groupBy("page", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max_by("y1", F.struct(*order)).alias("by1"), F.count_if(F.col("fill") != F.col("p_fill")).alias("alternations"), F.count_distinct("fill").alias("fills")
    )
    kept = g.where("n >= 3 AND fills >= 2 AND alternations >= greatest(1, n - 2)")
    return kept.select("page", "run", "n", *[F.col(f"b{c}").alias(c) for c in Box._fields], "alternations")


@query("win_column_order", "WIN-07", f"""
WITH s AS (SELECT *, (x0 + x1) / 2 >= max(x1) OVER (PARTITION BY page) * 0.5::DOUBLE AS on_right FROM regions), c AS (SELECT *, count(*) FILTER (WHERE on_right) OVER (PARTITION BY page) >= 2 AND count(*) FILTER (WHERE NOT on_right) OVER (PARTITION BY page) >= 2 AS split FROM s)
SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN split AND on_right THEN 1 ELSE 0 END, {_RO})::INT AS rank FROM c""")
def column_order(v):
    """Two columns if both halves of the regions' width have two or more."""
    w = Window.partitionBy("page")
    right = box().cx >= F.max("x1").over(w) * 0.5
    rows = v.regions.withColumn("on_right", right)
    rows = rows.withColumn("split", (F.count_if("on_right").over(w) >= 2) & (F.count_if(~F.col("on_right")).over(w) >= 2))
    return Q.reading_order(rows, ["page"], first=[F.when(F.col("split") & F.col("on_right"), 1).otherwise(0)]).select("page", "id", "rank")


@query("win_reindex", "WIN-08", f"SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN reading_order = 0 THEN 10000 ELSE reading_order END, {_RO})::INT AS rank FROM blocks")
def reindex(v):
    """Ranks anew by the order so far, of which 0 counts as missing."""
    return Q.reading_order(v.blocks, ["page"], first=[F.when(F.col("reading_order") == 0, 10000).otherwise(F.col("reading_order"))]).select("page", "id", "rank")


_BUL = r"^\s*([•◦▪‣·*-]|[0-9]{1,3}[.)]|[A-Za-z][.)]|\([A-Za-z0-9]{1,3}\)|[ivxIVX]{1,5}[.)])\s+"


@query("win_paragraphs", "WIN-10 WIN-19", rf"""
WITH l AS (SELECT *, CASE WHEN len(ls) = 0 THEN [text] ELSE ls END AS lines_of FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM blocks)),
e AS (SELECT page, id, x0, y0, y1, font_size, len(lines_of) AS n, unnest(range(len(lines_of)))::INT AS i, trim(unnest(lines_of)) AS raw FROM l),
q AS (SELECT *, (y0 + (y1 - y0) * i / n) + 0.85::DOUBLE * greatest(font_size, 1.0) AS baseline FROM e WHERE raw <> ''), p AS (SELECT *, lag(baseline) OVER w AS pb, lag(font_size) OVER w AS pf FROM q WINDOW w AS (PARTITION BY page, id ORDER BY i))
SELECT page, id, i, regexp_matches(raw, '{_BUL}') AS is_list, CASE WHEN regexp_matches(raw, '{_BUL}') THEN CASE WHEN trim(regexp_replace(raw, '{_BUL}', '')) = '' THEN raw ELSE trim(regexp_replace(raw, '{_BUL}', '')) END ELSE raw END AS text, round(baseline, 9) AS baseline,
 round(CASE WHEN pb IS NULL THEN NULL WHEN baseline - pb - 1.2::DOUBLE * pf <= 0.25::DOUBLE THEN 0.0::DOUBLE ELSE baseline - pb - 1.2::DOUBLE * pf END, 9) AS space_before FROM p""")
def paragraphs(v):
    """The lines of a block as paragraphs, with list marks off and the space before each."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = v.blocks.withColumn("ls", F.when(F.size(lines) == 0, F.array("text")).otherwise(lines))
    rows = rows.select("page", "id", "y0", "y1", "font_size", F.size("ls").alias("n"), F.posexplode("ls").alias("i", "line")).withColumn("raw", F.trim("line")).where("raw <> ''")
    top = F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("i") / F.col("n")
    rows = rows.withColumn("baseline", G.baseline(Box(F.lit(0.0), top, F.lit(0.0), top), F.col("font_size")))
    rows = Q.before(rows, ["page", "id"], ["i"], "baseline", "font_size")
    marked = T.is_list_line(F.col("raw"))
    return rows.select("page", "id", "i", marked.alias("is_list"), F.when(marked, T.without_mark(F.col("raw"))).otherwise(F.col("raw")).alias("text"), F.round("baseline", 9).alias("baseline"), F.round(X.space_before(F.col("baseline"), F.col("p_baseline"), F.col("p_font_size")), 9).alias("space_before"))


@query("win_title_pick", "WIN-15 SORT-12", """
WITH t AS (SELECT b.page, b.id, b.y0, row_number() OVER (PARTITION BY b.page ORDER BY b.y0, -b.font_size, b.id) AS n FROM blocks b JOIN annotations a USING (page, id) WHERE a.role = 'title') SELECT page, id FROM t WHERE n = 1 AND y0 <= 216""")
def title_pick(v):
    """The one title of a page: the topmost, of equals the largest, unless too low."""
    t = v.blocks.join(v.annotations.where("role = 'title'").select("page", "id"), ["page", "id"])
    top = t.groupBy("page").agg(F.min(F.struct("y0", (-F.col("font_size")).alias("f"), "id")).alias("t"))
    return top.where(F.col("t.y0") <= PAGE_H * 0.4).select("page", "t.id")


@query("win_line_drift", "WIN-16", """
WITH e AS (SELECT page, (y0 + y1) / 2 AS y, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, id) AS i FROM blocks WHERE source = 'native'), o AS (SELECT page, (y0 + y1) / 2 AS y, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, id) AS i FROM blocks WHERE source = 'ocr'),
d AS (SELECT page, max(abs(e.y - o.y)) AS drift FROM e JOIN o USING (page, i) GROUP BY page) SELECT page, drift, round(least(1.0, drift / 12.0), 4) AS severity FROM d WHERE drift > 3""")
def line_drift(v):
    """Largest distance of expected and rendered lines that have the same place in their order."""
    at = F.row_number().over(Window.partitionBy("page").orderBy("y", "id"))
    side = lambda s, n: v.blocks.where(F.col("source") == s).select("page", "id", box().cy.alias("y")).withColumn("i", at).select("page", "i", F.col("y").alias(n))
    d = side("native", "e").join(side("ocr", "o"), ["page", "i"]).groupBy("page").agg(F.max(F.abs(F.col("e") - F.col("o"))).alias("drift"))
    return d.where("drift > 3").select("page", "drift", F.round(F.least(F.lit(1.0), F.col("drift") / 12.0), 4).alias("severity"))


@query("win_order_concordance", "WIN-17", """
SELECT a.page, count(*) AS pairs, count(*) FILTER (WHERE a.ord <= b.ord) AS correct, round(count(*) FILTER (WHERE a.ord <= b.ord)::DOUBLE / count(*), 6) AS score FROM annotations a JOIN annotations b ON a.page = b.page AND a.id < b.id GROUP BY a.page""")
def order_concordance(v):
    """Share of the pairs of a page that the planned order leaves in order."""
    a, b = (v.annotations.select("page", "id", "ord").alias(x) for x in "ab")
    met = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.id") < F.col("b.id")))
    g = met.groupBy("a.page").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("a.ord") <= F.col("b.ord")).alias("correct"))
    return g.select("page", "pairs", "correct", F.round(F.col("correct") / F.col("pairs"), 6).alias("score"))


_W = "(t.x1 - t.x0) * 0.85::DOUBLE"
_BAND = f"(s.fill IS NOT NULL AND s.y1 - s.y0 BETWEEN 8 AND 72 AND s.x1 - s.x0 >= {_W})"
_RULE = f"((s.stroke IS NOT NULL AND s.y1 - s.y0 <= 3 AND s.x1 - s.x0 >= {_W}) OR (s.fill IS NOT NULL AND least(s.x1 - s.x0, s.y1 - s.y0) <= 1.5 AND greatest(s.x1 - s.x0, s.y1 - s.y0) >= {_W}))"


@query("win_supporting_fills", "WIN-14", f"""
WITH m AS (SELECT t.page, t.id, t.x0 AS tx0, t.y0 AS ty0, t.x1 AS tx1, t.y1 AS ty1, s.x0, s.y0, s.x1, s.y1, s.id AS sid, {_BAND} AS band, s.y0 <= t.y0 + 20 AS header FROM tables_ t JOIN shapes s ON t.page = s.page AND ({_BAND} OR {_RULE}) AND s.y1 >= t.y0 - 2 AND s.y0 <= t.y1 + 2 AND ({S.share("s", "t")} >= 0.15 OR s.y0 BETWEEN t.y0 - 2 AND t.y0 + 20)),
g AS (SELECT page, id, least(min(x0), min(tx0)) AS x0, least(min(y0), min(ty0)) AS y0, greatest(max(x1), max(tx1)) AS x1, greatest(max(y1), max(ty1)) AS y1, count(*) AS n, count(*) FILTER (WHERE band) AS bands_, arg_min(sid, row(y0, sid)) FILTER (WHERE band AND header) AS header FROM m GROUP BY page, id)
SELECT page, id, x0, coalesce(h.y0, g.y0) AS y0, x1, y1, n, bands_ AS n_bands, header FROM g LEFT JOIN (SELECT page, id AS header, y0 FROM shapes) h USING (page, header)""".replace("SELECT page, id, x0, coalesce(h.y0, g.y0) AS y0, x1, y1, n,", "SELECT page, g.id, g.x0, coalesce(h.y0, g.y0) AS y0, g.x1, g.y1, n,"))
def supporting_fills(v):
    """Tables widened to the bands and rules that support them; the topmost band is the header."""
    t, s = box("a"), box("b")
    span = t.w * 0.85
    fill, stroke = F.col("b.fill").isNotNull(), F.col("b.stroke").isNotNull()
    band = fill & s.h.between(8, 72) & (s.w >= span)
    rule = (stroke & (s.h <= 3) & (s.w >= span)) | (fill & (F.least(s.w, s.h) <= 1.5) & (F.greatest(s.w, s.h) >= span))
    on = (band | rule) & (s.y1 >= t.y0 - 2) & (s.y0 <= t.y1 + 2) & ((G.share_of_first(s, t) >= 0.15) | s.y0.between(t.y0 - 2, t.y0 + 20))
    m = J.pairs(v.tables_, v.shapes, on).select("a.page", "a.id", *[F.col(f"a.{c}").alias(f"t{c}") for c in Box._fields], *[F.col(f"b.{c}").alias(c) for c in Box._fields], F.col("b.id").alias("sid"), band.alias("band"), (s.y0 <= t.y0 + 20).alias("head"))
    head = F.min(F.when(F.col("band") & F.col("head"), F.struct("y0", "sid")))
    g = m.groupBy("page", "id").agg(
        F.least(F.min("x0"), F.min("tx0")).alias("x0"), F.least(F.min("y0"), F.min("ty0")).alias("top"), F.greatest(F.max("x1"), F.max("tx1")).alias("x1"), F.greatest(F.max("y1"), F.max("ty1")).alias("y1"), F.count(F.lit(1)).alias("n"), F.count_if("band").alias("n_bands"), head.alias("h")
    )
    return g.select("page", "id", "x0", F.coalesce("h.y0", "top").alias("y0"), "x1", "y1", "n", "n_bands", F.col("h.sid").alias("header"))


_ISSUE = "CASE WHEN evidence THEN 0 ELSE 1 END, -severity, kind, id"


@query("sort_issues", "SORT-03 SORT-04", f"""
WITH p AS (SELECT page, sum(severity) AS total FROM issues GROUP BY page), o AS (SELECT page, row_number() OVER (PARTITION BY floor(page / 10.0::DOUBLE) ORDER BY -round(total, 6), page) AS page_rank FROM p)
SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY {_ISSUE})::INT AS rank, page_rank::INT AS page_rank FROM issues JOIN o USING (page)""")
def sort_issues(v):
    """Issues of a page by evidence and severity; pages of a deck by their severity."""
    p = v.issues.groupBy("page").agg(F.round(F.sum("severity"), 6).alias("total"))
    deck = F.floor(F.col("page") / 10.0)
    p = p.select("page", F.row_number().over(Window.partitionBy(deck).orderBy(F.desc("total"), "page")).alias("page_rank"))
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.when(F.col("evidence"), 0).otherwise(1), F.desc("severity"), "kind", "id"))
    return v.issues.withColumn("rank", rank).join(p, "page").select("page", "id", "rank", "page_rank")


_ACTIONS = "CASE WHEN kind IN ('text_overflow', 'extra_wrap') THEN ['widen_bbox', 'match_line_bboxes', 'shrink_font'] WHEN kind = 'line_drift' THEN ['match_line_bboxes', 'widen_bbox', 'shrink_font'] WHEN element = 'text' THEN ['widen_bbox', 'match_line_bboxes', 'shrink_font'] ELSE ['raster_fallback'] END"


def proposed_actions(kind, element):
    """Fixes for an issue, in the order in which to try them."""
    text = F.array(*map(F.lit, ("widen_bbox", "match_line_bboxes", "shrink_font")))
    drift = F.array(*map(F.lit, ("match_line_bboxes", "widen_bbox", "shrink_font")))
    return F.when(kind.isin("text_overflow", "extra_wrap"), text).when(kind == "line_drift", drift).when(element == "text", text).otherwise(F.array(F.lit("raster_fallback")))


@query("sort_fix_candidates", "SORT-06 STATE-02 UDF-06", f"""
WITH i AS (SELECT *, id % 7 AS el, row_number() OVER (PARTITION BY page ORDER BY {_ISSUE}) AS rank, {_ACTIONS} AS acts FROM issues), a AS (SELECT page, id, el, rank, unnest(acts) AS action, unnest(range(len(acts))) AS pos FROM i),
d AS (SELECT *, row_number() OVER (PARTITION BY page, el, action ORDER BY rank, pos) AS n FROM a) SELECT page, id, el, action, row_number() OVER (PARTITION BY page ORDER BY rank, pos)::INT AS place FROM d WHERE n = 1""")
def fix_candidates(v):
    """What to try on a page, in order, each element and action once."""
    order = [F.when(F.col("evidence"), 0).otherwise(1), F.desc("severity"), F.col("kind"), F.col("id")]
    i = J.ranked(v.issues.withColumn("el", F.col("id") % 7), ["page"], *order)
    a = i.select("page", "id", "el", "rank", F.posexplode(proposed_actions(F.col("kind"), F.col("element"))).alias("pos", "action"))
    first = a.groupBy("page", "el", "action").agg(F.min(F.struct("rank", "pos", "id")).alias("f")).select("page", "el", "action", "f.*")
    return J.ranked(first, ["page"], F.col("rank"), F.col("pos"), name="place").select("page", "id", "el", "action", "place")


@query("sort_paint_stack", "SORT-08 SNK-02", """
WITH u AS (SELECT page, id, 0 AS layer, z, 'shape' AS kind FROM shapes WHERE opacity >= 1 AND fill IS NOT NULL AND kind = 'rect' UNION ALL SELECT page, page AS id, 1, 0, 'raster' FROM pages_ UNION ALL SELECT page, id, 2, z, 'shape' FROM shapes WHERE NOT (opacity >= 1 AND fill IS NOT NULL AND kind = 'rect') AND z < 35 UNION ALL SELECT page, id, 2, z, 'image' FROM images
 UNION ALL SELECT page, id, 3, z, 'table' FROM tables_ UNION ALL SELECT page, id, 4, z, 'shape' FROM shapes WHERE NOT (opacity >= 1 AND fill IS NOT NULL AND kind = 'rect') AND z >= 35 UNION ALL SELECT page, id, 5, reading_order, 'text' FROM blocks)
SELECT page, kind, id, row_number() OVER (PARTITION BY page ORDER BY layer, z, kind, id)::INT AS place FROM u""")
def paint_stack(v):
    """All elements of a page in the order in which they are painted."""
    under = F.coalesce((F.col("opacity") >= 1) & F.col("fill").isNotNull() & (F.col("kind") == "rect"), F.lit(False))
    layer = F.when(under, 0).when(F.col("z") < 35, 2).otherwise(4)
    part = lambda df, n, z, kind: df.select("page", "id", (F.lit(n) if isinstance(n, int) else n).alias("layer"), z.cast("int").alias("z"), F.lit(kind).alias("kind"))
    z = F.col("z")
    all_ = part(v.shapes, layer, z, "shape").unionByName(part(v.pages_.withColumn("id", F.col("page")), 1, F.lit(0), "raster")).unionByName(part(v.images, 2, z, "image"))
    all_ = all_.unionByName(part(v.tables_, 3, z, "table")).unionByName(part(v.blocks, 5, F.col("reading_order"), "text"))
    return J.ranked(all_, ["page"], *map(F.col, ("layer", "z", "kind", "id")), name="place").select("page", "kind", "id", "place")


@query("set_watermark_union", "SET-02", """
WITH m AS (SELECT page, id, x0, y0 FROM blocks WHERE x0 >= 700 AND y0 >= 440 AND source = 'ocr') SELECT page, id, x0, y0 FROM m UNION ALL SELECT page, -1, 691.2::DOUBLE, 486.0::DOUBLE FROM pages_ p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page = p.page)""")
def watermark_union(v):
    """Marks found on a page, or one made up where there is none."""
    found = v.blocks.where("x0 >= 700 AND y0 >= 440 AND source = 'ocr'").select("page", "id", "x0", "y0")
    none = v.pages_.select("page").join(found.select("page"), "page", "left_anti")
    return found.unionByName(none.select("page", F.lit(-1).cast("long").alias("id"), F.lit(691.2).alias("x0"), F.lit(486.0).alias("y0")))


@query("set_tables", "SET-04 JOIN-17", f"""
WITH i AS (SELECT page, id + 20000 AS id, x0, y0, x1, y1 FROM bands) SELECT page, id, 'ruled' AS kind FROM tables_ UNION ALL SELECT page, id, 'inferred' FROM i a WHERE NOT EXISTS (SELECT 1 FROM tables_ b WHERE a.page = b.page AND ({S.share("a", "b")} >= 0.4 OR {S.share("b", "a")} >= 0.4))""")
def all_tables(v):
    """Ruled tables, and inferred ones that overlap none of them either way."""
    inferred = v.bands.withColumn("id", F.col("id") + 20000)
    free = J.anti(inferred, v.tables_, lambda a, b: (G.share_of_first(a, b) >= 0.4) | (G.share_of_first(b, a) >= 0.4))
    return v.tables_.select("page", "id", F.lit("ruled").alias("kind")).unionByName(free.select("page", "id", F.lit("inferred").alias("kind")))


@query("set_split_background", "SET-07", """
WITH b AS (SELECT *, (x1 - x0) * (y1 - y0) / 518400.0 >= 0.03 AND stroke IS NOT NULL AND coalesce(stroke_width, 1) > 0 AS cut FROM shapes) SELECT page, id::VARCHAR AS id, fill, CASE WHEN NOT coalesce(cut, false) THEN stroke END AS stroke, z FROM b UNION ALL SELECT page, concat(id, '_outline'), NULL, stroke, greatest(z + 1, 1) FROM b WHERE cut""")
def split_background(v):
    """A stroked page background becomes a fill below and an outline above."""
    cut = F.coalesce((box().w * box().h / (PAGE_W * PAGE_H) >= 0.03) & F.col("stroke").isNotNull() & (F.coalesce("stroke_width", F.lit(1.0)) > 0), F.lit(False))
    key = F.col("id").cast("string")
    whole = F.struct(key.alias("id"), F.col("fill"), F.col("stroke"), F.col("z"))
    fill = F.struct(key.alias("id"), F.col("fill"), F.lit(None).cast("string").alias("stroke"), F.col("z"))
    line = F.struct(F.concat(key, F.lit("_outline")).alias("id"), F.lit(None).cast("string").alias("fill"), F.col("stroke"), F.greatest(F.col("z") + 1, F.lit(1)).alias("z"))
    return v.shapes.select("page", F.explode(F.when(cut, F.array(fill, line)).otherwise(F.array(whole))).alias("s")).select("page", "s.*")
