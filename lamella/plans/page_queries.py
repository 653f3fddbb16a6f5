"""Queries over page-local operators with growing state.

Those without check SQL are tested against brute-force versions on small pages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.functions import geometry as G
from lamella.functions import rules as R
from lamella.functions import text as T
from lamella.functions.geometry import box
from lamella.operators import pages as P
from lamella.operators import spatial as J
from lamella.sources.views import PAGE_H, PAGE_W

from . import sqltext as S
from .registry import query
from .text_queries import _BUL


_FIG = "STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]"
_MEETS = "greatest(0.0, least(f.x1, k.x1) - greatest(f.x0, k.x0)) * greatest(0.0, least(f.y1, k.y1) - greatest(f.y0, k.y0)) / greatest(1.0, (f.x1 - f.x0) * (f.y1 - f.y0)) >= 0.6"


@query("page_merged_figures", "FLT-20", f"""
WITH RECURSIVE f AS (SELECT page, id, x0, y0, x1, y1, row_number() OVER (PARTITION BY page ORDER BY id) AS n FROM regions f WHERE label IN ('figure', 'chart') AND NOT EXISTS (SELECT 1 FROM images k WHERE k.page = f.page AND {_MEETS})),
r AS (SELECT page, 0::BIGINT AS n, []::{_FIG} AS kept FROM (SELECT DISTINCT page FROM f) UNION ALL SELECT r.page, f.n, CASE WHEN len(list_filter(r.kept, lambda k: {_MEETS})) = 0 THEN list_append(r.kept, {{'id': f.id, 'x0': f.x0, 'y0': f.y0, 'x1': f.x1, 'y1': f.y1}}) ELSE r.kept END FROM r JOIN f ON f.page = r.page AND f.n = r.n + 1),
l AS (SELECT page, arg_max(kept, n) AS kept FROM r GROUP BY page)
SELECT page, id, 'image' AS kind FROM images UNION ALL SELECT page, k.id, 'figure' FROM (SELECT page, unnest(kept) AS k FROM l)""")
def merged_figures(v):
    """Images of a page, and the figure regions that none before them covers to 0.6."""

    def work(images: pd.DataFrame, figures: pd.DataFrame) -> pd.DataFrame:
        figures = figures.sort_values("id")
        kept = P.grow_free(P.boxes(figures), P.boxes(images), lambda a, b: P.intersections(a, b) / np.maximum(1.0, P.areas(a))[:, None] >= 0.6)
        return pd.concat([images[["id"]].assign(kind="image"), figures.iloc[kept][["id"]].assign(kind="figure")])

    figures = v.regions.where("label IN ('figure', 'chart')").select("page", "id", *P.BOX)
    return P.by_page_pair(v.images.select("page", "id", *P.BOX), figures, work, "id long, kind string")


_FIRST_FREE = "list_filter({cands}, lambda x: NOT coalesce(list_contains({taken}, x.k), false))[1]"


@query("page_grouping_scores", "JOIN-19 JOIN-20 SRC-17", f"""
WITH RECURSIVE p AS (SELECT a.page, a.id AS f, b.id AS w, {S.iou("a", "b")} AS score, {S.inter("a", "b")} AS com, {S.area("a")} AS fa, {S.area("b")} AS wa, regexp_matches(a.text, '{_BUL}') AND b.label = 'list' AS listed FROM blocks a JOIN regions b ON a.page = b.page AND {S.inter("a", "b")} > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, f DESC, w DESC) AS n FROM p WHERE score >= 0.35),
r AS (SELECT page, 0::BIGINT AS n, []::BIGINT[] AS fs, []::BIGINT[] AS ws, false AS ok, 0.0::DOUBLE AS score FROM (SELECT DISTINCT page FROM o) UNION ALL SELECT r.page, o.n, CASE WHEN list_contains(r.fs, o.f) OR list_contains(r.ws, o.w) THEN r.fs ELSE list_append(r.fs, o.f) END, CASE WHEN list_contains(r.fs, o.f) OR list_contains(r.ws, o.w) THEN r.ws ELSE list_append(r.ws, o.w) END, NOT (list_contains(r.fs, o.f) OR list_contains(r.ws, o.w)), o.score FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1),
g AS (SELECT page, count(*) AS pairs, avg(score) AS mean FROM r WHERE ok GROUP BY page),
i AS (SELECT page, f, row_number() OVER (PARTITION BY page ORDER BY f) AS n, list(struct_pack(k := w, s := s) ORDER BY s DESC, w) AS cands FROM (SELECT *, greatest(score, 0.9 * com / greatest(wa, 1.0)) AS s FROM p WHERE listed) WHERE s >= 0.25 GROUP BY page, f),
l AS (SELECT page, 0::BIGINT AS n, []::BIGINT[] AS ws FROM (SELECT DISTINCT page FROM i) UNION ALL SELECT l.page, i.n, list_append(l.ws, {_FIRST_FREE.format(cands="i.cands", taken="l.ws")}.k) FROM l JOIN i ON i.page = l.page AND i.n = l.n + 1),
h AS (SELECT page, max(len(list_filter(ws, lambda x: x IS NOT NULL))) AS hits FROM l GROUP BY page), nf AS (SELECT page, count(*) AS n_found, count(*) FILTER (WHERE regexp_matches(text, '{_BUL}')) AS fl FROM blocks GROUP BY page), nw AS (SELECT page, count(*) AS n_wanted, count(*) FILTER (WHERE label = 'list') AS wl FROM regions GROUP BY page),
m AS (SELECT page, count(*) AS merges FROM (SELECT page, f FROM p WHERE com / greatest(wa, 1.0) >= 0.5 GROUP BY ALL HAVING count(*) >= 2) GROUP BY page), t AS (SELECT page, count(*) AS splits FROM (SELECT page, w FROM p WHERE com / greatest(fa, 1.0) >= 0.5 GROUP BY ALL HAVING count(*) >= 2) GROUP BY page),
z AS (SELECT page, coalesce(n_found, 0) AS n_found, coalesce(n_wanted, 0) AS n_wanted, coalesce(fl, 0) AS fl, coalesce(wl, 0) AS wl, coalesce(pairs, 0) AS pairs, coalesce(mean, 0.0) AS mean, coalesce(merges, 0) AS merges, coalesce(splits, 0) AS splits, coalesce(hits, 0)::DOUBLE AS hits FROM pages_ LEFT JOIN nf USING (page) LEFT JOIN nw USING (page) LEFT JOIN g USING (page) LEFT JOIN m USING (page) LEFT JOIN t USING (page) LEFT JOIN h USING (page)),
y AS (SELECT *, CASE WHEN fl + wl > 0 THEN CASE WHEN fl > 0 THEN hits / fl ELSE 0.0 END END AS lp, CASE WHEN fl + wl > 0 THEN CASE WHEN wl > 0 THEN hits / wl ELSE 0.0 END END AS lr FROM z)
SELECT page, n_found::INT AS n_found, n_wanted::INT AS n_wanted, CASE WHEN n_wanted > 0 THEN round(n_found::DOUBLE / n_wanted, 6) WHEN n_found = 0 THEN 0.0 ELSE -1.0 END AS ratio, round(mean, 6) AS mean_iou, merges::INT AS merges, splits::INT AS splits, (n_found - pairs)::INT AS unmatched_found, (n_wanted - pairs)::INT AS unmatched_wanted, lp AS list_precision, lr AS list_recall, CASE WHEN lp + lr <= 0 THEN 0.0 ELSE 2 * lp * lr / (lp + lr) END AS list_f1 FROM y""")
def grouping_scores(v):
    """Blocks of a page against its regions as the truth."""

    def work(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found, wanted = found.sort_values("id"), wanted.sort_values("id")
        return pd.DataFrame([P.grouping_scores(P.boxes(found), P.boxes(wanted), found["is_list"].to_numpy(bool), (wanted["label"] == "list").to_numpy())])

    found = v.blocks.select("page", "id", *P.BOX, T.is_list_line(F.col("text")).alias("is_list"))
    return P.by_page_pair(found, v.regions.select("page", "id", "label", *P.BOX), work, P.GROUPING_SCHEMA)


@query("join_grouping_errors", "JOIN-19", f"""
WITH p AS (SELECT a.page, a.id AS f, b.id AS w, {S.inter("a", "b")} / greatest({S.area("b")}, 1.0) >= 0.5 AS covers, {S.inter("a", "b")} / greatest({S.area("a")}, 1.0) >= 0.5 AS inside, {S.iou("a", "b")} >= 0.35 AS meets FROM blocks a JOIN regions b ON a.page = b.page AND {S.inter("a", "b")} > 0),
m AS (SELECT page, count(*) AS merges FROM (SELECT page, f FROM p WHERE covers GROUP BY ALL HAVING count(*) >= 2) GROUP BY page), s AS (SELECT page, count(*) AS splits FROM (SELECT page, w FROM p WHERE inside GROUP BY ALL HAVING count(*) >= 2) GROUP BY page), c AS (SELECT page, count(*) AS candidates FROM p WHERE meets GROUP BY page)
SELECT page, coalesce(merges, 0) AS merges, coalesce(splits, 0) AS splits, coalesce(candidates, 0) AS candidates FROM pages_ LEFT JOIN m USING (page) LEFT JOIN s USING (page) LEFT JOIN c USING (page)""")
def grouping_errors(v):
    """Blocks that cover two regions or more, regions that hold two blocks or more, and candidate pairs."""
    a, b = G.box("a"), G.box("b")
    common, one = G.intersection_area(a, b), F.lit(1.0)
    p = J.pairs(v.blocks, v.regions, common > 0).select("a.page", F.col("a.id").alias("f"), F.col("b.id").alias("w"), (common / F.greatest(G.area(b), one) >= 0.5).alias("covers"), (common / F.greatest(G.area(a), one) >= 0.5).alias("inside"), (G.iou(a, b) >= 0.35).alias("meets"))
    # A pair counts for its block and for its region, so that it is joined once.
    of_block = F.struct(F.lit(True).alias("is_block"), F.col("f").alias("id"), F.col("covers").alias("held"), F.col("meets").alias("meets"))
    of_region = F.struct(F.lit(False).alias("is_block"), F.col("w").alias("id"), F.col("inside").alias("held"), F.lit(False).alias("meets"))
    ends = p.where("covers OR inside OR meets").select("page", F.explode(F.array(of_block, of_region)).alias("e")).select("page", "e.*").where("held OR meets")
    held = ends.groupBy("page", "is_block", "id").agg(F.count_if("held").alias("n"), F.count_if("meets").alias("meets"))
    counts = held.groupBy("page").agg(F.count_if(F.col("is_block") & (F.col("n") >= 2)).alias("merges"), F.count_if(~F.col("is_block") & (F.col("n") >= 2)).alias("splits"), F.sum("meets").alias("candidates"))
    return v.pages_.select("page").join(counts, "page", "left").na.fill(0)


@query("page_acceptance", "JOIN-21", f"""
WITH RECURSIVE b AS (SELECT page, id, source, reading_order, role, role IN ('header', 'footer', 'page_number') AS margin, x0, y0, x1, y1, lower(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS t FROM blocks JOIN annotations USING (page, id)),
p AS (SELECT w.page, w.id AS w, f.id AS f, w.margin, f.reading_order AS ro, CASE WHEN w.t = '' THEN 0.0 WHEN f.t = w.t THEN 1.0 WHEN contains(w.t, f.t) OR contains(f.t, w.t) THEN 0.85 ELSE 0.0 END AS ts, {S.iou("f", "w")} AS place, greatest({S.iou("f", "w")}, {S.inter("f", "w")} / greatest({S.area("w")}, 1.0)) AS over FROM b w JOIN b f ON f.page = w.page AND f.source = 'native'),
s AS (SELECT page, w, bool_or(ts >= 0.85 OR (ts >= 0.5 AND over >= 0.15) OR over >= 0.5) AS still FROM p WHERE margin GROUP BY ALL), g AS (SELECT b.page, count(*) AS n_margin, count(*) FILTER (WHERE NOT coalesce(still, false)) AS n_filtered FROM b LEFT JOIN s ON s.page = b.page AND s.w = b.id WHERE margin GROUP BY b.page),
c AS (SELECT page, w, row_number() OVER (PARTITION BY page ORDER BY w) AS n, list(struct_pack(k := f, o := ro) ORDER BY score DESC, f) AS cands FROM (SELECT *, greatest(ts, 0.9 * place) AS score FROM p WHERE NOT margin) WHERE score >= 0.35 GROUP BY page, w),
r AS (SELECT page, 0::BIGINT AS n, []::BIGINT[] AS fs, []::INT[] AS os FROM (SELECT DISTINCT page FROM c) UNION ALL SELECT r.page, c.n, list_append(r.fs, {_FIRST_FREE.format(cands="c.cands", taken="r.fs")}.k), list_append(r.os, {_FIRST_FREE.format(cands="c.cands", taken="r.fs")}.o) FROM r JOIN c ON c.page = r.page AND c.n = r.n + 1),
o AS (SELECT page, list_filter(arg_max(os, n), lambda x: x IS NOT NULL) AS os FROM r GROUP BY page), e AS (SELECT page, i, os[i + 1] AS v FROM (SELECT page, os, unnest(range(len(os))) AS i FROM o)),
k AS (SELECT a.page, count(*) AS n_pairs, count(*) FILTER (WHERE a.v <= z.v) AS right_way FROM e a JOIN e z ON a.page = z.page AND a.i < z.i GROUP BY a.page), t AS (SELECT page, coalesce(bool_or(role = 'title'), false) = coalesce(bool_or(role = 'title') FILTER (WHERE source = 'native'), false) AS ok FROM b GROUP BY page)
SELECT page, ok::INT::DOUBLE AS title_accuracy, coalesce(n_margin, 0)::INT AS n_margin, coalesce(n_filtered, 0)::INT AS n_filtered, CASE WHEN n_margin > 0 THEN round(n_filtered::DOUBLE / n_margin, 6) END AS filter_rate, coalesce(n_pairs, 0)::INT AS n_pairs, CASE WHEN n_pairs > 0 THEN round(right_way::DOUBLE / n_pairs, 6) END AS order_score FROM t LEFT JOIN g USING (page) LEFT JOIN k USING (page)""")
def acceptance(v):
    """Planned native blocks of a page against labelled ones."""

    def work(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([P.acceptance(found.sort_values("id"), wanted.sort_values("id"))])

    labelled = v.blocks.select("page", "id", "text", "source", "reading_order", *P.BOX).join(v.annotations.select("page", "id", "role"), ["page", "id"])
    found = labelled.where("source = 'native'").drop("source")
    return P.by_page_pair(found, labelled.drop("source", "reading_order"), work, P.ACCEPTANCE_SCHEMA)


@query("page_components", "JOIN-28", """
WITH RECURSIVE e AS (SELECT a.page, a.id AS a, b.id AS b FROM images a JOIN images b ON a.page = b.page AND a.x0 - 8 <= b.x1 AND b.x0 <= a.x1 + 8 AND a.y0 - 8 <= b.y1 AND b.y0 <= a.y1 + 8), r AS (SELECT page, a, b FROM e UNION SELECT r.page, r.a, e.b FROM r JOIN e ON r.page = e.page AND r.b = e.a),
c AS (SELECT page, a AS id, min(b) AS component FROM r GROUP BY ALL) SELECT page, component, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM images JOIN c USING (page, id) GROUP BY ALL""")
def components(v):
    """Images within 8 points of one another, transitively, as one box."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        return pdf[["id", *P.BOX]].assign(component=pdf["id"].to_numpy()[P.box_components(P.boxes(pdf), 8.0)])

    rows = P.by_page(v.images.select("page", "id", *P.BOX), work, "id long, x0 double, y0 double, x1 double, y1 double, component long")
    return rows.groupBy("page", "component").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("page_ocr_lines", "WIN-05 AGG-14")
def ocr_lines(v):
    """Read fragments merged along their lines: extent, text, confidence by characters."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        return pdf[["id"]].assign(run=P.line_groups(P.boxes(pdf)))

    ocr = v.blocks.where("source = 'ocr'")
    rows = ocr.join(P.by_page(ocr.select("page", "id", *P.BOX), work, "id long, run long"), ["page", "id"])
    n = F.length("text")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("x0", "id", "text"))), lambda x: x["text"])
    merged = rows.groupBy("page", "run").agg(
        F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"), pieces.alias("pieces"), (F.sum(F.col("confidence") * n) / F.greatest(F.lit(1), F.sum(n))).alias("confidence")
    )
    return merged.select("page", "run", *[F.col(f"b{c}").alias(c) for c in P.BOX], T.join_pieces(F.col("pieces")).alias("text"), F.round("confidence", 6).alias("confidence"))


#: Each step takes one block: the next that goes on with the region's last member, else the first that is free.
@query("page_heuristic_regions", "WIN-09", f"""
WITH RECURSIVE m AS (SELECT *, median(font_size) OVER (PARTITION BY page) AS base, regexp_matches(text, '{_BUL}') AS listed FROM blocks), t AS (SELECT DISTINCT a.page, a.id FROM blocks a JOIN tables_ b ON a.page = b.page AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND a.y0 - b.y1 BETWEEN 0 AND 40),
b AS (SELECT m.*, row_number() OVER (PARTITION BY m.page ORDER BY round(y0, 1), round(x0, 1), m.id) AS i, CASE WHEN y1 <= 0.06::DOUBLE * 540 AND font_size < 1.2::DOUBLE * base THEN 'header' WHEN y0 >= 0.9::DOUBLE * 540 AND regexp_matches(trim(text), '^[0-9]{{1,4}}$') THEN 'page_number' WHEN y0 >= 0.93::DOUBLE * 540 AND t.id IS NULL THEN 'footer'
 WHEN font_size >= 1.4::DOUBLE * base AND y0 <= 0.28::DOUBLE * 540 THEN 'title' WHEN listed THEN 'list' WHEN regexp_matches(trim(text), '^(Figure|Table|Fig\\.)\\s') AND font_size <= base THEN 'caption' ELSE 'text' END AS label FROM m LEFT JOIN t ON m.page = t.page AND m.id = t.id),
e AS (SELECT a.page, a.i, list(struct_pack(j := b.i, l := b.label, s := b.listed) ORDER BY b.i) AS nexts FROM b a JOIN b ON a.page = b.page AND a.i < b.i AND b.label IN ('text', 'list', 'caption') AND CASE WHEN greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1.0, least(a.y1 - a.y0, b.y1 - b.y0)) >= 0.45 THEN b.x0 - a.x1 <= least(0.08::DOUBLE * 960, 0.6::DOUBLE * (a.y1 - a.y0 + b.y1 - b.y0) / 2)
 ELSE b.y0 - a.y1 BETWEEN -0.2::DOUBLE * (b.y1 - b.y0) AND 1.35::DOUBLE * (b.y1 - b.y0) AND abs(a.x0 + a.x1 - b.x0 - b.x1) / 2 <= 0.18::DOUBLE * 960 AND (abs(a.x0 - b.x0) <= 0.12::DOUBLE * 960 OR b.listed) END GROUP BY a.page, a.i),
n AS (SELECT page, list(struct_pack(j := i, l := label, s := listed) ORDER BY i) AS all_ FROM b GROUP BY page),
r AS (SELECT page, 0::BIGINT AS n, []::BIGINT[] AS used, struct_pack(j := 0::BIGINT, l := 'none', s := false) AS last, -1::BIGINT AS region, 'none' AS label, false AS listed FROM n
 UNION ALL SELECT page, n + 1, list_append(used, coalesce(nxt, fresh).j), coalesce(nxt, fresh), CASE WHEN nxt IS NULL THEN region + 1 ELSE region END, CASE WHEN nxt IS NULL THEN fresh.l WHEN nxt.l = 'list' THEN 'list' ELSE label END, CASE WHEN nxt IS NULL THEN fresh.s ELSE listed OR nxt.s END
 FROM (SELECT r.*, CASE WHEN r.label IN ('text', 'list', 'caption') THEN list_filter(coalesce(e.nexts, []), lambda x: NOT list_contains(r.used, x.j) AND NOT (r.label = 'list' AND x.l <> 'list' AND NOT x.s))[1] END AS nxt, list_filter(n.all_, lambda x: NOT list_contains(r.used, x.j))[1] AS fresh FROM r JOIN n ON n.page = r.page LEFT JOIN e ON e.page = r.page AND e.i = r.last.j) WHERE fresh IS NOT NULL),
f AS (SELECT page, region, arg_max(label, n) AS label, bool_or(listed) AS listed FROM r WHERE n > 0 GROUP BY ALL)
SELECT b.page, b.id, r.region, CASE WHEN f.listed THEN 'list' ELSE f.label END AS label FROM r JOIN b ON r.page = b.page AND r.last.j = b.i JOIN f ON f.page = r.page AND f.region = r.region WHERE r.n > 0""")
def heuristic_regions(v):
    """Regions grown from the blocks of a page without a layout model."""
    rows = v.blocks.withColumn("base", F.median("font_size").over(Window.partitionBy("page")))
    rows = J.flagged(rows, v.tables_, lambda a, b: (F.least(a.x1, b.x1) > F.greatest(a.x0, b.x0)) & (a.y0 - b.y1).between(0, 40), "blocked")
    label = R.label_by_place(box(), F.col("font_size"), F.col("base"), F.col("text"), PAGE_W, PAGE_H, F.col("blocked"))
    rows = rows.select("page", "id", *P.BOX, label.alias("label"), T.is_list_line(F.col("text")).alias("is_list"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(ry=pdf["y0"].round(1), rx=pdf["x0"].round(1)).sort_values(["ry", "rx", "id"]).reset_index(drop=True)
        region, labels = P.paragraph_regions(P.boxes(pdf), pdf["label"].tolist(), pdf["is_list"].to_numpy(bool), PAGE_W)
        return pdf[["id"]].assign(region=region, label=[labels[r] for r in region])

    return P.by_page(rows, work, "id long, region long, label string").select("page", "id", "region", "label")


_GRID = "kind string, n_rows int, n_cols int, x0 double, y0 double, x1 double, y1 double, occupancy double, widths array<double>, heights array<double>, aligns array<string>, cells array<array<string>>"


def _grid_rows(grids: list[P.Grid]) -> pd.DataFrame:
    names = [x.split()[0] for x in _GRID.split(", ")]
    rows = [("zebra" if g.fills else "text", *g.low.shape, *g.box.tolist(), round(g.occupancy, 6), g.widths.tolist(), g.heights.tolist(), g.aligns, g.texts) for g in grids]
    return pd.DataFrame(rows, columns=names)


def _cell_words(v):
    """A narrow word for each cell with a text: words that stand in rows and columns."""
    x0, y0 = F.col("x0"), F.col("y0")
    key = F.col("table_id") * 100 + F.col("row") * 10 + F.col("col")
    return v.cells.where("trim(text) <> ''").select("page", key.alias("id"), x0, y0, (x0 + 12).alias("x1"), (y0 + 12).alias("y1"), "text")


@query("page_text_grids", "WIN-11 WIN-12 SORT-07")
def text_grids(v):
    """Tables without rules from the alignment of words alone."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return _grid_rows(P.text_grids(P.boxes(pdf), pdf["text"].tolist()))

    return P.by_page(_cell_words(v), work, _GRID)


@query("page_inferred_tables", "SET-03 WIN-13 WIN-04 JOIN-17")
def inferred_tables(v):
    """All tables without rules of a page: on zebra stacks, then from words, free of ruled tables."""
    from .sequence_queries import zebra_stacks

    stacks = zebra_stacks(v.bands, 120.0, 300.0, -60.0, 60.0).select("page", F.col("run").alias("id"), *P.BOX, F.lit("stack").alias("text"))
    on = J.pairs(stacks, v.bands.select("page", "id", "fill", *P.BOX), lambda a, b: (b.x0 >= a.x0) & (b.x1 <= a.x1) & (b.y0 >= a.y0) & (b.y1 <= a.y1))
    bands = on.select("a.page", F.col("a.id").alias("id"), *[F.col(f"b.{c}").alias(c) for c in P.BOX], F.col("b.fill").alias("text"), F.lit("band").alias("part"))
    ruled = v.tables_.where("NOT borderless").select("page", "id", *P.BOX, F.lit("").alias("text"), F.lit("ruled").alias("part"))
    words = _cell_words(v).select("page", "id", *P.BOX, "text", F.lit("word").alias("part"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {k: g.sort_values(["id", "y0", "x0"]) for k, g in pdf.groupby("part")}
        words = part.get("word")
        if words is None:
            return _grid_rows([])
        stacks = [(P.boxes(g), g["text"].tolist()) for _, g in part["band"].groupby("id")] if "band" in part else []
        ruled = P.boxes(part["ruled"]) if "ruled" in part else np.empty((0, 4))
        return _grid_rows(P.inferred_tables(P.boxes(words), words["text"].tolist(), stacks, ruled))

    return P.by_page(words.unionByName(bands).unionByName(ruled), work, _GRID)


@query("page_unique_names", "WIN-18", r"""
SELECT id, path, CASE WHEN n = 1 THEN path ELSE regexp_replace(path, '(\.[^./]*)$', concat('__', n, '\1')) END AS output FROM (SELECT id, path, row_number() OVER (PARTITION BY lower(path) ORDER BY id) AS n FROM files)""")
def unique_names(v):
    """Output names that differ case apart; none of the inputs looks like a numbered name."""
    return P.deck_names(v.files)


@query("page_plugin_plan", "UDF-01", """
SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY y0, x0, id)::INT AS ord, CASE WHEN row_number() OVER (PARTITION BY page ORDER BY y0, x0, id) = 1 THEN 'title' ELSE 'body' END AS role FROM blocks""")
def plugin_plan(v):
    """A planner plugged in as a function of a page's evidence."""

    def planner(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["y0", "x0", "id"])
        return order[["id"]].assign(ord=np.arange(1, len(order) + 1), role=["title", *["body"] * (len(order) - 1)])

    return P.by_page(v.blocks.select("page", "id", *P.BOX), planner, "id long, ord int, role string").select("page", "id", "ord", "role")


@query("file_conversion", "UDF-05", """
SELECT id, path, CASE WHEN id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN id % 5 <> 0 THEN n_pages END AS pages, CASE WHEN id % 5 = 0 THEN concat('ValueError: cannot open ', path) END AS error FROM files""")
def file_conversion(v):
    """A conversion function run for each file; a failure becomes the file's status and stops no other."""

    def convert(row) -> int:
        if row.id % 5 == 0:
            raise ValueError(f"cannot open {row.path}")
        return row.n_pages

    return converted(v.files, convert)


def converted(files, convert):
    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                try:
                    rows.append((row.id, row.path, "ok", convert(row), None))
                except Exception as e:  # whatever a plugged-in function raises is its row's result
                    rows.append((row.id, row.path, "failed", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "path", "status", "pages", "error"])

    return files.select("id", "path", "n_pages").mapInPandas(run, "id long, path string, status string, pages int, error string")


def _kept_sql(rows: str, meets: str) -> str:
    """SQL of a growing set: rows (page, n from 1, id, box) in order, kept if they meet no row kept before."""
    return f"""WITH RECURSIVE f AS ({rows}), r AS (SELECT page, 0::BIGINT AS n, []::{_FIG} AS kept FROM (SELECT DISTINCT page FROM f) UNION ALL SELECT r.page, f.n, CASE WHEN len(list_filter(r.kept, lambda k: {meets})) = 0 THEN list_append(r.kept, {{'id': f.id, 'x0': f.x0, 'y0': f.y0, 'x1': f.x1, 'y1': f.y1}}) ELSE r.kept END FROM r JOIN f ON f.page = r.page AND f.n = r.n + 1)
SELECT page, k.id FROM (SELECT page, unnest(arg_max(kept, n)) AS k FROM r GROUP BY page)"""


def _kept(rows, order: list[str], up: list[bool], conflict):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=up)
        return pdf.iloc[P.grow_free(P.boxes(pdf), np.empty((0, 4)), conflict)][["id"]]

    return P.by_page(rows, work, "id long").select("page", "id")


_COMMON = "(greatest(0.0, least(f.x1, k.x1) - greatest(f.x0, k.x0)) * greatest(0.0, least(f.y1, k.y1) - greatest(f.y0, k.y0)))"


@query("page_suppressed", "SORT-07", _kept_sql("SELECT page, id, x0, y0, x1, y1, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, id) AS n FROM regions", f"{_COMMON} / ((f.x1 - f.x0) * (f.y1 - f.y0)) >= 0.3"))
def suppressed(v):
    """Regions by confidence, each kept unless one kept before covers 0.3 of it."""
    return _kept(v.regions.select("page", "id", "confidence", *P.BOX), ["confidence", "id"], [False, True], P.heavy_overlap(0.3))


@query("page_growing_bands", "JOIN-17", _kept_sql("SELECT page, id, x0, y0, x1, y1, row_number() OVER (PARTITION BY page ORDER BY id) AS n FROM bands", f"{_COMMON} / ((f.x1 - f.x0) * (f.y1 - f.y0)) >= 0.4 OR {_COMMON} / ((k.x1 - k.x0) * (k.y1 - k.y0)) >= 0.4"))
def growing_bands(v):
    """Bands in order, each kept unless it overlaps one kept before either way."""
    return _kept(v.bands.select("page", "id", *P.BOX), ["id"], [True], P.heavy_overlap(0.4, both=True))


@query("page_greedy_pairs", "JOIN-19", f"""
WITH RECURSIVE p AS (SELECT a.page, a.id AS f, b.id AS w, {S.iou("a", "b")} AS score FROM blocks a JOIN regions b ON a.page = b.page AND {S.iou("a", "b")} >= 0.35), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, f DESC, w DESC) AS n FROM p),
r AS (SELECT page, 0::BIGINT AS n, []::BIGINT[] AS fs, []::BIGINT[] AS ws, false AS ok, 0::BIGINT AS f, 0::BIGINT AS w FROM (SELECT DISTINCT page FROM o) UNION ALL
 SELECT r.page, o.n, CASE WHEN list_contains(r.fs, o.f) OR list_contains(r.ws, o.w) THEN r.fs ELSE list_append(r.fs, o.f) END, CASE WHEN list_contains(r.fs, o.f) OR list_contains(r.ws, o.w) THEN r.ws ELSE list_append(r.ws, o.w) END, NOT (list_contains(r.fs, o.f) OR list_contains(r.ws, o.w)), o.f, o.w FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1)
SELECT page, f AS found, w AS wanted FROM r WHERE ok""")
def greedy_pairs(v):
    """Blocks and regions paired one to one, best overlap first."""

    def work(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found, wanted = found.sort_values("id"), wanted.sort_values("id")
        pairs = P.greedy_pairs(P.ious(P.boxes(found), P.boxes(wanted)), 0.35)
        a, b = found["id"].to_numpy(), wanted["id"].to_numpy()
        return pd.DataFrame([(a[i], b[j]) for i, j in pairs], columns=["found", "wanted"])

    return P.by_page_pair(v.blocks.select("page", "id", *P.BOX), v.regions.select("page", "id", *P.BOX), work, "found long, wanted long")
