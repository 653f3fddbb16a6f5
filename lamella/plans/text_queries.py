"""Queries over string expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.functions import text as T
from lamella.functions.geometry import box
from lamella.sources.views import PAGE_H, PAGE_W

from .registry import query

_CJK = r"\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}"
_SP = r"[\s\x{00a0}\x{3000}]"
_BUL = r"^\s*([•◦▪‣·*-]|[0-9]{1,3}[.)]|[A-Za-z][.)]|\([A-Za-z0-9]{1,3}\)|[ivxIVX]{1,5}[.)])\s+"
_BARE = f"regexp_replace(text, '{_SP}', '', 'g')"


def _n(cls, of=_BARE):
    return f"length(regexp_replace({of}, '[^{cls}]', '', 'g'))"


_SCRIPT = f"CASE WHEN {_n(_CJK)} = 0 AND {_n('A-Za-z')} = 0 AND {_n('0-9')} = 0 THEN 'other' WHEN {_n(_CJK)} * 10 >= length({_BARE}) * 8 THEN 'cjk' WHEN {_n('A-Za-z')} * 10 >= length({_BARE}) * 8 THEN 'latin' WHEN {_n('0-9')} * 10 >= length({_BARE}) * 8 THEN 'numeric' ELSE 'mixed' END"


@query("text_tokens", "STR-01", r"""
SELECT doc_id, len(t)::INT AS n_tokens, t[1] AS first_token, t[len(t)] AS last_token FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '([\p{L}\p{N}_\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}]+)', 1), lambda x: lower(x)) AS t FROM documents WHERE doc_id IS NOT NULL)""")
def text_tokens(v):
    t = v.documents.select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.try_element_at("t", F.lit(1)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token"))


@query("text_scripts", "STR-02 STR-03 STR-21 STR-20", f"""
SELECT page, id, {_SCRIPT} AS script, regexp_matches(text, '[{_CJK}]') AS has_cjk, CASE WHEN regexp_matches(text, '[{_CJK}]') THEN 'cjk' ELSE 'latin' END AS font_script,
 ({_SCRIPT}) = 'latin' AND length(trim(text)) BETWEEN 6 AND 16 AND x1 - x0 <= 100 AND y1 - y0 <= 16 AS tiny_footer FROM blocks""")
def text_scripts(v):
    t, b = F.col("text"), box()
    return v.blocks.select("page", "id", T.script_of(t).alias("script"), T.has_cjk(t).alias("has_cjk"), T.font_script(t).alias("font_script"), T.tiny_footer(t, b.w, b.h).alias("tiny_footer"))


@query("text_list_marks", "STR-04 STR-05 STR-26", rf"""
WITH m AS (SELECT *, regexp_extract(text, '{_BUL}', 1) AS mark, trim(regexp_replace(text, '{_BUL}', '')) AS rest FROM blocks)
SELECT page, id, regexp_matches(text, '{_BUL}') AS is_list, CASE WHEN rest = '' THEN trim(text) ELSE rest END AS bare,
 CASE WHEN mark = '' THEN NULL WHEN regexp_matches(mark, '^[0-9]+[.)]$') THEN 'arabicPeriod' WHEN regexp_matches(mark, '^[A-Z][.)]$') THEN 'alphaUcPeriod' WHEN regexp_matches(mark, '^[a-z][.)]$') THEN 'alphaLcPeriod' ELSE 'bullet' END AS style,
 greatest(0, least(8, floor((x0 - 50.0) / 18)))::INT AS level, greatest(1, coalesce(CASE WHEN id % 7 = 0 THEN 2 END, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))))::INT AS n_lines FROM m""")
def text_list_marks(v):
    t = F.col("text")
    return v.blocks.select("page", "id", T.is_list_line(t).alias("is_list"), T.without_mark(t).alias("bare"), T.list_style(t).alias("style"), T.list_level(F.col("x0"), F.lit(50.0)).alias("level"), T.source_lines(t, F.when(F.col("id") % 7 == 0, 2)).alias("n_lines"))


_EDGE = r"regexp_matches(right(a, 1), '^[\p{L}\p{N}]$') AND regexp_matches(left(b, 1), '^[\p{L}\p{N}]$') AND NOT regexp_matches(right(a, 1), '[" + _CJK + r"]') AND NOT regexp_matches(left(b, 1), '[" + _CJK + "]')"


@query("text_join_pieces", "STR-06 STR-07", f"""
WITH p AS (SELECT page, id, text AS a, lead(text, 1, '') OVER (PARTITION BY page ORDER BY id) AS b FROM blocks)
SELECT page, id, {_EDGE} AS needs_space, CASE WHEN trim(a) = '' THEN CASE WHEN trim(b) = '' THEN '' ELSE b END WHEN trim(b) = '' THEN a ELSE concat(a, CASE WHEN {_EDGE} THEN ' ' ELSE '' END, b) END AS joined FROM p""")
def text_join_pieces(v):
    from pyspark.sql.window import Window

    w = Window.partitionBy("page").orderBy("id")
    p = v.blocks.select("page", "id", F.col("text").alias("a"), F.lead("text", 1, "").over(w).alias("b"))
    return p.select("page", "id", T.needs_space(F.col("a"), F.col("b")).alias("needs_space"), T.join_pieces(F.array("a", "b")).alias("joined"))




def _form(of):
    return f"lower(regexp_replace({of}, '{_SP}', '', 'g'))"


@query("text_matching", "STR-08 STR-09 STR-10", f"""
WITH p AS (SELECT page, id, text, coalesce(lag(text) OVER (PARTITION BY page ORDER BY id), '') AS other FROM blocks), m AS (SELECT *, {_form("text")} AS a, {_form("other")} AS b FROM p)
SELECT page, id, a AS match_form, regexp_replace(text, '{_SP}', '', 'g') AS bare, CASE WHEN a = b THEN 1.0::DOUBLE WHEN contains(b, a) OR contains(a, b) THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS score FROM m""")
def text_matching(v):
    from pyspark.sql.window import Window

    w = Window.partitionBy("page").orderBy("id")
    p = v.blocks.select("page", "id", "text", F.coalesce(F.lag("text").over(w), F.lit("")).alias("other"))
    return p.select("page", "id", T.match_form(F.col("text")).alias("match_form"), T.without_space(F.col("text")).alias("bare"), T.match_score(F.col("text"), F.col("other")).alias("score"))


@query("text_labels_fonts", "STR-11 STR-15 STR-22 STR-28 STR-29 STR-23", f"""
WITH r AS (SELECT *, CASE id % 5 WHEN 0 THEN ' Doc-Title' WHEN 1 THEN 'plain text' WHEN 2 THEN 'TABLE' WHEN 3 THEN 'Page_Header ' ELSE 'weird' END AS raw, CASE id % 4 WHEN 0 THEN 'sans' WHEN 1 THEN 'serif' WHEN 2 THEN 'mono' ELSE 'odd' END AS cls,
 CASE id % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'zh_tw' WHEN 2 THEN 'ja' WHEN 3 THEN 'fr' ELSE 'de' END AS lang FROM blocks)
SELECT page, id, CASE id % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'table' WHEN 3 THEN 'header' ELSE 'other' END AS label,
 CASE WHEN id % 4 = 1 THEN 'Courier New' WHEN id % 4 = 0 THEN 'Arial' WHEN id % 4 = 2 THEN 'Times New Roman' END AS office_font, font IS NOT NULL AS known,
 coalesce(font, CASE WHEN cls = 'odd' THEN NULL WHEN regexp_matches(text, '[{_CJK}]') THEN CASE cls WHEN 'sans' THEN 'Heiti' WHEN 'serif' THEN 'Noto Serif' ELSE 'Noto Mono' END ELSE CASE cls WHEN 'sans' THEN 'Arial' WHEN 'serif' THEN 'Times New Roman' ELSE 'Courier New' END END) AS resolved,
 CASE lang WHEN 'en' THEN 'rec_en' WHEN 'zh_tw' THEN 'rec_cjk' WHEN 'ja' THEN 'rec_cjk' ELSE 'rec_latin' END AS recogniser FROM r""")
def text_labels_fonts(v):
    i = F.col("id")
    raw = F.when(i % 5 == 0, " Doc-Title").when(i % 5 == 1, "plain text").when(i % 5 == 2, "TABLE").when(i % 5 == 3, "Page_Header ").otherwise("weird")
    cls = F.when(i % 4 == 0, "sans").when(i % 4 == 1, "serif").when(i % 4 == 2, "mono").otherwise("odd")
    lang = F.when(i % 6 == 0, "en").when(i % 6 == 1, "zh_tw").when(i % 6 == 2, "ja").when(i % 6 == 3, "fr").otherwise("de")
    models = v.spark.createDataFrame([("en", "rec_en"), ("zh_tw", "rec_cjk"), ("ja", "rec_cjk"), ("fr", "rec_latin"), ("de", "rec_latin")], "lang string, recogniser string")
    rows = v.blocks.withColumn("raw", raw).withColumn("cls", cls).withColumn("lang", lang).join(F.broadcast(models), "lang", "left")
    return rows.select("page", "id", T.layout_label(F.col("raw")).alias("label"), T.office_font(F.col("font")).alias("office_font"), T.known_font(F.col("font")).alias("known"), T.resolved_font(F.col("cls"), F.col("text"), F.col("font"), {"sans": {"cjk": "Heiti"}}).alias("resolved"), "recogniser")


@query("text_colours", "STR-12 STR-13 STR-14 STR-27", """
SELECT page, id, printf('#%06X', (id * 977) & 16777215) AS from_int, printf('#%02X%02X%02X', round(least(1.0, x0 / 800.0) * 255)::INT, round(confidence * 255)::INT, 255) AS from_floats,
 CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'solid' WHEN 2 THEN 'solid' ELSE 'dash' END AS dash, id % 3 = 0 AS white FROM blocks""")
def text_colours(v):
    i = F.col("id")
    dashes = F.when(i % 4 == 0, None).when(i % 4 == 1, "").when(i % 4 == 2, "[] 0").otherwise("[3 2] 0")
    colour = F.when(i % 3 == 0, "#F5FFf6").when(i % 3 == 1, "#F4FFFF").otherwise("white")
    return v.blocks.select("page", "id", T.hex_colour(i * 977).alias("from_int"), T.hex_of_floats(F.col("x0") / 800.0, F.col("confidence"), F.lit(1.7)).alias("from_floats"), T.dash_style(dashes).alias("dash"), T.near_white(colour).alias("white"))


@query("text_predicates", "STR-16 STR-19 STR-24 STR-25 FLT-02", """
SELECT page, id, contains(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), 'view') AND x0 >= 0.72::DOUBLE * 960 AND y0 >= 0.9::DOUBLE * 540 AND x1 - x0 <= 192 AND y1 - y0 <= 0.06::DOUBLE * 540 AS corner_mark,
 id % 5 < 2 AS bracketed, id % 6 > 3 AS safe, contains(lower(text), 'error') OR contains(lower(text), 'signup') AS expected FROM blocks""")
def text_predicates(v):
    i, t = F.col("id"), F.col("text")
    label = F.when(i % 5 == 0, "(note)").when(i % 5 == 1, "【標註】").when(i % 5 == 2, "(note]").when(i % 5 == 3, "()").otherwise("plain")
    name = F.when(i % 6 == 0, "/etc/x").when(i % 6 == 1, "a/../b").when(i % 6 == 2, "C:/x").when(i % 6 == 3, "\\x").when(i % 6 == 4, "a/b..c").otherwise("ppt/slide1.xml")
    return v.blocks.select("page", "id", T.corner_mark(t, box(), PAGE_W, PAGE_H, ["view"]).alias("corner_mark"), T.bracketed(label).alias("bracketed"), T.safe_member(name).alias("safe"), T.contains_any(t, ["error", "signup"]).alias("expected"))


@query("text_short_columns", "STR-17", r"""
SELECT page, table_id, col, avg(CASE WHEN (length(trim(text)) <= 12 AND len(regexp_split_to_array(trim(text), ' +')) <= 2) OR regexp_matches(trim(text), '^[-+]?[$€]?[0-9][0-9.,]*%?$') THEN 1.0 ELSE 0.0 END) >= 0.55 AS short FROM cells WHERE trim(text) <> '' GROUP BY ALL""")
def text_short_columns(v):
    cells = v.cells.where("trim(text) <> ''")
    return cells.groupBy("page", "table_id", "col").agg((F.avg(T.short_or_numeric(F.col("text")).cast("double")) >= 0.55).alias("short"))


@query("text_evidence", "STR-18 SORT-10", """
SELECT page, id, n, CASE WHEN length(text) > 12 THEN concat(left(text, 11), '…') ELSE text END AS short FROM (SELECT *, (row_number() OVER (PARTITION BY page ORDER BY id))::INT AS n FROM blocks) WHERE n <= 20""")
def text_evidence(v):
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("page").orderBy("id"))
    return v.blocks.withColumn("n", n).where("n <= 20").select("page", "id", "n", T.shortened(F.col("text"), 12).alias("short"))
